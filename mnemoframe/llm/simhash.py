"""Near duplicates by SimHash fingerprints and pigeonhole blocks.

Each text gives one fingerprint: a bit is 1 if it is set in over half of the hashes of its word shingles. Fingerprints
are cut into BLOCKS blocks; of two that differ in DISTANCE bits at most as many blocks differ, so they agree on SHARE blocks.
Every choice of SHARE blocks is a join key. Equal
fingerprints are folded into one node before any join; candidate pairs of a key are verified by their distance, and
linked nodes are joined into components.

A key that more than CROWDED fingerprints share is not joined pair by pair: its fingerprints are spread to their 64
neighbours at one bit. Two differ in at most two bits exactly if they meet in a common neighbour, where at most 65 can
meet. All links are found, in linear work.

Null texts count as empty; texts without words have fingerprint zero and are linked like any other. Null ids form
links too but are never a component's id unless it has no other. Extra columns stay.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .components import connected

SEED = 42
CROWDED = 64
DISTANCE, BLOCKS, SHARE = 2, 5, 3
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each run of `width` words; of the whole sequence where it is shorter; nothing without words."""
    words = text.encode("utf-8", "replace").translate(LOWER).split()
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)] if words else [], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(start, end[width - 1:].tolist())), np.uint64, len(start))


def bit_counts(x: np.ndarray) -> np.ndarray:
    """How many of the numbers have each of the 64 bits: eight bytes are summed at once, 255 numbers at a time."""
    padded = np.zeros(-(-len(x) // 255) * 255, np.uint64)
    padded[: len(x)] = x
    counts = np.empty(64, np.int64)
    for s in range(8):
        sums = ((padded >> np.uint64(s)) & LANES).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        counts[s::8] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: str, width: int) -> int:
    hashes = shingle_hashes(text, width)
    bits = bit_counts(hashes) * 2 > len(hashes) if len(hashes) else np.zeros(64, bool)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprinted(docs: DataFrame, width: int = 3, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with a column of 64 bits as a long."""
    def batch(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py() or "", width) for t in texts], pa.int64())

    return docs.withColumn(name, F.arrow_udf(batch, "bigint")(text_of(text)))


def block_keys(node: str) -> Column:
    """The keys of a fingerprint: the bits of each choice of SHARE blocks, with the place of the choice in the top bits."""
    cuts = np.linspace(0, 64, BLOCKS + 1).round().astype(int)
    masks = [sum(((1 << int(cuts[b + 1])) - (1 << int(cuts[b])) for b in chosen)) for chosen in combinations(range(BLOCKS), SHARE)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(k).alias("choice"), F.col(node).bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(signed)])


def links(nodes: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b) pairs of the distinct fingerprints of a column `node` that differ in at most DISTANCE bits: enough of them to connect
    what belongs together."""
    keyed = nodes.select("node", F.explode(block_keys("node")).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keyed.join(shared, "key"), "blocks")
    few, many = members.where(F.col("n") <= crowded), members.where(F.col("n") > crowded)
    x, y = few.select("key", F.col("node").alias("a")), few.select("key", F.col("node").alias("b"))
    near = x.join(y, (x.key == y.key) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
    flips = F.array(*[F.lit(int(np.uint64(1 << i).astype(np.int64))) for i in range(64)], F.lit(0).cast("long"))
    around = F.transform(flips, lambda bit: F.col("node").bitwiseXOR(bit))
    meet = many.select("node").distinct().select("node", F.explode(around).alias("at")).groupBy("at").agg(F.collect_list("node").alias("all")).where(F.size("all") > 1)
    return near.unionAll(meet.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where("a <> b"))


def grouped(docs: DataFrame, width: int = 3, crowded: int = CROWDED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, fingerprint, component_id) of every row; row is a hash of all columns, to find the row again.

    component_id is the smallest id reachable over links of at most DISTANCE bits, a row's own included.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    prints = written(fingerprinted(docs.select(F.col(doc_id).alias("id"), row.alias("row"), F.col(text).alias("text")), width)
                     .select("id", "row", "fingerprint", F.col("fingerprint").alias("node")), "prints")
    nodes = prints.groupBy("node").agg(F.min("id").alias("least"))
    return named_groups(prints, nodes, connected(links(nodes.select("node"), crowded)))


def named_groups(prints: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, row, fingerprint, component_id) of prints, by the smallest id (least) of the nodes of one root."""
    named = nodes.join(roots, "node", "left").select("node", "least", "root")
    linked = named.where("root is not null")
    best = linked.groupBy("root").agg(F.min("least").alias("best"))
    ids = linked.join(best, "root").select("node", "best").unionAll(named.where("root is null").select("node", F.col("least").alias("best")))
    return prints.join(ids, "node").select("id", "row", "fingerprint", F.col("best").alias("component_id"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """One row of each group: the smallest id, ties by the hash of the row, identical rows once; columns as given."""
    return one_of_each(docs, grouped(docs, doc_id=doc_id, **how), doc_id)


def one_of_each(docs: DataFrame, rows: DataFrame, doc_id: str) -> DataFrame:
    """The representatives of docs by rows, as grouped() makes them."""
    # groups are named by their smallest id; where all ids of a group are null, each fingerprint is a group of its own
    group = F.when(F.col("component_id").isNull(), F.xxhash64("fingerprint"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    best = rows.groupBy("component_id", group.alias("alone")).agg(F.min(order).alias("best"))
    copies = rows.groupBy("id", "row").agg(F.count("*").alias("n"))
    twins = copies.select(F.col("id").alias("_i"), F.col("row").alias("_r"), F.col("n").alias("_n"))
    chosen = best.select("best.id", "best.row").join(twins, F.col("id").eqNullSafe(F.col("_i")) & (F.col("row") == F.col("_r"))).select("_i", "_r", "_n")
    named = docs.withColumn("_row", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    kept = named.join(chosen, named[doc_id].eqNullSafe(chosen["_i"]) & (F.col("_row") == F.col("_r")))
    return kept.where("_n = 1").select(*docs.columns).unionAll(kept.where("_n > 1").select(*docs.columns).dropDuplicates())
