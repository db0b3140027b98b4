"""Near duplicates by SimHash fingerprints and by the exact Jaccard index of word shingles.

Two texts belong together if their fingerprints, those of simhash.py, differ in at most two bits, or if the index of their sets of
shingles is high enough. Links of both kinds are joined into components at once, so that no link is lost over a row that only
one kind finds. Fingerprints that close are near an index of 1, or of texts in which repeats of one passage prevail;
the index reaches further down.

Links of fingerprints are found by simhash.links, exactly. For the index, candidates come from MinHash bands: a pair at the index j shares one of BANDS keys with probability
1 - (1 - j ** ROWS) ** BANDS, which is 0.9993 at 0.8 and does not depend on the number of texts. Keys are 64-bit hashes
of ROWS minima, so unrelated texts do not meet by chance however many there are. Texts with equal sets of shingles
are folded into one node before.

Nodes that share keys, directly or over others, form a coarse group, which holds every pair that shares a key. Inside
it pairs are compared in tasks by their whole sets; no pair is shuffled, tasks send a forest of the links. First each
chunk of CHUNK nodes is compared within itself and with chunk 0, in linear work; that settles groups of one or two
chunks, and dense groups, which are then linked throughout. In groups that are still in parts all pairs of chunks of
WIDE nodes are compared: that work grows with the group's square.

Null texts count as empty; all empty texts are one node, which links with nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .components import connected
from .simhash import fingerprint, links as print_links, named_groups, one_of_each, shingle_hashes

ROWS = 6
BANDS = 24
CHUNK = 32
WIDE = 512
PRINTED = 3  # words of a shingle of the fingerprints
# the least product of the hashes with an odd number is one minimum
ODD = np.random.default_rng(5).integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of hashes; none of an empty one."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(len(ODD), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 256):
        np.minimum(least, np.multiply.outer(ODD, hashes[start:start + 256]).min(axis=1), out=least)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(least[b * ROWS:(b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def sketched(docs: DataFrame, width: int, text: str) -> DataFrame:
    """docs with node, a hash of the set of shingles, keys, and print, the fingerprint."""
    kind = pa.struct([("node", pa.int64()), ("keys", pa.list_(pa.int64())), ("print", pa.int64())])

    def batch(texts: pa.Array) -> pa.Array:
        nodes, keys, prints = np.empty(len(texts), np.uint64), [], []
        for i, t in enumerate(texts):
            own = t.as_py() or ""
            hashes = np.unique(shingle_hashes(own, width))
            nodes[i] = xxhash.xxh64_intdigest(hashes.tobytes())
            keys.append(band_keys(hashes))
            prints.append(fingerprint(own, PRINTED))
        return pa.StructArray.from_arrays([pa.array(nodes.view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(prints, pa.int64())], fields=list(kind))

    found = docs.withColumn("_found", F.arrow_udf(batch, "node bigint, keys array<bigint>, print bigint")(text_of(text)))
    return found.withColumns({"node": F.col("_found.node"), "keys": F.col("_found.keys"), "print": F.col("_found.print")}).drop("_found")


def alike(prints: DataFrame) -> DataFrame:
    """(a, b) node pairs that connect the nodes of each component of fingerprints. prints: (node, print)."""
    own = prints.select("node", "print").distinct()
    roots = connected(print_links(own.select(F.col("print").alias("node")).distinct()))
    named = written(own.join(roots.withColumnRenamed("node", "print"), "print", "left").select("node", F.coalesce("root", "print").alias("root")).distinct(), "alike")
    several = named.groupBy("root").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead <> last").drop("last")
    return named.join(several, "root").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))


def forest(sets: list[np.ndarray], tenths: int) -> list[tuple[int, int]]:
    """Links that connect what belongs together: a node is compared with all that are not reached yet."""
    size = np.array([len(s) for s in sets])
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    marked, free, links, line = np.zeros(len(words), np.int64), np.arange(len(sets)), [], []
    while len(free):
        if line:
            own = line.pop()
        else:
            own, free = int(free[0]), free[1:]
        at = free[(10 * size[free] >= tenths * size[own]) & (10 * size[own] >= tenths * size[free])]
        if not len(at):
            continue
        mine = flat[ends[own] - size[own]:ends[own]]
        marked[mine] = 1
        both = np.array([marked[flat[ends[k] - size[k]:ends[k]]].sum() for k in at])
        marked[mine] = 0
        near = at[10 * both >= tenths * (size[own] + size[at] - both)]
        links += [(own, int(k)) for k in near]
        line += near.tolist()
        free = np.setdiff1d(free, near, assume_unique=True)
    return links


def compared(groups: DataFrame, width: int, tenths: int) -> DataFrame:
    """(a, b) links of whole groups (root, low, high); an unfinished group waits for the next batch."""
    keys = ("root", "low", "high")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}

        def done() -> pa.RecordBatch:
            nodes = list(held)
            links = forest(list(held.values()), tenths) if len(held) > 1 else []
            return pa.record_batch([pa.array([nodes[i] for i, _ in links], pa.int64()), pa.array([nodes[j] for _, j in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            for *key, node, text in zip(*[batch.column(c).to_pylist() for c in (*keys, "node", "text")]):
                if key != group:
                    if len(held) > 1:
                        yield done()
                    group, held = key, {}
                if node not in held:
                    held[node] = np.unique(shingle_hashes(text or "", width))
        if len(held) > 1:
            yield done()

    own = groups.select(*keys, "node", "text").repartition(*keys).sortWithinPartitions(*keys)
    return own.mapInArrow(rows, "a long, b long")


def links(nodes: DataFrame, texts: DataFrame, width: int, tenths: int, chunk: int = CHUNK, wide: int = WIDE) -> DataFrame:
    """(a, b) node pairs that connect what belongs together. nodes: (node, row, keys); texts: (row, text)."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    coarse = written(connected(keyed.join(shared, "key").where("node <> lead").select("node", "lead")), "coarse")
    sizes = coarse.groupBy("root").agg(F.count("*").alias("n"))
    members = written(coarse.join(sizes, "root").join(nodes.select("node", "row"), "node").join(texts, "row").select("root", "n", "node", "text"), "members")

    def side(size: int):
        return F.ceil(F.col("n") / size).cast("int"), F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / size)).cast("int")

    chunks, own = side(chunk)
    first = members.withColumn("low", F.lit(0)).withColumn("high", F.explode(F.when(own == 0, F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(own))))
    found = written(compared(first, width, tenths), "links")
    many = coarse.join(sizes.where(chunks > 2), "root").select(F.col("root").alias("whole"), "node")
    part = F.coalesce("root", "node")
    split = written(many.join(connected(found), "node", "left").groupBy("whole").agg(F.min(part).alias("x"), F.max(part).alias("y")).where("x <> y").select(F.col("whole").alias("root")), "split")
    if split.isEmpty():
        return found
    chunks, own = side(wide)
    rest = members.join(split, "root").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    rest = rest.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    return found.unionAll(written(compared(rest, width, tenths), "links"))


def grouped(docs: DataFrame, width: int = 5, tenths: int = 8, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, wide: int = WIDE) -> DataFrame:
    """(id, row, fingerprint, component_id) of every row, as simhash.grouped.

    component_id is the smallest id reachable over links of fingerprints or of a Jaccard index of at least tenths / 10, a row's own
    included.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    prints = written(sketched(rows, width, "text").select("id", "row", "node", "keys", "print"), "prints")
    nodes = prints.groupBy("node").agg(F.min("id").alias("least"), F.min("row").alias("row"), F.first("keys").alias("keys"))
    near = links(nodes, rows.select("row", "text"), width, tenths, chunk, wide)
    roots = connected(near.unionAll(alike(prints)))
    return named_groups(prints.select("id", "row", F.array("node").alias("fingerprint"), "node"), nodes, roots)


def representatives(docs: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """One row of each group: the smallest id, ties by the hash of the row, identical rows once; columns as given."""
    return one_of_each(docs, grouped(docs, doc_id=doc_id, **how), doc_id)
