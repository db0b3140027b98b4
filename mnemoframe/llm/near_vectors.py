"""Near-duplicate vectors by counting collisions of one-dimensional projections.

For unit vectors a cosine of at least `least` is a distance of at most d; a random projection of such a pair differs by
a normal variable of deviation d, that of an unrelated pair by one of about sqrt(2). A window around the query on one
sorted projection tells the two apart only weakly, and all windows of all projections together hold a fixed share of
all pairs. So the sorted projections are nested: a table takes several projections with coarse windows as a cell and
sorts the rows of a cell by one more; a query meets the rows in its window there. The number of coarse projections
grows with the logarithm of the rows, so that a cell holds about OCCUPANCY unrelated rows at every size, and the number
of tables follows from it and RECALL, for pairs right at the threshold; closer ones are found more surely.
For each pair that meets, the collisions on COUNTED projections are counted; pairs whose count reaches the one that a
pair at the threshold reaches with probability COUNT_RECALL are verified by their cosine in double precision.

Equal vectors are folded into one node before. A pair is handled in the first table in which both share a cell and
a window, so nothing has to be made distinct and no pair is shuffled: tasks send sums of links per node, and a spanning forest of
their links. Cells of more than CROWDED rows are cut into chunks, and each pair of chunks is a group of its own.

Null, zero and empty vectors, those with null or non-finite components, and rows with a null id link with nothing.
Vectors of different length are never linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected

WIDTH = 2.0
OCCUPANCY = 16
RECALL = 0.95
COUNTED = 48
COUNT_RECALL = 0.995
CROWDED = 1024
SEED = 20


def normal(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def same_cell(width: float, distance: float) -> float:
    """Chance that two points at `distance` fall into one cell of a randomly shifted grid on a random projection."""
    c = width / distance
    return 1 - 2 * normal(-c) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


class Plan:
    """Projections per table, number of tables, window and least count for a threshold and a number of rows."""

    def __init__(self, least: float, rows: int):
        self.distance = math.sqrt(2 * (1 - least))
        near, far = same_cell(WIDTH, self.distance), same_cell(WIDTH, math.sqrt(2))
        self.coarse = max(2, math.ceil(math.log(max(rows, 2) / OCCUPANCY) / -math.log(far)))
        met = near ** self.coarse * (2 * normal(2.6) - 1)
        self.tables = max(4, math.ceil(math.log(1 - RECALL) / math.log(1 - met)))
        self.window = 1.7 * self.distance  # of the counted projections
        self.fine = 2.6 * self.distance  # of the sorted one
        p, below, self.count = 2 * normal(1.7) - 1, 0.0, 0
        for c in range(COUNTED + 1):
            below += math.comb(COUNTED, c) * p ** c * (1 - p) ** (COUNTED - c)
            if below > 1 - COUNT_RECALL:
                self.count = c
                break

    @lru_cache(maxsize=8)  # noqa: B019
    def directions(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Gaussian directions: coarse ones of all tables, one sorted per table, the counted ones; and the shifts."""
        draw = np.random.default_rng([SEED, size])
        n = self.tables * (self.coarse + 1) + COUNTED
        return draw.standard_normal((size, n)), draw.random(self.tables * self.coarse) * WIDTH

    def placed(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each row in each table, its place on the table's sorted projection, and its counted projections."""
        directions, shifts = self.directions(unit.shape[1])
        p = unit @ directions
        n = self.tables * self.coarse
        steps = np.floor((p[:, :n] + shifts) / WIDTH).astype(np.int64).reshape(len(unit), self.tables, self.coarse).astype(np.uint64)
        cells = np.broadcast_to(np.arange(self.tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(unit.shape[1]), (len(unit), self.tables)).copy()
        for j in range(self.coarse):
            cells = (cells ^ steps[:, :, j]) * np.uint64(0xBF58476D1CE4E5B9)
            cells ^= cells >> np.uint64(29)
        return cells.view(np.int64), p[:, n:n + self.tables], p[:, n + self.tables:].astype(np.float32)


def units(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) for each vector length."""
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))
    sizes = np.diff(ends, prepend=0)
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        x = flat[(ends[rows] - size)[:, None] + np.arange(size)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out.append((rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))))
    return out


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def folded(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Rows (id, h1, h2) with the two hashes that stand for the vector; null where it links with nothing."""
    ok = usable(F.col(embedding)) & F.col(vec_id).isNotNull()
    return vectors.select(F.col(vec_id).cast("long").alias("id"), *[F.when(ok, F.xxhash64(embedding, F.lit(s))).alias(h) for h, s in (("h1", 1), ("h2", 2))], F.when(ok, F.col(embedding)).alias("vector"))


def in_cells(nodes: DataFrame, plan: Plan, with_vectors: bool) -> DataFrame:
    """(cell, node) for each table, with copies and vector if wanted."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit in units(batch.column("vector")):
                for start in range(0, len(at), 1024):
                    part = at[start:start + 1024]
                    cells, _, _ = plan.placed(unit[start:start + 1024])
                    own = batch.take(pa.array(np.repeat(part, plan.tables)))
                    columns = [pa.array(cells.ravel()), own.column("node")] + ([own.column("copies"), own.column("vector")] if with_vectors else [])
                    yield pa.record_batch(columns, names=["cell", "node", "copies", "vector"][: len(columns)])

    kind = dict(nodes.dtypes)["vector"]
    return nodes.select("node", "copies", "vector").mapInArrow(rows, "cell long, node long" + (f", copies long, vector {kind}" if with_vectors else ""))


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest row reachable from each of n rows over links a-b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def linked(batch: pa.RecordBatch, plan: Plan, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of whole groups (cell, chunk pair) that are linked and whose first table to meet in this is."""
    found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    cell, low, high, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "low", "high", "side"))
    node = batch.column("node").to_numpy()
    for rows, unit in units(batch.column("vector")):
        cells, fine, counted = plan.placed(unit)
        mine = cell[rows]
        table = (cells == mine[:, None]).argmax(axis=1)
        line = fine[np.arange(len(rows)), table]
        order = np.lexsort((line, high[rows], low[rows], mine))
        group = np.concatenate(([0], np.cumsum((np.diff(mine[order]) != 0) | (np.diff(low[rows][order]) != 0) | (np.diff(high[rows][order]) != 0))))
        line = line[order]
        for shift in range(1, len(order)):
            near = (group[shift:] == group[:-shift]) & (line[shift:] - line[:-shift] <= plan.fine)
            at = np.flatnonzero(near)
            if not len(at):  # rows of a group are sorted by the line: a wider shift meets nothing either
                break
            for start in range(0, len(at), 4096):
                a, b = order[at[start:start + 4096]], order[at[start:start + 4096] + shift]
                if (low[rows[a]] != high[rows[a]]).any():  # two chunks: pairs across only
                    across = (low[rows[a]] == high[rows[a]]) | (side[rows[a]] != side[rows[b]])
                    a, b = a[across], b[across]
                passing = (np.abs(counted[a] - counted[b]) <= plan.window).sum(axis=1) >= plan.count
                a, b = a[passing], b[passing]
                close = (unit[a] * unit[b]).sum(axis=1) >= least
                a, b = a[close], b[close]
                # a table whose sorted projection parts the pair is no try for it
                first = ((cells[a] == cells[b]) & (np.abs(fine[a] - fine[b]) <= plan.fine)).argmax(axis=1) == table[a]
                a, b = a[first], b[first]
                keep = node[rows[a]] != node[rows[b]]
                found[0].append(rows[a[keep]])
                found[1].append(rows[b[keep]])
    return np.concatenate(found[0]), np.concatenate(found[1])


def partial_links(groups: DataFrame, plan: Plan, least: float) -> DataFrame:
    """(node, links, root): per task, how many vectors a node is linked with, and an edge to its forest's root.

    groups is partitioned and sorted by group; a batch's unfinished last group waits for the next batch.
    """
    keys = ("cell", "low", "high")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            batch = pa.concat_batches(parts)
            a, b = linked(batch, plan, least)
            node, copies = batch.column("node").to_numpy(), batch.column("copies").to_numpy()
            names, at = np.unique(node, return_inverse=True)
            links = np.bincount(at[a], copies[b], len(names)) + np.bincount(at[b], copies[a], len(names)) if len(a) else np.zeros(len(names))
            root = names[roots(at[a], at[b], len(names))]
            some = links > 0
            return pa.record_batch([pa.array(names[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=["node", "links", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
            changes = np.flatnonzero(np.any([np.diff(x) != 0 for x in k], axis=0)) + 1
            if held and any(held[-1].column(c)[held[-1].num_rows - 1].as_py() != batch.column(c)[0].as_py() for c in keys):
                yield done(held)
                held = []
            if len(changes):
                yield done([*held, batch.slice(0, changes[-1])])
                held = []
                batch = batch.slice(changes[-1])
            held.append(batch)
        if held:
            yield done(held)

    return groups.mapInArrow(rows, "node long, links long, root long")


def neighbours(vectors: DataFrame, least: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", crowded: int = CROWDED) -> DataFrame:
    """(id, n_links, component_id): one row per row; component_id is the smallest id reachable, own included."""
    rows = folded(vectors, vec_id, embedding)
    nodes = written(rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "vectors")
    plan = Plan(least, nodes.count())
    hot = in_cells(nodes, plan, False).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select(F.col("cell").alias("c"), F.ceil(F.col("n") / crowded).cast("int").alias("chunks"))
    placed = in_cells(nodes, plan, True)
    chunked = placed.join(hot, F.col("cell") == F.col("c"), "left").drop("c").withColumn("side", F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")))
    others = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    groups = chunked.withColumn("other", F.explode(others)).select("cell", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "node", "copies", "vector")
    partial = written(partial_links(groups.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high", "node"), plan, least), "links")
    links = partial.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("h1", "h2", "node", "copies").join(links, "node", "left").join(connected(partial.select("node", "root")), "node", "left")
    named = named.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    alone = rows.where("h1 is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return rows.where("h1 is not null").select("id", "h1", "h2").join(named, ["h1", "h2"]).select("id", "n_links", "component_id").unionAll(alone)
