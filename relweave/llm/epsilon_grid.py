"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine >= t lie within epsilon = sqrt(2 - 2 t). Vectors are rotated onto their principal axes (second
moments over all vectors) and sorted by grid cells of side epsilon on the leading axes. The order is cut into blocks of
a fixed number of rows, where it can between cells; a large cell has several. Pairs of blocks whose boxes are further apart
than epsilon are skipped, the others are units of work. A unit joins two intervals recursively: halves whose boxes are
too far apart are skipped, small ones are compared by a matrix product in double precision. Skipping only uses lower
bounds of distances, so no link is lost. Where vectors point in all directions alike, boxes of no size are that far apart
and nearly all pairs of blocks are compared.

Copies: bit-equal vectors are one class and are joined once. A unit returns a link count and a root for each vector, not
pairs, so a large group of near-copies stays linear in what is sent.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different lengths do not link, each length is joined on its own; a null key takes no part (no links, null component, not
kept); rows that repeat a key are counted each and share a component; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from relweave.llm.components import connected_components
from relweave.runtime import materialize, shuffle_partitions

#: Vectors of a block, and their components in all (long vectors make blocks of fewer rows): what bounds a unit's memory.
BLOCK_ROWS = 8192
BLOCK_NUMBERS = 1 << 22
GRID_DIMS = 6
#: Leading grid axes between whose cells blocks are cut (at most (2 / epsilon + 1)^CUT_DIMS cells).
CUT_DIMS = 3
BOX_DIMS = 24
LEAF = 512


def unit_rows(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Orthogonal axes (columns), by falling second moment of the unit vectors in column ``v``."""

    def moments(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            if len(batch):
                x = unit_rows(batch["v"])
                total += x.T @ x
        yield pd.DataFrame({"at": np.arange(dims * dims), "m": total.ravel()})

    got = vectors.select("v").mapInPandas(moments, "at int, m double").groupBy("at").agg(F.sum("m").alias("m")).collect()
    out = np.zeros(dims * dims)
    for r in got:  # dims^2 numbers
        out[r["at"]] = r["m"]
    _, axes = np.linalg.eigh(out.reshape(dims, dims))
    return axes[:, ::-1]


def _gap(low_a, high_a, low_b, high_b) -> float:
    """Squared distance between two boxes."""
    d = np.maximum(0.0, np.maximum(low_a - high_b, low_b - high_a))
    return float(d @ d)


class _Unit:
    """The join of one or two intervals of the order."""

    def __init__(self, x: np.ndarray, count: np.ndarray, axes: np.ndarray, threshold: float):
        self.x, self.count, self.threshold = x, count, threshold
        self.box = x @ axes[:, :BOX_DIMS]
        self.reach = (2 - 2 * threshold) * (1 + 1e-9) + 1e-12
        self.links = np.zeros(len(x), dtype=np.int64)
        self.root = np.arange(len(x))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return int(i)

    def _far(self, a, b) -> bool:
        p, q = self.box[a[0] : a[1]], self.box[b[0] : b[1]]
        return _gap(p.min(axis=0), p.max(axis=0), q.min(axis=0), q.max(axis=0)) > self.reach

    def join(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        if a != b and self._far(a, b):
            return
        n, m = a[1] - a[0], b[1] - b[0]
        if n <= LEAF and m <= LEAF:
            return self._leaf(a, b)
        if a == b:
            h = (a[0] + a[1]) // 2
            for p, q in (((a[0], h), (a[0], h)), ((a[0], h), (h, a[1])), ((h, a[1]), (h, a[1]))):
                self.join(p, q)
        elif n >= m:
            h = (a[0] + a[1]) // 2
            self.join((a[0], h), b), self.join((h, a[1]), b)
        else:
            h = (b[0] + b[1]) // 2
            self.join(a, (b[0], h)), self.join(a, (h, b[1]))

    def _leaf(self, a, b) -> None:
        near = self.x[a[0] : a[1]] @ self.x[b[0] : b[1]].T >= self.threshold
        if a == b:
            np.fill_diagonal(near, False)
        rows, cols = near.any(axis=1), near.any(axis=0)
        if not rows.any():
            return
        self.links[a[0] : a[1]] += near @ self.count[b[0] : b[1]]
        if a != b:
            self.links[b[0] : b[1]] += near.T @ self.count[a[0] : a[1]]
        i, j = np.flatnonzero(rows), np.flatnonzero(cols)
        sub = near[np.ix_(i, j)]
        label, big = np.arange(len(i)), len(i)
        while True:  # labels fall to the least of their group
            of_col = np.where(sub, label[:, None], big).min(axis=0)
            new = np.minimum(label, np.where(sub, of_col[None, :], big).min(axis=1))
            if (new == label).all():
                break
            label = new
        for at, to in ((a[0] + i, a[0] + i[label]), (b[0] + j, a[0] + i[of_col])):
            for p, q in zip(at.tolist(), to.tolist(), strict=True):
                p, q = self.find(p), self.find(q)
                if p != q:
                    self.root[max(p, q)] = min(p, q)


def block_starts(cells: list[int], rows: int) -> list[tuple[int, int]]:
    """(first row, first block) of each cell's segment, cells being numbers of rows in order.

    A segment is a cell, or several small ones together; it starts anew once it holds half a block's rows.
    """
    out, start, block, held = [], 0, 0, 0
    for n in cells:
        if held >= rows / 2:
            start, block, held = start + held, block - (-held // rows), 0
        out.append((start, block))
        held += n
    return out


def units_of(classes: DataFrame, dims: int, threshold: float) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """The classes (rep, many, v) in order with their blocks, the units (block, unit) that are not skipped, and the axes."""
    spark = classes.sparkSession
    rows_a_block = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // dims))
    axes = principal_axes(classes, dims)
    epsilon = float(np.sqrt(2 - 2 * threshold))
    grid = min(GRID_DIMS, dims)
    cells = [f"c{i}" for i in range(grid)]

    def place(batches):
        for batch in batches:
            p = unit_rows(batch["v"]) @ axes[:, :grid] if len(batch) else np.zeros((0, grid))
            yield batch.assign(**{c: np.floor(p[:, i] / epsilon).astype(np.int32) for i, c in enumerate(cells)})

    schema = classes.select("rep", "many", "v").schema
    for c in cells:
        schema = schema.add(c, T.IntegerType())
    ordered = classes.select("rep", "many", "v").mapInPandas(place, schema).repartitionByRange(shuffle_partitions(spark), *cells, "rep").sortWithinPartitions(*cells, "rep")
    cut = cells[:CUT_DIMS]
    ordered = materialize(ordered.withColumn("at", F.monotonically_increasing_id()).drop(*cells[CUT_DIMS:]), "ego")
    # number of each row in the whole order, from the rows of each range (a row a range)
    ranges = ordered.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("rows"))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("ahead"))
    sizes = ordered.groupBy(*cut).count().orderBy(*cut).collect()  # a row a cell
    starts = block_starts([r["count"] for r in sizes], rows_a_block)
    segments = spark.createDataFrame([(*r[: len(cut)], *x) for r, x in zip(sizes, starts, strict=True)], ", ".join(f"{c} int" for c in cut) + ", start long, base long")
    rank = F.col("ahead") + F.col("at").bitwiseAND((1 << 33) - 1)
    # both tables have as many rows as ranges or cells, whatever the number of vectors
    placed = ordered.join(F.broadcast(ranges), F.shiftright("at", 33) == F.col("range")).join(F.broadcast(segments), cut)
    placed = placed.select("rep", "many", "v", rank.alias("rank"), (F.col("base") + F.floor((rank - F.col("start")) / rows_a_block)).cast("int").alias("block"))
    box = min(BOX_DIMS, dims)

    def boxes(batches):
        for batch in batches:
            p = unit_rows(batch["v"]) @ axes[:, :box] if len(batch) else np.zeros((0, box))
            for b in np.unique(batch["block"]):
                mine = p[(batch["block"] == b).to_numpy()]
                yield pd.DataFrame({"block": b, "dim": np.arange(box), "low": mine.min(axis=0), "high": mine.max(axis=0)})

    got = placed.select("v", "block").mapInPandas(boxes, "block int, dim int, low double, high double").groupBy("block", "dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    n_blocks = max((r["block"] for r in got), default=-1) + 1  # boxes are some hundred bytes for thousands of vectors
    low, high = np.zeros((n_blocks, box)), np.zeros((n_blocks, box))
    for r in got:
        low[r["block"], r["dim"]], high[r["block"], r["dim"]] = r["low"], r["high"]
    reach = (2 - 2 * threshold) * (1 + 1e-9) + 1e-12

    def units(batches):
        for batch in batches:
            for a in batch["id"].tolist():
                d = np.maximum(0.0, np.maximum(low[a] - high[a:], low[a:] - high[a]))
                near = a + np.flatnonzero((d * d).sum(axis=1) <= reach)
                unit = a * n_blocks + near
                yield pd.DataFrame({"block": np.r_[np.full(len(near), a), near[1:]], "unit": np.r_[unit, unit[1:]]}).astype("int64")

    return placed, spark.range(n_blocks).mapInPandas(units, "block long, unit long"), axes


def _linked(classes: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(id, n, root): links of each of the classes (rep, many, v), all of one length, with others of a unit, and a root."""
    placed, sent, axes = units_of(classes, dims, threshold)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        unit = _Unit(unit_rows(pdf["v"]), pdf["many"].to_numpy(), axes, threshold)
        first = int((pdf["block"] == pdf["block"].iloc[0]).sum())
        a, b = (0, first), (first, len(pdf))
        unit.join(a, b if first < len(pdf) else a)
        some = np.flatnonzero(unit.links > 0)
        rep = pdf["rep"].to_numpy()
        return pd.DataFrame({"id": rep[some], "n": unit.links[some], "root": rep[[unit.find(i) for i in some.tolist()]]})

    return materialize(placed.join(sent, "block").groupBy("unit").applyInPandas(run, "id long, n long, root long"), "ego")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """``key``, n_links, component_id and kept of each row; linked: cosine >= threshold."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    good = F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0) & F.col(key).isNotNull(), F.lit(False))
    rows = df.select(F.col(key).alias("id"), v.alias("v"), good.alias("good"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(17), "v").alias("h2"))
    classes = rows.where("good").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("many"), F.min_by("v", "id").alias("v"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "ego")
    # rows of one key share a component even if their vectors are not linked
    again = rows.where("good").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).groupBy("id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("reps"))
    edges = materialize(again.where(F.size("reps") > 1).select(F.explode("reps").alias("id"), F.lit(0).cast("long").alias("n"), F.col("a").alias("root")), "ego")
    for r in classes.groupBy(F.size("v").alias("dims")).count().where("count > 1").orderBy("dims").collect():  # lengths that occur
        edges = edges.unionByName(_linked(classes.where(F.size("v") == r["dims"]), r["dims"], threshold))
    whole = connected_components(edges.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = edges.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    member = classes.select("h1", "h2", "rep", "many", "least").join(counts, "rep", "left").join(whole.withColumnsRenamed({"node": "rep", "component_id": "whole"}), "rep", "left")
    member = materialize(member.withColumn("whole", F.coalesce("whole", "rep")), "ego")
    named = member.groupBy("whole").agg(F.min("least").alias("component_id"))
    member = member.join(named, "whole").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "good", "h1", "h2").join(member, ["h1", "h2"], "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("id"))
    links = F.when(F.col("good"), F.col("n_links")).otherwise(F.lit(0)).cast("long")
    return out.select(F.col("id").alias(key), links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
