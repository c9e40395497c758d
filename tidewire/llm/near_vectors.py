"""Near-duplicate vectors by comparing tiles in the order of principal components.

Vectors of length one are turned to their principal axes. Vectors of a label are dealt to cells by their first
two coordinates and to tiles of bounded size within a cell. Two vectors of cosine c are at most
sqrt(2 - 2c) apart, so only tiles of one cell or of neighbouring cells are compared. A pair of tiles
sums products over leading coordinates first; what the rest can add is at most the product of the
norms of the rests, and rows and columns that cannot reach the threshold any more are left out.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, staged

THRESHOLD = 0.98
TILE = 1024
#: leading coordinates summed at a time
STEP = 16
#: cosines closer to the threshold than this are computed anew from the vectors as given
DOUBT = 1e-9


def _doubles(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _products(batches):
    total = None
    for b in batches:
        if b.num_rows:
            u = _unit(_doubles(b.column("vector")))
            part = u.T @ u
            total = part if total is None else total + part
    if total is not None:
        d = len(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(total.tolist(), pa.list_(pa.float64()))],
            names=["width", "row", "products"])


def axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Principal axes of all vectors of one width; width squared numbers."""
    rows = vectors.select("vector").mapInArrow(_products, "width long, row long, products array<double>")
    sums = rows.select("row", F.posexplode("products").alias("at", "v")).groupBy("row", "at").agg(F.sum("v").alias("v"))
    m = np.zeros((width, width))
    for r in sums.collect():
        m[r.row, r["at"]] = r.v
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]


def _placed(turn: np.ndarray, cell: float):
    def run(batches):
        for b in batches:
            if b.num_rows:
                first = _unit(_doubles(b.column("vector"))) @ turn[:, :2]
                at = np.floor(first / cell).astype(np.int32)
                y = at[:, 1] if at.shape[1] > 1 else np.zeros(len(at), np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at[:, 0]), pa.array(y)],
                                                 names=[*b.schema.names, "x", "y"])
    return run


def _tile(turn: np.ndarray):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        x = _doubles(rows.column("vector").combine_chunks())
        ids, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
        return pa.table({
            "label": pa.array([key[0].as_py()], pa.string()), "x": pa.array([key[1].as_py()], pa.int32()),
            "y": pa.array([key[2].as_py()], pa.int32()), "tile": pa.array([key[3].as_py()], pa.int32()),
            "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
            "copies": pa.array([copies.astype("<i8").tobytes()], pa.binary()),
            "vectors": pa.array([x.tobytes()], pa.binary()),
            "turned": pa.array([(_unit(x) @ turn).tobytes()], pa.binary())})
    return run


def linked(a, ua, b, ub, threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` whose cosine reaches the threshold; ``ua`` and ``ub`` are turned units."""
    d = ua.shape[1]
    rows, cols = np.arange(len(ua)), np.arange(len(ub))
    sums = np.zeros((len(rows), len(cols)))
    rest_a = np.sqrt(np.maximum(np.cumsum((ua ** 2)[:, ::-1], axis=1)[:, ::-1], 0))
    rest_b = np.sqrt(np.maximum(np.cumsum((ub ** 2)[:, ::-1], axis=1)[:, ::-1], 0))
    for at in range(0, d, step):
        to = min(d, at + step)
        sums += ua[rows, at:to] @ ub[cols, at:to].T
        if to < d:
            bound = sums + rest_a[rows, to][:, None] * rest_b[cols, to][None, :]
            may = bound >= threshold - DOUBT
            r, c = may.any(axis=1), may.any(axis=0)
            if not r.any():
                return np.zeros(0, int), np.zeros(0, int)
            if not (r.all() and c.all()):
                rows, cols, sums = rows[r], cols[c], sums[np.ix_(r, c)]
    i, j = np.nonzero(sums >= threshold - DOUBT)
    near = sums[i, j] < threshold + DOUBT
    i, j = rows[i], cols[j]
    keep = np.ones(len(i), bool)
    x, y = a[i[near]], b[j[near]]
    keep[near] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))) >= threshold
    return i[keep], j[keep]


def _compare(threshold: float):
    def one(row):
        ids, copies, vectors, turned = {}, {}, {}, {}
        for s in "ab":
            ids[s] = np.frombuffer(row[f"ids_{s}"], "<i8")
            copies[s] = np.frombuffer(row[f"copies_{s}"], "<i8")
            vectors[s] = np.frombuffer(row[f"vectors_{s}"]).reshape(len(ids[s]), -1)
            turned[s] = np.frombuffer(row[f"turned_{s}"]).reshape(len(ids[s]), -1)
        i, j = linked(vectors["a"], turned["a"], vectors["b"], turned["b"], threshold)
        if row["same"]:
            i, j = i[i < j], j[i < j]
        counts: dict[int, int] = {}
        root: dict[int, int] = {}

        def find(k):
            while root.setdefault(k, k) != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for x, y, nx, ny in zip(ids["a"][i].tolist(), ids["b"][j].tolist(),
                                copies["a"][i].tolist(), copies["b"][j].tolist()):
            counts[x] = counts.get(x, 0) + ny
            counts[y] = counts.get(y, 0) + nx
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        return [(k, n, find(k)) for k, n in counts.items()]

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                found = one(b.slice(k, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[c] for f in found], pa.int64()) for c in range(3)], names=["rep", "n", "joined"])
    return run


def _pairs(cells: DataFrame) -> DataFrame:
    """Pairs of tiles to compare, each once: label, x, y, tile and x_b, y_b, tile_b."""
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                       for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    near = cells.select("label", "x", "y", "tiles", F.explode(around).alias("d")).select(
        "label", "x", "y", "tiles", (F.col("x") + F.col("d.i")).alias("x_b"), (F.col("y") + F.col("d.j")).alias("y_b"))
    other = cells.select("label", F.col("x").alias("x_b"), F.col("y").alias("y_b"), F.col("tiles").alias("tiles_b"))
    tiles = near.join(other, ["label", "x_b", "y_b"]) \
        .withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))) \
        .withColumn("tile_b", F.explode(F.sequence(F.lit(0), F.col("tiles_b") - 1)))
    here = (F.col("x") == F.col("x_b")) & (F.col("y") == F.col("y_b"))
    return tiles.where(~here | (F.col("tile") <= F.col("tile_b"))).select(
        "label", "x", "y", "tile", "x_b", "y_b", "tile_b", (here & (F.col("tile") == F.col("tile_b"))).alias("same"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for ``vectors`` (vec_id, embedding, label).

    Vectors are compared when their labels are equal and not null and their widths agree. Null, zero
    and empty vectors and those with null or non-finite components link with nothing. Equal vectors
    are compared once and count as copies of each other. Rows without a vec_id are dropped; a vec_id
    must be unique. Other columns are ignored.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"),
                          F.col("label").cast("string").alias("label")).where("vec_id is not null")
    top = F.array_max(F.transform("vector", F.abs))
    sound = F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) \
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (top > 0)
    # far from the ends of the range of doubles; a power of two changes no digit
    scale = F.pow(F.lit(2.0), F.floor(F.log2(top)))
    good = rows.where(sound).select("vec_id", "label", F.transform("vector", lambda v: v / scale).alias("vector"))
    classes = staged(good.groupBy("label", "vector").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    member = good.join(classes, ["label", "vector"]).select("vec_id", "rep", "copies")
    found = None
    widths = sorted(r[0] for r in classes.select(F.size("vector")).distinct().collect())
    for width in widths:
        part = _one_width(classes.where(F.size("vector") == width), width, threshold, tile)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"),
                           F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    found = staged(found, "linked")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("joined").alias("b"))).withColumnRenamed("id", "rep")
    out = rows.select("vec_id").join(member, "vec_id", "left").join(counts, "rep", "left").join(roots, "rep", "left")
    return out.select(
        "vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("root", "rep", "vec_id").cast("long").alias("component_id")) \
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _one_width(classes: DataFrame, width: int, threshold: float, tile: int) -> DataFrame:
    turn = axes(classes, width)
    cell = max(float(np.sqrt(max(0.0, 2 - 2 * threshold))) * (1 + 1e-9), 1e-3)
    placed = classes.mapInArrow(_placed(turn, cell),
                                "label string, vector array<double>, rep long, copies long, x int, y int")
    cells = placed.groupBy("label", "x", "y").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    cells = staged(cells, "cells")
    dealt = placed.join(cells, ["label", "x", "y"]).withColumn(
        "tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    tiles = staged(dealt.groupBy("label", "x", "y", "tile").applyInArrow(
        _tile(turn), "label string, x int, y int, tile int, ids binary, copies binary, vectors binary, "
                     "turned binary"), "tiles")
    side = {s: tiles.select("label", *[F.col(c).alias(c + ("_b" if s == "b" else "")) for c in ("x", "y", "tile")],
                            *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "copies", "vectors", "turned")]) for s in "ab"}
    both = _pairs(cells).join(side["a"], ["label", "x", "y", "tile"]).join(side["b"], ["label", "x_b", "y_b", "tile_b"])
    return both.select("same", *[f"{c}_{s}" for s in "ab" for c in ("ids", "copies", "vectors", "turned")]) \
        .mapInArrow(_compare(threshold), "rep long, n long, joined long")
