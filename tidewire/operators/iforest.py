"""Isolation-forest ensemble.

Every tree is grown from a bounded sample (psi rows, 256 by default, the size the method's authors
recommend) chosen by a hash of the row key, so training never needs more than psi rows in one task
and gives the same forest for any partitioning. A forest is a table of nodes whose size depends on
the parameters only: at most members * trees * (2 psi - 1) rows.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .. import config
from ..session import cut_lineage

NODE_TYPE = ("member int, tree int, node int, feature int, cut double, left int, right int, "
             "path double")
MAX_NODES = 4_000_000
#: rows that walk through the trees together
SCORED = 8192


def average_path(n: float) -> float:
    """Expected depth of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, usable: np.ndarray, limit: int, rng) -> list[tuple]:
    """One tree as (node, feature, cut, left, right, path) rows; leaves have feature -1."""
    nodes, todo = [], [(0, np.arange(len(x)), 0)]
    used = 1
    while todo:
        node, rows, depth = todo.pop()
        part = x[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        choices = usable[hi[usable] > lo[usable]]
        if depth >= limit or len(rows) <= 1 or len(choices) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + average_path(len(rows))))
            continue
        f = int(rng.choice(choices))
        cut = float(rng.uniform(lo[f], hi[f]))
        side = part[:, f] < cut
        if not side.any() or side.all():
            cut = float(np.nextafter(hi[f], -np.inf)) if side.all() else float(hi[f])
            side = part[:, f] < cut
        left, right, used = used, used + 1, used + 2
        nodes.append((node, f, cut, left, right, 0.0))
        todo += [(left, rows[side], depth + 1), (right, rows[~side], depth + 1)]
    return nodes


def _draw(slots: int, share: float):
    """Rows (slot, x, order): every row joins every slot with probability ``share``, by skips from one to the next.

    The skips are drawn from the row's hash, so a repeated task draws the same; a row that joins none costs one draw.
    """
    import pyarrow as pa

    def uniform(h, k):
        x = h + np.atleast_1d(np.asarray(k, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0 ** -53

    def skip(u):
        if share >= 1.0:
            return np.zeros(len(u), np.int64)
        return np.minimum(np.floor(np.log1p(-u) / np.log1p(-share)), slots).astype(np.int64)

    def run(batches):
        for b in batches:
            h = b.column("h").to_numpy().view(np.uint64)
            rows, slot, k = np.arange(len(h)), skip(uniform(h, 0)), 1
            while True:
                inside = slot < slots
                rows, slot = rows[inside], slot[inside]
                if not len(rows):
                    break
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot.astype(np.int32)), b.column("x").take(pa.array(rows)),
                     pa.array(uniform(h[rows] ^ np.uint64(0x5851F42D4C957F2D), slot.astype(np.uint64)))],
                    names=["slot", "x", "order"])
                slot = slot + 1 + skip(uniform(h[rows], k))
                k += 1
    return run


def tree_samples(df: DataFrame, features: list[str], key: str, members: int, trees: int, psi: int,
                 seed: int) -> DataFrame:
    """(slot, x, order): about 1.3 psi candidate rows per tree, by one law at every size."""
    total = max(df.count(), 1)
    share = min(1.0, (1.3 * psi + 20.0) / total)
    rows = df.select(F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.array(*[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("x"))
    return rows.mapInArrow(_draw(members * trees, share), "slot int, x array<double>, order double")


def fit_iforest(df: DataFrame, features: list[str], key: str = "id", psi: int = 256,
                params: dict | None = None) -> DataFrame:
    """Node table of the ensemble, fitted on ``df`` (normally the normal rows)."""
    p = {**config.FOREST_PARAMS, **(params or {})}
    members, trees, seed = p["members"], p["trees"], p["seed"]
    if members * trees * (2 * psi - 1) > MAX_NODES:
        raise ValueError("forest too large to broadcast; lower trees or psi")
    samples = tree_samples(df, features, key, members, trees, psi, seed)
    # psi rows per tree, decided before any group is collected
    best = Window.partitionBy("slot").orderBy("order")
    kept = samples.withColumn("r", F.row_number().over(best)).where(F.col("r") <= psi)
    use = max(1, int(p["feature_share"] * len(features)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        slot = int(pdf["slot"].iloc[0])
        rng = np.random.default_rng([seed + slot // trees, slot])
        x = np.stack(pdf.sort_values("order")["x"].to_numpy()).astype(float)
        usable = np.sort(rng.choice(len(features), use, replace=False))
        limit = math.ceil(math.log2(max(len(x), 2)))
        out = pd.DataFrame(_grow(x, usable, limit, rng),
                           columns=["node", "feature", "cut", "left", "right", "path"])
        out.insert(0, "tree", slot % trees)
        out.insert(0, "member", slot // trees)
        return out

    return kept.select("slot", "x", "order").groupBy("slot").applyInPandas(grow, NODE_TYPE)


class Forest:
    """A fitted forest: nodes, features, sample size, and the label cut of each member."""

    def __init__(self, nodes: pd.DataFrame, features: list[str], psi: int, offsets=None):
        self.nodes, self.features, self.psi = nodes, features, psi
        self.offsets = offsets or []

    @classmethod
    def grow(cls, df: DataFrame, features: list[str], key: str = "id", psi: int = 256,
             params: dict | None = None) -> "Forest":
        """The trees alone, without the label cuts."""
        table = fit_iforest(df, features, key, psi, params)
        nodes = table.limit(MAX_NODES + 1).toPandas()  # size bounded by the parameters
        if nodes.empty:
            raise ValueError("no rows to fit on")
        return cls(nodes.sort_values(["member", "tree", "node"]), features, psi)

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], key: str = "id", psi: int = 256,
            params: dict | None = None) -> "Forest":
        model = cls.grow(df, features, key, psi, params)
        return model.set_offsets(cut_lineage(model.score(df, key).select("member_scores"), "members"), params)

    def set_offsets(self, scored: DataFrame, params: dict | None = None) -> "Forest":
        """The label cut of each member, from the scores of the rows it was fitted on."""
        share = {**config.FOREST_PARAMS, **(params or {})}["contamination"]
        from .ordered import exact_quantiles
        each = scored.select(*[F.col("member_scores")[i].alias(f"m{i}") for i in range(self.members)])
        cuts = exact_quantiles(each, each.columns, [share])
        self.offsets = [cuts[f"m{i}"][0] for i in range(self.members)]
        return self

    @property
    def members(self) -> int:
        return int(self.nodes["member"].max()) + 1

    def _arrays(self):
        """Per member (feature, cut, path), a row per tree, level by level as full binary trees.

        Below a leaf both sides lead to its path, so every row takes the same number of steps in every tree.
        """
        out = []
        for member, rows in self.nodes.groupby("member"):
            rows = rows.sort_values(["tree", "node"])
            feature, cut, left, right, path = (rows[c].to_numpy() for c in ("feature", "cut", "left", "right", "path"))
            first = np.flatnonzero(np.diff(rows["tree"].to_numpy(), prepend=-1))[:, None]
            at, features, cuts = first, [], []
            while (feature[at] >= 0).any():
                inner = feature[at] >= 0
                features.append(np.where(inner, feature[at], 0))
                cuts.append(np.where(inner, cut[at], np.inf))
                sides = [np.where(inner, first + side[at], at) for side in (left, right)]
                at = np.stack(sides, axis=2).reshape(len(first), -1)
            whole = lambda levels, kind: np.concatenate(
                levels or [np.zeros((len(first), 0))], axis=1).astype(kind)
            out.append((whole(features, np.int64), whole(cuts, float), path[at]))
        return out

    def score(self, df: DataFrame, key: str = "id", keep: list[str] | None = None) -> DataFrame:
        """Add ``member_scores`` and ``score``, both in (-1, 0); lower is more anomalous."""
        import pyarrow as pa
        keep = [key] if keep is None else [key] + [c for c in keep if c != key]
        shared = df.sparkSession.sparkContext.broadcast(self._arrays())
        scale, width = average_path(self.psi), len(self.features)
        rows = df.select(*keep, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                                          for c in self.features]).alias("_x"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields
                           if f.name != "_x") + ", member_scores array<double>, score double"

        def walk(x, forest):
            n = len(x)
            flat, rows = np.ascontiguousarray(x.T).ravel(), np.arange(n)
            at, place, low = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, bool)
            value, limit = np.empty(n), np.empty(n)
            scores = []
            for features, cuts, paths in forest:
                total = np.zeros(n)
                for feature, cut, path in zip(features * n, cuts, paths):
                    at[:] = 0
                    for _ in range(len(path).bit_length() - 1):
                        feature.take(at, out=place, mode="clip")
                        np.add(place, rows, out=place)
                        flat.take(place, out=value, mode="clip")
                        cut.take(at, out=limit, mode="clip")
                        # a missing number is not below the cut and goes right
                        np.less(value, limit, out=low)
                        at *= 2
                        at += 2
                        at -= low
                    at -= len(cut)
                    path.take(at, out=value, mode="clip")
                    total += value
                scores.append(-np.power(2.0, -total / len(paths) / scale))
            return np.stack(scores, axis=1)

        def run(batches):
            forest = shared.value
            for batch in batches:
                for k in range(0, batch.num_rows, SCORED):
                    b = batch.slice(k, SCORED)
                    both = walk(b.column("_x").flatten().to_numpy(False).reshape(b.num_rows, width), forest)
                    starts = pa.array(np.arange(b.num_rows + 1) * both.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [*b.columns[:-1], pa.ListArray.from_arrays(starts, pa.array(both.ravel())),
                         pa.array(both.mean(axis=1))], names=[*b.schema.names[:-1], "member_scores", "score"])

        return rows.mapInArrow(run, schema)

    def vote(self, scored: DataFrame) -> DataFrame:
        """Add ``vote``: the rounded mean of member labels, -1 anomalous, 1 normal."""
        labels = F.array(*[F.when(F.col("member_scores")[i] < F.lit(cut), -1).otherwise(1)
                           for i, cut in enumerate(self.offsets)])
        mean = F.aggregate(labels, F.lit(0), lambda a, v: a + v) / F.lit(len(self.offsets))
        return scored.withColumn("vote", F.rint(mean).cast("int"))

    def decision(self, scored: DataFrame) -> DataFrame:
        """Replace the member scores by anomaly-oriented ones: cut minus score."""
        return scored.withColumn("member_scores", F.array(*[
            F.lit(cut) - F.col("member_scores")[i] for i, cut in enumerate(self.offsets)]))


def predict_forest(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("prediction", (F.col("score") < F.lit(threshold)).cast("int"))


def prediction_summary(predicted: DataFrame, threshold: float, error: str | None = None) -> DataFrame:
    """Samples, anomalies, rate, threshold and, when given, the mean error."""
    aggs = [F.count(F.lit(1)).alias("total_samples"),
            F.sum("prediction").alias("anomalies_detected"),
            F.avg("prediction").alias("anomaly_rate")]
    if error:
        aggs.append(F.avg(error).alias("mean_error"))
    return predicted.agg(*aggs).withColumn("threshold", F.lit(float(threshold)))
