"""Prepare feature columns for the detectors."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from .. import config
from ..functions.sender import cyclic
from ..session import cut_lineage
from . import linear
from .ordered import exact_quantiles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def add_composites(df: DataFrame, composites: dict | None = None) -> DataFrame:
    """Weighted sums whose components are all present."""
    for name, (parts, weights) in (composites or config.FOREST_COMPOSITES).items():
        if all(p in df.columns for p in parts):
            total = F.lit(0.0)
            for p, w in zip(parts, weights):
                total = total + F.col(p) * w
            df = df.withColumn(name, total)
    return df


def select_features(df: DataFrame, wanted: list[str] | None = None,
                    composites: dict | None = None) -> list[str]:
    """Configured features that exist, then the composites."""
    wanted = config.FOREST_FEATURES if wanted is None else wanted
    extra = config.FOREST_COMPOSITES if composites is None else composites
    return [c for c in wanted if c in df.columns] + [c for c in extra if c in df.columns]


def correlations(df: DataFrame, cols: list[str]) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of every pair over rows where both are present.

    The columns are written once; products are added up from the smallest values on, and tasks multiply whole blocks of
    rows. Constant columns give no value.
    """
    pairs = [(a, b) for j, b in enumerate(cols) for a in cols[:j]]
    if not pairs:
        return {}
    width = len(cols)
    data = cut_lineage(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]), "numbers")
    low = data.agg(*[F.min(c).alias(c) for c in data.columns]).first()
    low = np.array([0.0 if v is None or not np.isfinite(v) else v for v in low])

    def add(batches, total):
        sums = total.reshape(4, width, width)
        for b in batches:
            x = np.stack([c.to_numpy(False).astype(float, copy=False) for c in b.columns], axis=1) - low
            here = np.stack([c.is_valid().to_numpy(False) for c in b.columns], axis=1).astype(float)
            x = np.where(here > 0, x, 0.0)
            sums += here.T @ here, x.T @ here, (x * x).T @ here, x.T @ x

    n, first, second, both = linear.summed(data, 4 * width * width, add).reshape(4, width, width)

    def value(i: int, j: int) -> float | None:
        m = n[i, j]
        if not m:
            return None
        squares = np.array([second[i, j], second[j, i]]) / m
        means = np.array([first[i, j], first[j, i]]) / m
        spread = squares - means * means
        if (spread <= 1e-13 * squares).any():
            return None
        return float((both[i, j] / m - means[0] * means[1]) / np.sqrt(spread[0] * spread[1]))

    return {(cols[i], cols[j]): value(i, j) for j in range(width) for i in range(j)}


def drop_correlated(df: DataFrame, cols: list[str], limit: float = 0.85) -> list[str]:
    """Columns without those that correlate above the limit with any earlier column."""
    table = correlations(df, cols)
    high = {b for (a, b), v in table.items() if v is not None and abs(v) > limit}
    return [c for c in cols if c not in high]


def zero_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null, NaN and infinite values become 0."""
    def fix(c: str) -> Column:
        v = F.col(c).cast("double")
        bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        return F.when(bad, 0.0).otherwise(v)
    return df.withColumns({c: fix(c) for c in cols})


def medians(df: DataFrame, cols: list[str]) -> dict[str, float]:
    return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5]).items() if v[0] is not None}


def fill_median(df: DataFrame, cols: list[str] | None = None,
                values: dict[str, float] | None = None) -> DataFrame:
    cols = numeric_columns(df) if cols is None else cols
    values = medians(df, cols) if values is None else values
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(v))
                           for c, v in values.items()})


def two_valued(df: DataFrame, cols: list[str], at_most: bool = False) -> list[str]:
    """Columns with exactly two distinct values, or at most two.

    Two passes without a shuffle: the extremes, then whether anything lies between them.
    """
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols
                    for n, f in (("lo", F.min), ("hi", F.max))]).first()
    mid = df.agg(*[F.count_if((F.col(c) > F.lit(ends[f"lo_{c}"])) & (F.col(c) < F.lit(
        ends[f"hi_{c}"]))).alias(c) for c in cols]).first()
    return [c for c in cols if mid[c] == 0 and ends[f"lo_{c}"] is not None
            and (at_most or ends[f"lo_{c}"] != ends[f"hi_{c}"])]


def feature_types(df: DataFrame, wanted: list[str] | None = None) -> dict[str, list[str]]:
    """Numeric, two-valued and categorical columns; two-valued ones are also numeric."""
    wanted = config.RECONSTRUCTION_FEATURES if wanted is None else wanted
    special = ["day_of_week", "time_category_anomaly"]
    have = [c for c in wanted if c in df.columns]
    numeric = [c for c in have if c not in special and c in numeric_columns(df)]
    return {"numeric": numeric, "binary": two_valued(df, have) if have else [],
            "categorical": [c for c in special if c in df.columns]
            if "day_of_week" in df.columns else []}


def mean_std(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation; a zero deviation counts as 1."""
    row = df.agg(*[x for c in cols for x in (
        F.avg(F.col(c).cast("double")).alias(f"m_{c}"),
        F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}"))]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in cols}


def standardize(df: DataFrame, stats: dict[str, tuple[float, float]], prefix="") -> DataFrame:
    return df.withColumns({f"{prefix}{c}": (F.col(c) - F.lit(m)) / F.lit(s)
                           for c, (m, s) in stats.items()})


def category_values(df: DataFrame, col: str, limit: int = 10_000) -> list[str]:
    """Sorted distinct values of a small categorical column, with 'unknown' added."""
    found = df.select(F.coalesce(F.col(col).cast("string"), F.lit("unknown")).alias("v")).distinct()
    values = [r[0] for r in found.limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"{col} has more than {limit} values")
    return sorted(set(values) | {"unknown"})


def one_hot(df: DataFrame, col: str, values: list[str], out: str | None = None) -> DataFrame:
    """0/1 array over ``values``; values not seen when fitting count as 'unknown'."""
    known = F.array(*[F.lit(v) for v in values])
    text = F.coalesce(F.col(col).cast("string"), F.lit("unknown"))
    safe = F.when(F.array_contains(known, text), text).otherwise("unknown")
    return df.withColumn(out or f"{col}_onehot",
                         F.transform(known, lambda v: (v == safe).cast("double")))


def add_cyclic(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    new = cyclic(F.col("hour") if "hour" in have else F.lit(0),
                 F.col("day_of_week") if "day_of_week" in have else F.lit(0))
    keep = {n: c for n, c in new.items()
            if (n.startswith("hour") and "hour" in have)
            or (n.startswith("day") and "day_of_week" in have)}
    return df.withColumns(keep)


def add_risks(df: DataFrame) -> DataFrame:
    """Complexity, sender and time risk, each when its columns are present."""
    have, new = set(df.columns), {}
    if {"message_entropy", "obfuscation_score", "url_count"} <= have:
        new["complexity_score"] = (
            F.col("message_entropy") * 0.3 + F.col("obfuscation_score") * 0.3
            + (F.col("url_count") > 0).cast("double") * 0.2
            + F.col("suspicious_word_count") / 10 * 0.2)
    if {"sender_legitimacy", "unusual_sender_pattern"} <= have:
        new["sender_risk"] = ((1 - F.col("sender_legitimacy")) * 0.4
                              + F.col("unusual_sender_pattern") * 0.3
                              + F.col("source_category_mismatch") * 0.3)
    if {"night_time", "time_category_anomaly"} <= have:
        new["time_risk"] = (F.col("night_time") * 0.3 + F.col("time_category_anomaly") * 0.4
                            + F.col("category_time_mismatch") * 0.3)
    return df.withColumns(new) if new else df


def add_length_stats(df: DataFrame) -> DataFrame:
    """Length z-score (sample deviation) and entropy relative to the log of the length."""
    new = {}
    if "message_length" in df.columns:
        mean = df.agg(F.avg("message_length")).scalar()
        std = df.agg(F.coalesce(F.stddev_samp("message_length"), F.lit(0.0))).scalar()
        if df.agg(F.stddev_samp("message_length").alias("s")).first()["s"]:
            new["message_length_zscore"] = (F.col("message_length") - mean) / std
        if "message_entropy" in df.columns:
            new["entropy_length_ratio"] = F.try_divide(
                F.col("message_entropy"), F.log(F.col("message_length") + 1))
    return df.withColumns(new) if new else df


def fit_adaptive_scale(df: DataFrame, cols: list[str]) -> dict[str, tuple[str, float, float]]:
    """Per column: none (at most two values), robust (over 5 % outliers) or standard scaling."""
    flat = set(two_valued(df, cols, at_most=True))
    rest = [c for c in cols if c not in flat]
    out: dict[str, tuple[str, float, float]] = {c: ("none", 0.0, 1.0) for c in cols}
    if not rest:
        return out
    q = exact_quantiles(df, rest, [0.25, 0.5, 0.75])
    spread = {c: q[c][2] - q[c][0] for c in rest}
    far = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(
        (F.col(c) < F.lit(q[c][0] - 1.5 * spread[c])) | (F.col(c) > F.lit(
            q[c][2] + 1.5 * spread[c]))).alias(c) for c in rest]).first()
    stats = mean_std(df, rest)
    for c in rest:
        if far[c] > far["_n"] * 0.05:
            out[c] = ("robust", q[c][1], spread[c] or 1.0)
        else:
            out[c] = ("standard", *stats[c])
    return out


def adaptive_scale(df: DataFrame, cols: list[str], fitted: dict | None = None) -> DataFrame:
    fitted = fit_adaptive_scale(df, cols) if fitted is None else fitted
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s)
                           for c, (kind, m, s) in fitted.items() if kind != "none"})


# ---- splits -----------------------------------------------------------------------------------

def unit_hash(*cols, seed: int = 42) -> Column:
    """Repeatable pseudo-random number in (0, 1) from key columns."""
    h = F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols], F.lit(seed))
    return (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def train_validation_split(df: DataFrame, key: str, validation: float = 0.2,
                           seed: int = 42) -> tuple[DataFrame, DataFrame]:
    u = unit_hash(key, seed=seed)
    return df.where(u >= validation), df.where(u < validation)


def augment(df: DataFrame, cols: list[str], key: str, factor: float = 0.01,
            seed: int = 7) -> DataFrame:
    """The rows plus one copy with small normal noise.

    Noise is a function of the key, so a recomputed task produces the same rows.
    """
    def noisy(i: int, c: str) -> Column:
        u, v = unit_hash(key, F.lit(2 * i), seed=seed), unit_hash(key, F.lit(2 * i + 1), seed=seed)
        return F.col(c) + factor * F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)
    return df.unionByName(df.withColumns({c: noisy(i, c) for i, c in enumerate(cols)}))


def stratified_split(df: DataFrame, label: str, key: str, train: float = 0.8, seed: int = 42,
                     out: str = "is_train") -> DataFrame:
    """Mark floor(train * count) rows of every label as training rows, by hash order.

    Rows fall into 4096 hash blocks per label. Block counts tell which blocks are all training or
    all test; inside a block rows are ranked. A label of any size is spread over all its blocks.
    """
    tag = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    rows = df.withColumn("_h", tag).withColumn("_block", F.substring("_h", 1, 3))
    sizes = rows.groupBy(label, "_block").agg(F.count(F.lit(1)).alias("_n"))
    by_label = Window.partitionBy(label)  # at most 4096 rows per label
    order = by_label.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    plan = sizes.select(
        F.col(label).alias("_label"), F.col("_block").alias("_b"),
        F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"),
        F.floor(F.sum("_n").over(by_label) * F.lit(train)).alias("_want"))
    joined = rows.join(plan, F.col(label).eqNullSafe(F.col("_label"))
                       & (F.col("_block") == F.col("_b")))
    rank = F.row_number().over(Window.partitionBy("_label", "_b").orderBy("_h", key))
    return joined.withColumn(out, (F.col("_before") + rank <= F.col("_want")).cast("int")).drop(
        "_h", "_block", "_label", "_b", "_before", "_want")
