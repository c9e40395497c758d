"""Running totals and exact quantiles over data of any size, by one plan each.

Running totals: rows are dealt into ranges of the order, whose bounds come from a sample, and written; totals run
inside a range and start at the sum of the ranges before it. Quantiles: one scan sketches all columns, which
brackets every wanted rank within the sketch's error; a second scan counts what lies below each bracket and the
distinct values inside, and running totals over those pick the ranks. Neither sends all rows through one task.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..session import work_dir

#: the sketch's rank error is at most 1 / ACCURACY of the rows
ACCURACY = 10_000


def in_ranges(df: DataFrame, by: list[str], order: str, descending: bool = False) -> DataFrame:
    """``df`` written in ranges of (by, order), with the range's number as ``_range``."""
    way = F.desc(order) if descending else F.asc(order)
    ranged = df.repartitionByRange(*[F.asc(c) for c in by], way).withColumn("_range", F.spark_partition_id())
    path = work_dir(df.sparkSession, "ranges")
    ranged.write.parquet(path)
    return df.sparkSession.read.schema(ranged.schema).parquet(path)


def running_totals(df: DataFrame, order: str, sums: list[str], descending: bool = False,
                   by: list[str] | None = None) -> DataFrame:
    """``df`` with inclusive running sums ``cum_<name>`` of ``sums`` along ``order``, and whole sums ``all_<name>``.

    ``order`` is unique within the groups ``by``. An empty table stays empty.
    """
    by = by or []
    way = F.desc(order) if descending else F.asc(order)
    rows = in_ranges(df, by, order, descending)
    # one row per range, and per group within it
    per_range = rows.groupBy(*by, "_range").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    group = Window.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select(*by, "_range", *[x for s in sums for x in (
        F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}"),
        F.sum(f"_t_{s}").over(group).alias(f"all_{s}"))])
    inside = Window.partitionBy(*by, "_range").orderBy(way).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumns({f"cum_{s}": F.sum(s).over(inside) for s in sums}).alias("r")
    same = F.col("r._range") == F.col("s._range")
    for c in by:
        same &= F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    return placed.join(starts.alias("s"), same).select(
        *[F.col(f"r.{c}") for c in df.columns],
        *[(F.col(f"cum_{s}") + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums], *[f"all_{s}" for s in sums])


def _running_starts(by: str, size: str):
    """Batches of rows sorted by ``by`` with ``start``, the sum of ``size`` before each row of its group."""
    def run(batches):
        last, at = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys, sizes = b.column(by), b.column(size).to_numpy()
            code = keys.dictionary_encode().indices.to_numpy()
            before = np.cumsum(sizes) - sizes
            head = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            start = before - np.repeat(before[head], np.diff(np.append(head, len(code))))
            if keys[0].as_py() == last:
                start[code == code[0]] += at
            last, at = keys[-1].as_py(), int(start[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(start)], names=[*b.schema.names, "start"])
    return run


def starts_in_ranges(df: DataFrame, by: str, order: str, size: str) -> DataFrame:
    """``df`` without ``order`` and with ``start``, the sum of ``size`` before each row of its group ``by`` along ``order``.

    For wide rows: they are shuffled and written once, in ranges of (by, order) with the sums inside a range. Only the first
    group of a range can begin in an earlier one, so at most as many sums as ranges are sent to all tasks. ``by`` has no nulls.
    """
    ranged = df.repartitionByRange(F.asc(by), F.asc(order)).sortWithinPartitions(by, order).drop(order).withColumn(
        "_range", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField("start", T.LongType())])
    path = work_dir(df.sparkSession, "starts")
    ranged.mapInArrow(_running_starts(by, size), schema).write.parquet(path)
    rows = df.sparkSession.read.schema(schema).parquet(path)
    sums = rows.groupBy(by, "_range").agg(F.sum(size).alias("_t"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(by, "_range", F.sum("_t").over(before).alias("_o")).where("_o > 0")
    return rows.join(F.broadcast(offsets), [by, "_range"], "left").withColumn(
        "start", F.col("start") + F.coalesce("_o", F.lit(0))).drop("_range", "_o")


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column; nulls and NaN are left out."""
    data = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    # twice the sketch's error, so that the ends of a bracket lie outside the wanted rank
    margin = 2.0 / accuracy
    marks = F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in probs for d in (-margin, margin)])
    row = data.agg(*[x for c in columns for x in (
        F.count(c).alias(f"n_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"),
        F.percentile_approx(c, marks, F.lit(accuracy)).alias(f"q_{c}"))]).first()
    wanted, whole = {}, {}
    for c in columns:
        n = row[f"n_{c}"]
        for i, p in enumerate(probs if n else []):
            low, high = row[f"q_{c}"][2 * i:2 * i + 2]
            whole[c, i] = (row[f"lo_{c}"], row[f"hi_{c}"], p * (n - 1))
            # neighbouring ranks lie within the margin once it spans two rows
            resolved = n * margin >= 2
            wanted[c, i] = (low if resolved and p > margin else row[f"lo_{c}"],
                            high if resolved and p + margin < 1 else row[f"hi_{c}"], p * (n - 1))
    found = _select(data, wanted)
    missed = {k: whole[k] for k in wanted if k not in found}
    if missed:
        # never so within the sketch's bound; the whole range holds every rank
        found |= _select(data, missed)
    return {c: [found.get((c, i)) for i in range(len(probs))] for c in columns}


def _select(data: DataFrame, wanted: dict[tuple[str, int], tuple[float, float, float]]) -> dict:
    """Values at the fractional ranks of ``wanted`` (low, high, rank) that lie in their brackets."""
    if not wanted:
        return {}
    keys = list(wanted)
    # a value below its bracket is counted as null, which sorts first
    places = F.array(*[F.when(F.col(c) <= wanted[c, i][1], F.struct(
        F.lit(k).alias("k"), F.when(F.col(c) >= wanted[c, i][0], F.col(c)).alias("v"))) for k, (c, i) in enumerate(keys)])
    counts = data.select(F.explode(F.filter(places, lambda p: p.isNotNull())).alias("p")) \
        .groupBy("p.k", "p.v").agg(F.count(F.lit(1)).alias("m"))
    ranks = F.create_map(*[x for k, key in enumerate(keys) for x in (F.lit(k), F.array(
        F.lit(math.floor(wanted[key][2])), F.lit(math.ceil(wanted[key][2]))))])
    totals = running_totals(counts, "v", ["m"], by=["k"]).withColumn("r", ranks[F.col("k")])
    at = lambda j: F.max(F.when((F.col("cum_m") - F.col("m") <= F.col("r")[j])
                                & (F.col("r")[j] < F.col("cum_m")), F.col("v")))
    out = {}
    for r in totals.groupBy("k").agg(at(0).alias("a"), at(1).alias("b")).collect():
        if r["a"] is not None and r["b"] is not None:
            out[keys[r["k"]]] = r["a"] + (r["b"] - r["a"]) * (wanted[keys[r["k"]]][2] % 1)
    return out
