"""Reconstruction-error detector: principal components of the prepared feature matrix.

A linear auto-encoder with k units has the same optimum as k principal components, which Spark fits
from one distributed covariance pass. Rows that the components describe badly are anomalous.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from .. import config
from ..session import cut_lineage
from . import prepare as pr
from .thresholds import percentile_threshold


class Reconstruction:
    """Fitted preparation (medians, scaling, indicators) plus components."""

    def __init__(self, kinds, medians, scales, hot, k, pca=None, threshold=None, center=None):
        self.kinds, self.medians, self.scales, self.hot = kinds, medians, scales, hot
        self.k, self.pca, self.threshold, self.center = k, pca, threshold, center

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str] | None = None, k: int = 8,
            key: str = "id", percentile: float = 98.0, augment: bool = True) -> "Reconstruction":
        """Fit on normal rows; the threshold comes from a held-out fifth of them."""
        kinds = pr.feature_types(df, columns)
        medians = pr.medians(df, kinds["numeric"])
        scales = pr.mean_std(pr.fill_median(df, kinds["numeric"], medians), kinds["numeric"])
        hot = {c: pr.category_values(df, c) for c in kinds["categorical"]}
        model = cls(kinds, medians, scales, hot, k)
        train, valid = pr.train_validation_split(df, key)
        matrix = model.prepare(train, key)
        width = len(model.names())
        cols = [f"_f{i}" for i in range(width)]
        flat = matrix.select(key, *[F.col("_x")[i].alias(c) for i, c in enumerate(cols)])
        if augment:
            flat = pr.augment(flat, cols, key)
        # written once, because means and products pass over it three times
        flat = cut_lineage(flat.select(*cols), "matrix")
        # the mean of what the components come from, all columns
        model.center = list(flat.agg(*[F.avg(c) for c in cols]).first())
        vectors = VectorAssembler(inputCols=cols, outputCol="_v").transform(flat).select("_v")
        model.pca = PCA(k=min(k, width), inputCol="_v", outputCol="_p").fit(vectors)
        model.threshold = percentile_threshold(model.errors(valid, key), "error", percentile)
        return model

    def names(self) -> list[str]:
        return (self.kinds["numeric"] + [f"{c}=raw" for c in self.kinds["binary"]]
                + [f"{c}={v}" for c, vs in self.hot.items() for v in vs])

    def prepare(self, df: DataFrame, key: str = "id", keep: list[str] | None = None) -> DataFrame:
        """One array per row: scaled numeric, raw two-valued and indicator columns."""
        keep = [key] + [c for c in keep or [] if c != key]
        filled = pr.fill_median(df, values=self.medians)
        parts = [F.array(*[((F.col(c) - F.lit(m)) / F.lit(s)) for c, (m, s) in self.scales.items()])]
        if self.kinds["binary"]:
            parts.append(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                                   for c in self.kinds["binary"]]))
        for c, values in self.hot.items():
            filled = pr.one_hot(filled, c, values, f"_hot_{c}")
            parts.append(F.col(f"_hot_{c}"))
        return filled.select(*keep, F.concat(*parts).alias("_x"))

    def errors(self, df: DataFrame, key: str = "id", keep: list[str] | None = None) -> DataFrame:
        """Add ``error``: mean squared difference between row and reconstruction.

        The components are orthonormal, so the squared difference is the squared length of the
        centred row minus that of its projection. Tasks add up column by column, so that a row's
        error does not depend on the rows beside it. A row without a value somewhere gets 0.
        """
        prepared = self.prepare(df, key, keep)
        comps, center = self.pca.pc.toArray().T, self.center
        width = len(center)
        cols = [c for c in prepared.columns if c != "_x"]

        def run(batches):
            for b in batches:
                values = b.column("_x").flatten().to_numpy(False).astype(float, copy=False)
                x = np.ascontiguousarray(values.reshape(b.num_rows, width).T)
                gone = b.column("_x").flatten().is_null().to_numpy(False).reshape(b.num_rows, width).any(1)
                left, proj = np.zeros(b.num_rows), np.zeros((len(comps), b.num_rows))
                for j in range(width):
                    column = x[j] - center[j]
                    left += column * column
                    for k, c in enumerate(comps):
                        proj[k] += column * c[j]
                held = np.zeros(b.num_rows)
                for p in proj:
                    held += p * p
                error = np.maximum((left - held) / width, 0.0)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.where(gone, 0.0, error))],
                                                 names=[*cols, "error"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prepared.schema.fields if f.name != "_x")
        return prepared.select(*cols, "_x").mapInArrow(run, f"{kinds}, error double")

    def predict(self, df: DataFrame, key: str = "id", keep: list[str] | None = None) -> DataFrame:
        out = self.errors(df, key, keep)
        return out.withColumn("prediction", (F.col("error") > F.lit(self.threshold)).cast("int"))


__all__ = ["PCAModel", "Reconstruction", "config", "vector_to_array"]
