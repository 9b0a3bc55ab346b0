"""Question router: logistic regression on embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train_and_predict(rows: DataFrame, key: str, vector: str, label: str, held_out: int = 5, seed: int = 42) -> DataFrame:
    """``key``, ``label``, ``predicted`` of one in ``held_out`` rows by hash; the others train."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = rows.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).alias("label"), (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(held_out)) == 0).alias("_held"))
    model = LogisticRegression(maxIter=30, regParam=0.01).fit(data.where("not _held"))
    return model.transform(data.where("_held")).select(key, "label", F.col("prediction").alias("predicted"))
