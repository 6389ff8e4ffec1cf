"""Text feature models that are fitted once and kept: vocabulary, weights and singular directions as one table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import features, spectra
from quillon.sources.tables import cut

#: A vocabulary of so many numbers may be broadcast, once counted.
BROADCAST_NUMBERS = 1 << 21


@dataclass
class TextModel:
    """What a fit leaves: (term, idf, x) of each known term, the singular values, and how texts are read.

    With `idf`, a row is its terms' counts times idf, of length 1; else the counts.
    """

    vocabulary: DataFrame
    values: list[float]
    grams: int
    idf: bool

    def transform(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, x) of every distinct key: its row on the fitted directions, zeros without a known term.

        Unknown terms are passed over; the texts of one key are one text; a
        null key stays one key.  One join with the vocabulary and one grouped
        sum, in which a term that all rows have is not gathered anywhere.
        """
        rank = len(self.values)
        small = self.vocabulary.count() * (rank + 1) <= BROADCAST_NUMBERS
        counts = features.terms(df, key, text, self.grams).groupBy(key, "term").agg(F.count("*").alias("_tf"))
        known = self.vocabulary.withColumnRenamed("x", "_x")
        joined = counts.join(F.broadcast(known) if small else known, "term").withColumn("_w", F.col("_tf") * F.col("idf"))
        sums = joined.groupBy(key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_l"), *(F.sum(F.col("_w") * F.col("_x")[k]).alias(f"_{k}") for k in range(rank)))
        length = F.col("_l") if self.idf else F.lit(1.0)
        rows = sums.select(F.col(key).alias("_key"), F.array(*(F.col(f"_{k}") / length for k in range(rank))).alias("x"))
        keys = df.select(key).distinct()
        zeros = F.array_repeat(F.lit(0.0), rank)
        return keys.join(rows, keys[key].eqNullSafe(rows["_key"]), "left").select(key, F.coalesce("x", zeros).alias("x"))

    def save(self, path: str) -> None:
        """Writes the model under a path that all executors see."""
        spark = self.vocabulary.sparkSession
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        spark.createDataFrame([([float(v) for v in self.values], self.grams, self.idf)], "values array<double>, grams int, idf boolean").write.mode("overwrite").parquet(f"{path}/model")


def load_text_model(spark: SparkSession, path: str) -> TextModel:
    how = spark.read.parquet(f"{path}/model").first()
    return TextModel(spark.read.parquet(f"{path}/vocabulary"), list(how["values"]), how["grams"], how["idf"])


def fit_text_model(df: DataFrame, key: str, text: str, rank: int, grams: int = 2, max_df: float = 0.95, min_df: int = 1, idf: bool = True, **how) -> TextModel:
    """A model of the rows' words and word pairs (up to `grams` words) on their leading `rank` singular directions.

    Terms in over max_df of the rows, or in fewer than min_df rows, are not
    known.  idf = ln((1 + rows) / (1 + rows with the term)) + 1.  `how` goes to
    the eigensolver (block, basis, tolerance).  A table without terms gives a
    model without directions.
    """
    counts = cut(features.terms(df, key, text, grams).groupBy(key, "term").agg(F.count("*").alias("tf")))
    n = df.select(key).distinct().count()
    frequency = counts.groupBy("term").agg(F.count("*").alias("_df")).filter((F.col("_df") >= min_df) & (F.col("_df") <= max_df * n))
    weight = F.log((1 + F.lit(n)) / (1 + F.col("_df"))) + 1 if idf else F.lit(1.0)
    known = cut(frequency.select("term", weight.cast("double").alias("idf")))
    raw = counts.join(known, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("_w"))
    if idf:
        length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_l"))
        raw = raw.join(length, key).withColumn("_w", F.col("_w") / F.col("_l"))
    values, right = spectra.singular_directions(cut(raw.select(key, "term", "_w")), key, "term", "_w", rank, **how)
    return TextModel(cut(known.join(right, "term")), [float(v) for v in values], grams, idf)
