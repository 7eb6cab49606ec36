"""Classification metrics from one confusion aggregate of (label, prediction)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def report(df: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support over all labels and predictions; a ratio with nothing below it is 0."""
    c = confusion(df)
    sides = c.select("label", F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"))
    sides = sides.unionByName(c.select(F.col("prediction").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))
    t = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    return t.select(
        "label",
        ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
    )


def summary(df: DataFrame) -> DataFrame:
    """balanced_accuracy: mean recall over the classes that occur; macro_f1: mean over labels and predictions."""
    return report(df).agg(F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))


def delta(results: DataFrame, base: str = "baseline", other: str = "augmented") -> DataFrame:
    """(model, metric, delta) of a table (stage, model, balanced_accuracy, macro_f1), joined by model."""
    long = results.unpivot(["stage", "model"], ["balanced_accuracy", "macro_f1"], "metric", "value")
    a = long.where(F.col("stage") == other).select("model", "metric", F.col("value").alias("a"))
    b = long.where(F.col("stage") == base).select("model", "metric", F.col("value").alias("b"))
    return a.join(b, ["model", "metric"]).select("model", "metric", F.round(F.col("a") - F.col("b"), 4).alias("delta"))


def results_pivot(results: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """(model, baseline, augmented) of a metric, as a chart shows them; a stage that was not run is null."""
    return results.groupBy("model").pivot("stage", ["baseline", "augmented"]).agg(F.first(metric))
