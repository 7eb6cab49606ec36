"""Class counts, quotas and the stratified split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def classes_to_augment(df: DataFrame, low: int, high: int) -> DataFrame:
    """Classes with low <= n < high."""
    return df.groupBy("label").agg(F.count("*").alias("n")).where((F.col("n") >= low) & (F.col("n") < high))


def by_count(df: DataFrame) -> DataFrame:
    """label, n, the rarest class first: the order in which classes are worked on."""
    return df.groupBy("label").agg(F.count("*").alias("n")).orderBy("n", "label")


def need(df: DataFrame, low: int, high: int, target: int, original: DataFrame | None = None) -> DataFrame:
    """label, n, need = target - n, n_original (0 if the class had no rows)."""
    out = classes_to_augment(df, low, high).withColumn("need", target - F.col("n"))
    counts = (df if original is None else original).groupBy("label").agg(F.count("*").alias("n_original"))
    return out.join(counts, "label", "left").withColumn("n_original", F.coalesce("n_original", F.lit(0).cast("long")))


def seeded(seed: int, *ids: str | Column) -> Column:
    """A reproducible random order: the MD5 of seed and ids."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(x).cast("string") if isinstance(x, str) else x.cast("string") for x in ids]))


#: Hex digits of the seeded order that divide a class; each further digit divides its parts by 16.
_DIGITS = 3


def seeded_rank(df: DataFrame, label: list[str], order: Column, row_id: str = "row_id") -> DataFrame:
    """Adds rank, from 1, by class in the seeded order. A class is ranked in 4096 parts, so that a hot one is no task of its own."""
    parted = df.withColumn("__h", order).withColumn("__b", F.substring("__h", 1, _DIGITS))
    counts = parted.groupBy(*label, "__b").agg(F.count("*").alias("__n"))
    lower = F.sum("__n").over(Window.partitionBy(*label).orderBy("__b")) - F.col("__n")
    within = F.row_number().over(Window.partitionBy(*label, "__b").orderBy("__h", row_id))
    ranked = parted.withColumn("__r", within).join(counts.select(*label, "__b", lower.alias("__lower")), [*label, "__b"])
    return ranked.withColumn("rank", (F.col("__r") + F.col("__lower")).cast("int")).select(*df.columns, "rank")


def stratified_split(df: DataFrame, share: float = 0.2, seed: int = 42, keep_singletons: bool = True) -> DataFrame:
    """Adds part ('train' or 'test'): of n rows of a class max(1, floor(n * share)) are test.

    A class of one row would leave nothing to train on; it stays in train unless ``keep_singletons`` is off.
    """
    slim = df.select("label", "row_id", seeded(seed, "row_id").alias("h")).withColumn("b", F.substring("h", 1, _DIGITS))
    parts = slim.groupBy("label", "b").agg(F.count("*").alias("n"))
    every = Window.partitionBy("label")
    parts = parts.withColumn("total", F.sum("n").over(every)).withColumn("lower", F.sum("n").over(every.orderBy("b")) - F.col("n"))
    tests = F.greatest(F.lit(1), F.floor(F.col("total") * share))
    if keep_singletons:
        tests = F.when(F.col("total") == 1, 0).otherwise(tests)
    # Only the part of a class in which its test rows end is ranked; texts are never exchanged for it.
    edge = parts.withColumn("left", tests - F.col("lower")).where((F.col("left") > 0) & (F.col("left") <= F.col("n")))
    inside = slim.join(edge.select("label", "b", "left"), ["label", "b"])
    ranked = inside.withColumn("r", F.row_number().over(Window.partitionBy("label", "b").orderBy("h", "row_id")))
    cut = ranked.where(F.col("r") == F.col("left")).select("label", F.struct("h", "row_id").alias("__cut"))
    # One row a class goes out, so that texts stay where they are: dealt by class, they would be as few tasks as classes.
    marked = df.join(F.broadcast(cut), "label", "left")
    own = F.struct(seeded(seed, "row_id").alias("h"), F.col("row_id"))
    return marked.withColumn("part", F.when(own <= F.col("__cut"), "test").otherwise("train")).select(*df.columns, "part")


def split_counts(train: DataFrame, test: DataFrame) -> DataFrame:
    a = train.groupBy("label").agg(F.count("*").alias("n_train"))
    b = test.groupBy("label").agg(F.count("*").alias("n_test"))
    return a.join(b, "label", "left").withColumn("n_test", F.coalesce("n_test", F.lit(0).cast("long")))


def thresholds(df: DataFrame, targets: list[int]) -> DataFrame:
    """One row: classes, fewest and most rows of a class, and how many classes lack each target."""
    n = df.groupBy("label").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_classes"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), *[F.count_if(F.col("n") < t).alias(f"below_{t}") for t in targets])


def marked(df: DataFrame, target: int) -> DataFrame:
    return distribution(df).withColumn("reached", F.when(F.col("n") >= target, "✓").otherwise("✗"))


def examples(df: DataFrame, k: int = 5, seed: int = 42, joined: str = "\n---\n") -> DataFrame:
    """For each class up to k rows in seeded order, joined for a prompt."""
    order = seeded(seed, "row_id")
    top = df.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(order, "row_id"))).where(F.col("rank") <= k)
    return top.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), joined).alias("examples"))


def round_robin(df: DataFrame, needs: DataFrame, seed: int = 42, reshuffle: bool = False) -> DataFrame:
    """(label, slot, row_id): for each of ``need`` slots a source; every source is used once before any is used again.

    With ``reshuffle`` every round has its own order, else all rounds share one.
    """
    sizes = df.groupBy("label").agg(F.count("*").alias("m")).join(needs.select("label", "need").where("need > 0"), "label")
    rounds = sizes.withColumn("round", F.explode(F.sequence(F.lit(0), F.floor((F.col("need") - 1) / F.col("m")).cast("int"))))
    held = df.select("label", "row_id")
    if reshuffle:
        ranked = seeded_rank(held.join(rounds, "label"), ["label", "round"], seeded(seed, "round", "row_id"))
    else:
        # All rounds share one order, so each class is ranked once.
        ranked = seeded_rank(held, ["label"], seeded(seed, "row_id")).join(rounds, "label")
    ranked = ranked.withColumnRenamed("rank", "k")
    slot = F.col("round") * F.col("m") + F.col("k") - 1
    return ranked.withColumn("slot", slot.cast("long")).where(F.col("slot") < F.col("need")).select("label", "slot", "row_id")
