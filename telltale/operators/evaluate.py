"""Evaluation of scores against labels: all of it aggregates, nothing collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Least area and detection, most false positives at 10 and at 25.
PROSE_FLOORS = {"auc": 0.95, "detection_10": 0.85, "false_positive_10": 0.10, "false_positive_25": 0.0}
CODE_FLOORS = {"auc": 0.95, "detection_10": 0.80, "false_positive_10": 0.10, "false_positive_25": 0.0}


def score_counts(df: DataFrame, score: str, positive: str, run: str | None = None) -> DataFrame:
    """``score, label, k``: how many texts of each label (1 or 0) have each score; all that an evaluation needs of a table, and what
    can be stored and added up later. With ``run`` by that column too.

    Texts are counted first, and those without a score or a label are told apart only then, so that no filter is pushed below the score
    and computes it again.
    """
    own = [F.col(run).alias("run")] if run else []
    told = df.groupBy(*own, F.col(score).cast("double").alias("score"), F.col(positive).cast("long").alias("label")).agg(F.count(F.lit(1)).alias("k"))
    return told.where("score IS NOT NULL AND label IS NOT NULL")


def merged(counts: DataFrame) -> DataFrame:
    """Counts of several runs as those of one."""
    return counts.groupBy("score", "label").agg(F.sum("k").alias("k"))


def append_counts(counts: DataFrame, path: str, run: str) -> None:
    """Stores a run's counts beside those of others; a run that is there already is replaced, so it may be repeated."""
    counts.select("score", "label", "k").write.mode("overwrite").parquet(f"{path}/run={run}")


def stored_counts(spark: SparkSession, path: str, runs: list[str] | None = None) -> DataFrame:
    """``run, score, label, k`` of stored runs, or of some of them."""
    found = spark.read.schema("score double, label long, k long, run string").parquet(path)
    return found.where(F.col("run").isin(*runs)) if runs is not None else found


def auc_of(counts: DataFrame) -> DataFrame:
    """Area under the curve from counts of each distinct score; ties count a half. No pair is ever built.

    Losses below a score are summed over ranges of scores, then within a range. The ranges, 64 to a point, are few enough for one task.
    """
    s = F.col("score").alias("s")
    both = counts.groupBy(s).agg(F.sum(F.col("k") * F.col("label")).alias("p"), F.sum(F.col("k") * (1 - F.col("label"))).alias("n")).withColumn("r", F.floor(F.col("s") * 64))
    inside = F.sum("n").over(Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    won = F.sum(F.col("p") * (F.coalesce("own", F.lit(0)) + F.col("n") / 2.0))
    ranges = both.withColumn("own", inside).groupBy("r").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), won.alias("won"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = ranges.withColumn("below", below).agg(F.sum(F.col("won") + F.col("p") * F.col("below")).alias("won"), (F.sum("p") * F.sum("n")).alias("pairs"))
    return total.select(F.bround(F.try_divide(F.col("won"), F.col("pairs").cast("double")), 6).alias("auc"))


def medians_of(counts: DataFrame) -> DataFrame:
    """The upper median of each label, from the running count of its distinct scores, which rounding keeps few."""
    label = Window.partitionBy("label")
    so_far = counts.withColumns({"_to": F.sum("k").over(label.orderBy("score")), "_half": F.expr("sum(k) OVER (PARTITION BY label) DIV 2")})
    past = F.col("_to") > F.col("_half")
    return so_far.agg(*[F.min(F.when(past & (F.col("label") == i), F.col("score"))).alias(f"median_{name}") for i, name in ((1, "positive"), (0, "negative"))])


def summary_of(counts: DataFrame) -> DataFrame:
    """One row of counts, means, upper medians, maxima, detection and false-positive rates at 10 and 25, and the area."""
    k, s = F.col("k"), F.col("score")
    of = {"positive": F.col("label") == 1, "negative": F.col("label") == 0}
    n = {name: F.coalesce(F.sum(F.when(which, k)), F.lit(0)) for name, which in of.items()}
    part = lambda name, x: F.bround(F.try_divide(F.sum(F.when(of[name], x)).cast("double"), F.sum(F.when(of[name], k)).cast("double")), 6)
    rate = lambda name, t: part(name, F.when(s >= t, k).otherwise(0))
    told = counts.agg(
        n["positive"].alias("n_positive"), n["negative"].alias("n_negative"), part("positive", s * k).alias("mean_positive"), part("negative", s * k).alias("mean_negative"),
        F.max(F.when(of["negative"], s)).alias("max_negative"), rate("positive", 10).alias("detection_10"), rate("positive", 25).alias("detection_25"),
        rate("negative", 10).alias("false_positive_10"), rate("negative", 25).alias("false_positive_25"),
    )
    return told.crossJoin(medians_of(counts)).crossJoin(auc_of(counts))  # one row each; what they count is shuffled once


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """``auc_of`` the counts of ``df``, which is read once."""
    return auc_of(score_counts(df, score, positive))


def summary(df: DataFrame, score: str, positive: str) -> DataFrame:
    """``summary_of`` the counts of ``df``, which is read once."""
    return summary_of(score_counts(df, score, positive))


#: What a gate compares, and whether more of it is better.
GATED = {"auc": True, "detection_10": True, "detection_25": True, "false_positive_10": False, "false_positive_25": False}


def regressions(current: DataFrame, last: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """``metric, before, now`` of what is worse than in the last run's summary by more than ``tolerance``."""
    rows = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in GATED])).alias("x")).select("x.*")
    both = rows(current, "now").join(F.broadcast(rows(last, "before")), "metric")
    better = F.col("metric").isin(*[m for m, more in GATED.items() if more])
    loss = F.when(better, F.col("before") - F.col("now")).otherwise(F.col("now") - F.col("before"))
    return both.where(loss > tolerance).select("metric", "before", "now")


def failures(summarised: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Adds ``floor_failures``, the names of what misses its floor."""
    tests = [F.when(F.col(k) < v if not k.startswith("false") else F.col(k) > v, F.lit(k)) for k, v in floors.items()]
    return summarised.withColumn("floor_failures", F.array_compact(F.array(*tests)))


def score_table(df: DataFrame, name: str, score: str, positive: str, size: str, language: str) -> DataFrame:
    """Samples as lines of a table, positive ones first, the highest scores first: ``position, value``."""
    row = F.format_string("  %6.1f  %-36s (%d, %s)", score, name, size, language)
    place = F.row_number().over(Window.partitionBy(positive).orderBy(F.desc(score), name))
    return df.select(F.when(F.col(positive) == 1, "positive").otherwise("negative").alias("label"), place.alias("position"), row.alias("value"))


def summary_lines(summarised: DataFrame) -> DataFrame:
    """The summary of ``failures`` as lines of one string: ``value``."""
    c, rate = F.col, lambda n: F.format_string("%5.1f%%", F.col(n) * 100)
    lines = F.array(
        F.format_string("AUC: %.4f", "auc"),
        F.format_string("positive: mean %.1f  median %.1f", "mean_positive", c("median_positive").cast("double")),
        F.format_string("negative: mean %.1f  highest %.1f", "mean_negative", c("max_negative").cast("double")),
        F.concat(F.lit("detection at 10: "), rate("detection_10"), F.lit("  at 25: "), rate("detection_25")),
        F.concat(F.lit("false positives at 10: "), rate("false_positive_10"), F.lit("  at 25: "), rate("false_positive_25")),
    )
    broken = F.transform("floor_failures", lambda x: F.concat(F.lit("floor missed: "), x))
    return summarised.select(F.array_join(F.concat(lines, broken), "\n").alias("value"))


def check_status(summarised: DataFrame) -> DataFrame:
    """One row: 1 if any summary of ``failures`` misses a floor, else 0."""
    return summarised.agg(F.max((F.size("floor_failures") > 0).cast("int")).alias("exit_status"))
