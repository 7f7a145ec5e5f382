"""Ranking and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row ``auc``, exact, ties counted as half.

    Rows are first added up per score. The scores are then laid out by range, each range adds
    up on its own, and only the totals of the ranges meet in one task. A score that fills
    a third of the table is one row by then.
    """
    per_score = df.groupBy(F.col(score).alias("_s")).agg(
        F.sum(F.col(label).cast("bigint")).alias("_p"),
        F.sum((1 - F.col(label)).cast("bigint")).alias("_n"),
    )
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid_out = per_score.repartitionByRange(ranges, "_s").withColumn("_range", F.spark_partition_id())
    below = W.partitionBy("_range").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    laid_out = laid_out.withColumn("_below", F.coalesce(F.sum("_n").over(below), zero))
    # Pairs in halves, so that the sums stay whole numbers of full precision.
    pairs = F.col("_p").cast("decimal(18,0)") * (2 * F.col("_below") + F.col("_n")).cast("decimal(19,0)")
    per_range = laid_out.groupBy("_range").agg(
        F.sum("_p").alias("_p"), F.sum("_n").alias("_n"), F.sum(pairs.cast("decimal(38,0)")).alias("_half_pairs")
    )
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    per_range = per_range.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), zero))
    won = F.sum(F.col("_half_pairs").cast("double") / 2 + F.col("_p").cast("double") * F.col("_offset"))
    all_pairs = F.sum("_p").cast("double") * F.sum("_n")
    return per_range.agg(F.when(all_pairs > 0, won / all_pairs).alias("auc"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, precision, recall, f1, support) per class, then accuracy and the two averages."""

    def cell(actual: int, predicted: int) -> Column:
        return F.count(F.when((F.col(label) == actual) & (F.col(prediction) == predicted), 1)).cast("double")

    cells = df.agg(*[cell(a, p).alias(f"c{a}{p}") for a in (0, 1) for p in (0, 1)])

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    for k in (0, 1):
        hit, other = F.col(f"c{k}{k}"), 1 - k
        cells = cells.withColumns(
            {
                f"s{k}": hit + F.col(f"c{k}{other}"),
                f"p{k}": ratio(hit, hit + F.col(f"c{other}{k}")),
                f"r{k}": ratio(hit, hit + F.col(f"c{k}{other}")),
            }
        )
        cells = cells.withColumn(
            f"f{k}", ratio(2 * F.col(f"p{k}") * F.col(f"r{k}"), F.col(f"p{k}") + F.col(f"r{k}"))
        )
    total = F.col("s0") + F.col("s1")
    accuracy = ratio(F.col("c00") + F.col("c11"), total)

    def row(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"),
            p.alias("precision"),
            r.alias("recall"),
            f.alias("f1"),
            s.cast("bigint").alias("support"),
        )

    def average(name: str, weights: tuple[Column, Column]) -> Column:
        def mean(letter: str) -> Column:
            weighted = F.col(f"{letter}0") * weights[0] + F.col(f"{letter}1") * weights[1]
            return ratio(weighted, weights[0] + weights[1])

        return row(name, mean("p"), mean("r"), mean("f"), total)

    one = F.lit(1.0)
    rows = [row(str(k), *[F.col(f"{x}{k}") for x in "prfs"]) for k in (0, 1)]
    rows.append(row("accuracy", accuracy, accuracy, accuracy, total))
    rows.append(average("macro avg", (one, one)))
    rows.append(average("weighted avg", (F.col("s0"), F.col("s1"))))
    return cells.select(F.inline(F.array(*rows)))


def feature_importance(df: DataFrame, top: int) -> DataFrame:
    """The ``top`` largest rows of (feature, importance)."""
    return df.orderBy(F.desc("importance"), "feature").limit(top)


def trial_summary(trials: DataFrame, top: int) -> DataFrame:
    """The ``top`` trials by score, with loss, spread of the fold scores and a mark on the best.

    ``trials`` has ``tid``, ``mean_cv_score`` and ``fold_scores``; a failed trial has a null
    score and takes no part.
    """
    done = trials.where(F.col("mean_cv_score").isNotNull())
    best = done.agg(F.max_by("tid", F.struct("mean_cv_score", -F.col("tid"))).alias("_best"))
    mean = F.aggregate("fold_scores", F.lit(0.0), lambda a, x: a + x) / F.size("fold_scores")
    spread = F.sqrt(
        F.aggregate(F.transform("fold_scores", lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
        / F.size("fold_scores")
    )
    return (
        done.crossJoin(F.broadcast(best))
        .withColumns(
            {
                "loss": -F.col("mean_cv_score"),
                "std_cv_score": spread,
                "is_best": F.col("tid") == F.col("_best"),
            }
        )
        .drop("_best")
        .orderBy(F.desc("mean_cv_score"), "tid")
        .limit(top)
    )
