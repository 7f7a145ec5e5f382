"""What each column looks like in either class of a 0/1 target.

All columns go through one unpivoted pass. The only things broadcast are one row per
column and class; bins and grid points are a fixed number per column and class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from needledrop.operators.quantiles import exact_quantiles, long_values
from needledrop.operators.sketches import distinct_estimate, sketch_distinct, sketch_quantiles, sketched

# Columns that are not profiled.
NOT_PROFILED = (
    "ts",
    "platform",
    "conn_country",
    "ip_addr",
    "master_metadata_track_name",
    "master_metadata_album_artist_name",
    "master_metadata_album_album_name",
    "spotify_track_uri",
    "episode_name",
    "episode_show_name",
    "spotify_episode_uri",
    "audiobook_title",
    "audiobook_uri",
    "audiobook_chapter_uri",
    "audiobook_chapter_title",
    "username",
    "obs_id",
    "track_id",
    "album_type",
    "fwdbtn",
)
# Bins of a histogram, points of a density curve.
HISTOGRAM_BINS, DENSITY_POINTS = 50, 200
NUMERIC, CATEGORICAL = "numeric", "categorical"

# exp(-z*z/2) is 0 as a double beyond this many bandwidths.
_REACH = 38.7


def column_roles(df: DataFrame, exclude: tuple[str, ...] = NOT_PROFILED) -> DataFrame:
    """(column, role) in one pass: a number column is numeric unless all its values are 0 or 1.

    "At most two distinct values, all of them 0 or 1" is the same as "all of them 0 or 1",
    so no distinct count is needed. A column without values counts as 0/1.
    """
    fields = [f for f in df.schema if f.name not in exclude]
    checked = [f for f in fields if isinstance(f.dataType, T.NumericType)]
    role = {f.name: F.lit(CATEGORICAL) for f in fields}

    def other(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`").cast("double")
        return F.coalesce(F.max(~c.isin(0.0, 1.0) & ~F.isnan(c)), F.lit(False)).alias(f.name)

    if checked:
        seen = df.agg(*[other(f) for f in checked])
        for f in checked:
            role[f.name] = F.when(F.col(f"`{f.name}`"), NUMERIC).otherwise(CATEGORICAL)
    else:
        seen = df.sparkSession.range(1)
    rows = F.array(*[F.struct(F.lit(n).alias("column"), r.alias("role")) for n, r in role.items()])
    return seen.select(F.inline(rows))


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """(target, n, pct, pct_of_rows): the first share leaves null targets out, the second does not."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    totals = df.agg(F.count(target).alias("_known"), F.count(F.lit(1)).alias("_rows"))
    return (
        counts.where(F.col(target).isNotNull())
        .crossJoin(F.broadcast(totals))
        .select(
            target,
            "n",
            (F.col("n") * F.lit(100.0) / F.col("_known")).alias("pct"),
            (F.col("n") * F.lit(100.0) / F.col("_rows")).alias("pct_of_rows"),
        )
    )


def _classes(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isin(0, 1)).withColumn("target", F.col(target).cast("int"))


def _class_stats(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, target, n, mean, std, min, max) of the usable columns.

    All columns are aggregated side by side, so the rows are not multiplied by the columns.
    """
    values = {c: F.col(f"`{c}`").cast("double") for c in columns}
    wide = _classes(df, target).select(
        "target", *[F.when(~F.isnan(v), v).alias(f"_{i}") for i, v in enumerate(values.values())]
    )
    measures = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    per_class = wide.groupBy("target").agg(
        *[f(f"_{i}").alias(f"_{i}_{m}") for i in range(len(columns)) for m, f in measures.items()]
    )
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"_{i}_{m}").alias(m) for m in measures])
        for i, c in enumerate(columns)
    ]
    stats = per_class.select("target", F.inline(F.array(*rows))).where(F.col("n") > 0)
    # Two rows per column at most: skip a column without values in one class or without any variance.
    of_column = W.partitionBy("column")
    classes = F.count(F.lit(1)).over(of_column)
    varies = F.max(F.col("min") != F.col("max")).over(of_column)
    usable = stats.withColumns({"_classes": classes, "_varies": varies}).where(
        (F.col("_classes") == 2) & F.col("_varies")
    )
    return usable.select("column", "target", *measures)


def class_conditional_stats(df: DataFrame, columns: list[str], target: str, exact: bool = True) -> DataFrame:
    """(column, target, n, mean, std, median, n_distinct).

    The exact distinct count sends every distinct value through a shuffle. Without ``exact`` the median and the
    distinct count come from sketches, with the errors of ``sketches``, and every task sends one row per class.
    """
    rows = _classes(df, target)
    if not exact:
        found = sketched(rows, columns, ["target"])
        medians = sketch_quantiles(found, [0.5], ["target"]).select("column", "target", F.col("value").alias("median"))
        distinct = sketch_distinct(found, ["target"]).drop("n")
        return _with_medians(_class_stats(df, columns, target), medians, distinct)
    long = long_values(rows, columns, ["target"])
    distinct = long.groupBy("column", "target").agg(F.count_distinct("value").alias("n_distinct"))
    medians = exact_quantiles(rows, columns, [0.5], ["target"]).select(
        "column", "target", F.col("value").alias("median")
    )
    return _with_medians(_class_stats(df, columns, target), medians, distinct)


def _with_medians(stats: DataFrame, medians: DataFrame, distinct: DataFrame) -> DataFrame:
    """All three have one row per column and class."""
    joined = stats.join(F.broadcast(medians), ["column", "target"]).join(F.broadcast(distinct), ["column", "target"])
    return joined.select("column", "target", "n", "mean", "std", "median", "n_distinct")


def _long_texts(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    texts = _classes(df, target).select("target", *[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot(["target"], columns, "column", "value").where(F.col("value").isNotNull())


def class_category_counts(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, value, count_0, count_1) over the values of either class; one pass."""
    counts = _long_texts(df, columns, target).groupBy("column", "value").agg(
        F.count(F.when(F.col("target") == 0, 1)).alias("count_0"),
        F.count(F.when(F.col("target") == 1, 1)).alias("count_1"),
    )
    both = counts.groupBy("column").agg(F.sum("count_0").alias("_0"), F.sum("count_1").alias("_1"))
    both = both.where((F.col("_0") > 0) & (F.col("_1") > 0)).select("column")
    return counts.join(F.broadcast(both), "column").orderBy("column", "value")


def class_category_union(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, value): sorted values seen in either class."""
    return _long_texts(df, columns, target).select("column", "value").distinct().orderBy("column", "value")


def class_histogram(
    df: DataFrame, columns: list[str], target: str, bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """(column, target, bin, lower, upper, n, density): equal bins over each class's own range.

    A value belongs to the bin whose edges hold it, [lower, upper) and the last one closed. Division only
    guesses the bin; where rounding put the value beside it, the comparison with the edges moves it by one.
    """
    point = F.col("min") == F.col("max")
    spans = _class_stats(df, columns, target).select(
        "column",
        "target",
        F.col("n").alias("_total"),
        F.when(point, F.col("min") - 0.5).otherwise(F.col("min")).alias("_lo"),
        F.when(point, F.col("max") + 0.5).otherwise(F.col("max")).alias("_hi"),
    )
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    long = long_values(_classes(df, target), columns, ["target"])
    guess = F.greatest(F.lit(0), F.least(F.floor((F.col("value") - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    placed = long.join(F.broadcast(spans), ["column", "target"]).withColumn("_guess", guess)
    edge = F.col("_lo") + F.col("_guess") * width
    next_edge = F.col("_lo") + (F.col("_guess") + 1) * width
    bin_ = (
        F.when((F.col("value") < edge) & (F.col("_guess") > 0), F.col("_guess") - 1)
        .when((F.col("value") >= next_edge) & (F.col("_guess") < bins - 1), F.col("_guess") + 1)
        .otherwise(F.col("_guess"))
    )
    placed = placed.select("column", "target", bin_.alias("bin"))
    counts = placed.groupBy("column", "target", "bin").agg(F.count(F.lit(1)).alias("n"))
    frame = spans.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    n = F.coalesce(F.col("n"), F.lit(0).cast("bigint"))
    return frame.join(F.broadcast(counts), ["column", "target", "bin"], "left").select(
        "column",
        "target",
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("lower"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("upper"),
        n.alias("n"),
        (n / (F.col("_total") * width)).alias("density"),
    )


def _density_setup(df: DataFrame, columns: list[str], target: str, points: int) -> DataFrame:
    """(column, target, _n, _lo, _step, _h): where a curve starts, its grid and its bandwidth n**(-1/5) * std."""
    stats = _class_stats(df, columns, target).where((F.col("n") > 1) & (F.col("std") > 0))
    return stats.select(
        "column",
        "target",
        F.col("n").alias("_n"),
        F.col("min").alias("_lo"),
        ((F.col("max") - F.col("min")) / F.lit(float(points - 1))).alias("_step"),
        (F.pow(F.col("n").cast("double"), F.lit(-0.2)) * F.col("std")).alias("_h"),
    )


def class_kde(
    df: DataFrame, columns: list[str], target: str, points: int = DENSITY_POINTS
) -> DataFrame:
    """(column, target, point, x, density): Gaussian kernels, bandwidth n**(-1/5) * std.

    Equal values are counted first, and a value is only sent to the grid points its kernel
    reaches as a double; at large n the bandwidth is small and that is a few of them.
    """
    setup = _density_setup(df, columns, target, points)
    values = long_values(_classes(df, target), columns, ["target"])
    values = values.groupBy("column", "target", "value").agg(F.count(F.lit(1)).alias("_w"))
    reach = F.col("_h") * _REACH
    offset = F.col("value") - F.col("_lo")
    first = F.greatest(F.lit(0), F.ceil((offset - reach) / F.col("_step"))).cast("int")
    final = F.least(F.lit(points - 1), F.floor((offset + reach) / F.col("_step"))).cast("int")
    reached = F.when(first <= final, F.sequence(first, final)).otherwise(F.array().cast("array<int>"))
    hit = values.join(F.broadcast(setup), ["column", "target"]).select(
        "column", "target", "value", "_w", "_lo", "_step", "_h", F.explode(reached).alias("point")
    )
    z = (F.col("value") - (F.col("_lo") + F.col("point") * F.col("_step"))) / F.col("_h")
    sums = hit.groupBy("column", "target", "point").agg(
        F.sum(F.col("_w") * F.exp(F.lit(-0.5) * z * z)).alias("_sum")
    )
    grid = setup.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    scale = F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi))
    return grid.join(F.broadcast(sums), ["column", "target", "point"], "left").select(
        "column",
        "target",
        "point",
        (F.col("_lo") + F.col("point") * F.col("_step")).alias("x"),
        (F.coalesce(F.col("_sum"), F.lit(0.0)) / scale).alias("density"),
    )


def class_kde_binned(
    df: DataFrame, columns: list[str], target: str, points: int = DENSITY_POINTS, tolerance: float = 1e-6
) -> DataFrame:
    """(column, target, point, x, density, error): the curve of ``class_kde`` from linear bins, for large tables.

    A value between two nodes of a fine mesh counts for both, by its distance, and the kernel sums run over
    the nodes. With a mesh of d * h that changes a curve by at most d * d / 8 of a kernel's highest value, and so
    no more than by 0.9 * ``tolerance`` of it; kernels end where they are below the other tenth. ``error``
    is that bound as a density. A task sends one row per cell that it has seen, and the cells are at most as many
    as distinct values, or the range over the mesh; the exact form sends every distinct value.
    """
    if not 0 < tolerance < 1:
        raise ValueError("the tolerance must lie between 0 and 1")
    setup = _density_setup(df, columns, target, points)
    mesh = F.col("_h") * math.sqrt(8 * 0.9 * tolerance)
    reach = F.col("_h") * math.sqrt(-2 * math.log(0.1 * tolerance))
    place = (F.col("value") - F.col("_lo")) / F.col("_mesh")
    values = long_values(_classes(df, target), columns, ["target"])
    located = values.join(F.broadcast(setup.select("column", "target", "_lo", mesh.alias("_mesh"))), ["column", "target"]).select(
        "column", "target", F.floor(place).alias("_cell"), (place - F.floor(place)).alias("_part")
    )
    cells = located.groupBy("column", "target", "_cell").agg(F.count(F.lit(1)).alias("_w"), F.sum("_part").alias("_right"))
    nodes = cells.select(
        "column",
        "target",
        F.inline(
            F.array(
                F.struct(F.col("_cell").alias("_node"), (F.col("_w") - F.col("_right")).alias("_mass")),
                F.struct((F.col("_cell") + 1).alias("_node"), F.col("_right").alias("_mass")),
            )
        ),
    )
    placed = nodes.join(F.broadcast(setup), ["column", "target"]).withColumn("_at", F.col("_node") * mesh)
    first = F.greatest(F.lit(0), F.ceil((F.col("_at") - reach) / F.col("_step"))).cast("int")
    final = F.least(F.lit(points - 1), F.floor((F.col("_at") + reach) / F.col("_step"))).cast("int")
    reached = F.when(first <= final, F.sequence(first, final)).otherwise(F.array().cast("array<int>"))
    z = (F.col("_at") - F.col("point") * F.col("_step")) / F.col("_h")
    sums = (
        placed.select("column", "target", "_at", "_mass", "_step", "_h", F.explode(reached).alias("point"))
        .groupBy("column", "target", "point")
        .agg(F.sum(F.col("_mass") * F.exp(F.lit(-0.5) * z * z)).alias("_sum"))
    )
    grid = setup.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    peak = F.lit(1 / math.sqrt(2 * math.pi)) / F.col("_h")
    return grid.join(F.broadcast(sums), ["column", "target", "point"], "left").select(
        "column",
        "target",
        "point",
        (F.col("_lo") + F.col("point") * F.col("_step")).alias("x"),
        (F.coalesce(F.col("_sum"), F.lit(0.0)) * peak / F.col("_n")).alias("density"),
        (peak * tolerance).alias("error"),
    )


def dataset_summary(df: DataFrame, by: str, user: str, obs_id: str, label: str, track: str, exact: bool = True) -> DataFrame:
    """One row per value of ``by``: rows, users, tracks, id range, positives.

    Without ``exact`` users and tracks are counted by sketches, within ``sketches.distinct_error``.
    """
    distinct = F.count_distinct if exact else lambda c: distinct_estimate(F.col(c))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        distinct(user).alias("n_users"),
        distinct(track).alias("n_tracks"),
        F.min(obs_id).alias("min_obs_id"),
        F.max(obs_id).alias("max_obs_id"),
        F.sum(label).cast("bigint").alias("n_positive"),
    )
