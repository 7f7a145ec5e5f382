"""Imputation and encoding as Spark ML stages, fitted on a declared set of rows.

A fitted stage keeps only small values on the driver: one fill per column, and per
category column the values above the frequency cut, of which there are at most 1 / cut.
The categories below the cut have no such bound and stay a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from needledrop.operators.columns import UNKNOWN
from needledrop.operators.quantiles import exact_quantiles, smallest_modes
from needledrop.sources.store import settled

# How encoded columns are named.
NUMBER_PREFIX, CATEGORY_PREFIX, MERGED = "num__", "cat__", "infrequent_sklearn"

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def learn_fills(df: DataFrame, numbers: list[str], texts: list[str]) -> tuple[dict, dict]:
    """Median per number column and smallest mode per text column; one row per column comes back."""
    medians, modes = {}, {}
    if numbers:
        medians = {r["column"]: r["value"] for r in exact_quantiles(df, numbers, [0.5]).collect()}
    if texts:
        found = {r["column"]: r["value"] for r in smallest_modes(df, texts).collect()}
        modes = {c: found.get(c, UNKNOWN) for c in texts}
    return medians, modes


def filled(df: DataFrame, column: str, value) -> Column:
    """``column`` with its nulls replaced; an integer column stays one if the fill is whole."""
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(kind, _INTEGERS):
        if float(value).is_integer():
            return F.coalesce(c, F.lit(int(value)).cast(kind))
        return F.coalesce(c.cast("double"), F.lit(float(value)))
    if isinstance(kind, T.NumericType):
        return F.coalesce(c, F.lit(float(value)).cast(kind))
    return F.coalesce(c, F.lit(value).try_cast(kind))


class _Columns(Params):
    numberCols = Param(Params._dummy(), "numberCols", "columns filled by their median", TypeConverters.toListString)
    textCols = Param(Params._dummy(), "textCols", "columns filled by their mode", TypeConverters.toListString)


class _Fills(Params):
    medians = Param(Params._dummy(), "medians", "fill per number column")
    modes = Param(Params._dummy(), "modes", "fill per text column")


class ColumnImputer(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Median for numbers, most frequent value for everything else."""

    @keyword_only
    def __init__(self, *, numberCols=(), textCols=()):
        super().__init__()
        self._setDefault(numberCols=[], textCols=[])
        self._set(numberCols=list(numberCols), textCols=list(textCols))

    def _fit(self, dataset: DataFrame) -> "ColumnImputerModel":
        medians, modes = learn_fills(
            dataset, self.getOrDefault(self.numberCols), self.getOrDefault(self.textCols)
        )
        return ColumnImputerModel(medians=medians, modes=modes)


class ColumnImputerModel(Model, _Fills, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, medians=None, modes=None):
        super().__init__()
        self._set(medians=dict(medians or {}), modes=dict(modes or {}))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fills = {**self.getOrDefault(self.medians), **self.getOrDefault(self.modes)}
        new = {c: filled(dataset, c, v) for c, v in fills.items()}
        return dataset.withColumns(new) if new else dataset


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) over the filled category columns."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = texts.unpivot([], columns, "column", "value").where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


class FeatureEncoder(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Numbers as they are, categories as one 0/1 column per frequent value.

    Categories under ``cut`` of the fitted rows share one column; a category that was not
    there at fit time is 0 in every column. ``spreadBy`` names a well-spread column, such as
    the row id. ``tableDir`` is where the rare categories are written; without it they
    stay a lazy frame and the model cannot be saved.
    """

    cut = Param(Params._dummy(), "cut", "share below which a category is merged", TypeConverters.toFloat)
    spreadBy = Param(Params._dummy(), "spreadBy", "well-spread column", TypeConverters.toString)
    tableDir = Param(Params._dummy(), "tableDir", "folder for the rare categories", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, numberCols=(), textCols=(), cut=0.01, spreadBy="obs_id", tableDir=""):
        super().__init__()
        self._set(
            numberCols=list(numberCols), textCols=list(textCols), cut=cut, spreadBy=spreadBy, tableDir=tableDir
        )

    def _fit(self, dataset: DataFrame) -> "FeatureEncoderModel":
        numbers, texts = self.getOrDefault(self.numberCols), self.getOrDefault(self.textCols)
        if not 0 < self.getOrDefault(self.cut) <= 1:
            raise ValueError("cut must be above 0 and at most 1: it bounds the categories that are kept")
        medians, modes = learn_fills(dataset, numbers, texts)
        kept: dict[str, list[str]] = {c: [] for c in texts}
        merged: list[str] = []
        rare = None
        if texts:
            full = dataset.select(*[filled(dataset, c, modes[c]).alias(c) for c in texts])
            total = F.broadcast(dataset.agg((F.count(F.lit(1)) * F.lit(self.getOrDefault(self.cut))).alias("_least")))
            counts = settled(category_counts(full, texts).crossJoin(total), "categories")
            frequent = F.col("n") >= F.col("_least")
            summary = counts.groupBy("column").agg(
                F.sort_array(F.collect_list(F.when(frequent, F.col("value")))).alias("kept"),
                F.bool_or(~frequent).alias("merged"),
            )
            for row in summary.collect():
                kept[row["column"]] = list(row["kept"])
                if row["merged"]:
                    merged.append(row["column"])
            rare = counts.where(~frequent).select("column", "value")
        path = ""
        if self.getOrDefault(self.tableDir) and merged:
            path = f"{self.getOrDefault(self.tableDir).rstrip('/')}/rare-{self.uid}"
            rare.write.mode("overwrite").partitionBy("column").parquet(path)
        model = FeatureEncoderModel(
            numberCols=numbers, textCols=texts, medians=medians, modes=modes, kept=kept,
            merged=sorted(merged), rareTable=path, spreadBy=self.getOrDefault(self.spreadBy),
        )
        model._rare = rare
        return model


class FeatureEncoderModel(Model, _Columns, _Fills, DefaultParamsReadable, DefaultParamsWritable):
    kept = Param(Params._dummy(), "kept", "frequent values per category column")
    merged = Param(Params._dummy(), "merged", "columns with rare values", TypeConverters.toListString)
    rareTable = Param(Params._dummy(), "rareTable", "table of rare values", TypeConverters.toString)
    spreadBy = Param(Params._dummy(), "spreadBy", "well-spread column", TypeConverters.toString)

    @keyword_only
    def __init__(
        self, *, numberCols=(), textCols=(), medians=None, modes=None, kept=None, merged=(), rareTable="", spreadBy=""
    ):
        super().__init__()
        self._rare = None
        self._set(
            numberCols=list(numberCols), textCols=list(textCols), medians=dict(medians or {}),
            modes=dict(modes or {}), kept=dict(kept or {}), merged=list(merged), rareTable=rareTable,
            spreadBy=spreadBy,
        )

    def _rare_values(self, spark: SparkSession) -> DataFrame:
        path = self.getOrDefault(self.rareTable)
        rare = spark.read.parquet(path) if path else self._rare
        if rare is None:
            raise ValueError("the rare categories were not saved; fit with tableDir set")
        columns = [F.col("column").cast("string").alias("_of"), F.col("value").cast("string").alias("_value")]
        return rare.select(*columns, F.lit(True).alias("_seen"))

    def with_groups(self, df: DataFrame) -> DataFrame:
        """Replace each category column by its kept value, the word for merged ones, or null.

        Values outside the short lists are looked up in the table of rare ones, those of all columns by one join
        of (column, value). Rows without such a value take no part in it.
        """
        kept, merged = self.getOrDefault(self.kept), set(self.getOrDefault(self.merged))
        modes, columns, order = self.getOrDefault(self.modes), self.getOrDefault(self.textCols), df.columns
        texts = {c: filled(df, c, modes[c]).cast("string") for c in columns}

        def frequent(c: str) -> Column:
            return F.coalesce(F.col(f"`{c}`").isin(kept[c]), F.lit(False)) if kept[c] else F.lit(False)

        open_to = [c for c in columns if c in merged]
        plain = {c: F.when(frequent(c), F.col(f"`{c}`")) for c in columns}
        if not open_to:
            return df.withColumns(texts).withColumns(plain) if columns else df

        def asking(c: str) -> Column:
            # Said of the column as it comes: conditions on what is also renamed below multiply in the optimizer.
            raw = F.col(f"`{c}`").cast("string")
            filled_in = F.when(raw.isNull(), 0 if str(modes[c]) in kept[c] else 1)
            return (filled_in.when(raw.isin(kept[c]), 0) if kept[c] else filled_in).otherwise(1)

        asks = reduce(lambda a, b: a + b, map(asking, open_to))
        sure = df.where(asks == 0).withColumns(texts).withColumns(plain)
        open_rows = df.where(asks > 0).withColumns(texts)

        # A row is known by its content; equal rows share their answers and are counted.
        row = F.struct(*[F.col(f"`{c}`") for c in order]).alias("_row")
        asked = [F.when(~frequent(c), F.struct(F.lit(c).alias("_of"), F.col(f"`{c}`").alias("_value"))) for c in open_to]
        named = open_rows.select(row, F.array(*asked).alias("_asked"), *[F.xxhash64(F.lit(i), F.to_json(row)).alias(f"_h{i}") for i in (0, 1)])
        # The row itself goes once, under a name that no value has and that differs from row to row.
        own = F.struct(F.lit("").alias("_of"), F.concat(F.lit("\x00"), F.col("_h0").cast("string")).alias("_value"))
        long = named.select("_h0", "_h1", "_row", F.posexplode(F.concat(F.array(own), "_asked")).alias("_at", "_ask")).where("_ask IS NOT NULL")
        long = long.select("_h0", "_h1", F.when(F.col("_at") == 0, F.col("_row")).alias("_row"), "_ask.*")
        answers = long.join(self._rare_values(df.sparkSession), ["_of", "_value"], "left").groupBy("_h0", "_h1").agg(
            F.first("_row", ignorenulls=True).alias("_row"), F.count("_row").alias("_n"),
            F.collect_set(F.when(F.col("_seen"), F.col("_of"))).alias("_merged"),
        )
        back = answers.select("_row.*", "_merged", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy"))

        def group(c: str) -> Column:
            found = F.when(frequent(c), F.col(f"`{c}`"))
            return found.when(F.array_contains("_merged", c), F.lit(MERGED)) if c in merged else found

        return sure.select(*order).unionByName(back.withColumns({c: group(c) for c in columns}).select(*order))

    def feature_names(self) -> list[str]:
        kept, merged = self.getOrDefault(self.kept), set(self.getOrDefault(self.merged))
        names = [NUMBER_PREFIX + c for c in self.getOrDefault(self.numberCols)]
        for c in self.getOrDefault(self.textCols):
            names += [f"{CATEGORY_PREFIX}{c}_{v}" for v in kept[c]]
            if c in merged:
                names.append(f"{CATEGORY_PREFIX}{c}_{MERGED}")
        return names

    def _encoded(self, df: DataFrame) -> list[Column]:
        """One double per feature name; ``df`` holds the groups."""
        kept, merged = self.getOrDefault(self.kept), set(self.getOrDefault(self.merged))
        medians = self.getOrDefault(self.medians)
        cols = []
        for c in self.getOrDefault(self.numberCols):
            cols.append((filled(df, c, medians[c]) if c in medians else F.col(c)).cast("double"))
        for c in self.getOrDefault(self.textCols):
            values = kept[c] + ([MERGED] if c in merged else [])
            cols += [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for v in values]
        return cols

    def wide(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and one double column per feature."""
        grouped = self.with_groups(df)
        named = [c.alias(n) for c, n in zip(self._encoded(grouped), self.feature_names())]
        return grouped.select(*keep, *named)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """All columns and a ``features`` vector, sparse where that is smaller; the category columns hold their group."""
        grouped = self.with_groups(dataset)
        # The size is told, so that the assembler does not read a row to learn it.
        size = {"ml_attr": {"num_attrs": len(self.feature_names())}}
        dense = grouped.withColumn("_dense", array_to_vector(F.array(*self._encoded(grouped))).alias("_dense", metadata=size))
        return VectorAssembler(inputCols=["_dense"], outputCol="features", handleInvalid="keep").transform(dense).drop("_dense")
