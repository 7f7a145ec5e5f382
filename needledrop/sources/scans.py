"""Readers for play tables and the track catalogue, with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from needledrop.functions import wall_clock
from needledrop.operators.columns import null_nans
from needledrop.operators.inference import typed_alike
from needledrop.operators.tracks import CATALOGUE_SCHEMA
from needledrop.sources.quoted import read_quoted

_CORRUPT = "_corrupt"


def _fields(names: str, kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names.split()]


# The columns of the play table and of its enriched form.
_RAW_FIELDS = [
    *_fields("obs_id", T.LongType()),
    *_fields("ts", T.TimestampType()),
    *_fields(
        "username platform conn_country ip_addr master_metadata_track_name "
        "master_metadata_album_artist_name master_metadata_album_album_name spotify_track_uri "
        "episode_name episode_show_name spotify_episode_uri audiobook_title audiobook_uri "
        "audiobook_chapter_uri audiobook_chapter_title reason_end",
        T.StringType(),
    ),
    *_fields("offline_timestamp", T.DoubleType()),
]
_FLAGS = "shuffle offline incognito_mode"
_TRACK_FIELDS = [
    *_fields("track_id album_type", T.StringType()),
    *_fields("duration_normalized popularity track_number available_markets_count release_year", T.FloatType()),
    *_fields("fwdbtn", T.IntegerType()),
]
PLAY_SCHEMA = T.StructType(_RAW_FIELDS + _fields(_FLAGS, T.BooleanType()))
# The enriched table has its flags filled and stored as 0/1.
ENRICHED_SCHEMA = T.StructType(_RAW_FIELDS + _TRACK_FIELDS + _fields(_FLAGS + " explicit", T.ByteType()))

# Texts that stand for a missing value in a delimited file.
MISSING_WORDS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
# Names under which a stored row index turns up.
INDEX_COLUMNS = ("_c0", "Unnamed: 0")


def _header(spark: SparkSession, path: str, sep: str, multi_line: bool) -> list[str]:
    return spark.read.options(header=True, sep=sep, escape='"', multiLine=multi_line).csv(path).columns


def _read_delimited(
    spark: SparkSession, path: str, sep: str, schema: T.StructType | None, known: T.StructType, multi_line: bool = False
) -> tuple[DataFrame, list[str]]:
    """The rows, and the names of the columns that are not known, which are text."""
    unknown: list[str] = []
    if schema is None:
        # The file's own columns in their order; types from ``known``, text for the rest.
        types = {f.name: f.dataType for f in known}
        names = _header(spark, path, sep, multi_line)
        unknown = [c for c in names if c not in types and c not in INDEX_COLUMNS]
        schema = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in names])
    # Text without a zone is read as UTC, whatever the session says; a quote is escaped by doubling it.
    options = {"timeZone": "UTC", "escape": '"'}
    if multi_line:
        df = read_quoted(spark, path, sep, schema, schema.names, options)
    else:
        df = spark.read.options(**options, header=True, sep=sep, enforceSchema=True).schema(schema).csv(path)
    df = df.drop(*INDEX_COLUMNS)
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    present = {c: F.when(~F.col(f"`{c}`").isin(*MISSING_WORDS), F.col(f"`{c}`")) for c in texts}
    return _normalised(df.withColumns(present) if present else df), unknown


def _normalised(df: DataFrame) -> DataFrame:
    df = null_nans(df)
    return wall_clock(df, "ts") if "ts" in df.columns else df


def read_plays(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """Tab-separated plays with a header; ``multi_line`` for quoted line breaks.

    Without a schema the columns that a play table does not have are given the narrowest type that fits.
    """
    df, unknown = _read_delimited(spark, path, "\t", schema, PLAY_SCHEMA, multi_line)
    return typed_alike([df], unknown)[0]


def read_play_frames(spark: SparkSession, paths: tuple[str, ...], multi_line: bool = False) -> list[DataFrame]:
    """Several play tables whose further columns have one type in all of them."""
    read = [_read_delimited(spark, p, "\t", None, PLAY_SCHEMA, multi_line) for p in paths]
    return typed_alike([df for df, _ in read], sorted({c for _, unknown in read for c in unknown}))


def read_enriched(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """Plays already joined with the catalogue: a CSV path, or else Parquet."""
    return read_enriched_frames(spark, (path,), schema, multi_line)[0]


def read_enriched_frames(
    spark: SparkSession, paths: tuple[str, ...], schema: T.StructType | None = None, multi_line: bool = False
) -> list[DataFrame]:
    """Several joined tables whose further CSV columns have one type in all of them."""
    frames, further = [], set()
    for path in paths:
        unknown: list[str] = []
        if path.rstrip("/").endswith(".csv"):
            df, unknown = _read_delimited(spark, path, ",", schema, ENRICHED_SCHEMA, multi_line)
        else:
            df = _normalised(spark.read.parquet(path))
        frames.append(df)
        further.update(unknown)
    # A Parquet table beside a CSV one keeps the types it has.
    texts = [c for c in sorted(further) if all(c not in df.columns or isinstance(df.schema[c].dataType, T.StringType) for df in frames)]
    return typed_alike(frames, texts)


# Catalogue files by name, in either case.
JSON_FILES = "*.[jJ][sS][oO][nN]"


def parsed_documents(spark: SparkSession, paths: str | list[str], keep: list[Column] | None = None) -> DataFrame:
    """``keep`` and the fields of the JSON documents in files or folders; unreadable files are skipped."""
    schema = T.StructType([*CATALOGUE_SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())])
    docs = (
        spark.read.schema(schema)
        .options(
            multiLine=True,
            mode="PERMISSIVE",
            columnNameOfCorruptRecord=_CORRUPT,
            pathGlobFilter=JSON_FILES,
            recursiveFileLookup=False,
        )
        .json(paths)
    )
    return docs.where(F.col(_CORRUPT).isNull()).select(*(keep or []), *CATALOGUE_SCHEMA.names)


def read_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON document per ``.json`` file of the folder itself; unreadable files are skipped."""
    return parsed_documents(spark, folder)


def parse_documents(df: DataFrame, text: str, schema: T.StructType, keep: list[str]) -> DataFrame:
    """``keep`` and the fields of a JSON text column; rows that are not JSON are skipped."""
    full = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(text), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    rows = df.select(*keep, parsed.alias("_doc")).where(
        F.col("_doc").isNotNull() & F.col(f"_doc.{_CORRUPT}").isNull()
    )
    return rows.select(*keep, *[F.col(f"_doc.{f.name}").alias(f.name) for f in schema.fields])
