"""Stand-ins for plays, catalogue, labels and trials, derived from the given tables.

Each view is a list of SQL expressions that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

PLAYS = {
    "obs_id": "event_id",
    "ts": "ts",
    "username": "user_id",
    "value": "value",
    "k": K,
    "reason_end": "CASE WHEN event_type = 'click' THEN 'fwdbtn' ELSE event_type END",
    "fwdbtn": "CASE WHEN event_type = 'click' THEN 1 ELSE 0 END",
    "spotify_track_uri": (
        f"CASE WHEN {K} % 13 = 0 THEN NULL WHEN {K} >= 90 THEN concat('spotify:track:x', CAST({K} AS VARCHAR(10))) "
        f"ELSE concat('spotify:track:', CAST({K} AS VARCHAR(10))) END"
    ),
    "master_metadata_track_name": f"CASE WHEN {K} % 10 < 9 THEN concat('t', CAST({K} AS VARCHAR(10))) END",
    "episode_name": f"CASE WHEN {K} % 10 = 9 THEN concat('e', CAST({K} AS VARCHAR(10))) END",
    "platform": (
        f"CASE {K} % 10 WHEN 0 THEN 'Windows 10 (x64)' WHEN 1 THEN 'Android OS 11' WHEN 2 THEN 'iOS 14.4 (iPhone12,1)' "
        "WHEN 3 THEN 'Linux [x86-64 0]' WHEN 4 THEN 'OS X 11.2.3' WHEN 5 THEN 'Partner google cast_tv' "
        "WHEN 6 THEN 'WebPlayer (websocket)' WHEN 7 THEN 'playstation' WHEN 9 THEN 'Android Chromecast' END"
    ),
    "value_nullable": f"CASE WHEN {K} % 7 = 0 THEN NULL ELSE value END",
    "conn_country": f"CASE WHEN {K} < 1 THEN 'rare' WHEN {K} < 40 THEN 'AR' WHEN {K} < 80 THEN 'US' WHEN {K} < 95 THEN 'BR' END",
    "shuffle": f"CASE WHEN {K} % 5 = 0 THEN NULL ELSE {K} % 2 = 0 END",
    "audiobook_title": "CAST(NULL AS VARCHAR(10))",
}
PLAYS_FROM = "events"

TRACKS = {
    "track_id": "CAST(p_partkey AS VARCHAR(10))",
    "duration_ms": "CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE CAST(floor(p_retailprice * 300) AS BIGINT) END",
    "explicit": "(p_partkey % 4 = 0)",
    "popularity": "p_size",
    "track_number": "CAST(p_partkey % 20 AS INT)",
    "available_markets_count": "CAST(p_partkey % 6 AS INT)",
    "album_type": "p_type",
    "release_date": (
        "CASE p_partkey % 7 WHEN 0 THEN '1999' WHEN 1 THEN '2005-07' WHEN 2 THEN '2012-07-04' WHEN 3 THEN '0000' "
        "WHEN 4 THEN '' WHEN 5 THEN '2020-13' ELSE '2030-01-01' END"
    ),
}
TRACKS_FROM = "part"

# The fields of plays as a text file would hold them, and mixtures of them.
WRITTEN = {
    "id": "CAST(event_id AS VARCHAR(30))",
    "amount": "CAST(value AS VARCHAR(30))",
    "share": "CAST(CAST(value / 1000 AS DECIMAL(12, 6)) AS VARCHAR(30))",
    "maybe_number": f"CASE WHEN {K} % 7 > 0 THEN CAST({K} AS VARCHAR(10)) END",
    "flag": f"CASE {K} % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'False' END",
    "flag_or_number": f"CASE {K} % 3 WHEN 0 THEN 'True' ELSE '1' END",
    "one_word": f"CASE WHEN event_id = 7 THEN 'none yet' ELSE CAST({K} AS VARCHAR(10)) END",
    "one_fraction": f"CASE WHEN event_id = 7 THEN '0.5' ELSE CAST({K} AS VARCHAR(10)) END",
    "wide": f"concat('1', CAST({K} AS VARCHAR(10)), '0000000000000000000')",
    "signed": f"CASE WHEN {K} % 2 = 0 THEN concat('-', CAST({K} AS VARCHAR(10))) ELSE concat('+0', CAST({K} AS VARCHAR(10))) END",
    "power": f"concat(CAST({K} AS VARCHAR(10)), 'e-3')",
    "name": "event_type",
    "nothing": "CAST(NULL AS VARCHAR(10))",
}

USER_ORDERS = {"obs_id": "o_orderkey", "username": "o_custkey", "ts": "o_orderdate"}
SCORED = {
    "obs_id": "event_id",
    "y": "CASE WHEN event_type = 'click' THEN 1 ELSE 0 END",
    "score": "round(value / 20, 0)",
    "fine_score": "value",
    "pred": "CASE WHEN value > 34 THEN 1 ELSE 0 END",
}
TRIALS = {"tid": "p_partkey", "max_depth": "p_size", "mean_cv_score": "p_retailprice / 1000"}

# A small model fitted on plays, as exported: (tree, node, feature, threshold, left, right, prediction).
# Feature 0 is k (-1 where null) and 1 is value; a leaf has feature -1.
SAVED_WEIGHTS = (1.0, 0.3, 0.3, 0.3)
SAVED_NODES = (
    (0, 0, 1, 124.11, 1, 4, -0.5988), (0, 1, 0, 5.5, 2, 3, -0.60566), (0, 2, -1, 0.0, -1, -1, -0.53546), (0, 3, -1, 0.0, -1, -1, -0.61026),
    (0, 4, 1, 126.45, 5, 6, -0.52195), (0, 5, -1, 0.0, -1, -1, -0.12821), (0, 6, -1, 0.0, -1, -1, -0.54161),
    (1, 0, 1, 1.825, 1, 4, -0.12623), (1, 1, 1, 0.635, 2, 3, 0.02558), (1, 2, -1, 0.0, -1, -1, -0.19811), (1, 3, -1, 0.0, -1, -1, 0.13695),
    (1, 4, 1, 2.375, 5, 6, -0.13177), (1, 5, -1, 0.0, -1, -1, -0.40698), (1, 6, -1, 0.0, -1, -1, -0.12839),
    (2, 0, 1, 273.045, 1, 4, -0.07357), (2, 1, 1, 141.005, 2, 3, -0.07213), (2, 2, -1, 0.0, -1, -1, -0.07865), (2, 3, -1, 0.0, -1, -1, 0.04004),
    (2, 4, 0, 22.5, 5, 6, -0.44166), (2, 5, -1, 0.0, -1, -1, 0.37886), (2, 6, -1, 0.0, -1, -1, -0.59084),
    (3, 0, 0, 4.5, 1, 4, -0.04404), (3, 1, 1, 135.155, 2, 3, 0.03711), (3, 2, -1, 0.0, -1, -1, 0.00827), (3, 3, -1, 0.0, -1, -1, 0.55618),
    (3, 4, 1, 165.365, 5, 6, -0.04826), (3, 5, -1, 0.0, -1, -1, -0.04429), (3, 6, -1, 0.0, -1, -1, -0.15602),
)

# Plays from here on are the held-out frame.
TEST_FROM = "TIMESTAMP '2024-01-25 00:00:00'"
IS_TEST = f"ts >= {TEST_FROM}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, source: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def plays(spark: SparkSession, sf_dir: str, minute: bool = False) -> DataFrame:
    """``minute`` cuts the time to the minute, so that plays tie."""
    columns = dict(PLAYS)
    if minute:
        columns["ts"] = MINUTE_SPARK
    return view(spark, sf_dir, PLAYS_FROM, columns)


MINUTE_SPARK = (
    "make_timestamp_ntz(year(ts), month(ts), dayofmonth(ts), hour(ts), minute(ts), CAST(0 AS DECIMAL(8, 6)))"
)
MINUTE_DUCKDB = "date_trunc('minute', ts)"


def heavy(columns: dict[str, str], row: str) -> dict[str, str]:
    """The same columns with a third of all rows given to one user."""
    return {**columns, "username": f"CASE WHEN {row} % 3 = 0 THEN 0 ELSE {columns['username']} END"}


def heavy_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays to the minute."""
    return view(spark, sf_dir, PLAYS_FROM, heavy({**PLAYS, "ts": MINUTE_SPARK}, "event_id"))


def heavy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "orders", heavy(USER_ORDERS, "o_orderkey"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TRACKS_FROM, TRACKS)


def user_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "orders", USER_ORDERS)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events", SCORED)


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "part", {**TRIALS, "fold_scores": "array(p_retailprice / 1000)"})


def labeled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")


def _sql(source: str, columns: dict[str, str]) -> str:
    listed = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    return f"SELECT {listed} FROM {source}"


SQL_VIEWS = {
    "plays": _sql(PLAYS_FROM, PLAYS),
    "minute_plays": _sql(PLAYS_FROM, {**PLAYS, "ts": MINUTE_DUCKDB}),
    "heavy_plays": _sql(PLAYS_FROM, heavy({**PLAYS, "ts": MINUTE_DUCKDB}, "event_id")),
    "heavy_orders": _sql("orders", heavy(USER_ORDERS, "o_orderkey")),
    "written": _sql(PLAYS_FROM, WRITTEN),
    "tracks": _sql(TRACKS_FROM, TRACKS),
    "user_orders": _sql("orders", USER_ORDERS),
    "scored": _sql("events", SCORED),
    "trials": _sql("part", TRIALS),
    "labeled_docs": (
        "SELECT d.doc_id, d.n_chars, d.lang, d.source, l.quality, l.toxic "
        "FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
    ),
}
