"""The corpus pipeline: toxicity, quality, near-duplicates, repeated spans, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Between stages the
documents are written as Parquet to the shared folder and read again. Stages read the five columns of
documents and no others; all but the last return these five.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.llm.common import table
from needledrop.llm.packing import pack
from needledrop.llm.quality import resample
from needledrop.llm.repeats import remove_repeats
from needledrop.llm.simhash import near_duplicates
from needledrop.llm.toxicity import toxicity
from needledrop.sources.store import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a 128-bit name of each row's content: ids may be null or repeated, and equal rows fare alike."""
    # Hashes pass over nulls, so which columns are null is hashed too.
    nulls = F.concat(*[F.col(c).isNull().cast("string") for c in COLUMNS])
    lanes = [F.lpad(F.hex(F.xxhash64(F.lit(lane), *[F.col(c) for c in COLUMNS], nulls)), 16, "0") for lane in (1, 2)]
    return docs.select(*COLUMNS, F.concat(*lanes).alias("row_key"))


def _only(keyed: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose row_key is in ``verdict``."""
    v = verdict.select(F.col("row_key").alias("_key"))
    return keyed.join(v, F.col("row_key") == F.col("_key"), "left_semi")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that are predicted toxic go."""
    rows = _keyed(docs)
    marked = toxicity(rows, table(spark, sf_dir, "labels"), carry=("row_key",))
    return _only(rows, marked.groupBy("row_key").agg(F.max("predicted").alias("toxic")).where("toxic = 0")).select(*COLUMNS)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: documents that the resampling does not draw go."""
    rows = _keyed(docs)
    drawn = resample(rows, table(spark, sf_dir, "labels"), carry=("row_key",))
    return _only(rows, drawn.groupBy("row_key").agg(F.min("kept").alias("kept")).where("kept")).select(*COLUMNS)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: of each group of near-duplicates one row stays, that of the smallest doc_id; null ids come last.

    Near-duplicates are reached by SimHash fingerprints of three-word shingles that differ in three bits at most.
    """
    rows = _keyed(docs)
    groups = near_duplicates(rows, most=3, words_each=3, carry=("row_key",))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("first")
    kept = _only(rows, groups.groupBy("root").agg(first).select("first.row_key"))
    # Only rows that are equal in all columns can be left twice.
    return kept.dropDuplicates(["row_key"]).select(*COLUMNS)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: words of spans of 35 and more that occur again go; documents that lose all stay, empty."""
    left = remove_repeats(docs.select(*COLUMNS), window=35)
    return left.select("row.doc_id", F.col("kept").alias("text"), "row.lang", "row.source", F.length("kept").cast("bigint").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: pieces of sequences of 2048 tokens."""
    return pack(docs, with_ids=False)


STAGES = [
    ("toxicity", clean),
    ("quality classifier", good),
    ("SimHash near-dedup", single),
    ("substring dedup", unrepeated),
    ("packing", packed),
]

# Trained scores, fingerprints and a tokenizer are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every result is written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
