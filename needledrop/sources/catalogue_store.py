"""A catalogue folder whose documents are parsed once.

Every file has a name: its path, time and length. The store has a manifest of the files that are parsed, and a folder
of documents per run. A run parses the files that the manifest does not name, and adds them to it when their
documents are complete, so a run that dies counts for nothing. Files that went or changed are left out on reading.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from needledrop.operators.tracks import CATALOGUE_SCHEMA
from needledrop.sources.scans import JSON_FILES, parsed_documents
from needledrop.sources.store import path_exists, settled

_FILE = ["path", "modified", "length"]
_NAMED = [T.StructField("path", T.StringType()), T.StructField("modified", T.TimestampType()), T.StructField("length", T.LongType())]
_KINDS = T.StructType([*_NAMED, T.StructField("run", T.StringType())])
_STORED = T.StructType([*_NAMED, *CATALOGUE_SCHEMA.fields])


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, length, location) of the documents in the folder itself; no file is opened."""
    files = spark.read.format("binaryFile").options(pathGlobFilter=JSON_FILES, recursiveFileLookup=False).load(folder)
    return files.select(
        F.col("_metadata.file_path").alias("path"), F.col("modificationTime").alias("modified"), "length", F.col("path").alias("location")
    )


def kept_catalogue(spark: SparkSession, folder: str, store: str) -> tuple[DataFrame, DataFrame, int]:
    """The documents of ``folder`` as ``read_catalogue`` gives them, the undecodable files, and how many files were parsed now.

    Only files that are new, or have another time or length, are parsed. Undecodable files are (path, modified,
    length): those without any document; they are not tried again until they change. Empty files are passed
    over, as in ``read_catalogue``. The paths of new files pass the driver, which lists the folder anyway. An empty folder gives empty tables.
    """
    store = store.rstrip("/")
    manifest = f"{store}/manifest"
    files = settled(listed(spark, folder), "listing")
    known = spark.read.schema(_KINDS).parquet(manifest) if path_exists(spark, manifest) else spark.createDataFrame([], _KINDS)
    new = settled(files.join(known, _FILE, "left_anti"), "new-files")
    # A path is read as a pattern, so its signs are escaped.
    paths = [re.sub(r"([\\*?\[\]{}])", r"\\\1", r["location"]) for r in new.select("location").toLocalIterator()]
    if paths:
        run = uuid.uuid4().hex
        named = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("length")]
        parsed_documents(spark, paths, named).write.parquet(f"{store}/run-{run}")
        new.select(*_FILE, F.lit(run).alias("run")).write.mode("append").parquet(manifest)
        known = spark.read.schema(_KINDS).parquet(manifest)
    # A file that came back as it was may be named by two runs: one of them counts.
    current = known.join(files.select(*_FILE), _FILE, "left_semi").groupBy(*_FILE).agg(F.min("run").alias("run"))
    current = settled(current, "current-files")
    runs = sorted(r["run"] for r in current.select("run").distinct().collect())
    if not runs:
        return spark.createDataFrame([], CATALOGUE_SCHEMA), current.select(*_FILE), 0
    rows = None
    for run in runs:
        part = spark.read.schema(_STORED).parquet(f"{store}/run-{run}").withColumn("run", F.lit(run))
        rows = part if rows is None else rows.unionByName(part)
    documents = rows.join(current, [*_FILE, "run"], "left_semi").select(*CATALOGUE_SCHEMA.names)
    return documents, current.join(rows, [*_FILE, "run"], "left_anti").select(*_FILE), len(paths)
