"""Token counts through a digest cache.

A text is known by the SHA-256 of its normalised content (null is empty), a count by that digest and the
digest of the tokenizer's file. Counts are joined from the cache; only distinct texts that it lacks are
encoded, and their counts are appended to it. A scan drops the copies it sees before texts are dealt
out by digest, so a text that a third of all rows hold is one row per task; texts travel compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.llm.common import partitions, ship, tokenizer_path
from needledrop.sources.store import path_exists, settled


def version_digest(name: str) -> str:
    """SHA-256 of a vocabulary file: a changed file is another version."""
    with open(tokenizer_path(name), "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def counter(name: str, ranks: str | None = None):
    """A function text -> number of tokens, as the library of the file gives it by default."""
    if name.endswith(".model"):
        def count(text: str) -> int:
            from needledrop.llm.pieces import processor

            return len(processor(name).encode(text))
    else:
        def count(text: str) -> int:
            from needledrop.llm.vocab import byte_count, plain_ids

            return byte_count(name, ranks, text) if ranks else len(plain_ids(name, text))
    return count


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compress texts; a copy of a text that this task has seen is left out."""
    pack, seen = zstandard.ZstdCompressor(level=3), set()
    for batch in batches:
        digests, blobs = [], []
        for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text")):
            if digest not in seen:
                seen.add(digest)
                digests.append(digest)
                blobs.append(pack.compress(text.as_py().encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.binary()), "blob": pa.array(blobs, pa.binary())})


def _encode(count):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last = zstandard.ZstdDecompressor(), None
        for batch in batches:
            digests, numbers = [], []
            for digest, blob in zip(batch.column("digest").to_pylist(), batch.column("blob")):
                if digest != last:  # equal digests are neighbours
                    digests.append(digest)
                    numbers.append(count(unpack.decompress(blob.as_py()).decode("utf-8", "surrogatepass")))
                    last = digest
            yield pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.binary()), "n_tokens": pa.array(numbers, pa.int64())})

    return encode


def token_counts(docs: DataFrame, cache: str, tokenizer: str, ranks: str | None = None, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; ``cache`` is a folder that all executors reach.

    No begin, end or added special tokens; special strings in texts as the library's default treats
    them; nothing is cut. ``ranks`` names the same byte-level vocabulary as ranks, for speed. Null and
    empty texts have no bytes and no tokens. Repeated rows give a row each; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    named = docs.select("doc_id", text).withColumn("digest", F.unhex(F.sha2("text", 256)))
    place = f"{cache.rstrip('/')}/version={version_digest(tokenizer)}"
    schema = "digest binary, n_tokens long"

    def stored() -> DataFrame:
        return spark.read.schema(schema).parquet(place) if path_exists(spark, place) else spark.createDataFrame([], schema)

    texts = named.select("digest", "text").mapInArrow(_distinct, "digest binary, blob binary")
    missing = texts.join(stored().select("digest"), "digest", "left_anti")
    dealt = missing.repartition(partitions(docs), "digest").sortWithinPartitions("digest")
    dealt.mapInArrow(_encode(counter(tokenizer, ranks)), schema).write.mode("append").parquet(place)
    # An append that was repeated after a failure may have left a count twice.
    known = settled(stored().dropDuplicates(["digest"]), "token-counts")
    rows = named.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes"))
    return rows.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
