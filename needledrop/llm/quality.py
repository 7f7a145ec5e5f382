"""Quality by importance resampling.

Two generative models of hashed word n-grams (1 and 2 words): one of target text (labelled good), one of all
raw text. A document's weight is the mean log ratio of its n-grams under the two, times a temperature, so
length decides nothing. Documents are drawn without replacement by Gumbel top-k: each weight gets
Gumbel noise from a hash of the document, and the k largest sums stay. The temperature is high, so
documents are drawn nearly in the order of their weight, and noise decides only between close ones.

The raw model counts every n-gram of every document; counts are combined per task before they shuffle and
end as one number per bucket. The k-th largest sum is found by counting in ever finer bins.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.llm.common import ship
from needledrop.sources.store import settled

_SHAPE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_REMEMBERED = 600_000


class _Tokens(dict):
    """Hashes of the letter runs, digit runs and signs of a white-space word; signs count, case too."""

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= _REMEMBERED:
            self.clear()
        parts = _SHAPE.findall(word)
        found = self[word] = np.array([zlib.crc32(p.encode("utf-8", "surrogatepass")) for p in parts], np.uint32)
        return found


def features(text: str | None, buckets: int, memory: dict) -> np.ndarray:
    """Buckets of all 1-grams and 2-grams of a whole text."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64)
    one = np.concatenate([memory[w] for w in words]).astype(np.uint64)
    two = (one[:-1] * np.uint64(0x9E3779B1) ^ one[1:]) * np.uint64(0x85EBCA77C2B2AE63)
    half = buckets // 2
    return np.concatenate([one * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32), half + (two >> np.uint64(32)) % np.uint64(half)]).astype(np.int64) % np.concatenate(
        [np.full(len(one), half), np.full(len(two), buckets)]
    )


def counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, target, raw): n-grams in target documents and in all; ``docs`` has text and target."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, total = _Tokens(), np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, target in zip(batch.column("text"), batch.column("target").to_pylist()):
                found = np.bincount(features(text.as_py(), buckets, memory), minlength=buckets)
                total[1] += found
                if target:
                    total[0] += found
        used = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_pydict({"bucket": used, "target": total[0][used], "raw": total[1][used]})

    seen = docs.mapInArrow(count, "bucket long, target long, raw long")
    return seen.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def log_ratio(found: list[tuple[int, int, int]], buckets: int) -> np.ndarray:
    """Smoothed log p(bucket | target) - log p(bucket | raw)."""
    target, raw = np.zeros(buckets), np.zeros(buckets)
    for bucket, t, r in found:
        target[bucket], raw[bucket] = t, r
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


def top_k_bound(keys: DataFrame, k: int, bits: int = 12) -> int | None:
    """The k-th largest ``key`` (a long), None with fewer rows: counted in 2**bits bins at a time."""
    if k <= 0:
        return None
    low, shift = -(1 << 63), 64
    rest = k
    while shift > 0:
        step = max(0, shift - bits)
        # Bins of the rows above `low` that share the bits settled so far.
        inside = keys if shift == 64 else keys.where((F.col("key") >= low) & (F.col("key") <= low + (1 << shift) - 1))
        bins = inside.groupBy(F.shiftright(F.col("key"), step).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        for row in sorted(bins.collect(), key=lambda r: -r["bin"]):
            if rest <= row["n"]:
                low, shift = row["bin"] << step, step
                break
            rest -= row["n"]
        else:
            return None
    return low


def resample(
    docs: DataFrame, labels: DataFrame, keep: float | None = None, margin: float = 0.01, target_rows: int = 20_000,
    buckets: int = 1 << 15, temperature: float = 200.0, seed: int = 3, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, kept) of every row of documents.

    ``keep`` is the share of rows to draw; by default the share of good ones among the labelled rows of
    this table and ``margin`` more, as good rows shall not be lost to the error of that share. Documents with the smallest drawn key are all kept, so ties and repeated rows fare alike.
    The target model is fitted on the ``target_rows`` good rows of smallest hash, the raw one on all rows.
    Null and empty texts have weight 0. Null labels are no labels; without a good one all weights are 0, and
    without any label all rows stay. Of other columns those in ``carry`` are added; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text, *carry)
    # At most target_rows ids, so no text is shuffled to be told whether it is one of them.
    chosen = marks.where("quality = 1").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").limit(target_rows)
    good = F.broadcast(chosen.select("doc_id", F.lit(True).alias("target")))
    found = counts(rows.join(good, "doc_id", "left").select("text", "target"), buckets)
    ratio = spark.sparkContext.broadcast(log_ratio([tuple(r) for r in found.collect()], buckets))  # one row per bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Tokens()
        for batch in batches:
            at = [features(t.as_py(), buckets, memory) for t in batch.column("text")]
            mean = [float(ratio.value[a].mean()) if len(a) else 0.0 for a in at]
            more = {c: batch.column(c) for c in carry}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "log_weight": pa.array(mean, pa.float64())} | more)

    kinds = dict(rows.dtypes)
    schema = ", ".join(["doc_id long", "log_weight double", *(f"{c} {kinds[c]}" for c in carry)])
    weighed = rows.mapInArrow(weigh, schema).withColumn("log_weight", F.col("log_weight") * temperature)
    # Uniform in (0, 1) from a hash of the id, as 52 bits and a half.
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    drawn = weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    # Millionths keep the order of the keys as whole numbers.
    drawn = settled(drawn.withColumn("key", F.round(F.col("gumbel_key") * 1e6).cast("bigint")), "gumbel-keys")
    n = drawn.count()
    if keep is None:
        share = drawn.select("doc_id").distinct().join(marks, "doc_id").agg(F.avg("quality").alias("share")).first()["share"]
        keep = 1.0 if share is None else min(1.0, float(share) + margin)
    bound = top_k_bound(drawn, int(np.ceil(keep * n)))
    kept = F.lit(False) if bound is None else F.col("key") >= bound
    return drawn.select("doc_id", "log_weight", "gumbel_key", kept.alias("kept"), *carry)
