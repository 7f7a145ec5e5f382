"""Token ids as files of length-delimited binary records, with an offset index beside them.

A record is framed as its length (8 bytes), the masked CRC-32C of these bytes, the payload and the masked
CRC-32C of the payload, all little-endian: the framing of the widespread ``.tfrecord`` files. The payload is
the document's id, one byte that tells whether the id is null and how wide a token id is, and the ids.

Documents are sorted by range, each task writes the files of its range, and a file ends after the record
that fills it. File names are new in every attempt of a task, and the index is a Parquet table that Spark
commits: what the index names is complete, whatever tasks or executors were lost, and files that it does not
name count for nothing. Files are written and read through Arrow's file systems (local or shared folders,
hdfs, s3, gs), by the full address that Spark gives the folder.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from needledrop.llm.common import partitions, ship
from needledrop.llm.crc32c import crc32c, masked

_HEAD, _HEAD_SIZE = "<qB", 9  # document id; 2 or 4 bytes an id, and 128 for a null document id
_NULL = 128
_FRAME = 12  # bytes before the payload; four follow it
_AT_ONCE = 4 << 20  # payload bytes that are framed at once

_INDEX = "part int, file string, at long, size long, doc_id long, n_tokens long, before long"


def _file_system(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def _address(spark: SparkSession, folder: str) -> str:
    """The folder with scheme and host, as the executors need it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + found.removeprefix("file:") if found.startswith("file:/") and not found.startswith("file://") else found


def frames(payloads: list[bytes]) -> list[bytes]:
    """Each payload with its length and checksums around it."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    lengths = sizes.astype("<u8").view(np.uint8)
    of_length = masked(crc32c(lengths, np.arange(len(sizes)) * 8, np.full(len(sizes), 8))).astype("<u4").tobytes()
    of_data = masked(crc32c(np.frombuffer(b"".join(payloads), np.uint8), np.cumsum(sizes) - sizes, sizes)).astype("<u4").tobytes()
    length = lengths.tobytes()
    return [
        b"".join((length[8 * i : 8 * i + 8], of_length[4 * i : 4 * i + 4], p, of_data[4 * i : 4 * i + 4]))
        for i, p in enumerate(payloads)
    ]


def payloads(data: bytes) -> list[memoryview]:
    """The payloads of whole records; raises ValueError where a length or a checksum is wrong."""
    view, starts, sizes, at = memoryview(data), [], [], 0
    while at < len(data):
        if at + _FRAME > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        (size,) = struct.unpack_from("<Q", data, at)
        if at + _FRAME + size + 4 > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        starts.append(at + _FRAME)
        sizes.append(size)
        at += _FRAME + size + 4
    raw = np.frombuffer(data, np.uint8)
    begin, length = np.array(starts, np.int64), np.array(sizes, np.int64)
    for start, size, end in ((begin - _FRAME, np.full(len(begin), 8), begin - 4), (begin, length, begin + length)):
        stored = np.zeros(len(begin), np.uint32)
        for byte in range(4):
            stored |= raw[end + byte].astype(np.uint32) << np.uint32(8 * byte)
        wrong = masked(crc32c(raw, start, size)) != stored
        if wrong.any():
            raise ValueError(f"checksum of the record at byte {starts[int(wrong.argmax())] - _FRAME} is wrong")
    return [view[s : s + n] for s, n in zip(starts, sizes)]


def unpacked(payload: memoryview) -> tuple[int | None, np.ndarray]:
    """Document id and token ids of a payload."""
    doc, kind = struct.unpack_from(_HEAD, payload)
    return (None if kind & _NULL else doc), np.frombuffer(payload, f"<u{kind & 7}", offset=_HEAD_SIZE)


def _write(address: str, tokenizer: str, end_id: int, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from needledrop.llm.vocab import id_type, word_ids

        store, path = _file_system(address)
        part, kind = TaskContext.get().partitionId(), id_type(tokenizer)
        end, width = np.array([end_id], kind), np.dtype(kind).itemsize
        out, name, at, before = None, "", 0, 0

        def flush(docs: list, bodies: list[bytes]) -> pa.RecordBatch:
            nonlocal out, name, at, before
            rows: dict[str, list] = {f.split()[0]: [] for f in _INDEX.split(", ")}
            for doc, body, frame in zip(docs, bodies, frames(bodies)):
                if out is None:
                    name, at = f"part-{part:06d}-{uuid.uuid4().hex}.tfrecord", 0
                    out = store.open_output_stream(f"{path}/{name}")
                out.write(frame)
                n = (len(body) - _HEAD_SIZE) // width
                for column, value in zip(rows.values(), (part, name, at, len(body), doc, n, before)):
                    column.append(value)
                at, before = at + len(frame), before + n
                if at >= file_bytes:
                    out.close()
                    out = None
            kinds = {"part": pa.int32(), "file": pa.string()}
            return pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in rows.items()})

        for batch in batches:
            docs, bodies, held = [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(word_ids(tokenizer, text.as_py() or ""), end).astype(f"<u{width}")
                bodies.append(struct.pack(_HEAD, doc or 0, width | _NULL * (doc is None)) + ids.tobytes())
                docs.append(doc)
                held += len(bodies[-1])
                if held >= _AT_ONCE:
                    yield flush(docs, bodies)
                    docs, bodies, held = [], [], 0
            if docs:
                yield flush(docs, bodies)
        if out is not None:
            out.close()

    return write


def write_records(
    docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, file_bytes: int = 32 << 20
) -> str:
    """Write every document's ids and ``end_id`` below ``folder``, ascending by doc_id; returns ``folder``.

    Records go to ``folder/data`` in files of about ``file_bytes``, the index to ``folder/index``: part, file,
    ``at`` (byte offset of the frame), ``size`` (of the payload), doc_id, n_tokens, ``before`` (tokens of the part
    before it). Order is doc_id with nulls first; rows of one id are ordered by a hash of their text, and equal
    rows are written as often as they occur. Null and empty texts are the end id alone. Other columns are
    ignored; no documents give an index without rows. The folder must be new.
    """
    spark = docs.sparkSession
    ship(spark)
    address = _address(spark, f"{folder}/data")
    # The folder is made by Spark, so that it exists wherever Spark's paths lead.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(address)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The row number only parts equal rows, so that a hot id fills several ranges.
    order = ["doc_id", "tie", "row"]
    narrow = narrow.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = narrow.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(_write(address, tokenizer, end_id, file_bytes), _INDEX).write.parquet(f"{folder}/index")
    return folder


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


def _read(address: str, with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _file_system(address)
        for batch in batches:
            for name, start, records in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "records"))):
                with store.open_input_file(f"{path}/{name}") as source:
                    found = payloads(source.read())
                if len(found) != records:
                    raise ValueError(f"{name} has {len(found)} records, its index {records}")
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                tokens = []
                for payload in found:
                    doc, ids = unpacked(payload)
                    for column, value in zip(out.values(), (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        column.append(value)
                    start += len(ids)
                    if with_ids:
                        tokens.append(ids)
                columns = {c: pa.array(v, pa.int64()) for c, v in out.items()}
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(tokens, pa.list_(pa.int64()))} if with_ids else {}))

    return read


def read_records(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, ``start`` (ids of all documents before it), n_tokens, ids_crc32 (and ids), read from the files.

    Lengths and checksums are verified; a damaged file raises. Files are dealt over the tasks, and only one
    row per range of documents is summed in one place to find where each file starts.
    """
    ship(spark)
    files = read_index(spark, folder).groupBy("part", "file").agg(
        F.min("before").alias("before"), F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("records")
    )
    parts = files.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    # One row per range: the number of ranges is the shuffle width.
    placed = files.join(F.broadcast(parts), "part").select("file", (F.col("begin") + F.col("before")).alias("start"), "records")
    placed = placed.repartition(partitions(placed), "file")
    shape = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return placed.mapInArrow(_read(_address(spark, f"{folder}/data"), with_ids), shape)


def _fetch(address: str):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _file_system(address)
        for batch in batches:
            wanted = list(zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size"))))
            found: list = [None] * len(wanted)
            name, source = None, None
            # Read in the order of the files, hand on in the order asked for.
            for i in sorted(range(len(wanted)), key=wanted.__getitem__):
                file, at, size = wanted[i]
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{path}/{file}")
                (payload,) = payloads(source.read_at(_FRAME + size + 4, at))
                found[i] = unpacked(payload)
            if source is not None:
                source.close()
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array([d for d, _ in found], pa.int64()), "ids": pa.array([i for _, i in found], pa.list_(pa.int64()))}
            )

    return fetch


def fetch_records(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, ids) of the records that rows of an index name, each read by its offset, in the order of the rows."""
    ship(index.sparkSession)
    shape = "doc_id long, ids array<long>"
    return index.select("file", "at", "size").mapInArrow(_fetch(_address(index.sparkSession, f"{folder}/data")), shape)


def shuffled_records(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """(doc_id, ids) of all records in an order drawn by ``seed``: only the narrow index is sorted."""
    index = read_index(spark, folder)
    drawn = [F.xxhash64("file", "at", F.lit(seed)), "file", "at"]
    return fetch_records(index.repartitionByRange(partitions(index), *drawn).sortWithinPartitions(*drawn), folder)
