"""Binary record files: framing, checksums, order, offsets, and what a lost or damaged file does."""

import random
import struct
import uuid
import zlib
from pathlib import Path

import numpy as np
import pytest
from helpers import docs, odd_pairs, prose

from needledrop.llm.crc32c import crc32c, masked
from needledrop.llm.queries import op13_record_files
from needledrop.llm.records import fetch_records, frames, payloads, read_index, read_records, shuffled_records, write_records
from needledrop.llm.vocab import plain_ids
from needledrop.sources.store import shared_dir

NAME = "word_bpe_49k.json"


def bitwise(data):
    c = 0xFFFFFFFF
    for byte in data:
        c ^= byte
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksums():
    check = np.frombuffer(b"123456789", np.uint8)
    assert crc32c(check, [0], [9])[0] == 0xE3069283  # the published check value
    r = random.Random(1)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 2, 7, 511, 512, 513, 1024, 1025, 5000, 0)]
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    assert list(crc32c(data, np.cumsum(sizes) - sizes, sizes)) == [bitwise(t) for t in texts]
    assert [crc32c(np.frombuffer(t, np.uint8), [0], [len(t)])[0] for t in texts] == [bitwise(t) for t in texts]
    assert len(crc32c(data, [], [])) == 0


def test_frames_read_back_and_damage_is_seen():
    bodies = [b"", b"abc", bytes(range(256)) * 9]
    data = b"".join(frames(bodies))
    assert [bytes(p) for p in payloads(data)] == bodies
    size, mark = struct.unpack_from("<QI", data, 16)
    assert size == 3 and mark == int(masked(crc32c(np.frombuffer(struct.pack("<Q", 3), np.uint8), [0], [8]))[0])
    for at in (3, 9, 20, 33, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            payloads(bytes(broken))
    with pytest.raises(ValueError):
        payloads(data[:-1])


def new_folder(spark):
    return f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"


def brute(pairs):
    """Rows in the order of the files, but for rows of one id, which any order may part."""
    out, start = [], 0
    for doc in sorted({d for d, _ in pairs}, key=lambda d: (d is not None, d or 0)):
        own = [plain_ids(NAME, t or "") + [1] for d, t in pairs if d == doc]
        out.append((doc, start, sorted((len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in own)))
        start += sum(map(len, own))
    return out


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    found = []
    for doc, own in sorted(out.items(), key=lambda x: (x[0] is not None, x[0] or 0)):
        own.sort(key=lambda r: r.start)
        assert all(a.start + a.n_tokens == b.start for a, b in zip(own, own[1:]))
        found.append((doc, own[0].start, sorted((r.n_tokens, r.ids_crc32) for r in own)))
    return found


@pytest.mark.parametrize("file_bytes", [1, 500, 32 << 20])
def test_records_read_back(spark, file_bytes):
    pairs = odd_pairs() + [(5000, f"again {i}") for i in range(300)] + [(-3, "a_, b"), (6000, prose(7, 300))]  # a hot id
    folder = write_records(docs(spark, pairs), new_folder(spark), file_bytes=file_bytes)
    rows = read_records(spark, folder).collect()
    assert by_id(rows) == brute(pairs)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.ids[-1] == 1 for r in rows)
    index = read_index(spark, folder)
    assert index.count() == len(pairs) and index.select("part").distinct().count() > 3
    # The files ascend by doc_id, one after the other.
    listed = [r.doc_id for r in index.orderBy("part", "before").collect()]
    assert listed == sorted(listed, key=lambda d: (d is not None, d or 0))


def test_shuffled_reads_by_offset(spark):
    pairs = [(i, prose(i, i % 30)) for i in range(200)]
    folder = write_records(docs(spark, pairs), new_folder(spark), file_bytes=3000)
    want = {d: plain_ids(NAME, t) + [1] for d, t in pairs}
    one, again, other = ([(r.doc_id, r.ids) for r in shuffled_records(spark, folder, s).collect()] for s in (1, 1, 2))
    assert one == again and one != other and dict(one) == want and dict(other) == want
    assert [d for d, _ in one] != sorted(d for d, _ in one)
    some = fetch_records(read_index(spark, folder).where("doc_id IN (3, 77)"), folder).collect()
    assert {r.doc_id: r.ids for r in some} == {3: want[3], 77: want[77]}


def test_files_of_lost_attempts_count_for_nothing_and_damaged_files_raise(spark):
    pairs = [(i, prose(i, 20)) for i in range(40)]
    folder = write_records(docs(spark, pairs), new_folder(spark))
    files = sorted(Path(f"{folder}/data").glob("*.tfrecord"))
    (files[0].parent / "part-000000-lost.tfrecord").write_bytes(files[0].read_bytes()[:-5])
    assert by_id(read_records(spark, folder).collect()) == brute(pairs)
    data = bytearray(files[0].read_bytes())
    data[20] ^= 1
    files[0].write_bytes(bytes(data))
    with pytest.raises(Exception, match="checksum of the record at byte 0"):
        read_records(spark, folder).collect()


def test_no_documents(spark):
    folder = write_records(docs(spark, []), new_folder(spark))
    assert read_records(spark, folder).count() == 0 and shuffled_records(spark, folder, 1).count() == 0


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    pairs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert by_id(op13_record_files(spark, folder).collect()) == brute(pairs)
