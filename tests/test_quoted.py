"""Quoted line breaks read in parallel, and types inferred from all values."""

import csv
import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from needledrop.operators.inference import common_type, infer_types, typed, typed_alike
from needledrop.sources.quoted import ends_inside, read_records
from needledrop.sources.scans import read_enriched, read_play_frames, read_plays


def automaton(line, sep, inside=False):
    """Whether a line ends inside quotes, character by character."""
    state = "in" if inside else "start"
    for c in line:
        if state == "in":
            state = "closed" if c == '"' else "in"
        elif state == "closed":
            state = "in" if c == '"' else "start" if c == sep else "out"
        elif c == '"' and state == "start":
            state = "in"
        else:
            state = "start" if c == sep else "out"
    return state == "in"


def brute_records(text, sep):
    out, held, inside = [], [], False
    for line in text.split("\n")[: None if not text.endswith("\n") else -1]:
        held.append(line)
        inside = automaton(line, sep, inside)
        if not inside:
            out.append("\n".join(held))
            held = []
    out += ["\n".join(held)] * bool(held)
    return [r.removesuffix("\r") for r in out if r.removesuffix("\r")]


def drawn_text(r, records):
    bits = ["a", "b,", 'say ""x""', "\n", "\r\n", ",", "é", "", "word "]
    plain = ["x", "", "12", 'inch 5"', "a b"]
    out = []
    for _ in range(records):
        out.append(",".join('"' + "".join(r.choice(bits) for _ in range(r.randint(0, 6))) + '"' if r.random() < 0.5 else r.choice(plain) for _ in range(3)))
    return "\n".join(out) + "\n" * r.randint(0, 1)


def test_how_lines_end(spark):
    r = random.Random(1)
    lines = ["".join(r.choice(['"', '"', ",", "a", "b"]) for _ in range(r.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    found = df.select("line", ends_inside(F.col("line"), ",").alias("a"), ends_inside(F.concat(F.lit('"'), "line"), ",").alias("b")).collect()
    assert [(x.line, x.a, x.b) for x in found if (x.a, x.b) != (automaton(x.line, ","), automaton(x.line, ",", True))] == []


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize("seed", range(4))
def test_records_are_cut_as_by_one_reader(spark, tmp_path, small_splits, seed):
    r = random.Random(seed)
    texts = [drawn_text(r, 120), drawn_text(r, 3), '"one\nfield\n' + "over\n" * 400 + 'many splits",x\nafter,y\n', ""]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.csv").write_bytes(text.encode())
    rows = read_records(spark, str(tmp_path), ",").collect()
    found = {}
    for row in sorted(rows, key=lambda x: (x.file, x.block, x.no)):
        found.setdefault(row.file.rsplit("/", 1)[1], []).append(row.record)
    assert found == {f"{i}.csv": want for i, t in enumerate(texts) if (want := brute_records(t, ","))}
    # Every split of 300 bytes is read by a task of its own, and most of them begin a record.
    assert len({row.block for row in rows if row.file.endswith("/0.csv")}) > len(texts[0].encode()) / 300 / 2


def test_a_field_that_never_closes_takes_the_rest(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\n2,y\n')
    assert [x.record for x in read_records(spark, str(tmp_path / "a.csv"), ",").orderBy("no").collect()] == ["a,b", '1,"x\n2,y']


def test_plays_with_line_breaks_equal_pandas(spark, tmp_path, small_splits):
    r = random.Random(5)
    rows = [
        (i, "2024-03-10T02:30:00Z", r.choice(["ann", "b\to b", 'c "q" d']), r.choice(["one\ntwo", "x\n\ny\n", "plain", 'he said "no"\n', "NA"]), r.random(), r.choice([1, None]), 7)
        for i in range(200)
    ]
    names = ["obs_id", "ts", "username", "master_metadata_track_name", "score", "maybe", "whole"]
    body = io.StringIO()
    writer = csv.writer(body, delimiter="\t", lineterminator="\n")
    writer.writerow(names)
    writer.writerows(rows)
    path = tmp_path / "plays.txt"
    path.write_text(body.getvalue())
    df = read_plays(spark, str(path), multi_line=True)
    assert dict(df.dtypes)["score"] == "double" and dict(df.dtypes)["maybe"] == "bigint" and dict(df.dtypes)["whole"] == "bigint"
    want = pd.read_csv(path, sep="\t", float_precision="round_trip")
    got = df.orderBy("obs_id").toPandas()
    assert list(got["master_metadata_track_name"].fillna("-")) == list(want["master_metadata_track_name"].fillna("-"))
    assert list(got["username"]) == list(want["username"]) and list(got["score"]) == list(want["score"])
    assert len(got) == 200 and got["ts"].notna().all()


def test_both_frames_get_one_type(spark, tmp_path):
    (tmp_path / "a.txt").write_text("obs_id\tn\tm\tflag\tgone\n1\t1\t5\tTrue\t\n2\t\t6\tFalse\tNA\n")
    (tmp_path / "b.txt").write_text("obs_id\tn\tm\tflag\tonly\n3\t2.5\tx\ttrue\t4\n")
    a, b = read_play_frames(spark, (str(tmp_path / "a.txt"), str(tmp_path / "b.txt")))
    kinds = [dict(df.dtypes) for df in (a, b)]
    assert kinds[0]["n"] == kinds[1]["n"] == "double" and kinds[0]["m"] == kinds[1]["m"] == "string" and kinds[1]["only"] == "bigint"
    assert [tuple(x) for x in a.select("obs_id", "n", "m", "flag", "gone").orderBy("obs_id").collect()] == [(1, 1.0, "5", True, None), (2, None, "6", False, None)]
    (tmp_path / "c.csv").write_text("obs_id,extra\n1,3\n2,4\n")
    assert dict(read_enriched(spark, str(tmp_path / "c.csv")).dtypes)["extra"] == "bigint"


WORDS = {
    "boolean": ["True", "false", None], "bigint": ["1", "-7", "+3", " 12 ", "007", "9223372036854775807", None],
    "double": ["1", "2.5", "-1e3", ".5", "inf", "9223372036854775808"], "string": ["1", "x"], "void": [None, None],
}


@pytest.mark.parametrize("kind", WORDS)
def test_narrowest_type(spark, kind):
    df = spark.createDataFrame([(w,) for w in WORDS[kind]], "`a.b` string")
    row = infer_types(df).first()
    values = [w for w in WORDS[kind] if w is not None]
    assert tuple(row) == ("a.b", kind, len(values), len(WORDS[kind]) - len(values))
    back = dict(typed(df.withColumnRenamed("a.b", "v"), {"v": kind}).dtypes)["v"]
    assert back == ("string" if kind == "void" else kind)


def test_lattice_and_odd_tables(spark):
    kinds = ["void", "boolean", "bigint", "double", "string"]
    for a in kinds:
        assert common_type(a, a) == a and common_type("void", a) == common_type(a, "void") == a and common_type(a, "string") == "string"
    assert common_type("bigint", "double") == "double" and common_type("boolean", "bigint") == "string"
    mixed = spark.createDataFrame([("True", "0x1f", "1d"), ("1", "3", "2f")], "a string, b string, c string")
    assert [x.type for x in infer_types(mixed).collect()] == ["string"] * 3
    empty = mixed.limit(0)
    assert [tuple(x) for x in infer_types(empty).collect()] == [(c, "void", 0, 0) for c in "abc"]
    assert infer_types(empty, []).count() == 0 and typed_alike([empty], ["a", "gone"])[0].columns == ["a", "b", "c"]
