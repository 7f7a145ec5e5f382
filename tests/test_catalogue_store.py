"""A catalogue of which only new and changed files are parsed."""

import json
import os

import pytest

from needledrop.operators.tracks import flatten_documents
from needledrop.sources.catalogue_store import kept_catalogue
from needledrop.sources.scans import read_catalogue


def put(folder, name, text):
    (folder / name).write_text(text)


def doc(name, popularity=1):
    return json.dumps({"id": name, "duration_ms": 5, "popularity": popularity, "album": {"album_type": "x", "release_date": "2001"}}, indent=1)


def names(df):
    return sorted(os.path.basename(r["path"]) for r in df.collect())


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in", str(tmp_path / "store")


def test_only_new_and_changed_files_are_parsed(spark, folders):
    source, store = folders

    def check(parsed, broken):
        documents, bad, n = kept_catalogue(spark, str(source), store)
        assert n == parsed and names(bad) == broken
        want = flatten_documents(read_catalogue(spark, str(source))).collect()
        assert sorted(map(str, flatten_documents(documents).collect())) == sorted(map(str, want))

    for i in range(40):
        put(source, f"{i}.json", doc(f"t{i}"))
    put(source, "odd [1]{2}* name.JSON", doc("odd"))
    put(source, "words.txt", doc("no"))
    (source / "sub").mkdir()
    put(source / "sub", "below.json", doc("below"))
    check(41, [])
    check(0, [])
    # One more and one that cannot be read; neither is tried again.
    put(source, "new.json", doc("new"))
    put(source, "broken.json", '{"id": ')
    put(source, "empty.json", "")
    check(2, ["broken.json"])
    check(0, ["broken.json"])
    # A file changes, another is mended, a third one goes.
    put(source, "3.json", doc("t3", 777))
    put(source, "broken.json", doc("mended"))
    (source / "4.json").unlink()
    check(2, [])
    documents = kept_catalogue(spark, str(source), store)[0]
    assert [r["popularity"] for r in flatten_documents(documents).where("track_id = 't3'").collect()] == ["777"]


def test_no_files_and_lost_runs(spark, folders):
    source, store = folders
    documents, bad, n = kept_catalogue(spark, str(source), store)
    assert (documents.count(), bad.count(), n) == (0, 0, 0)
    assert flatten_documents(documents).columns == flatten_documents(read_catalogue(spark, str(source))).columns
    put(source, "a.json", doc("a"))
    # The folder of a run that died: the manifest does not name it.
    spark.createDataFrame([("x",)], "id string").write.parquet(f"{store}/run-dead")
    assert [r["id"] for r in kept_catalogue(spark, str(source), store)[0].collect()] == ["a"]
