"""Operators on documents against brute force, with odd rows."""

import collections
import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from helpers import docs, odd_pairs, prose

from needledrop.llm import simhash
from needledrop.llm import toxicity as toxicity_module
from needledrop.llm.components import components
from needledrop.llm.counts import token_counts
from needledrop.llm.packing import hilbert, pack, sequences
from needledrop.llm.quality import resample
from needledrop.llm.repeats import remove_repeats
from needledrop.llm.toxicity import buckets_of, fit, scored, toxicity, words_of
from needledrop.llm.vocab import byte_count, plain_ids, word_ids
from needledrop.llm.windows_core import Words, runs
from needledrop.sources.store import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def simhash_brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(marks, most):
    marks = sorted(set(marks))
    up = {m: m for m in marks}

    def find(m):
        while up[m] != m:
            m = up[m]
        return m

    for i, a in enumerate(marks):
        for b in marks[i + 1 :]:
            if bin(a ^ b).count("1") <= most:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {m: find(m) for m in marks}


def near_copies():
    base = prose(50, 400).split()
    out = []
    for i in range(60):
        words = list(base)
        for j in range(i % 4):
            words[(i * 37 + j * 101) % 400] = f"w{i}x{j}"
        out.append((100 + i, " ".join(words)))
    return out


@pytest.mark.parametrize("cell_rows", [2, 4096])
def test_near_duplicates_equal_brute_force(spark, cell_rows):
    pairs = odd_pairs() + near_copies()
    found = simhash.near_duplicates(docs(spark, pairs), cell_rows=cell_rows).collect()
    marks = [simhash_brute(t) for _, t in pairs]
    root = roots(marks, 3)
    least = {}
    for (d, _), m in zip(pairs, marks):
        if d is not None:
            least[root[m]] = min(d, least.get(root[m], d))
    want = sorted((str(d), f"{m:016x}", str(least.get(root[m]))) for (d, _), m in zip(pairs, marks))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == want
    assert len({root[m] for m in marks}) < len(set(marks))  # there are links
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_anchors_cover_all_pairs_within_three_bits():
    rng = np.random.default_rng(0)
    a = rng.integers(-(2**63), 2**63, 400, dtype=np.int64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in a], np.uint64)
    b = (a.view(np.uint64) ^ flips).view(np.int64)
    ra, na, ha = simhash.anchors(a)
    rb, nb, _ = simhash.anchors(b)
    assert np.bincount(ra).max() <= 32
    homes, all_b = set(zip(ra[ha], na[ha])), set(zip(rb, nb))
    for i in range(len(a)):
        assert any((i, n) in all_b for j, n in homes if j == i)


def test_components_of_chains_stars_and_odd_links(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3), (200, None), (7, 6)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeats_brute(pairs, window):
    words = [WORD.findall(t or "") for _, t in pairs]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(pairs, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((str(d), kept, len(w), sum(gone)))
    return sorted(out)


def passages():
    """Shared spans of many lengths around the window, in changing surroundings, and within one text."""
    shared = prose(70, 120).split()
    out = []
    for i in range(40):
        start, size = (i * 7) % 80, 8 + (i * 5) % 34
        out.append((300 + i, " ".join(prose(400 + i, 20 + i).split() + shared[start : start + size] + prose(500 + i, 15).split())))
    out.append((390, " ".join(shared[:30] + ["mid"] + shared[:30])))
    return out


@pytest.mark.parametrize(("window", "k"), [(12, 4), (35, 12), (5, 5), (1, 1)])
def test_remove_repeats_equals_brute_force(spark, window, k):
    pairs = odd_pairs() + passages()
    found = remove_repeats(docs(spark, pairs), window, k)
    assert found.columns == ["row", "kept", "n_words", "n_removed"] and "score" in found.schema["row"].dataType.names
    got = sorted((str(r.row.doc_id), r.kept, r.n_words, r.n_removed) for r in found.collect())
    assert got == repeats_brute(pairs, window)
    hashed = remove_repeats(docs(spark, pairs), window, k, digest=True).collect()
    assert sorted(r.kept for r in hashed) == sorted(hashlib.sha256(w[1].encode()).hexdigest() for w in got)


def test_remove_repeats_of_nothing(spark):
    assert remove_repeats(docs(spark, [])).count() == 0


def test_rows_that_are_two_thirds_copies_share_one_list_of_runs(spark):
    copies = [(1, prose(50, 300))] * 800
    pairs = copies + [(100 + i, prose(200 + i, 60)) for i in range(400)]
    found = {}
    for r in remove_repeats(docs(spark, pairs)).collect():
        found.setdefault(r.row.doc_id, []).append((r.n_words, r.n_removed))
    assert found[1] == [(300, 300)] * 800
    assert all(found[100 + i] == [(60, 0)] for i in range(400))
    folder = Path(shared_dir(spark)) / spark.sparkContext.applicationId
    newest = max(folder.glob("runs-by-text-*"), key=lambda p: p.stat().st_mtime)
    lists = [len(r.runs) for r in spark.read.parquet(str(newest)).collect()]
    # One list for all copies, no longer than twice the runs of one of them.
    assert max(lists) <= 2 * len(runs(Words.of(np.frombuffer(copies[0][1].encode(), np.uint8)), 35, 12)[0])


def test_token_counts_and_their_cache(spark, tmp_path):
    pairs = odd_pairs() + [(20, "a <|endoftext|> b"), (21, "tab\t \n\n  end ")]
    want = sorted(
        (str(d), len((t or "").encode()), n := len(plain_ids("byte_bpe_50k.json", t or "")), n > 512) for d, t in pairs
    )
    cache = str(tmp_path / "cache")
    for _ in range(2):
        found = token_counts(docs(spark, pairs), cache, "byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect()) == want
        # Every distinct text is encoded and stored once, in the first round.
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in pairs})
    assert token_counts(docs(spark, []), cache, "byte_bpe_50k.json").count() == 0
    import sentencepiece
    from needledrop.llm.common import tokenizer_path

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    other = token_counts(docs(spark, pairs[:9]), cache, "piece_bpe_32k.model").collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in other) == sorted((str(d), len(sp.encode(t or ""))) for d, t in pairs[:9])


TRICKY = [
    "a  b", "a \t b", "\n\n x", "x \n\n y", " lead", "trail ", "<|endoftext|>", "foo <|endoftext|> bar", "it's we'll DON'T", "ÀÉ Straße İ ΣΑΣ",
    "a\x1cb \x85 \xa0 c", "é é", "１２ 12 345", "!!! ??..", "日本語 ", "​ ﻿ x", "  ", "\r\n a\r\n", "a.b,c.. d.,e ,f", "", "'sx 's' l'l",
]


def test_fast_ids_of_random_signs_are_the_library_s():
    r = random.Random(17)
    ascii_signs = [chr(c) for c in range(0x20, 0x7F)] + ["\t", "\n"]
    drawn = [ascii_signs, [*ascii_signs, *map(chr, range(0xA0, 0x100))], [*"_.,'ab \t"], [*"ab._,-", *"ÀÖØöøÿß "]]
    texts = ["a_, b", "x_.y", "__.", "_ ._", "a,_b", *("".join(r.choice(drawn[i % 4]) for _ in range(r.randint(0, 30))) for i in range(20_000))]
    assert [t for t in texts if list(word_ids("word_bpe_49k.json", t)) != plain_ids("word_bpe_49k.json", t)] == []
    assert [t for t in texts if byte_count("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", t) != len(plain_ids("byte_bpe_50k.json", t))] == []


@pytest.mark.parametrize("text", TRICKY + [prose(i, 50).title() for i in range(20)])
def test_fast_ids_are_the_library_s(text):
    assert list(word_ids("word_bpe_49k.json", text)) == plain_ids("word_bpe_49k.json", text)
    assert byte_count("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", text) == len(plain_ids("byte_bpe_50k.json", text))


def test_packing_round_trip(spark):
    pairs = odd_pairs() + [(500 + i, prose(600 + i, 30)) for i in range(80)]
    pieces = pack(docs(spark, pairs), capacity=256)
    rows = pieces.collect()
    ids = {}
    for d, t in pairs:
        ids.setdefault(str(d), []).append(plain_ids("word_bpe_49k.json", t or "") + [1])
    assert sum(r.length for r in rows) == sum(len(x) for xs in ids.values() for x in xs)
    for r in rows:
        want = [x for x in ids[str(r.doc_id)] if len(x) == r.doc_tokens and x[r.start : r.start + r.length] == list(r.ids)]
        assert want and r.length == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    full = {s.sequence_id: len(s.ids) for s in sequences(pieces).collect()}
    last = max(full)
    assert sorted(full) == list(range(last + 1)) and all(n == 256 for s, n in full.items() if s != last) and full[last] <= 256
    offsets = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == offsets[r.sequence_id]
        offsets[r.sequence_id] += r.length
    assert pack(docs(spark, [])).count() == 0


def test_neighbours_on_the_curve_are_neighbours_in_space():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = hilbert(grid, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def labelled(n=600):
    insults = ["grobnak", "wolfrump", "stinkvat"]
    pairs, toxic = [], []
    for i in range(n):
        words = prose(1000 + i, 30 + i % 50).split()
        bad = i % 5 == 0
        if bad:
            words[i % 20] = insults[i % 3] + ["", "s", "ed"][i // 5 % 3]
        pairs.append((i, " ".join(words)))
        toxic.append((i, 1, int(bad), "x"))
    return pairs, toxic


def test_toxicity_on_held_out_rows(spark):
    pairs, marks = labelled()
    extra = [(5000, "a grobnaky thing " + prose(7, 3000)), (5001, prose(8, 3000)), (5002, ""), (5003, None), (None, prose(9, 20))]
    labels = spark.createDataFrame(marks + [(None, 1, 1, "x"), (3, 0, None, "x")], "doc_id long, quality int, toxic int, text string")
    rows = toxicity(docs(spark, pairs + extra), labels).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(pairs) + len(extra)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    truth = {d: t for d, _, t, _ in marks}
    right = [by[d].predicted == truth[d] for d in truth if by[d].held_out]
    assert sum(right) / len(right) > 0.97
    # An unseen misspelling in a long text, a long clean text, and no text at all.
    assert (by[5000].predicted, by[5001].predicted, by[5002].predicted, by[5003].predicted) == (1, 0, 0, 0)
    none = spark.createDataFrame([], labels.schema)
    assert toxicity(docs(spark, pairs[:5]), none).agg({"predicted": "sum"}).first()[0] == 0
    assert toxicity(docs(spark, []), labels).count() == 0


def test_insults_after_forty_unspaced_letters_count(spark):
    pairs, marks = labelled()
    glue = ["".join(prose(70 + i, 60).split()) for i in range(3)]
    insults = ["grobnak", "wolfrump", "stinkvat"]
    bad = [(7000 + i, g[: 45 + 7 * i] + insults[i] + g[45 + 7 * i :]) for i, g in enumerate(glue)]
    bad += [(7010 + i, "-".join(prose(80 + i, 40).split() + [w] + prose(90 + i, 5).split())) for i, w in enumerate(insults)]
    clean = [(7100 + i, g) for i, g in enumerate(glue)] + [(7110, "_".join(prose(85, 60).split()))]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int, text string")
    rows = {r.doc_id: r for r in toxicity(docs(spark, pairs + bad + clean), labels).collect()}
    assert [rows[d].predicted for d, _ in bad] == [1] * len(bad)
    assert [rows[d].predicted for d, _ in clean] == [0] * len(clean)
    # All n-grams of a long word are in its pieces, also at its end; short words stay whole.
    word = "".join(chr(0x4E00 + i) for i in range(101))
    pieces = words_of(word)
    assert all(any(word[i : i + 5] in p for p in pieces) for i in range(97)) and pieces[-1][-1] == word[-1]
    # One rule for words of every length: a piece starts every six letters.
    assert words_of("a" * 12 + " b-c") == ["a" * 12, "b-c"]
    for n in range(13, 100):
        pieces = words_of(word[:n])
        assert [word.index(p[0]) for p in pieces] == list(range(0, 6 * len(pieces), 6)) and all(len(p) == 12 for p in pieces[:-1])


def test_score_is_the_forward_pass_of_the_worst_window(spark):
    pairs, marks = labelled(200)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int, text string")
    rows = docs(spark, pairs + odd_pairs() + [(9000, "a-b ... x"), (9001, "!!! ??")])
    model = fit(rows, labels, per_class=60)

    def forward(text):
        words = [buckets_of(w, len(model.vectors)) for w in words_of(text)]
        bags = [model.vectors[b].astype(float).mean(axis=0) if b else np.zeros(model.vectors.shape[1]) for b in words]
        spans = [bags[i : i + model.window] for i in range(max(1, len(bags) - model.window + 1))]
        logits = [(np.mean(s, axis=0) if s else np.zeros(model.vectors.shape[1])) @ model.softmax + model.bias for s in spans]
        return max(float(np.exp(x[1] - np.logaddexp(*x))) for x in logits)

    texts = {str(d): t for d, t in pairs + odd_pairs() + [(9000, "a-b ... x"), (9001, "!!! ??")] if d not in (None, 7)}
    found = {str(r.doc_id): r.score for r in scored(rows, model).collect()}
    assert {d: found[d] for d in texts} == pytest.approx({d: forward(t) for d, t in texts.items()}, abs=1e-6)


def test_many_words_are_scored_at_one_time(monkeypatch):
    r, values = random.Random(5), np.random.default_rng(5).normal(size=1 << 12)
    signs = "abcdefghij-_<>09éßñ日本🙂ﬁ٣²"
    words = ["".join(r.choice(signs[: r.choice([2, 10, 14, len(signs)])]) for _ in range(r.randint(1, 12))) for _ in range(9000)]
    words += [w for t in (prose(3, 4000), "haha aaaaaaaaaaaa a ab abc abcd") for w in t.split()] + ["-" * 40, "x-" * 12]
    want = [float(values[b].mean()) if (b := buckets_of(w, len(values))) else 0.0 for w in words]
    found = np.concatenate(toxicity_module._WordScores(values).of([words[:5000], [], words[5000:]]))
    assert toxicity_module.means_of(words, values) == pytest.approx(want, abs=1e-12)
    assert found == pytest.approx(toxicity_module.means_of(words_of(" ".join(words)), values), abs=1e-12)
    # Words are not hashed one by one, but for the few that repeat an n-gram.
    calls = []
    monkeypatch.setattr(toxicity_module, "buckets_of", lambda w, n: calls.append(w) or buckets_of(w, n))
    some = [f"word{i}" for i in range(3000)]
    toxicity_module._WordScores(values).of([some])
    assert len(calls) < 30


def test_a_labelled_id_on_many_rows_teaches_once(spark):
    pairs, marks = labelled(60)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int, text string")
    once, often = (fit(docs(spark, pairs + [pairs[0]] * n), labels, per_class=20) for n in (0, 400))
    assert np.array_equal(once.vectors, often.vectors) and np.array_equal(once.softmax, often.softmax)


def test_quality_keeps_good_rows(spark):
    pairs = [(i, prose(2000 + i, 40) if i % 6 else " ".join(w + "$$$ %%%" for w in prose(i, 40).split())) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 6 > 0), None, 1.0) for i in range(600) if i // 6 % 2], "doc_id long, quality int, toxic int, kept double")
    rows = {r.doc_id: r for r in resample(docs(spark, pairs), labels).collect()}
    assert all(rows[i].kept for i in range(600) if i % 6)
    assert sum(rows[i].kept for i in range(0, 600, 6)) <= 10  # the margin
    share = resample(docs(spark, pairs), labels, keep=0.5).where("kept").count()
    assert share == 300
    odd = resample(docs(spark, odd_pairs()), labels).collect()
    assert len(odd) == len(odd_pairs()) and all(r.log_weight is not None for r in odd)
    none = spark.createDataFrame([], labels.schema)
    assert resample(docs(spark, odd_pairs()), none).where("kept").count() == len(odd_pairs())
    assert resample(docs(spark, []), labels).count() == 0
    # Equal rows fare alike.
    twice = resample(docs(spark, [(1, "a"), (1, "a"), (2, "b")]), labels, keep=0.3).groupBy("doc_id", "kept").count().collect()
    assert len({(r.doc_id) for r in twice}) == len(twice)


def test_largest_sums_are_drawn(spark):
    df = resample(docs(spark, [(i, prose(i, 20)) for i in range(200)]), spark.createDataFrame([(1, 1)], "doc_id long, quality int"), keep=0.25)
    rows = sorted(df.collect(), key=lambda r: -r.gumbel_key)
    assert [r.kept for r in rows] == [True] * 50 + [False] * 150
