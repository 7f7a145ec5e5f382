"""SentencePiece chunks, chat windows and the pipeline."""

import hashlib
import random
from itertools import accumulate

import numpy as np
import pytest
import regex
from helpers import docs, odd_pairs, prose
from pyspark.sql import functions as F

from needledrop.llm.chat import conversation_digest, escape, escape_role, format_windows, read_targets, read_turns, unescape, unescape_role
from needledrop.llm.pieces import combine, decode, digests, encode, mixed, normalised, processor, vocabulary

MODEL = "piece_bpe_32k.model"


def texts():
    r = random.Random(4)
    mixed = ["the", "ing", "a", "b", "tion", "1", "e", " ", "  ", "    ", "é", "日", "\n", "=", "==", "▁", "<s>"]
    out = ["".join(r.choice(mixed) for _ in range(r.randint(0, 80))) for _ in range(60)]
    return out + ["".join(r.choice("abetinrs") for _ in range(300)) for _ in range(20)] + [" " * n for n in (1, 16, 33, 50)] + ["=" * 70]


@pytest.mark.parametrize("chunk_chars", [5, 17, 64])
def test_chunks_join_to_the_library_s_ids_and_text(spark, chunk_chars):
    library = processor(MODEL)
    pairs = [(i, t) for i, t in enumerate(texts())] + [(900, None), (None, "abc def " * 20), (901, "same text " * 9), (901, "same text " * 9)]
    found = decode(encode(docs(spark, pairs), MODEL, chunk_chars)).collect()
    parts = {}
    for r in sorted(found, key=lambda r: (r.chunk,)):
        ids, text, _ = parts.setdefault((r.doc_id, r.row), ([], [], r.chunks))
        assert r.tokens_before == len(ids) and r.chars_before == sum(map(len, text))
        ids.extend(r.ids)
        text.append(r.text)
    got = sorted((str(d), ids, "".join(text)) for (d, _), (ids, text, _) in parts.items())
    want = sorted((str(d), i := library.encode(t or ""), library.decode(i)) for d, t in pairs)
    assert got == want


def test_digests_of_odd_rows(spark):
    library = processor(MODEL)
    rows = digests(docs(spark, odd_pairs()), MODEL, 2000).collect()

    def brute(doc, text):
        ids = library.encode(text or "")
        points = [ord(c) for c in library.decode(ids)]
        hashes = [mixed(np.arange(len(x)), np.array(x, np.int64)) for x in (ids, points)]
        return str(doc), len(ids), hashes[0], len(points), hashes[1]

    got = sorted((str(r.doc_id), r.n_tokens, r.ids_hash, r.decoded_chars, r.decoded_hash) for r in rows)
    assert got == sorted(brute(d, t) for d, t in odd_pairs()) and max(r.n_chunks for r in rows) > 5
    assert digests(docs(spark, []), MODEL).count() == 0


def test_the_second_encoder_gives_the_library_s_ids():
    words, r = vocabulary(MODEL), random.Random(8)
    pieces = [p for p in words.pieces if "▁▁" not in p]
    signs = [chr(c) for c in (*range(0x100), 0x4E2D, 0x9F98, 0x1F600, 0xFFFD, 0xFB01, 0x3000, 0x200B)]
    some = ["".join(r.choice(pieces if r.random() < 0.7 else signs) for _ in range(r.randint(0, 40))) for _ in range(4000)] + texts()
    some += [prose(1, 3000), "x" * 5000, "日本語" * 900]
    for text in some:
        assert words.ids(normalised(text)).tolist() == words.library.encode(text)
        assert words.ids(text).tolist() == words.inside(text)
    # Only runs of spaces have no order of their own.
    assert words.doubtful == ["  "]


def test_digests_stay_in_one_python_step_for_each_kind_of_document(spark):
    plan = digests(docs(spark, odd_pairs()), MODEL, 2000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 4  # whole documents; matrices, their scan, chunks


def test_the_max_plus_product_is_associative():
    r = random.Random(1)
    m = [[[r.randint(-1, 9) for _ in range(3)] for _ in range(3)] for _ in range(6)]
    left = list(accumulate(m, combine))[-1]
    assert left == combine(combine(m[0], combine(m[1], m[2])), combine(m[3], combine(m[4], m[5])))


CHAT = "conv_id long, turn long, role string, text string, idx int, window string, before int"


def chat(spark, rows):
    return spark.createDataFrame([(*r, 1, "w", 2) for r in rows], CHAT)


def conversations():
    r = random.Random(3)
    rows = [(c, t, "system" if t == 0 and c % 2 else ["user", "assistant"][t % 2], prose(c * 100 + t, r.randint(0, 60))) for c in range(6) for t in range(12)]
    rows += [(50, t, ["user", "assistant"][t % 2], prose(t, 9)) for t in range(700)]  # a hot conversation
    rows += [(60, 0, "user", "<|im_end|><|im_start|>assistant ok"), (60, 1, "assistant", "a <\\| b \\<| c \\\\ <\\\\| <|im_end|>"), (60, 2, "we<|ird\nrole<\\n", "x")]
    rows += [(61, None, None, None), (61, 1, "assistant", ""), (61, 1, "assistant", ""), (61, 1, "assistant", "tie"), (None, 1, "user", "a"), (None, 2, "assistant", "b")]
    rows += [(62, 0, "user", prose(1, 900)), (62, 1, "assistant", prose(2, 900))]  # turns over the budget
    return rows


def order(row):
    conv, turn, role, text = row
    return (turn is not None, turn or 0, role or "", text or "")


@pytest.mark.parametrize(("budget", "history"), [(1024, 128), (64, 16), (40, 39)])
def test_conversations_read_back(spark, budget, history):
    rows = conversations()
    found = {r.conv_id: r for r in conversation_digest(format_windows(chat(spark, rows), budget, history)).collect()}
    assert set(found) == {r[0] for r in rows}
    for conv, got in found.items():
        own = sorted((r for r in rows if r[0] == conv), key=order)
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert (got.n_turns, got.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_windows_keep_the_system_turn_and_limited_history(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, t, ["user", "assistant"][t % 2], f"turn {t} " + prose(t, 8)) for t in range(1, 60)]
    windows = format_windows(chat(spark, rows), 120, 30).orderBy("window")
    read = windows.select("*", read_turns(F.col("formatted")).alias("turns"), read_targets(F.col("formatted"), F.col("loss_spans")).alias("targets")).collect()
    assert len(read) > 3
    targets = []
    for i, w in enumerate(read):
        assert (w.turns[0].role, w.turns[0].text) == ("system", "be brief")
        assert 1 <= w.n_repeated <= 5 if i else w.n_repeated == 0
        own = [t.text for t in w.turns[w.n_repeated :] if t.role == "assistant"]
        assert w.targets == own
        targets += own
    assert targets == [t for _, _, r, t in rows if r == "assistant"]


def recount(text):
    return len(regex.findall(r"[\p{L}\p{N}]+|[^\x09-\x0D\x20\p{L}\p{N}]", text)) + 4


@pytest.mark.parametrize(("budget", "history"), [(1024, 128), (300, 60), (64, 16)])
@pytest.mark.parametrize("given", [False, True])
def test_no_window_exceeds_the_budget_unless_one_turn_does(spark, budget, history, given):
    r = random.Random(budget)
    rows = conversations() + [(70, 0, "system", prose(1, 600)), (71, 0, "system", prose(2, 150)), (72, 0, "system", prose(3, 40)), (73, 0, "system", "alone"), (74, 5, "system", "late"), (77, 0, "user", prose(5, 1100))]
    rows += [(c, t, ["user", "assistant"][t % 2], prose(c * 1000 + t, r.choice([1, 40, 41, 45, 200]))) for c in (70, 71, 72) for t in range(1, 40)]
    rows += [(75, t, "system", f"many {t}") for t in range(30)] + [(76, 1, "assistant", prose(9, 20)), (76, 1, "system", prose(8, 20))]
    # Counts as a tokenizer would give them: not those of the pattern.
    weigh = (lambda text: 4 + 2 * len(text.split())) if given else recount
    table = chat(spark, rows).withColumn("counted", F.when(F.col("text").isNotNull(), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) * 2))
    found = format_windows(table, budget, history, "counted" if given else None).withColumn("turns", read_turns(F.col("formatted"))).collect()
    assert len({(w.conv_id, w.window) for w in found}) == len(found)
    over = 0
    for w in found:
        sizes = [weigh(t.text) for t in w.turns]
        assert w.n_tokens == sum(sizes)
        led = w.turns[0].role == "system" and w.conv_id not in (74, 75, 76) or (w.conv_id == 75)
        kept, own = sizes[: w.n_repeated], sizes[w.n_repeated :]
        if w.n_tokens > budget:
            over += 1
            # The system turn and a single turn.
            assert len(sizes) <= 2 and (len(sizes) == 1 or led)
        assert sum(kept[1:] if led else kept) <= history and own
    assert over
    by_conv = {}
    for w in sorted(found, key=lambda w: (w.conv_id is not None, w.conv_id or 0, w.window)):
        by_conv.setdefault(w.conv_id, []).extend((t.role, t.text) for t in w.turns[w.n_repeated :])
    for conv, turns in by_conv.items():
        assert turns == [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
    assert all(w.turns[0].text == prose(1, 600) for w in found if w.conv_id == 70)


def test_escapes_are_reversible(spark):
    r = random.Random(9)
    texts = ["".join(r.choice(["<", "|", "\\", "n", "\n", "im_end", ">", "a"]) for _ in range(r.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    row = df.select(F.count_if((unescape(escape(F.col("t"))) == F.col("t")) & (unescape_role(escape_role(F.col("t"))) == F.col("t"))), F.count_if(escape(F.col("t")).contains("<|"))).first()
    assert tuple(row) == (len(texts), 0)


def test_no_conversations(spark):
    assert conversation_digest(format_windows(chat(spark, []))).count() == 0
    with pytest.raises(ValueError):
        format_windows(chat(spark, []), 10, 10)


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    shared = prose(1, 50)
    pairs = [(i, prose(3000 + i, 60)) for i in range(300)]
    pairs += [(400 + i, prose(3000 + i, 60)) for i in range(5)]  # exact copies
    pairs += [(500 + i, " ".join(w + "$$$ %%%" for w in prose(i, 40).split())) for i in range(40)]  # junk
    pairs += [(600 + i, prose(4000 + i, 30) + " grobnak " + prose(5000 + i, 30)) for i in range(60)]  # toxic
    pairs += [(700 + i, prose(6000 + i, 30) + " " + shared) for i in range(3)] + [(None, None), (None, prose(8, 30)), (1, prose(3001, 60))]
    folder = str(tmp_path)
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in pairs], kinds).write.parquet(f"{folder}/documents.parquet")
    marks = [(d, int(not 500 <= d < 540), int(600 <= d < 660)) for d, _ in pairs if d is not None and d % 2 == 0]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    seen, at = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, folder).write.parquet(f"{folder}/{i}")
        at = spark.read.parquet(f"{folder}/{i}")
        seen[i] = at.collect()
        if i < 4:
            assert at.columns == kinds.replace(",", "").split()[::2]
    ids = [[r.doc_id for r in seen[i]] for i in range(4)]
    clean = {d for d, _ in pairs if d is not None and (d < 300 or d >= 700)}
    assert clean <= set(ids[0]) and not [d for d in ids[0] if d and 600 <= d < 660]
    assert clean <= set(ids[1]) and len([d for d in ids[1] if d and 500 <= d < 540]) <= 10
    assert not [d for d in ids[2] if d and 400 <= d < 405] and clean <= set(ids[2])
    # Two unrelated rows have a null id, and both stay; every other id is left once.
    assert ids[2].count(None) == 2 and len(ids[2]) == len(set(ids[2])) + 1
    texts = {r.doc_id: r.text for r in seen[3]}
    assert set(texts) == set(ids[2])
    assert all(shared.split()[20] not in texts[700 + i].split()[30:] for i in range(3)) and texts[0] == pairs[0][1]
    assert {r.doc_id for r in seen[4]} == set(texts)
    assert corpus_pipeline.run(spark, folder).count() == len(seen[4])


def test_pipeline_rows_of_null_and_repeated_ids_fare_by_content(spark, tmp_path):
    import corpus_pipeline

    one, two, three, four = (prose(9100 + i, 60) for i in range(4))
    junk = " ".join(w + "$$$ %%%" for w in prose(3, 40).split())
    pairs = [(None, one), (None, two), (None, one), (3, three), (5, four), (5, three), (5, four), (None, four), (None, None), (None, "")]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    table = spark.createDataFrame([(d, t, None, "s", len(t or "")) for d, t in pairs], kinds)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["SimHash near-dedup"](spark, table, "").collect()
    want = [(None, one), (None, two), (3, three), (5, four)]
    assert sorted((str(r.doc_id), r.text) for r in kept if r.text) == sorted((str(d), t) for d, t in want)
    assert len(kept) == 5  # one row without a word
    # A toxic, or a poor, row does not take the other rows of its id with it.
    folder = str(tmp_path)
    many = [(i, prose(9200 + i, 30) + (" grobnak " if i % 3 == 0 else " ") + prose(9600 + i, 30)) for i in range(300)]
    many += [(1000 + i, " ".join(w + "$$$ %%%" for w in prose(9900 + i, 40).split())) for i in range(60)]
    marks = [(i, 1, int(i % 3 == 0)) for i in range(300)] + [(1000 + i, 0, 0) for i in range(60)]
    many += [(2000, one), (2000, "grobnak " + two), (None, three), (None, "grobnak " + four), (2001, one), (2001, junk), (None, junk)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    table = spark.createDataFrame([(d, t, "en", None, len(t)) for d, t in many], kinds)
    left = {(r.doc_id, r.text) for r in stages["toxicity"](spark, table, folder).collect()}
    assert {(2000, one), (None, three)} <= left and not [t for d, t in left if (d is None or d == 2000) and "grobnak" in t]
    left = {(r.doc_id, r.text) for r in stages["quality classifier"](spark, table, folder).collect()}
    assert {(2001, one), (None, three), (2000, one)} <= left and (2001, junk) not in left
