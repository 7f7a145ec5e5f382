"""Periodic runs against a quadratic scan of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import docs, odd_pairs, prose

from needledrop.llm.periods import find_runs, kept_words, periodic_runs, repeated_tail, suffix_lcps
from needledrop.llm.queries import op12_periodic_runs


def brute_runs(words, least=6, times=4):
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            part = words[start : start + length]
            if length >= max(least, times * q) and all(part[p:] != part[:-p] for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc, text, planted):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc).encode() if doc is not None else b"")
    if planted and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
    best = (*top[0], 1000 * top[0][1] // top[0][2]) if top else (None,) * 4
    digest = [hashlib.sha256(b).hexdigest() for b in ("".join(f"{s},{x},{q}\n" for s, x, q in runs).encode(), b" ".join(w for i, w in enumerate(words) if i not in gone))]
    return doc, len(runs), *best, *digest


def drawn(r):
    k = r.choice([1, 2, 2, 3, 5])
    words = [r.randrange(k) for _ in range(r.randint(0, 60))]
    for _ in range(r.randint(0, 3)):
        unit = [r.randrange(4) for _ in range(r.randint(1, 6))]
        words += (unit * r.randint(1, 7))[: r.randint(1, 40)] + [r.randrange(k)]
    return words


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (1, 2), (10, 3), (3, 5)])
def test_runs_equal_brute_force(least, times):
    r = random.Random(least * times)
    for _ in range(120):
        texts = [drawn(r) for _ in range(r.randint(1, 6))]
        codes = np.array([w for t in texts for w in t], np.int64)
        assert find_runs(codes, np.cumsum([len(t) for t in texts]), least, times) == [brute_runs(t, least, times) for t in texts]


def test_neighbouring_suffixes_and_their_common_prefixes():
    words = [1, 2, 1, 2, 1, 2, 3, 1, 2]
    a, b, lcp = suffix_lcps(np.array(words), np.array([9]), 1)
    order = sorted(range(9), key=lambda i: words[i:])
    want = [(x, y, next((k for k in range(9) if words[x : x + k + 1] != words[y : y + k + 1] or max(x, y) + k >= 9), 9)) for x, y in zip(order, order[1:])]
    assert list(zip(a, b, lcp)) == [w for w in want if w[2] >= 1]


def long_pairs():
    """Documents of which the planted tail hits some, with runs of their own, and one word again and again."""
    r = random.Random(3)
    pairs = [(i, prose(i, r.randint(0, 90))) for i in range(120)]
    pairs += [(500 + i, prose(i, 20) + " " + (prose(900 + i, r.randint(1, 9)) + " ") * r.randint(3, 8) + "\x85 end\x1fof") for i in range(60)]
    return pairs + [(700, "ha " * 700), (701, ("a b " * 5 + "c ") * 6), (702, "ha " * 5), (703, "\x0b x \x0c" * 6), (-4, "la " * 30)]


@pytest.mark.parametrize("planted", [False, True])
def test_documents_equal_brute_force(spark, planted):
    pairs = long_pairs() + odd_pairs()
    change = repeated_tail if planted else None
    found = periodic_runs(docs(spark, pairs), change=change).collect()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r[n] for n in names) for r in found), key=str) == sorted((brute(d, t, planted) for d, t in pairs), key=str)
    # Some documents have runs of their own, and the planted tails add to them.
    own = sum(brute(d, t, False)[1] > 0 for d, t in pairs)
    assert own > 20 and (sum(r.n_runs > 0 for r in found) > own) is planted
    for row in found:
        assert hashlib.sha256(row.collapsed.encode()).hexdigest() == row.collapsed_sha256 and len(row.runs) == row.n_runs


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    pairs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    pairs = [(d, t) for d, t in pairs if len(t or "") < 3000]
    found = {r.doc_id: tuple(r) for r in op12_periodic_runs(spark, folder).collect()}
    assert [(found[d], w) for d, t in pairs if found[d] != (w := brute(d, t, True))] == []


def test_collapsing_keeps_the_first_period():
    assert list(kept_words(8, [(1, 6, 1)])) == [True, True, False, False, False, False, False, True]
    assert list(repeated_tail(None, 3)) == [0, 1, 2] or zlib.crc32(b"") % 10 == 0


def test_no_documents_and_wrong_parameters(spark):
    assert periodic_runs(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs(spark, []), times=1)
