"""Conversation repair against a label-setting search over whole edit strings."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from helpers import prose
from pyspark.sql import functions as F

from needledrop.llm import auction
from needledrop.llm.queries import op11_conversation_repair
from needledrop.llm.repair import damaged, repair_conversations, repaired_turns

KIND = "conv_id long, turn long, role string, text string, copies string, part int, fault string, no long"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], KIND)


def damage(rows):
    """Rows after damage in the order of the operator, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        said = [" " if x is None else x for x in (conv, turn, role, text)]
        lot = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = "user" if lot == 4 else said[2], "" if lot == 1 else re.sub("[.!?]", "", said[3]) if lot == 2 else said[3]
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(lot, 1))
    return {c: sorted(r, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, r in out.items()}


def cheapest(rows, faults):
    """(cost, letters, turns left): strings grow letter by letter, the cheapest and then the least first."""
    heap, done, follows = [(0, "", 0, "", ())], set(), {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    while True:
        cost, letters, i, last, left = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, letters, left
        new = follows[last]
        heapq.heappush(heap, (cost + 5, letters + "I", i, new, (*left, (names[new], ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, letters + "D", i + 1, last, left))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                if role[:1] == new or (role[:1] == "s" and last == ""):
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, role[:1], (*left, (role, text))))
                heapq.heappush(heap, (cost + more + 1, letters + "R", i + 1, new, (*left, (names[new], text))))


def brute(rows):
    out = {}
    for conv, own in damage(rows).items():
        faults, seen = [], set()
        for _, role, text in own:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
            faults.append(fault)
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, letters, left = cheapest(own, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, digest)
    return out


def got(df):
    found = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: r[1:] for r in found}


def odd_conversations():
    r = random.Random(7)
    roles = ["user", "assistant", "system", "tool", "", "user", "assistant"]
    texts = ["Yes.", "No", " ", "", None, "ok!", "Why? ", "é。", "last.\n", "\x0b\x0c", "x.\x1f"]
    rows = [(c, t, r.choice(roles), r.choice(texts)) for c in range(150) for t in range(r.randint(1, 9)) if r.random() < 0.9]
    rows += [(200, t, ["user", "assistant"][t % 2], prose(t % 5, 3) + r.choice([".", ""])) for t in range(600)]  # a hot conversation
    rows += [(201, 3, "user", "same.")] * 90 + [(202, t, "user", "same.") for t in range(90)]  # ties and repeated rows
    rows += [(None, 1, "user", "a."), (None, None, None, None), (None, 2, "assistant", "b."), (203, None, "user", "null turn."), (203, None, "assistant", "c.")]
    rows += [(204, 10**15, "user", "far."), (204, -5, "system", "before."), (205, 1, "user", prose(1, 4000) + ".")]
    rows += [(c, 0, "user", "alone.") for c in range(300, 400)]  # some lose their only turn
    return rows


@pytest.mark.parametrize("long_rows", [3, 64, 4096])
def test_repair_equals_brute_force(spark, long_rows):
    rows = odd_conversations()
    found = got(repair_conversations(damaged(conversations(spark, rows)), long_rows))
    want = brute(rows)
    assert set(found) == set(want)
    assert [(c, found[c], want[c]) for c in want if found[c] != want[c]] == []
    assert any(zlib.crc32(f"{c}:0".encode()) % 20 == 0 and want[c][5:7] == (0, "") for c in range(300, 400))


def test_one_conversation_holds_two_thirds_of_the_rows(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], "ok." if t % 3 else prose(t, 4) + ".") for t in range(2000)]
    rows += [(c, t, ["user", "assistant"][t % 2], prose(c, 3) + ".") for c in range(2, 252) for t in range(4)]
    turns = damaged(conversations(spark, rows))
    found = got(repair_conversations(turns))
    assert found == brute(rows)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op11_conversation_repair(spark, folder)) == brute(rows)


def test_no_conversations(spark):
    assert repair_conversations(damaged(conversations(spark, []))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 16, 17, 33, 300])
def test_auctions_of_blocks_equal_a_label_setting_search(n):
    r = random.Random(n)
    names, faults = ["system", "user", "assistant", "tool"], {auction.SOUND: "", auction.DOOMED: "blank", auction.CUT: "truncated"}
    for _ in range(60 if n < 100 else 3):
        codes = bytes(r.randrange(12) for _ in range(n))
        rows = [(0, names[c % 4], "t") for c in codes]
        cost, letters, left = cheapest(rows, [faults[c // 4] for c in codes])
        assert auction.repair(codes) == (cost, letters)
        assert repaired_turns([(role, text) for _, role, text in rows], letters) == list(left)


def test_prices_never_break_the_rule_and_tight_arcs_are_cheapest():
    layers = [auction._LAYERS[c] for c in bytes([1, 6, 1, 2, 11, 0, 2])]
    costs = (0, auction.FAR, auction.FAR, 0)
    arcs, price, tight, end = auction._prices(layers, [auction.START], costs)
    assert all(price[i] <= a[0] + price[a[2]] for i, out in enumerate(arcs) for a in out)
    assert tight[auction.START] and price[end] == 0
