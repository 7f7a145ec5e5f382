"""Chat formatting under a token budget, with DataFrame functions only.

A conversation becomes windows of whole turns. Prefix sums of turn tokens choose the windows: turns belong
together that have the same floor(tokens before it / stride), and a turn longer than a stride is alone. The
stride is half of what the budget leaves beside the history and the system turn of the conversation. A window
opens with the system turn, repeats a limited number of tokens of the turns before it, and then holds its own
turns. Loss is taken on the assistant turns that are a window's own; repeated ones are masked, so every
target counts once.

``<|im_start|>role\\ntext<|im_end|>\\n`` frames a turn. Inside roles and texts a backslash is doubled
and ``<|`` becomes ``<\\|``, a line break in a role becomes ``<\\n``: no text can hold a marker, and
between ``<`` and ``|`` or ``n`` a single backslash is always one of ours, so it reads back exactly.

Long conversations are not gathered to number their turns: counts and prefix sums are first summed per
block of turn numbers, and rows only meet the rows of their block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from needledrop.sources.store import settled

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"

_LONG = "bigint"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def turn_tokens(text: Column) -> Column:
    """Tokens of a turn for the budget: runs of letters and digits, other visible signs, and the frame."""
    return (F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\x09-\x0D\x20\p{L}\p{N}]")) + 4).cast(_LONG)


def _in_order(turns: DataFrame, tokens: str | None) -> DataFrame:
    """(conv_id, turn, role, text, tokens) without nulls in role, text and tokens."""
    text = F.coalesce("text", F.lit(""))
    known = turn_tokens(text) if tokens is None else F.coalesce(F.greatest(F.col(tokens), F.lit(0)) + 4, turn_tokens(text))
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), known.cast(_LONG).alias("tokens"))


def numbered(turns: DataFrame, block_turns: int = 256) -> DataFrame:
    """Add ``idx`` (from 0), ``before`` (tokens of earlier turns) and ``n_turns`` in the order turn, role, text, tokens.

    Null turns come first. Rows that are equal in every column are turns of their own.
    """
    conv = W.partitionBy("conv_id")
    block = F.floor(F.col("turn") / block_turns)
    rows = turns.withColumn("_block", F.coalesce(block, F.lit(-(2**62))))
    totals = rows.groupBy("conv_id", "_block").agg(F.count(F.lit(1)).alias("_n"), F.sum("tokens").alias("_t"))
    earlier = conv.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast(_LONG)
    totals = totals.select(
        "conv_id", "_block", F.sum("_n").over(conv).alias("n_turns"),
        F.coalesce(F.sum("_n").over(earlier), zero).alias("_n0"), F.coalesce(F.sum("_t").over(earlier), zero).alias("_t0"),
    )
    rows = rows.join(
        totals.withColumnsRenamed({"conv_id": "_conv", "_block": "_b"}),
        F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_block") == F.col("_b")),
    )
    inside = W.partitionBy("conv_id", "_block").orderBy("turn", "role", "text", "tokens")
    return rows.select(
        "conv_id", "turn", "role", "text", "tokens", "n_turns",
        (F.col("_n0") + F.row_number().over(inside) - 1).alias("idx"),
        (F.col("_t0") + F.coalesce(F.sum("tokens").over(inside.rowsBetween(W.unboundedPreceding, -1)), zero)).alias("before"),
    )


def windows(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """One row per (window, turn in it): ``window``, ``part`` and the turn, of turns with ``tokens``.

    ``part`` is 0 for the repeated system turn, 1 for repeated history, 2 for the window's own turns; the system
    turn is the first window's own. The system turn, history and two strides keep the budget, and turns up to a
    stride fill less than two. A longer turn is alone in its window, which repeats what fits beside it.
    So a window is over the budget only where the system turn and one turn are.
    """
    zero = F.lit(0).cast(_LONG)
    # The first turn of a conversation in the order of ``numbered``: one row each, combined before it is sent.
    opening = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text", "tokens")).alias("o"))
    opening = opening.where("o.role = 'system'").select(F.col("conv_id").alias("_conv"), F.col("o.tokens").alias("_s"))
    rows = numbered(turns).join(opening, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    s = F.coalesce("_s", zero)
    stride = F.greatest(F.lit(1), F.floor((F.lit(budget - history) - s) / 2))
    at = F.col("before") - s
    long = (F.col("tokens") > stride).cast(_LONG)
    leads = F.col("_s").isNotNull() & (F.col("idx") == 0)
    # Written once: the joins below read the numbered turns several times.
    rows = settled(
        rows.select(
            "conv_id", "n_turns", "idx", "role", "text", "tokens", s.alias("system"), leads.alias("leads"),
            at.alias("at"), F.when(leads, 0).otherwise(F.floor(at / stride) * 2 + long).alias("window"),
        ),
        "numbered-turns",
    )
    others = rows.where(~F.col("leads"))
    # The first turn of each window asks which turns end the history span before it.
    first = others.groupBy("conv_id", "window").agg(
        F.min("at").alias("_start"), F.min("idx").alias("_first"),
        (F.lit(budget) - F.max("system") - F.sum("tokens")).alias("_left"),
    )
    first = first.withColumn("_span", F.least(F.lit(history), F.greatest(zero, F.col("_left"))))
    # Turns within `history` tokens lie in the asker's slot of that width or in the slot before it.
    slot = F.floor(F.col("_start") / history)
    asked = first.withColumn("_slot", F.explode(F.array(slot, slot - 1)))
    repeated = others.withColumn("_slot", F.floor(F.col("at") / history)).alias("r").join(
        asked.alias("a"),
        F.col("r.conv_id").eqNullSafe(F.col("a.conv_id"))
        & (F.col("r._slot") == F.col("a._slot"))
        & (F.col("r.at") < F.col("a._start"))
        & (F.col("r.at") >= F.col("a._start") - F.col("a._span")),
    )
    cols = ["idx", "role", "text", "tokens"]
    own = others.select("conv_id", "window", F.lit(2).alias("part"), *cols)
    again = repeated.select("r.conv_id", "a.window", F.lit(1).alias("part"), *[F.col(f"r.{c}") for c in cols])
    # The system turn of a conversation goes before every window; it is the first one's own, or a window alone.
    system = rows.where("leads").alias("s")
    part = F.when(F.col("f._first") == 1, 2).otherwise(0)
    opened = first.alias("f").join(system, F.col("f.conv_id").eqNullSafe(F.col("s.conv_id"))).select(
        "f.conv_id", "f.window", part.alias("part"), *[F.col(f"s.{c}") for c in cols]
    )
    alone = rows.where("leads AND n_turns = 1").select("conv_id", "window", F.lit(2).alias("part"), *cols)
    return own.unionByName(again).unionByName(opened).unionByName(alone)


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 128, tokens: str | None = None) -> DataFrame:
    """(conv_id, window, formatted, n_tokens, n_repeated, loss_spans) of conversations (conv_id, turn, role, text).

    ``loss_spans`` are (start, length) in code points of ``formatted``: the text of the window's own
    assistant turns. ``n_repeated`` turns come first that earlier windows hold as their own. Windows are numbered
    in their order, with gaps. ``tokens`` names a column with the tokens of each text (those of ``token_counts``);
    without it, or where it is null, they are counted by a pattern. Four more frame a turn. ``n_tokens`` is at
    most ``budget`` unless the system turn and a single turn are over it. Null roles and texts are empty; null
    conv_ids are one conversation; other columns are ignored.
    """
    if not 0 < history < budget:
        raise ValueError("history must be positive and below the budget")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    framed = windows(_in_order(turns, tokens), budget, history).select(
        "conv_id", "window", "tokens",
        F.struct(
            "part", "idx", head.alias("head"), escape(F.col("text")).alias("body"),
            ((F.col("part") == 2) & (F.col("role") == "assistant")).alias("target"),
        ).alias("t"),
    )
    rows = framed.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("t")).alias("t"), F.sum("tokens").alias("n_tokens"))
    tail = len(END) + 1
    placed = F.aggregate(
        "t",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + tail).alias("at"),
            F.when(
                t["target"],
                F.concat(
                    acc["spans"],
                    F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    text = F.concat_ws("", F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))))
    return rows.select(
        "conv_id", "window", text.alias("formatted"), "n_tokens",
        F.size(F.filter("t", lambda t: t["part"] < 2)).alias("n_repeated"), placed["spans"].alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted window, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    parsed = F.transform(pieces, lambda p: F.substr(p, F.lit(1), F.length(p) - (len(END) + 1)))
    return F.transform(
        parsed,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
        ),
    )


def read_targets(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask of a window, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"])))


def conversation_digest(formatted_windows: DataFrame) -> DataFrame:
    """Read every conversation back from its windows, as digests."""
    own = F.slice(F.col("turns"), F.col("n_repeated") + 1, F.greatest(F.size("turns") - F.col("n_repeated"), F.lit(0)))
    read = formatted_windows.withColumn("turns", read_turns(F.col("formatted"))).select(
        "conv_id",
        F.struct(
            "window",
            F.size(own).cast(_LONG).alias("n"),
            F.concat_ws("", F.transform(own, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("said"),
            F.concat_ws("", read_targets(F.col("formatted"), F.col("loss_spans"))).alias("loss"),
            F.length("formatted").cast(_LONG).alias("chars"),
        ).alias("w"),
    )
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    total = lambda name: F.aggregate("w", F.lit(0).cast(_LONG), lambda a, w: a + w[name])
    joined = lambda name: F.concat_ws("", F.transform("w", lambda w: w[name]))
    return whole.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast(_LONG).alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )
