"""Types of text columns, inferred from all of their values in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needledrop.functions.scalars import NUMBER

# Texts that are a truth value.
TRUE_WORDS = ("True", "TRUE", "true")
FALSE_WORDS = ("False", "FALSE", "false")

EMPTY, BOOLEAN, WHOLE, NUMBERS, TEXT = "void", "boolean", "bigint", "double", "string"

_WHOLE_NUMBER = r"^\s*[+-]?\d+\s*$"
# One bit per kind of value; a column is known by the kinds that occur in it.
_BIT = {BOOLEAN: 1, WHOLE: 2, NUMBERS: 4, TEXT: 8}


def _kind(value: Column) -> Column:
    whole = value.rlike(_WHOLE_NUMBER) & F.trim(value).try_cast("bigint").isNotNull()
    return (
        F.when(value.isin(*TRUE_WORDS, *FALSE_WORDS), _BIT[BOOLEAN])
        .when(whole, _BIT[WHOLE])
        .when(value.rlike(NUMBER), _BIT[NUMBERS])
        .when(value.isNotNull(), _BIT[TEXT])
    )


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, type, n_values, n_missing): the narrowest type that every value of a text column fits.

    Types are boolean, bigint (64 bits), double and string; a column without values is void. Whole numbers
    beyond 64 bits are double. Truth words beside numbers, as any other mixture, are string. One
    aggregation over all columns: a row per column leaves it, whatever the table holds.
    """
    columns = df.columns if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, type string, n_values long, n_missing long")
    kinds = [(f"k{i}", f"n{i}", F.col(f"`{c}`").cast("string")) for i, c in enumerate(columns)]
    seen = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.bit_or(_kind(v)).alias(k) for k, _, v in kinds], *[F.count(v).alias(n) for _, n, v in kinds]
    )

    def named(bits: Column) -> Column:
        only_numbers = bits.bitwiseAND(_BIT[BOOLEAN] | _BIT[TEXT]) == 0
        return (
            F.when(bits.isNull(), EMPTY).when(bits == _BIT[BOOLEAN], BOOLEAN).when(bits == _BIT[WHOLE], WHOLE).when(only_numbers, NUMBERS).otherwise(TEXT)
        )

    rows = [
        F.struct(
            F.lit(c).alias("column"), named(F.col(k)).alias("type"), F.col(n).alias("n_values"), (F.col("rows") - F.col(n)).alias("n_missing")
        )
        for c, (k, n, _) in zip(columns, kinds)
    ]
    return seen.select(F.inline(F.array(*rows)))


def common_type(one: str, other: str) -> str:
    """The narrowest type for the values of two columns."""
    if EMPTY in (one, other) or one == other:
        return other if one == EMPTY else one
    return NUMBERS if {one, other} == {WHOLE, NUMBERS} else TEXT


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns cast to their inferred types; void ones stay as they are."""

    def cast(name: str, kind: str) -> Column:
        value = F.col(f"`{name}`")
        if kind == BOOLEAN:
            return F.when(value.isin(*TRUE_WORDS), True).when(value.isin(*FALSE_WORDS), False)
        return F.trim(value).try_cast(kind)

    new = {c: cast(c, k) for c, k in types.items() if k not in (EMPTY, TEXT) and c in df.columns}
    return df.withColumns(new) if new else df


def typed_alike(frames: list[DataFrame], columns: list[str]) -> list[DataFrame]:
    """Frames whose text ``columns`` have, in all of them, the narrowest common type. One job per frame that has any."""
    types: dict[str, str] = {}
    for df in frames:
        own = [c for c in columns if c in df.columns]
        for row in infer_types(df, own).collect() if own else []:
            types[row["column"]] = common_type(types.get(row["column"], EMPTY), row["type"])
    return [typed(df, types) for df in frames]
