"""Row-level expressions on strings and numbers; all are built-in, none is a Python UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Platform families and the texts that mark them; the first match wins.
PLATFORM_MARKS = (
    ("windows", ("windows",)),
    ("android", ("android",)),
    ("ios", ("ios", "iphone", "ipad")),
    ("linux", ("linux",)),
    ("osx", ("osx", "mac", "os x")),
    ("cast", ("cast", "chromecast")),
    ("webplayer", ("webplayer", "web player", "web")),
)
OTHER_PLATFORM = "other"

# Fixed value: the text in front of a track id in its URI.
TRACK_URI_PREFIX = "spotify:track:"
# Fixed value: the end reason that is the positive class.
POSITIVE_REASON = "fwdbtn"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def platform_family(platform: Column | str) -> Column:
    lowered = F.lower(_col(platform))
    cases = None
    for family, marks in PLATFORM_MARKS:
        hit = reduce(lambda a, b: a | b, [lowered.contains(m) for m in marks])
        cases = F.when(hit, family) if cases is None else cases.when(hit, family)
    return cases.otherwise(OTHER_PLATFORM)


def track_id(uri: Column | str) -> Column:
    return F.replace(_col(uri), F.lit(TRACK_URI_PREFIX), F.lit(""))


def label_flag(reason: Column | str) -> Column:
    """1 where the play ended by the forward button, else 0; null counts as 0."""
    return F.when(_col(reason).eqNullSafe(F.lit(POSITIVE_REASON)), 1).otherwise(0)


def presence_flag(value: Column | str) -> Column:
    return _col(value).isNotNull().cast("tinyint")


def song_age(year: Column | str, released: Column | str) -> Column:
    """Years since release; negative or unknown ages are 0."""
    age = _col(year).cast("double") - F.nanvl(_col(released).cast("double"), F.lit(None).cast("double"))
    return F.when(age >= 0, age).otherwise(F.lit(0.0))


# Decimal numbers and infinities; Java would also read 1d, 1f and hexadecimal text as numbers.
NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)\s*$"


def lenient_float(text: Column | str) -> Column:
    """Number or null; bad text never raises, also under ANSI mode."""
    c = _col(text).cast("string")
    return F.when(c.rlike(NUMBER), c.try_cast("double")).cast("float")


def as_salted_key(key: Column, matches: Column, spread: Column) -> Column:
    """``key`` where ``matches``, else a text that equals no key and differs from row to row.

    Rows that cannot match would all meet in one join partition under a null or a constant.
    """
    salt = F.concat(F.lit("\x00"), F.xxhash64(spread).cast("string"))
    return F.when(matches, key).otherwise(salt)
