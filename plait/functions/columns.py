"""Column expressions: encodings, buckets, keys, labels.  All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lenient_date(x) -> Column:
    """yyyy-MM-dd, null where it cannot be read; dates and timestamps pass."""
    return F.try_to_date(c(x).cast("string").substr(1, 10), "yyyy-MM-dd")


def coded(x, values: dict[str, int]) -> Column:
    """A small integer for each value; 0 for all others and null."""
    out = reduce(lambda acc, kv: acc.when(c(x) == kv[0], kv[1]), list(values.items())[1:], F.when(c(x) == next(iter(values)), next(iter(values.values()))))
    return out.otherwise(0).cast("tinyint")


#: Fixed values of the encodings.
SIDES, STANDS, THROWS = {"Bot": 1, "Top": 0}, {"R": 1, "L": 2, "S": 3}, {"R": 1, "L": 2}


def occupied(x) -> Column:
    return c(x).isNotNull().cast("tinyint")


def clip(x, lo, hi) -> Column:
    return F.least(F.greatest(c(x), F.lit(lo)), F.lit(hi))


def inning_bucket(x) -> Column:
    """1-3, 4-6, 7-8, 9 and over."""
    return F.when(c(x) <= 3, 0).when(c(x) <= 6, 1).when(c(x) <= 8, 2).otherwise(3)


def score_bucket(x) -> Column:
    """-3 and under to 3 and over, as 0 to 6."""
    return clip(x, -3, 3) + 3


def pitch_number_bucket(x) -> Column:
    return F.when(c(x) <= 1, 0).when(c(x) == 2, 1).when(c(x) == 3, 2).otherwise(3)


def truncated(x) -> Column:
    """A number as a long, cut towards zero; null and not-a-number as 0, beyond the range its end."""
    d = c(x).cast("double")
    return F.when(d.isNull() | F.isnan(d), 0).when(d >= 2.0**63, 2**63 - 1).when(d <= -(2.0**63), -(2**63)).otherwise(F.when(d < 0, F.ceil(d)).otherwise(F.floor(d))).cast("bigint")


def runners(b1, b2, b3) -> Column:
    """A bit for each base."""
    bit = lambda x: F.when(c(x) > 0, 1).otherwise(0)
    return bit(b1) + 2 * bit(b2) + 4 * bit(b3)


def bases_text(state) -> Column:
    """The occupied bases with dashes, '-' alone for none."""
    at = [F.when(c(state).bitwiseAND(F.lit(1 << i)) > 0, F.lit(str(i + 1))) for i in range(3)]
    text = F.concat_ws("-", *at)
    return F.when(text == "", "-").otherwise(text)


def safe_token(x) -> Column:
    """Fit for a column name."""
    return F.when(c(x) == "<OOV>", "OOV").otherwise(F.regexp_replace(c(x), "[^A-Za-z0-9]", "_"))


def html_escaped(x) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, c(x))


def packed_key(parts: list[tuple[str, int]]) -> Column:
    """Components with their radix in one long; the first stands highest."""
    return reduce(lambda acc, p: acc * F.lit(p[1]).cast("bigint") + F.col(p[0]).cast("bigint"), parts[1:], F.col(parts[0][0]).cast("bigint"))


def unpacked_key(key, radices: list[int]) -> list[Column]:
    """Inverse of :func:`packed_key`, in whole numbers throughout; the first has no radix."""
    out, rest = [], c(key)
    for r in reversed(radices):
        out.append(rest % r)
        rest = F.call_function("div", rest, F.lit(r))
    return [rest, *reversed(out)]


def label(x, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(c(x) == k, v).otherwise(out)
    return out


#: Labels of buckets.
INNINGS = {0: "1-3", 1: "4-6", 2: "7-8", 3: "9+"}
SCORES = {0: "<=-3", 1: "-2", 2: "-1", 3: "0", 4: "+1", 5: "+2", 6: ">=+3"}
STAND_NAMES = {1: "R", 2: "L", 3: "S"}
