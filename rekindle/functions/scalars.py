"""Scalar expressions used by cleaning, assembly and content operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that counts as a plain decimal number, and words that mark a purchase.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
PURCHASE_PATTERN = "purchase|buy|order"


def plain_name(c: Column) -> Column:
    """Lower case without underscores, spaces and hyphens."""
    return F.translate(F.lower(c), "_ -", "")


def compact_name(c: Column) -> Column:
    """Lower case, only ``[a-z0-9]`` kept."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def name_tokens(c: Column) -> Column:
    """Distinct lower-case words of an identifier, split at symbols and camelCase."""
    spaced = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    words = F.split(F.lower(F.regexp_replace(spaced, "[^0-9a-zA-Z]+", " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def content_token(c: Column, unicode: bool = False) -> Column:
    """Runs of other characters become one space; nothing left becomes ``unknown``."""
    other = r"[^\p{L}\p{N}]+" if unicode else "[^a-z0-9]+"
    cleaned = F.trim(F.regexp_replace(F.lower(c.cast("string")), other, " "))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("unknown"))


def labelled_value(name: str, c: Column, dtype: T.DataType, unicode: bool = False) -> Column:
    """``name_value`` text of a side feature; null stays null."""
    label = name.lower()
    if isinstance(dtype, T.NumericType):
        return F.when(c.isNotNull(), F.format_string(label.replace("%", "%%") + "_%.3f", c.cast("double")))
    return F.when(c.isNotNull(), F.concat(F.lit(label + "_"), content_token(c, unicode)))


def pipe_values(c: Column) -> Column:
    """Distinct non-empty parts of ``a|b|c``."""
    return F.array_distinct(F.filter(F.split(c, r"\|"), lambda g: g != ""))


def safe_double(c: Column, dtype: T.DataType | None = None) -> Column:
    """Double or null; text must be a plain decimal number, NaN is null."""
    if dtype is not None and isinstance(dtype, (T.NumericType, T.BooleanType)):
        value = c.cast("double")
    else:
        text = F.trim(c.cast("string"))
        value = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def _six_digits(x: Column) -> Column:
    """``x``, or its six-digit neighbour where the seventh and last decimal digit is a 5.

    Java rounds such a number up by its decimal text; the exact binary value may lie below the
    tie. The sign of x·10^j - n is computed without rounding (Dekker's product) and decides.
    """
    size = F.abs(x)
    places = F.lit(6) - F.floor(F.log10(size)).cast("int")
    scale = F.pow(F.lit(10.0), places)
    product = size * scale
    n = F.rint(product)
    tie = places.between(1, 22) & (n % 10 == 5) & (n / scale == size)

    def halves(v):
        high = v * 134217729.0 - (v * 134217729.0 - v)
        return high, v - high

    (a, b), (c, d) = halves(size), halves(scale)
    rest = (product - n) + ((((a * c - product) + a * d) + b * c) + b * d)
    down = (n - 5) / 10
    up = (rest > 0) | ((rest == 0) & (down % 2 == 1))
    return F.when(tie, F.signum(x) * F.when(up, down + 1).otherwise(down) / (scale / 10)).otherwise(x)


def join_key(c: Column, dtype: T.DataType | None = None) -> Column:
    """Text under which ``1``, ``1.0``, `` 1`` and ``001`` are the same key."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType)):
        return c.cast("string")
    if isinstance(dtype, T.LongType):  # beyond 2^53 the value is that of the nearest double
        exact = F.abs(c) <= F.lit(2**53)
        return F.when(exact, c.cast("string")).otherwise(c.cast("double").try_cast("decimal(38,0)").cast("string"))
    text = F.trim(c.cast("string"))
    number = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    number = F.when(F.abs(number) < F.lit(float("inf")), number)
    short = F.regexp_replace(F.format_string("%g", _six_digits(number)), r"([.][0-9]*?)0+(e|$)", "$1$2")
    short = F.regexp_replace(short, r"[.](e|$)", "$1")
    whole = number == F.floor(number)
    small = whole & (F.abs(number) < F.lit(1e18))
    return (
        F.when(number.isNull(), text)
        .when(small, F.when(small, number).cast("bigint").cast("string"))
        .when(whole & (F.abs(number) < F.lit(1e37)), number.try_cast("decimal(38,0)").cast("string"))
        .otherwise(short)
    )


def split_bucket(user: Column, item: Column, salt: str = "") -> Column:
    """Stable bucket 0..9999 of a pair, the same in every engine that has md5.

    A second split of one part needs another ``salt``: all its pairs share the old buckets.
    """
    head = F.substring(F.md5(F.concat(user, F.lit("|"), item, F.lit(salt))), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % 10000


def is_purchase(event: Column) -> Column:
    return F.coalesce(F.lower(event).rlike(PURCHASE_PATTERN), F.lit(False))


def finite_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def epoch_micros(c: Column, dtype: T.DataType) -> Column:
    """Time as a double: micros since 1970 for times, dates and ISO text, the number itself for numbers."""
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(dtype, (T.DateType, T.TimestampNTZType)):
        return F.timestamp_diff("MICROSECOND", origin, c.cast("timestamp_ntz")).cast("double")
    text = F.trim(c.cast("string"))
    parsed = F.timestamp_diff("MICROSECOND", origin, text.try_cast("timestamp_ntz")).cast("double")
    return F.coalesce(safe_double(text), parsed)
