"""Log positions. Only transport positions are parsed; payload positions are opaque text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIR = r"^[0-9A-Fa-f]+/[0-9A-Fa-f]+$"
WHOLE = r"^[0-9]+$"
HALF = 4294967296

# The metadata keys that may hold a position, in order of preference.
PAYLOAD_POSITION_KEYS = ("source_position", "commit_lsn", "lsn", "wal_end_lsn", "end_lsn", "final_lsn")
ACKNOWLEDGE_POSITION_KEYS = ("wal_end_lsn", "wal_end", "lsn")


def lsn_valid(value: Column) -> Column:
    """True for HEX/HEX in either case, or a non-negative integer."""
    text = value.cast("string")
    return F.coalesce(text.rlike(PAIR) | text.rlike(WHOLE), F.lit(False))


def _half(text: Column, place: int) -> Column:
    """One hex half as a number; leading zeros do not matter, and NULL stands for what no BIGINT holds."""
    digits = F.regexp_replace(F.split_part(text, F.lit("/"), F.lit(place)), r"^0+(?=.)", "")
    return F.when(F.length(digits) <= 16, F.conv(digits, 16, 10).try_cast("bigint"))


def lsn_to_number(value: Column) -> Column:
    """HEX/HEX or decimal text to a byte position; NULL when malformed or above the BIGINT range."""
    text = value.cast("string")
    pair = F.try_add(F.try_multiply(_half(text, 1), F.lit(HALF)), _half(text, 2))
    return F.when(text.rlike(PAIR), pair).when(text.rlike(WHOLE), text.try_cast("bigint"))


def number_to_lsn(value: Column) -> Column:
    """Byte position to HEX/HEX with true halves."""
    number = value.cast("bigint")
    return F.concat(
        F.hex(F.shiftrightunsigned(number, 32)), F.lit("/"),
        F.hex(number.bitwiseAND(F.lit(HALF - 1))),
    )


def normalise_lsn(value: Column) -> Column:
    """Pairs stay as they are, decimal text becomes a pair, blank becomes NULL."""
    text = F.nullif(value.cast("string"), F.lit(""))
    return F.coalesce(F.when(text.rlike(WHOLE), number_to_lsn(text.try_cast("bigint"))), text)


def lsn_diff(later: Column, earlier: Column) -> Column:
    return lsn_to_number(later) - lsn_to_number(earlier)


def pick_position(metadata: Column, keys: tuple[str, ...]) -> Column:
    """The first of several metadata keys that holds a position."""
    return F.coalesce(*[F.try_element_at(metadata, F.lit(key)) for key in keys])
