"""Keys, hashes and times as column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest number of differing bits at which two perceptual hashes count as close.
NEAR_BITS = 8
#: Longest pause, in seconds, inside one session.
GAP_SECONDS = 30 * 60


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trimmed(col: Column | str) -> Column:
    """Without surrounding blanks of any kind (spaces, tabs, line ends, wide blanks)."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def path_key(col: Column | str) -> Column:
    """Case-insensitive path: upper-cased, every ``/`` read as a backslash."""
    return F.translate(F.upper(_c(col)), "/", "\\")


def sha_key(col: Column | str) -> Column:
    """32 bytes of a usable SHA-256 text, else null.

    Usable: 64 hexadecimal digits between optional blanks, in any letter case.
    """
    return F.unhex(F.when(trimmed(col).rlike("^[0-9A-Fa-f]{64}$"), trimmed(col)))


def usable_hash(col: Column | str) -> Column:
    """A perceptual hash, or null where it is null or 0 (not computed)."""
    return F.nullif(_c(col).cast("long"), F.lit(0).cast("long"))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of differing bits of two 64-bit hashes."""
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def device_key(col: Column | str) -> Column:
    return F.lower(trimmed(col))


def micros(col: Column | str) -> Column:
    """Microseconds since 1970-01-01 00:00 of a zone-free timestamp.

    Computed from the calendar fields, so that no session time zone and no
    daylight saving rule enters.
    """
    c = _c(col).cast("timestamp_ntz")
    seconds = (
        F.unix_date(c.cast("date")).cast("long") * 86400
        + F.hour(c) * 3600
        + F.minute(c) * 60
    )
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


def area(width: Column | str, height: Column | str) -> Column:
    """64-bit pixel area; 0 where a side is null or not positive."""
    w, h = _c(width).cast("long"), _c(height).cast("long")
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0).cast("long"))
