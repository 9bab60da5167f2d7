"""ISO-8601 reading. Naive times are UTC, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# date, optional separator and time, optional fraction, optional offset; the dashes
# and colons may be left out
_ISO = (
    r"\A(\d{4})-?(\d{2})-?(\d{2})"
    r"(?:[^\d](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
    r"(?:(Z)|([+-]\d{2})(?::?(\d{2}))?)?)?\z"
)

# the usual spelling, which the timestamp cast reads as it is
_USUAL = r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}(?::\d{2})?)?\z"
_ZONED = r"(?:Z|[+-]\d{2}(?::\d{2})?)\z"


def iso_timestamp(value: Column | str) -> Column:
    """Timestamp of an ISO-8601 text, NULL when it is not one.

    Fractions beyond microseconds are cut. Both the extended and the basic form are
    read; a lone year or a text with trailing characters is not a time.
    """
    value = F.col(value) if isinstance(value, str) else value

    def part(index: int, default: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(value, _ISO, index), F.lit("")), F.lit(default))

    rebuilt = F.concat(
        part(1, ""), F.lit("-"), part(2, ""), F.lit("-"), part(3, ""),
        F.lit(" "), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"),
        F.lit("."), F.left(part(7, "0"), F.lit(6)),
        part(9, "+00"), F.lit(":"), part(10, "00"),
    )
    zoned = F.when(value.rlike(_ZONED), value).otherwise(F.concat(value, F.lit("Z")))
    return F.when(value.rlike(_USUAL), F.try_to_timestamp(zoned)).when(value.rlike(_ISO), F.try_to_timestamp(rebuilt))


def event_time(value: Column, default: Column) -> Column:
    """Time of a message: the default when absent, NULL when it cannot be read."""
    return F.when(value.isNull(), default).otherwise(iso_timestamp(value))
