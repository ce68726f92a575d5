"""Column functions on identifiers, names and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX32 = r"^[0-9a-f]{32}$"
_DASHED = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_NESTED = r"\{0x[0-9a-f]{8},0x[0-9a-f]{4},0x[0-9a-f]{4},\{(0x[0-9a-f]{2},){7}0x[0-9a-f]{2}\}\}"
GUID_PATTERN = rf"^([0-9a-f]{{32}}|{_DASHED}|\{{{_DASHED}\}}|\({_DASHED}\)|{_NESTED})$"
_NOT_WORD = r"[^\p{L}\p{Nd}]"


def canon_guid(value: Column) -> Column:
    """Any GUID spelling as 32 lower-case hex digits; anything else is null."""
    text = F.lower(F.trim(value))
    return F.when(text.rlike(GUID_PATTERN), F.regexp_replace(text, r"0x|[-{}(),]", ""))


def norm_library_id(value: Column) -> Column:
    """Library id without dashes, in lower case."""
    return F.lower(F.replace(value, F.lit("-"), F.lit("")))


def norm_name(value: Column) -> Column:
    """Letters and digits of a device name, in lower case."""
    return F.regexp_replace(F.lower(value), _NOT_WORD, "")


def parse_date(value: Column) -> Column:
    """Timestamp of a date string; unparsable text is null and sorts as the earliest date."""
    return value.try_cast("timestamp")


def round_trip_date(value: Column) -> Column:
    """Date text with seven decimals and the UTC mark, as catalog entries carry it."""
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'")


def strip_device_ts(value: Column) -> Column:
    """Drop the ``|timestamp`` suffix from a base64 device id; other ids pass unchanged.

    The suffix counts only when the last pipe is not the first character and it is at most
    20 characters long including the pipe.
    """
    text = F.try_to_binary(F.trim(value), F.lit("base64")).cast("string")
    tail = F.substring_index(text, "|", -1)
    head = F.left(text, F.length(text) - F.length(tail) - F.lit(1))
    strip = (
        text.contains("|")
        & (F.length(text) - F.length(tail) > 1)
        & (F.length(tail) + 1 <= 20)
    )
    # long values may come out of base64() in lines
    again = F.replace(F.base64(F.encode(head, "utf-8")), F.lit("\r\n"), F.lit(""))
    return F.when(F.coalesce(strip, F.lit(False)), again).otherwise(value)
