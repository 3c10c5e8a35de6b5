"""Times as Columns: Windows file times, epochs, and the texts that options and listings use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = 11_644_473_600  # seconds from 1601 to 1970
TICKS = 10_000_000  # tenths of microseconds in a second


def whole_seconds(micros: Column) -> Column:
    return F.floor(micros / 1_000_000).cast("long")


def to_filetime(seconds: Column, ticks: Column | int = 0) -> Column:
    """Seconds since 1970 as tenths of microseconds since 1601."""
    return (seconds + EPOCH) * TICKS + ticks


def filetime_seconds(ticks: Column) -> Column:
    """Tenths of microseconds since 1601 as whole seconds since 1970; null for 0."""
    return F.when(ticks > 0, (F.floor(ticks / TICKS) - EPOCH).cast("long"))


def moment_ns(text: str | int | None) -> int | None:
    """An option's time, seconds since 1970 or yyyy-MM-ddTHH:mm:ssZ, in nanoseconds; None for an empty one."""
    if text is None or text == "":
        return None
    if isinstance(text, int) or text.isdigit():
        return int(text) * 1_000_000_000
    import datetime

    return int(datetime.datetime.strptime(text, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=datetime.UTC).timestamp()) * 1_000_000_000


def snip_ns(text: str) -> tuple[int | None, int | None]:
    """The option ``a,b``: exactly one comma, either side may be empty."""
    if text.count(",") != 1:
        raise ValueError(f"a range needs exactly one comma: {text!r}")
    return tuple(moment_ns(x.strip()) for x in text.split(","))


def shown(at: Column) -> Column:
    """A timestamp as a listing shows it, in the session's time zone."""
    return F.date_format(at, "yyyy-MM-dd hh:mm:ss a")
