"""Predicates as Columns: time ranges, decode rules, visibility, protocol detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a stream that is HTTP begins with.
HTTP_STARTS = ("GET", "HEAD", "POST", "PUT", "DELETE", "TRACE", "OPTIONS", "CONNECT", "PATCH", "HTTP")


def snip(at: Column, lo: Column | None, hi: Column | None, closed: bool = True) -> Column:
    """Whether a time lies in a range; either bound may be missing, the upper one counts if ``closed``."""
    out = F.lit(True)
    if lo is not None:
        out = out & (at >= lo)
    if hi is not None:
        out = out & ((at <= hi) if closed else (at < hi))
    return out


def matches(rules: list[dict[str, str]], props: dict[str, Column]) -> Column:
    """Whether any rule holds; a rule holds if all its properties have the values that it names. No rules: false."""
    one = lambda r: reduce(lambda a, b: a & b, [F.coalesce(props[k] == v, F.lit(False)) for k, v in r.items()], F.lit(True))
    return reduce(lambda a, b: a | b, [one(r) for r in rules], F.lit(False))


def visible(is_metadata: Column, parsed: Column, in_snip: Column, show_metadata: bool = False, show_all: bool = False) -> Column:
    """Metadata shows only on demand, files that were decoded further only with ``show_all``, and the snip range always counts."""
    out = in_snip
    if not show_metadata:
        out = out & ~is_metadata
    if not show_all:
        out = out & ~parsed
    return out


def is_http(head: Column) -> Column:
    """Whether at least seven characters begin with a method or a response."""
    return (F.length(head) >= 7) & head.rlike("^(" + "|".join(HTTP_STARTS) + ")")


def application(l4: Column, src_port: Column, dst_port: Column) -> Column:
    """The application protocol that ports alone tell; null if none."""
    either = lambda p: (src_port == p) | (dst_port == p)
    return (
        F.when((l4 == "udp") & either(53), "dns")
        .when((l4 == "udp") & src_port.isin(67, 68), "dhcp")
        .when((l4 == "tcp") & either(22), "ssh")
        .when((l4 == "tcp") & either(21), "ftpcontrol")
        .when((l4 == "tcp") & either(443), "tls")
        .when((l4 == "tcp") & either(445), "smb")
    )
