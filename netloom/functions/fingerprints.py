"""Connection fingerprints as Columns over parsed fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The reserved values that clients put among suites and extensions.
GREASE = [(0x0A + 0x10 * k) * 0x101 for k in range(16)]
#: Versions as JA4 writes them.
VERSIONS = {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3", 0x0002: "s2"}


def hassh(kex: Column, enc: Column, mac: Column, comp: Column) -> Column:
    """MD5 of the four algorithm lists of a key exchange."""
    return F.md5(F.concat_ws(";", kex, enc, mac, comp).cast("binary"))


def hex4(values: Column) -> Column:
    """Numbers as four hexadecimal digits each, joined by commas."""
    return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), ",")


def part(text: Column) -> Column:
    """The first twelve digits of a SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 12)


def without_grease(values: Column) -> Column:
    return F.filter(values, lambda x: ~x.isin(GREASE))


def two(n: Column) -> Column:
    """A count with two digits at least."""
    return F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))


def ja3(version: Column, suites: Column, extensions: Column, groups: Column, formats: Column) -> Column:
    text = lambda a: F.array_join(F.transform(without_grease(a), lambda x: x.cast("string")), "-")
    return F.md5(F.concat_ws(",", version.cast("string"), text(suites), text(extensions), text(groups), text(formats)).cast("binary"))


def ja3s(version: Column, suite: Column, extensions: Column) -> Column:
    return F.md5(F.concat_ws(",", version.cast("string"), suite.cast("string"), F.array_join(F.transform(extensions, lambda x: x.cast("string")), "-")).cast("binary"))


def version_name(version: Column) -> Column:
    out = F.lit("00")
    for v, name in VERSIONS.items():
        out = F.when(version == v, name).otherwise(out)
    return out


def alpn_ends(alpn: Column) -> Column:
    """The first and last character of the first protocol; 00 without one."""
    return F.when(F.length(F.coalesce(alpn, F.lit(""))) > 0, F.concat(F.substring(alpn, 1, 1), F.substring(alpn, -1, 1))).otherwise("00")


def ja4(version: Column, sni: Column, suites: Column, extensions: Column, signatures: Column, alpn: Column) -> Column:
    """JA4 of a TLS client hello over TCP. Counts are not capped, and an empty list hashes like an empty text."""
    s, e = without_grease(suites), without_grease(extensions)
    listed = F.filter(e, lambda x: ~x.isin(0, 16))
    a = F.concat(F.lit("t"), version_name(version), F.when(F.length(F.coalesce(sni, F.lit(""))) > 0, "d").otherwise("i"), two(F.size(s)), two(F.size(e)), alpn_ends(alpn))
    sig = F.when(F.size(signatures) > 0, F.concat(F.lit("_"), hex4(signatures))).otherwise("")
    return F.concat_ws("_", a, part(hex4(F.array_sort(s))), part(F.concat(hex4(F.array_sort(listed)), sig)))


def ja4s(version: Column, suite: Column, extensions: Column, alpn: Column) -> Column:
    """JA4S of a server hello; extensions stay in their order."""
    a = F.concat(F.lit("t"), version_name(version), two(F.size(extensions)), alpn_ends(alpn))
    return F.concat_ws("_", a, F.lpad(F.lower(F.hex(suite)), 4, "0"), part(hex4(extensions)))


def ja4h(method: Column, version: Column, names: Column, cookie: Column, referer: Column, language: Column) -> Column:
    """JA4H of an HTTP request: ``names`` are its header names in order."""
    plain = F.filter(names, lambda x: ~F.lower(x).isin("cookie", "referer"))
    lang = F.rpad(F.substring(F.regexp_replace(F.lower(F.split(F.coalesce(language, F.lit("")), ",")[0]), "[^a-z0-9]", ""), 1, 4), 4, "0")
    pairs = F.transform(F.split(F.coalesce(cookie, F.lit("")), ";"), lambda x: F.trim(x))
    fields = F.transform(pairs, lambda x: F.split(x, "=")[0])
    a = F.concat(
        F.lower(F.substring(method, 1, 2)),
        F.regexp_replace(version, r"[^0-9]", ""),
        F.when(cookie.isNotNull(), "c").otherwise("n"),
        F.when(referer.isNotNull(), "r").otherwise("n"),
        two(F.size(plain)),
        lang,
    )
    of = lambda x: F.when(cookie.isNotNull(), part(F.array_join(F.array_sort(x), ","))).otherwise("000000000000")
    return F.concat_ws("_", a, part(F.array_join(plain, ",")), of(fields), of(pairs))
