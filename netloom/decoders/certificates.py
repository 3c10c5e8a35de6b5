"""Certificates of TLS handshakes: the chain of each stream in order, as PEM, with the JA4X of each.

A certificate is DER: values inside values, each with its tag and length. The
walk over them runs on batches, and tells the object identifiers of issuer,
subject and extensions, the modulus of an RSA key, and the common names; hashes
and PEM are Columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import number
from ..functions.fingerprints import part

HANDSHAKE, CERTIFICATE = 22, 11
#: Tags of DER.
INTEGER, BIT_STRING, OID, SEQUENCE, SET, VERSION, EXTENSIONS = 0x02, 0x03, 0x06, 0x30, 0x31, 0xA0, 0xA3
#: The identifiers of an RSA key and of a common name.
RSA, COMMON_NAME = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("550403")

PARSED = "struct<issuer:array<string>,subject:array<string>,extensions:array<string>,issuer_name:string,subject_name:string,modulus:binary>"


def values(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(tag, start, end) of the values that lie side by side in a stretch; one that does not fit is an error."""
    end = len(data) if end is None else end
    while at < end:
        if at + 2 > end:
            raise ValueError("a value without length")
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            more = n & 0x7F
            if not 1 <= more <= 4 or at + more > end:
                raise ValueError("a length of no sense")
            n, at = int.from_bytes(data[at : at + more], "big"), at + more
        if at + n > end:
            raise ValueError("a value that is cut")
        yield tag, at, at + n
        at += n


def _names(data: bytes, at: int, end: int) -> tuple[list[str], str | None]:
    """The identifiers of a name's entries in order, and its common name."""
    found, common = [], None
    for _, a, b in values(data, at, end):
        for _, c, d in values(data, a, b):
            (tag, s, e), (_, vs, ve), *_ = values(data, c, d)
            if tag != OID:
                raise ValueError("an entry without identifier")
            found.append(data[s:e].hex())
            if data[s:e] == COMMON_NAME:
                common = data[vs:ve].decode("utf-8", "replace")
    return found, common


def parse(data: bytes) -> dict | None:
    """What ``PARSED`` names of one certificate; None for what is none."""
    try:
        ((tag, a, b),) = values(data)
        inner = next(values(data, a, b))
        if tag != SEQUENCE or inner[0] != SEQUENCE:
            return None
        fields = list(values(data, inner[1], inner[2]))
        if fields[0][0] == VERSION:
            fields = fields[1:]
        # Serial number, algorithm, issuer, validity, subject, key; then what is optional.
        issuer, issuer_name = _names(data, *fields[2][1:])
        subject, subject_name = _names(data, *fields[4][1:])
        algorithm, bits = list(values(data, *fields[5][1:]))[:2]
        modulus = None
        _, s, e = next(values(data, algorithm[1], algorithm[2]))
        if data[s:e] == RSA:
            _, ks, ke = next(values(data, bits[1] + 1, bits[2]))
            _, ms, me = next(values(data, ks, ke))
            modulus = data[ms:me].lstrip(b"\0")
        extensions = []
        for kind, s, e in fields[6:]:
            if kind == EXTENSIONS:
                _, ls, le = next(values(data, s, e))
                for _, xs, xe in values(data, ls, le):
                    _, os, oe = next(values(data, xs, xe))
                    extensions.append(data[os:oe].hex())
    except (ValueError, IndexError, StopIteration):
        return None
    return {"issuer": issuer, "subject": subject, "extensions": extensions, "issuer_name": issuer_name, "subject_name": subject_name, "modulus": modulus}


def parsed(der: Column) -> Column:
    """``PARSED`` of certificates; null for bytes that are none."""
    texts = pa.list_(pa.string())
    kind = pa.struct([("issuer", texts), ("subject", texts), ("extensions", texts), ("issuer_name", pa.string()), ("subject_name", pa.string()), ("modulus", pa.binary())])

    @F.arrow_udf(PARSED)
    def each(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            yield pa.array([None if x is None else parse(x) for x in column.to_pylist()], kind)

    return each(der)


def ja4x(cert: Column) -> Column:
    """The fingerprint of a parsed certificate: parts for the identifiers of issuer, subject and extensions; null without one."""
    of = lambda c: part(F.array_join(cert[c], ","))
    return F.when(cert.isNotNull(), F.concat_ws("_", of("issuer"), of("subject"), of("extensions")))


def pem(der: Column, known: Column) -> Column:
    """PEM of a certificate, 64 characters a line; bytes that are none stay as they are."""
    lines = F.regexp_replace(F.regexp_replace(F.base64(der), "\\s", ""), "(.{1,64})", "$1\n")
    text = F.concat(F.lit("-----BEGIN CERTIFICATE-----\n"), lines, F.lit("-----END CERTIFICATE-----\n"))
    return F.when(known, F.encode(text, "UTF-8")).otherwise(der)


def from_pem(text: Column) -> Column:
    """The bytes between the marks of a PEM text; null without them."""
    inner = F.regexp_extract(text, "(?s)-----BEGIN CERTIFICATE-----(.*?)-----END CERTIFICATE-----", 1)
    return F.when(inner != "", F.unbase64(F.regexp_replace(inner, r"\s", "")))


def chains(records: DataFrame) -> DataFrame:
    """(stream, side, run, n, place, at, first_of_chain, der, pem, ja4x, subject_name, issuer_name, modulus) of every certificate in handshake records.

    ``place`` counts the certificates of a side from 0, in order; ``at`` is
    where one begins in its run. A message that is longer than its record is
    left out, as is a chain's rest behind a length that does not fit. Bytes
    that are no certificate have null names and fingerprint, and stay as they
    are in ``pem``. A chain may be any length.
    """
    kind = pa.list_(pa.struct([("at", pa.int64()), ("der", pa.binary())]))

    @F.arrow_udf("array<struct<at:long,der:binary>>")
    def split(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            rows = []
            for body in column.to_pylist():
                out, at = [], 0
                while body and at + 4 <= len(body):
                    size = int.from_bytes(body[at + 1 : at + 4], "big")
                    here, end = at + 7, at + 4 + size
                    if body[at] == CERTIFICATE and end <= len(body):
                        while here + 3 <= end:
                            n = int.from_bytes(body[here : here + 3], "big")
                            if here + 3 + n > end:
                                break
                            out.append({"at": here + 3, "der": body[here + 3 : here + 3 + n]})
                            here += 3 + n
                    at = end
                rows.append(out)
            yield pa.array(rows, kind)

    b = F.col("body")
    plausible = records.where((F.col("type") == HANDSHAKE) & number(b, 0, 1).isin(2, CERTIFICATE))
    each = plausible.select("stream", "side", "run", "n", F.col("at").alias("record_at"), F.posexplode(split("body")).alias("k", "c"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("stream", "side").orderBy("n", "k")) - 1
    each = each.withColumns({"place": place, "der": F.col("c.der"), "at": F.col("record_at") + 5 + F.col("c.at")}).withColumn("p", parsed(F.col("der")))
    known = F.col("p").isNotNull()
    return each.select(
        "stream", "side", "run", "n", "place", "at", ((F.col("k") == 0) & (F.col("place") == 0)).alias("first_of_chain"), "der", pem(F.col("der"), known).alias("pem"), ja4x(F.col("p")).alias("ja4x"), "p.subject_name", "p.issuer_name", "p.modulus"
    )
