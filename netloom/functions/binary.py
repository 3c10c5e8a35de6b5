"""Bytes: numbers, exclusive or, ciphers, compression."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


#: Fixed value: the lower half of each byte of eight.
HALVES = 0x0F0F0F0F0F0F0F0F


def number(data: Column, at, length: int, little: bool = False) -> Column:
    """An unsigned integer of up to eight bytes at a place (from 0); null beyond the end, and from 2^63 on."""
    at = F.lit(at) if isinstance(at, int) else at
    h = F.hex(F.substring(data, at.cast("int") + 1, F.lit(length)))
    if little:  # Digits from the last to the first, then the two of each byte change places; no regular expression a number.
        x = F.conv(F.reverse(h), 16, -10).cast("long")
        x = F.shiftleft(x.bitwiseAND(HALVES), 4).bitwiseOR(F.shiftrightunsigned(x, 4).bitwiseAND(HALVES))
        return F.when((F.length(h) == 2 * length) & (F.substring(h, 15, 1) < "8" if length == 8 else F.lit(True)), x)
    return F.when(F.length(h) == 2 * length, F.conv(h, 16, 10).try_cast("long"))


def ipv4(data: Column, at) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.concat_ws(".", *[number(data, at + k, 1).cast("string") for k in range(4)])


def aes_cbc(data: Column, key: Column, iv: Column) -> Column:
    """AES-CBC without padding: a block is added behind that makes the padding right, by encrypting an empty text after the last block."""
    last = F.substring(data, F.length(data) - 15, F.lit(16))
    more = F.substring(F.aes_encrypt(F.lit(b""), key, F.lit("CBC"), F.lit("PKCS"), last), 17, 16)
    return F.aes_decrypt(F.concat(iv, data, more), key, F.lit("CBC"), F.lit("PKCS"))


def aes_gcm(nonce: Column, data: Column, key: Column, aad: Column) -> Column:
    """AES-GCM with the tag checked; null if it does not fit."""
    return F.try_aes_decrypt(F.concat(nonce, data), key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def by_slices(f: Callable[..., pa.Array], *columns: pa.Array, rows: int = 256) -> pa.Array:
    """``f`` of columns, some rows at a time: a batch never lies in memory a second time as Python's objects."""
    parts = [f(*[c.slice(k, rows) for c in columns]) for k in range(0, len(columns[0]), rows)]
    return pa.concat_arrays(parts) if parts else f(*columns)


@F.arrow_udf(BinaryType())
def xor(data: pa.Array, key: pa.Array) -> pa.Array:
    """The data with a key repeated along it; an empty key leaves it as it is."""
    return by_slices(_xored, data, key)


def _xored(data: pa.Array, key: pa.Array) -> pa.Array:
    out = []
    for d, k in zip(data, key, strict=True):
        if not (d.is_valid and k.is_valid and len(k.as_py())):
            out.append(d.as_py())
            continue
        a, b = np.frombuffer(d.as_py(), np.uint8), np.frombuffer(k.as_py(), np.uint8)
        out.append((a ^ np.resize(b, len(a))).tobytes())
    return pa.array(out, pa.binary())


def _each(f):
    @F.arrow_udf(BinaryType())
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            yield by_slices(lambda c: pa.array([None if x is None else f(x) for x in c.to_pylist()], pa.binary()), column)

    return of


def _inflate(data: bytes, *wbits: int) -> bytes:
    for w in wbits:
        d = zlib.decompressobj(w)
        try:
            return d.decompress(data) + d.flush()
        except zlib.error:
            continue
    return b""


def _unchunk(data: bytes) -> bytes:
    """The body of a chunked transfer; a malformed chunk ends it."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            n = int(data[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            break
        out.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
        if n == 0:
            break
    return b"".join(out)


gunzip = _each(lambda x: _inflate(x, 31))
inflate = _each(lambda x: _inflate(x, 15, -15))
unchunk = _each(_unchunk)
gzip = _each(lambda x: (c := zlib.compressobj(wbits=31)).compress(x) + c.flush())
deflate = _each(lambda x: zlib.compress(x))
chunk = _each(lambda x: b"".join(b"%x\r\n%s\r\n" % (len(x[k : k + 1000]), x[k : k + 1000]) for k in range(0, len(x), 1000)) + b"0\r\n\r\n")
