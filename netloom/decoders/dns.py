"""DNS datagrams as JSON: keys sorted, one tab a level, numbers as text."""

from __future__ import annotations

import ipaddress
import json
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .registry import Options, decoder, made, properties

#: Names of classes and record types by number, from 0.
CLASSES = (
    "Unknown (0)",
    "IN",
    "IN_QU",
    "CH",
    "HS",
)
RECORDS = (
    "Unknown (0)",
    "A",
    "NS",
    "MD",
    "MF",
    "CNAME",
    "SOA",
    "MB",
    "MG",
    "MR",
    "NULL_R",
    "WKS",
    "PTR",
    "HINFO",
    "MINFO",
    "MX",
    "TXT",
    "RP",
    "AFSDB",
    "X25",
    "ISDN",
    "RT",
    "NSAP",
    "NSAP_PTR",
    "SIG",
    "KEY",
    "PX",
    "GPOS",
    "AAAA",
    "LOC",
    "NXT",
    "EID",
    "NIMLOC",
    "SRV",
    "ATMA",
    "NAPTR",
    "KX",
    "CERT",
    "A6",
    "DNAM",
    "SINK",
    "OPT",
    "APL",
    "DS",
    "SSHFP",
    "IPSECKEY",
    "RRSIG",
    "NSEC",
    "DNSKEY",
    "DHCID",
    "NSEC3",
    "NSEC3PARAM",
)


def _called(names: tuple[str, ...], n: int) -> str:
    return "ALL" if n == 255 else names[n] if n < len(names) else f"Unknown ({n})"


def _name(data: bytes, at: int) -> tuple[str, int]:
    """A name and the place behind it; pointers lead backwards only."""
    labels, behind, least = [], -1, len(data)
    while True:
        n = data[at]
        if n >= 0xC0:
            to = (n & 0x3F) << 8 | data[at + 1]
            behind = at + 2 if behind < 0 else behind
            if to >= least:
                raise ValueError("a pointer that leads forwards")
            at = least = to
        elif n == 0:
            return ".".join(labels), at + 1 if behind < 0 else behind
        else:
            labels.append(data[at + 1 : at + 1 + n].decode("latin-1"))
            at += 1 + n


def to_json(data: bytes) -> str | None:
    """The JSON of a message; null for what is none. The identifier is read as the bytes lie, low byte first."""
    try:
        flags, nq, na, nn = struct.unpack_from(">4H", data, 2)
        out: dict = {"ID": str(struct.unpack_from("<H", data)[0])}
        at, queries, answers, authorities = 12, [], [], []
        for _ in range(nq):
            name, at = _name(data, at)
            kind, cls = struct.unpack_from(">2H", data, at)
            at += 4
            queries.append({"type": _called(RECORDS, kind), "name": name, "class": _called(CLASSES, cls)})
        for k in range(na + nn):
            name, at = _name(data, at)
            kind, cls, ttl, n = struct.unpack_from(">2HIH", data, at)
            at += 10
            rdata = data[at : at + n]
            if k >= na:
                authorities.append({"auth": name, "ttl": str(ttl)})
            else:
                row = {"name": name, "data": "", "ttl": str(ttl), "type": _called(RECORDS, kind), "class": _called(CLASSES, cls)}
                if kind in (1, 28) and n in (4, 16):
                    row["data"] = ipaddress.ip_address(rdata).compressed
                elif kind == 15:
                    row["preference"] = str(struct.unpack_from(">H", rdata)[0])
                    row["data"] = _name(data, at + 2)[0]
                answers.append(row)
            at += n
    except (struct.error, IndexError, ValueError):
        return None
    if queries:
        out["Queries"] = queries
    if flags & 0x8000:
        out |= {"Answers": answers, "Authorities": authorities}
    return json.dumps(out, indent="\t", sort_keys=True, ensure_ascii=False)


@F.arrow_udf(StringType())
def dns_json(payload: pa.Array) -> pa.Array:
    return pa.array([None if x is None else to_json(x) for x in payload.to_pylist()], pa.string())


def messages(packets: DataFrame) -> DataFrame:
    """A row for each DNS datagram: its name (REQ- or RES- and its identifier) and its JSON."""
    df = packets.where("l4 = 'udp' AND (src_port = 53 OR dst_port = 53)").withColumn("content", dns_json("payload")).where("content IS NOT NULL")
    is_response = F.get_json_object("content", "$.Answers").isNotNull()
    name = F.concat(F.when(is_response, "RES-").otherwise("REQ-"), F.get_json_object("content", "$.ID"))
    return df.withColumns({"filename": name, "is_response": is_response}).drop("payload")


@decoder("dns", lambda o: (F.col("file_type") == "udp") & ((F.col("first.src_port") == 53) | (F.col("first.dst_port") == 53)))
def files(runs: DataFrame, options: Options) -> DataFrame:
    """A file for each datagram that is a message."""
    ends = ("src_ip", "dst_ip", "src_port", "dst_port")
    m = messages(runs.select("stream", "offset", "ts_ns", "first", "first.path", "first.frame_no", F.lit("udp").alias("l4"), *[F.col("first")[c].alias(c) for c in ends], F.col("content").alias("payload")))
    own = properties(protocol=F.lit("dns"), srcIP=F.col("src_ip"), dstIP=F.col("dst_ip"), srcPort=F.col("src_port"), dstPort=F.col("dst_port"))
    return m.select(*made(F.col("stream"), F.concat_ws("@", F.lit("dns"), "frame_no"), F.col("filename"), F.encode("content", "UTF-8"), own, offset=F.col("offset")))
