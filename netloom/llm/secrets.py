"""Secret scans: all rules, whole, in one pass of one deterministic automaton over the bytes of a text.

Rules are compiled into the transition arrays of one minimal automaton (see
``automaton``), whose states tell where the matches of each rule begin and end.
Matches too short for their rule are dropped. The result for each rule is that
of a leftmost, non-overlapping search by itself; spans of different rules may
overlap. A text costs time in proportion to its length, whatever is in it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, compile_rules, find
from .words import blocks


@dataclass(frozen=True)
class Rule:
    """A match is ``word`` and then ``rest``. ``least`` characters are asked of the match, or with ``value`` of the run that ends it."""

    name: str
    word: bytes
    rest: bytes
    least: int = 0
    value: bool = False


#: The base kinds first, in the order in which spans at one place are listed.
BASE = (
    Rule("assign", rb"(?i:password|passwd|secret|token|api_?key)", rb"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, value=True),
    Rule("access", rb"AKIA", rb"[A-Z0-9]+", 20),
    Rule("hex", rb"[0-9a-f]{24}", rb"[0-9a-f]*", 24),
)
MORE = (
    Rule("forge", rb"gh[pousr]_", rb"[A-Za-z0-9]+", 40),
    Rule("chat", rb"xox[abprs]-", rb"[A-Za-z0-9-]+", 15),
    Rule("payment", rb"[rs]k_live_", rb"[A-Za-z0-9]+", 24),
    Rule("map", rb"AIza", rb"[A-Za-z0-9_-]+", 39),
    Rule("jwt", rb"eyJ", rb"[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", rb"-----BEGIN ", rb"[A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


@functools.cache
def _compiled(rules: tuple[Rule, ...]) -> Automaton:
    return compile_rules([(r.word, r.rest) for r in rules])


def scan_texts(texts: list[bytes], rules: tuple[Rule, ...] = RULES, dfa: Automaton | None = None) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule number, end) in bytes, sorted; ``dfa`` is the automaton of the rules, where it is there already."""
    data = bytes([255]).join(texts) + bytes([255])
    ends = np.cumsum([len(t) + 1 for t in texts])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, (starts, stops, firsts)) in enumerate(zip(rules, find(dfa or _compiled(rules), data), strict=True)):
        enough = stops - (firsts if rule.value else starts) >= rule.least
        starts, stops = starts[enough], stops[enough]
        owner = np.searchsorted(ends, starts, side="right")
        for i, s, e in zip(owner.tolist(), starts.tolist(), stops.tolist(), strict=True):
            lo = int(ends[i]) - 1 - len(texts[i])
            out[i].append((s - lo, k, e - lo))
    for found in out:
        found.sort()
    return out


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte places as code point places; a match holds single-byte characters only."""
    if not spans or text.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[s]), k, int(before[e])) for s, k, e in spans]


SPAN = "array<struct<kind:string,start:long,end:long>>"


def spans(text, rules: tuple[Rule, ...] = RULES):
    """Column: the spans of a text by start, then by rule; code points, ends exclusive. Null and empty texts: an empty list."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    dfa = _compiled(rules)  # made once, and sent to the tasks

    @F.arrow_udf(SPAN)
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            rows = []
            for texts in blocks(column):
                rows += [[{"kind": rules[k].name, "start": s, "end": e} for s, k, e in _points(t, x)] for t, x in zip(texts, scan_texts(texts, rules, dfa), strict=True)]
            yield pa.array(rows, kind)

    return of(F.col(text) if isinstance(text, str) else text)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id_col, spans) for every row of ``docs``, repeated ids and null ids included; other columns are ignored."""
    return docs.select(F.col(id_col), spans(text_col, rules).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the SHA-256 of their spans and all spans as one string."""
    name = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda r: F.size(F.filter("spans", lambda x: x["kind"] == r.name)).cast("long").alias(f"n_{r.name}")
    base = F.filter("spans", lambda x: x["kind"].isin([r.name for r in BASE]))
    return found.select(
        id_col,
        *[count(r) for r in BASE],
        F.sha2(F.array_join(F.transform(base, name), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", name), ",").alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret in the text replaced by ``mark``; overlapping spans count as one. Null texts stay null.

    Columns and rows are those of ``docs``; a column n_chars, if there is one, follows the text.
    """
    cover, dfa = mark.encode(), _compiled(rules)

    def clean(text: bytes, found: list[tuple[int, int, int]]) -> bytes:
        out, at = [], 0
        for s, _, e in found:
            if s >= at:
                out += [text[at:s], cover]
            at = max(at, e)
        return b"".join(out) + text[at:]

    @F.arrow_udf("string")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            rows = []
            for texts in blocks(column):
                rows += [clean(t, x) if x else t for t, x in zip(texts, scan_texts(texts, rules, dfa), strict=True)]
            yield pa.array([None if null else x for null, x in zip(column.is_null().to_pylist(), rows, strict=True)], pa.binary()).cast(pa.string())

    out = docs.withColumn(text_col, of(F.col(text_col)))
    return out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
