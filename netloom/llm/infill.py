"""Fill-in-middle: texts cut in three at line ends and put together in another order behind sentinels.

One Aho-Corasick automaton finds the events of a text in one passage: the
characters that end a unit (for lines the line feed) and the sentinels. The
text between two events is a gap that belongs to one unit, so the number of
units before an event is counted, not scanned for, and the place of unit k is
looked up among the events alone. Where the cuts fall is told by a hash of the
document's id, so a task that runs again cuts alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>"


@dataclass(frozen=True)
class Infill:
    """Parameters: the sentinels before prefix, suffix and middle, how many of a hundred texts are cut, how many of these begin with the suffix, and what is hashed before the id."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    cut_percent: int = 100
    suffix_first_percent: int = 50
    seed: str = "7"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or any(not m or "\n" in m for m in marks):
            raise ValueError("three different sentinels without line feeds are needed")
        if any(a != b and a in b for a in marks for b in marks):
            raise ValueError("no sentinel may be within another")


def events(how: Infill) -> ahocorasick.Automaton:
    """The automaton over line feeds (value 1) and sentinels (value 0)."""
    found = ahocorasick.Automaton()
    found.add_word("\n", 1)
    for mark in (how.prefix, how.suffix, how.middle):
        found.add_word(mark, 0)
    found.make_automaton()
    return found


def line_ends(text: str, automaton: ahocorasick.Automaton) -> tuple[list[int], bool]:
    """Where each line of ``text`` ends (exclusive), in order, and whether it has a sentinel."""
    ends: list[int] = []
    marked = False
    for at, is_end in automaton.iter(text):
        if is_end:
            ends.append(at + 1)
        else:
            marked = True
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return ends, marked


def draws(doc_id: int | str | None, seed: str) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 of a document: the first digits of the SHA-256 of seed, colon and id (nothing where it is null)."""
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(d[4 * k : 4 * k + 4], "big") for k in range(4))


def cut(doc_id: int | str | None, text: str | None, how: Infill, automaton: ahocorasick.Automaton) -> tuple:
    """(lines, form, characters of prefix and of middle, output) of one text."""
    text = text or ""
    ends, marked = line_ends(text, automaton)
    n = len(ends)
    one, two, chance, order = draws(doc_id, how.seed)
    if not text or marked or chance % 100 >= how.cut_percent:
        return n, "plain", None, None, text
    first, last = sorted((one % (n + 1), two % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < how.suffix_first_percent:
        return n, "spm", a, b - a, how.suffix + suffix + how.prefix + prefix + how.middle + middle
    return n, "psm", a, b - a, how.prefix + prefix + how.suffix + suffix + how.middle + middle


def fill_in_middle(docs: DataFrame, how: Infill | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output) of every row; nothing is shuffled.

    ``n`` is the number of lines; the sizes are code points, and null in a row
    of form plain, whose output is its text: an empty one, one with a sentinel,
    and those that chance leaves out. A null text counts as empty, and a null
    id as no digits. Rows that repeat are cut each by itself, and rows of one
    id alike. A text of any length is one passage. Other columns are ignored,
    whatever their names; an empty table gives an empty table.
    """
    how = how or Infill()

    @F.arrow_udf(CUT)
    def each(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        automaton = events(how)
        kinds = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
        for ids, texts in parts:
            rows = [cut(i.as_py(), t.as_py(), how, automaton) for i, t in zip(ids, texts, strict=True)]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    return docs.select(F.col(id_col), each(F.col(id_col).cast("string"), F.col(text_col)).alias("__c")).select(id_col, "__c.*")


def restored(output: Column, form: Column, how: Infill | None = None) -> Column:
    """The text again, from an output and its form: the three parts between the sentinels in their old order."""
    how = how or Infill()
    quoted = "|".join("\\Q" + m + "\\E" for m in (how.prefix, how.suffix, how.middle))
    part = F.split(output, quoted)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def digest(cut_rows: DataFrame, how: Infill | None = None) -> DataFrame:
    """Rows of ``fill_in_middle`` with hashes in place of texts: of the output, and of the text rebuilt from it."""
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return cut_rows.withColumns({"output_sha256": sha(F.col("output")), "restored_sha256": sha(restored(F.col("output"), F.col("form"), how))}).drop("output")
