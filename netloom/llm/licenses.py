"""License scans: MinHash bands of overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters and digits; shingles are five words. A template of n
shingles is looked for in windows of 2 h shingles that begin every h, where h is
the least power of two from 4 on that is at least n: some window holds the
template whole. Every window has a MinHash signature, the least hash of its
shingles under each of 32 multipliers; the windows of all sizes are built from
one another, halves before wholes.

Every band is one row of the signature, so a window that shares the fraction J
of its shingles with a template meets it in some band with probability
1 - (1 - J)^32. The loosest case, four fifths of a template in a window four
times its shingles, has J of about 0.19, that is 99.9 %. Nothing is reported for
meeting in a band: the template's shingles are counted in the window, and a
share of 0.8 is asked for.

Templates are looked up in blocks of bounded size in each task; more templates
mean more look-ups and no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .words import blocks, shingle_hashes

SHINGLE, BANDS, LEAST, SHARE = 5, 32, 4, 0.8
U = np.uint64
#: Odd multipliers, one a band, from one generator with a fixed seed.
MULTIPLIERS = np.random.default_rng(2).integers(1 << 62, 1 << 63, BANDS, dtype=np.uint64) * U(2) + U(1)
_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


@dataclass(frozen=True)
class Template:
    name: str
    text: str


def standard() -> tuple[Template, ...]:
    return tuple(Template(k, v) for k, v in TEMPLATES.items())


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return shingle_hashes([t.translate(_WORDS) for t in texts], SHINGLE)


class Index:
    """Templates by the size of their windows and the signatures of their shingles, and their shingles for the count."""

    def __init__(self, templates: tuple[Template, ...]):
        self.names = [t.name for t in templates]
        hashes, offsets = _hashes([t.text.encode() for t in templates])
        every = [hashes[offsets[k] : offsets[k + 1]] for k in range(len(templates))]
        self.sets = [np.unique(h) for h in every]
        #: Half of a window, in shingles.
        self.half = [max(LEAST, 1 << max(0, len(h) - 1).bit_length()) for h in every]
        with np.errstate(over="ignore"):
            signatures = np.array([[(s * m).min() if len(s) else U(0) for s in self.sets] for m in MULTIPLIERS], U)
        #: For each half size: the numbers of the templates, for each band their values in order, and 16 bits of each value to tell most others apart.
        self.sizes = {}
        for h in sorted(set(self.half)):
            own = np.array([t for t, x in enumerate(self.half) if x == h and len(self.sets[t])])
            bands = []
            for row in signatures[:, own] if len(own) else ():
                seen = np.zeros(1 << 16, bool)
                seen[(row >> U(20)).astype(np.uint16)] = True
                order = np.argsort(row)
                bands.append((row[order], own[order], seen))
            if bands:
                self.sizes[h] = bands

    def candidates(self, hashes: np.ndarray, cuts: dict[int, np.ndarray], alone: dict[int, np.ndarray]) -> list[tuple[int, int, int]]:
        """(half size, window, template) wherever a window's signature is a template's in some band.

        ``cuts``: for each half size where the halves begin, in ``hashes``; a window is a half and the next, or the half alone if it is the last of its text.
        """
        found: set[tuple[int, int, int]] = set()
        sizes = list(self.sizes)
        steps = {h: np.searchsorted(cuts[g], cuts[h]) for g, h in zip(sizes, sizes[1:], strict=False)}
        for band, m in enumerate(MULTIPLIERS):
            with np.errstate(over="ignore"):
                least = hashes * m
            for h in sizes:
                least = np.minimum.reduceat(least, steps.get(h, cuts[h]))
                window = least.copy()
                np.minimum(least[:-1], least[1:], out=window[:-1], where=~alone[h][:-1])
                keys, own, seen = self.sizes[h][band]
                for w in np.flatnonzero(seen[(window >> U(20)).astype(np.uint16)]).tolist():
                    lo, hi = np.searchsorted(keys, window[w], "left"), np.searchsorted(keys, window[w], "right")
                    found.update((h, w, int(t)) for t in own[lo:hi])
        return sorted(found)


def _scan(texts: list[bytes], index: Index) -> list[list[tuple[int, float, int]]]:
    """For each text the templates found in it: (template, share of its shingles, number of the word where its best window begins)."""
    hashes, offsets = _hashes(texts)
    out: list[list[tuple[int, float, int]]] = [[] for _ in texts]
    if not len(hashes):
        return out
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    within = np.arange(len(hashes)) - offsets[text]
    cuts = {h: np.flatnonzero(within % h == 0) for h in index.sizes}
    alone = {h: np.append(np.diff(text[c]) != 0, True) for h, c in cuts.items()}
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for h, w, t in index.candidates(hashes, cuts, alone):
        first = int(cuts[h][w])
        own = int(text[first])
        share = float(np.isin(index.sets[t], hashes[first : min(int(offsets[own + 1]), first + 2 * h)]).mean())
        if share >= SHARE:
            best[own, t] = max(best.get((own, t), (0.0, 0)), (share, int(offsets[own]) - first))
    for (own, t), (share, at) in sorted(best.items()):
        out[own].append((t, share, -at))
    return out


FOUND = "array<struct<license:string,share:double,word:long>>"


def licenses(text, templates: tuple[Template, ...] = standard()):
    """Column: the templates found in a text, in the templates' order, each with the share of its shingles and the word number
    (of letters and digits, from 0) at which the window begins. Null and empty texts, and those under five words: none."""
    kind = pa.list_(pa.struct([("license", pa.string()), ("share", pa.float64()), ("word", pa.int64())]))

    @F.arrow_udf(FOUND)
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(templates)
        for column in parts:
            rows = []
            for texts in blocks(column):
                rows += [[{"license": index.names[t], "share": s, "word": w} for t, s, w in found] for found in _scan(texts, index)]
            yield pa.array(rows, kind)

    return of(F.col(text) if isinstance(text, str) else text)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = standard()) -> DataFrame:
    """(id_col, license, share, word): a row for each template in each row of ``docs``; repeated and null ids stay, other columns are ignored."""
    found = docs.select(F.col(id_col), F.explode(licenses(text_col, templates)).alias("f"))
    return found.select(id_col, "f.*")
