"""Toxicity by compression distance: which of two zstandard dictionaries makes a window of text shorter.

The dictionaries are trained on ordinary and on toxic text. What toxic text has
in common with ordinary text tells nothing, so the toxic dictionary is trained
on the stretches of toxic documents that are rare in ordinary ones, and is used
on top of the ordinary one: a window then gets shorter only by what is in toxic
text alone. A document's windows give the share of windows that gain at least
each of a few thresholds, the largest gain and the mean gain; a logistic
calibration on the labelled sample turns these into a score from 0 to 1.

Training runs on the driver over a sample of labelled rows, bounded by the
parameters of ``Training``. Scoring runs over whole texts where they are read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import lasting
from .words import blocks

WINDOW, LEVEL, MIN_MATCH = 64, 1, 6
GRAM = 6
GAINS = (2, 3, 4, 6)
U = np.uint64


@dataclass(frozen=True)
class Training:
    """The bounds of the sample and the sizes of the dictionaries.

    Of the labelled ids up to ``toxic`` and ``ordinary`` of each label with the
    least hash are taken, of these the rows whose text has at most ``longest``
    characters, and of these as many, by that hash, as have ``characters`` in all. ``support`` is the share of toxic documents that a
    stretch must occur in, ``ratio`` how many times more common it must be there.
    """

    toxic: int = 2000
    ordinary: int = 4000
    longest: int = 20_000
    characters: int = 40_000_000
    support: float = 0.01
    ratio: float = 10.0
    ordinary_bytes: int = 16_384
    toxic_bytes: int = 2_048


@dataclass(frozen=True)
class Model:
    """Two dictionaries, and the weights of the calibration. Small and picklable."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def _normal(text: bytes) -> bytes:
    return b" " + b" ".join(text.lower().split()) + b" "


def _windows(text: bytes) -> list[bytes]:
    """The whole text in windows of about WINDOW bytes, cut before a space where the second half of a window has one."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(n, at + WINDOW)
        if end < n:
            space = text.rfind(b" ", at + WINDOW // 2, end)
            end = space if space > 0 else end
        out.append(text[at:end])
        at = end
    return out


@functools.lru_cache(maxsize=4)
def _compressors(ordinary: bytes, toxic: bytes):
    def make(content: bytes):
        how = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=len(content), source_size=WINDOW, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress

    return make(ordinary), make(ordinary + toxic)


def _features(texts: list[bytes], ordinary: bytes, toxic: bytes) -> np.ndarray:
    plain, harsh = _compressors(ordinary, toxic)
    out = np.zeros((len(texts), len(GAINS) + 4))
    for k, text in enumerate(texts):
        gains = np.array([len(plain(w)) - len(harsh(w)) for w in _windows(_normal(text))])
        if not len(gains):
            continue
        shares = [float((gains >= g).mean()) for g in GAINS]
        top = np.sort(gains)[-3:]
        out[k] = [*np.sqrt(shares), gains.mean(), gains.max(), top.mean(), 1 / np.sqrt(len(gains))]
    return out


def _probability(features: np.ndarray, weights) -> np.ndarray:
    w = np.asarray(weights)
    return 1 / (1 + np.exp(-np.clip(features @ w[:-1] + w[-1], -30, 30)))


def _grams(text: bytes) -> np.ndarray:
    a = np.frombuffer(text + b"\0" * 8, np.uint8)
    return np.ndarray((max(0, len(text) - GRAM + 1),), "<u8", a, strides=(1,)) & U((1 << 8 * GRAM) - 1)


def _distinct(texts: list[bytes]) -> list[bytes]:
    """Without near copies, which would make their own stretches look common: two least hashes tell them."""
    seen, out = set(), []
    for t in texts:
        g = _grams(t)
        if not len(g):
            continue
        with np.errstate(over="ignore"):
            mark = tuple(int((g * U(m)).min()) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
        if mark not in seen:
            seen.add(mark)
            out.append(t)
    return out


def _common(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    every = [np.unique(_grams(t)) for t in texts]
    return np.unique(np.concatenate(every) if every else np.empty(0, U), return_counts=True)


def _stretches(text: bytes, chosen: np.ndarray) -> bytes:
    """The parts of a text that chosen grams cover, joined by zero bytes."""
    g = _grams(text)
    hit = np.isin(g, chosen)
    cover = np.zeros(len(text) + 2, np.int8)
    for k in range(GRAM):
        cover[1 + k : 1 + k + len(g)] |= hit
    edges = np.flatnonzero(np.diff(cover))
    return b"\0".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\0".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, both labels weighing by their rows."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionaries(toxic: list[bytes], ordinary: list[bytes], how: Training) -> tuple[bytes, bytes]:
    p, n = (_distinct([_normal(t) for t in x]) for x in (toxic, ordinary))
    (gp, cp), (gn, cn) = _common(p), _common(n)
    at = np.minimum(np.searchsorted(gn, gp), max(0, len(gn) - 1))
    other = np.where(gn[at] == gp, cn[at], 0) if len(gn) else np.zeros(len(gp))
    chosen = gp[(cp >= max(2, how.support * len(p))) & (cp * (len(n) + 1) >= how.ratio * (other + 1) * len(p))]
    return (
        _dictionary([w for t in n for w in _windows(t)], how.ordinary_bytes),
        _dictionary([s for s in (_stretches(t, chosen) for t in p) if s], how.toxic_bytes),
    )


def sample(docs: DataFrame, labels: DataFrame, how: Training = Training(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, text, toxic) of at most ``how.toxic + how.ordinary`` rows that may be learned from, no held-out one among them.

    Ids are chosen from the labels alone, so only they, a bounded number, meet
    the texts. An id with several labels counts by the greater, one with
    several texts by the least. Null ids, labels and texts are left out.
    """
    mine = labels.select(id_col, label_col).where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    mine = mine.groupBy(F.col(id_col).alias("__id")).agg((F.max(label_col) == 1).alias("toxic")).withColumn("__o", F.xxhash64("__id"))
    part = lambda toxic, n: mine.where(F.col("toxic") == toxic).orderBy("__o", "__id").limit(n)
    chosen = lasting(part(True, how.toxic).unionByName(part(False, how.ordinary)).drop("__o"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.col("__text").isNotNull() & (F.char_length("__text") <= how.longest))
    met = texts.join(F.broadcast(chosen), "__id").groupBy(F.col("__id").alias("id"), "toxic").agg(F.min("__text").alias("text"))  # a bounded number of ids
    met = lasting(met)
    sizes = met.select("id", F.char_length("text").alias("n"), F.xxhash64("id").alias("o"))  # a row an id, so the window is bounded too
    upto = F.sum("n").over(Window.orderBy("o", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return met.join(F.broadcast(sizes.withColumn("upto", upto).where(F.col("upto") <= how.characters).select("id")), "id")


def train(docs: DataFrame, labels: DataFrame, how: Training = Training(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled rows of ``docs``; a class may be missing.

    The calibration sees text that is new to the dictionaries: each half of the
    sample is measured with dictionaries of the other half. The dictionaries
    that are kept are trained on both.
    """
    rows = sorted((zlib.crc32(r.text.encode()), r.text, r.toxic) for r in sample(docs, labels, how, id_col, text_col, label_col).collect())
    toxic, ordinary = [t.encode() for _, t, y in rows if y], [t.encode() for _, t, y in rows if not y]
    x, y = [], []
    for k in (0, 1):
        own = _dictionaries(toxic[1 - k :: 2], ordinary[1 - k :: 2], how)
        x.append(_features([*toxic[k::2], *ordinary[k::2]], *own))
        y += [1.0] * len(toxic[k::2]) + [0.0] * len(ordinary[k::2])
    weights = _logistic(np.concatenate(x), np.array(y)) if len(set(y)) > 1 else np.array([0.0] * (len(GAINS) + 4) + [-3.0])
    return Model(*_dictionaries(toxic, ordinary, how), tuple(weights.tolist()))


def score(text, model: Model):
    """Column: the score of a text, from 0 to 1. Null and empty texts get that of a text without any gain."""

    @F.arrow_udf("double")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            got = [_probability(_features(b, model.ordinary, model.toxic), model.weights) for b in blocks(column)]
            yield pa.array(np.concatenate(got) if got else [], pa.float64())

    return of(F.col(text) if isinstance(text, str) else text)


def held_out(id_col: str = "doc_id"):
    """Column: whether a row is kept from training, by a hash of its id; null ids count as an empty one."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of ``docs``, repeated and null ids included; other columns are ignored."""
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score(text_col, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score under ``threshold``; columns are those of ``docs``."""
    return docs.where(score(text_col, model) < threshold)
