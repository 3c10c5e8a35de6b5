"""Words and word shingles of whole texts, for use inside Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .xxh import hash_spans

#: Texts are taken in blocks of about so many bytes, so that memory is bounded
#: by a block and one text, however many rows Arrow hands over at once.
BLOCK_BYTES = 4 << 20


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The texts as UTF-8 bytes (null: empty), in lists of about ``most`` bytes."""
    part: list[bytes] = []
    size = 0
    for x in texts:
        b = x.as_buffer()
        b = b.to_pybytes() if b is not None else b""
        part.append(b)
        size += len(b)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def shingle_hashes(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every run of ``n`` words, repeats included, and the offsets of each text's.

    Words are runs of bytes other than space and 9 to 13; ASCII capitals count
    as small; the words of a run are joined by one space. A text of fewer words
    is one run of all its words, and a text of none has no run.
    """
    joined = [b" ".join(x.lower().split()) for x in texts]
    data = b"\n".join(joined) + b"\n"
    a = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero((a == 32) | (a == 10))
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = np.flatnonzero(a[ends] == 10)  # the last word of each text
    count = np.diff(last, prepend=-1)  # an empty text counts as one empty word
    first = last - count + 1
    runs = np.maximum(count - n + 1, 1)
    runs[[not x for x in joined]] = 0
    offsets = np.concatenate([[0], np.cumsum(runs)])
    text = np.repeat(np.arange(len(texts)), runs)
    word = first[text] + np.arange(offsets[-1]) - offsets[text]
    s = starts[word]
    e = ends[np.minimum(word + n - 1, last[text])]
    return hash_spans(data, s, e - s), offsets
