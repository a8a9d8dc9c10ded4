"""Vectorised word arithmetic over Arrow string batches.

A batch of texts is treated as one byte buffer with offsets, so words, lines,
n-gram windows and their 64-bit hashes are found by a handful of numpy passes
instead of a Python loop per word.  Work is cut into chunks of about
``CHUNK_BYTES`` of text: memory follows the chunk (or the longest single text),
not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: close inputs give unrelated outputs."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[s:e]`` for disjoint, sorted, non-empty spans."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    at = within + np.repeat(starts, sizes)
    return mix(np.add.reduceat(values[at] * _powers(int(sizes.max()))[within], first) + sizes.astype(np.uint64))


class TextBatch:
    """Texts of one chunk: bytes, offsets, and words as byte spans."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        if texts.null_count:
            texts = texts.fill_null(b"")
        n = len(texts)
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.offsets = off - off[0]
        self.n = n

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Number of set bytes of each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def spans(self, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes outside ``gap`` that stay within a text: starts, ends, text index."""
        edge = np.zeros(len(gap) + 1, bool)
        edge[self.offsets] = True
        inside = ~gap
        before = np.concatenate([[False], inside[:-1]])
        after = np.concatenate([inside[1:], [False]])
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def words(self, lower: bool = False) -> None:
        """White-space words (space, tab to carriage return); optionally with A-Z folded."""
        self.starts, self.ends, self.doc = self.spans(_SPACE[self.data])
        data = _LOWER[self.data] if lower else self.data
        self.hash = span_hashes(_BYTE[data], self.starts, self.ends)
        self.n_words = np.bincount(self.doc, minlength=self.n)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Non-empty newline-split lines: start, end, text index, hash of the whole line."""
        starts, ends, doc = self.spans(self.data == 10)
        return starts, ends, doc, span_hashes(_BYTE[self.data], starts, ends)


def windows(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` neighbours of one text, with the index of its first."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(hashes) - k + 1
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out = out * _BASE + hashes[j : j + m]
    first = np.flatnonzero(doc[:m] == doc[k - 1 :])
    return mix(out[first]), first


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch that hold about ``limit`` bytes of ``column`` each, a longer text alone."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0), np.int64)
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > limit:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    yield batch.slice(first)
