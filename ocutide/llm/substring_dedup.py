"""Substring deduplication by sliding sentence spans.

Sentences end at ``.``, ``!`` or ``?`` before white space, at a newline and at the
end of the text.  For the search each is cut into pieces before every word
whose hash is the least of ``NEAR`` words to either side (equals all count, so repeated
words are cut as well): a cut depends on its neighbours only, whatever the sentence
around it, so a passage that begins and ends in mid-sentence has the same cuts
everywhere but for ``NEAR`` words at its edges.  From every piece a run goes to the
first end of a piece that makes it ``RUN`` pieces and ``MIN_WORDS`` words or more; to
every end of a sentence another comes from the last such start, so that nothing is
left over there.  A text too short for any run is one run as a whole.  A run is hashed
over its lower-cased words, whatever the cuts inside it.  Hashes are joined across the
whole corpus, and each piece covered by a run that isn't its first occurrence (smallest
doc_id, then earliest place) is removed; ``n_removed`` counts the sentences that lose
words.  Up to ``NEAR`` words of a sentence that keeps others stay.  What repeats in fewer
than ``MIN_WORDS`` words, inside longer texts, stays as well.

Shuffles: (hash, doc_id) once to find the first occurrence of repeated runs, which
is combined before the shuffle, and once for the join, in which a hot run is an
ordinary skewed key that adaptive execution splits; then texts by doc_id.

Null or empty text: no sentences, returned as it is.  Rows with the same doc_id
are one document to the search: none counts as a repeat of another, and each gets
the same treatment.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocutide.llm.textbatch import _BASE, _SPACE, TextBatch, chunks, mix

RUN, MIN_WORDS = 2, 20
#: Words to either side among which the word after a cut has the least hash.
NEAR = 4
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def sentences(b: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each sentence that has a word: text, first word, end word."""
    n = len(b.data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    b.words(lower=True)
    edge = np.zeros(n + 1, bool)
    edge[b.offsets] = True
    space = _SPACE[b.data]
    ends = b.data == 10
    ends[:-1] |= _STOP[b.data[:-1]] & space[1:]
    ends |= edge[1:]
    stop = np.flatnonzero(ends) + 1
    doc = np.searchsorted(b.offsets, stop - 1, "right") - 1
    last = np.searchsorted(b.starts, stop, "left")
    first = np.concatenate([[0], last[:-1]])
    real = last > first
    return doc[real], first[real], last[real]


def cuts(b: TextBatch) -> np.ndarray:
    """Whether the hash of each word is the least of its neighbourhood within its text."""
    least = np.ones(len(b.hash), bool)
    for d in range(1, NEAR + 1):
        other = b.doc[d:] != b.doc[:-d]
        least[d:] &= other | (b.hash[d:] <= b.hash[:-d])
        least[:-d] &= other | (b.hash[:-d] <= b.hash[d:])
    return least


def pieces(b: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece of a sentence: end byte (where the next word begins), text, first word, end word, index of its sentence, whether the sentence ends with it."""
    doc, first, last = sentences(b)
    if not len(first):
        return first, doc, first, last, first, np.zeros(0, bool)
    begins = cuts(b)
    begins[first] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(b.hash))
    of = np.searchsorted(first, start, "right") - 1
    whole = end == last[of]
    # white space goes with the piece before it, so what is left of a text never runs together
    following = np.minimum(end, len(b.starts) - 1)
    inside = (end < len(b.starts)) & (b.doc[following] == doc[of])
    return np.where(inside, b.starts[following], b.offsets[doc[of] + 1]), doc[of], start, end, of, whole


def _prefix_sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of words times powers of the base, and the inverse powers: a span's hash in one step."""
    powers, inverse = np.full(len(h), _BASE), np.full(len(h) + 1, _INVERSE)
    powers[:1] = inverse[:1] = 1
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(powers))]), np.cumprod(inverse)


def runs(b: TextBatch, run: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, first piece (within the text) and number of pieces of each run, by place."""
    _, doc, first, last, _, full = pieces(b)
    m = len(first)
    if not m:
        return np.zeros(0, np.uint64), doc, doc, doc
    start = np.searchsorted(doc, doc, "left")
    stop = np.searchsorted(doc, doc, "right")
    i = np.arange(m)
    # the least end with enough pieces and enough words
    end = np.maximum(i + run, np.searchsorted(last, first + min_words, "left") + 1)
    ok = end <= stop
    # and for each end of a sentence the last start of such a run, unless that is listed already
    e = np.flatnonzero(full)
    back = np.minimum(e + 1 - run, np.searchsorted(first, last[e] - min_words, "right") - 1)
    fine = back >= start[e]
    e, back = e[fine] + 1, back[fine]
    fresh = end[back] != e
    i, end = np.concatenate([i[ok], back[fresh]]), np.concatenate([end[ok], e[fresh]])
    # a text too short for that is one run
    has = np.zeros(b.n, bool)
    has[doc[i]] = True
    short = np.flatnonzero((np.arange(m) == start) & ~has[doc])
    i, end = np.concatenate([i, short]), np.concatenate([end, stop[short]])
    order = np.lexsort((end, i))
    i, end = i[order], end[order]
    total, inverse = _prefix_sums(b.hash)
    lo, hi = first[i], last[end - 1]
    return mix((total[hi] - total[lo]) * inverse[lo] + (hi - lo).astype(np.uint64)), doc[i], i - start[i], end - i


def _run_rows(batches: Iterable[pa.RecordBatch], run: int, min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            h, doc, place, size = runs(TextBatch(part.column("text")), run, min_words)
            # of a text's equal runs the first; the others are found again when the text is rewritten
            order = np.lexsort((place, h, doc))
            keep = np.ones(len(h), bool)
            keep[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
            ids = part.column("doc_id").cast(pa.int64()).take(pa.array(doc[keep]))
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), ids], ["run", "doc_id"])


def _without_scraps(drop: np.ndarray, of: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``drop`` but for stretches of at most NEAR words of a sentence that keeps others: neighbours of a passage agree in as many by chance."""
    if not drop.any():
        return drop
    at = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (drop[1:] != drop[:-1])]))
    words = np.add.reduceat(size, at)
    alone = np.bincount(of[at], minlength=of[-1] + 1)[of[at]] == 1
    return drop & np.repeat(alone | (words > NEAR), np.diff(np.append(at, len(drop))))


def _rewritten(batches: Iterable[pa.RecordBatch], run: int, min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            b = TextBatch(part.column("text"))
            texts = part.column("text").to_pylist()
            stop, doc, first, last, of, _ = pieces(b)
            base = np.searchsorted(doc, np.arange(b.n + 1), "left")
            _, at = np.unique(of, return_index=True)
            n = np.bincount(doc[at], minlength=b.n)
            drop = np.zeros(len(stop), bool)
            h, owner, place, size = runs(b, run, min_words)
            hashes = part.column("runs").to_pylist()
            bounds = np.searchsorted(owner, np.arange(b.n + 1), "left")
            for d in range(b.n):
                lo, hi = bounds[d], bounds[d + 1]
                if lo == hi:
                    continue
                own = h[lo:hi]
                _, at = np.unique(own, return_index=True)
                bad = np.ones(hi - lo, bool)
                bad[at] = False
                if hashes[d]:
                    bad |= np.isin(own.view(np.int64), np.array(hashes[d], np.int64))
                for j in np.flatnonzero(bad):
                    s = base[d] + place[lo + j]
                    drop[s : s + size[lo + j]] = True
            drop = _without_scraps(drop, of, last - first)
            lost = np.unique(of[drop], return_index=True)[1]
            removed = np.bincount(doc[drop][lost], minlength=b.n)
            raw = b.data
            for d in np.flatnonzero(removed):
                lo, hi = base[d], base[d + 1]
                keep = np.ones(b.offsets[d + 1] - b.offsets[d], bool)
                begin = np.concatenate([[b.offsets[d]], stop[lo : hi - 1]]) - b.offsets[d]
                for s in np.flatnonzero(drop[lo:hi]):
                    keep[begin[s] : stop[lo + s] - b.offsets[d]] = False
                texts[d] = raw[b.offsets[d] : b.offsets[d + 1]][keep].tobytes().decode("utf-8", "replace").strip() if keep.any() else ""
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_sentences", "n_removed", "text"])


def repeated_runs(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id and hash of each run of pieces that another document, of a smaller doc_id, has too."""
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(lambda it: _run_rows(it, run, min_words), "run bigint, doc_id bigint")
    first = rows.groupBy("run").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id")
    # keys under another expression: the join gets exchanges of its own, which adaptive execution can split
    left, right = rows.select(F.expr("run ^ 1").alias("k"), "doc_id"), first.select(F.expr("run ^ 1").alias("k"), "first_id")
    return left.join(right, "k").where("doc_id > first_id").select("doc_id", F.expr("k ^ 1").alias("run"))


def substring_dedup(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) without its repeated passages: doc_id, n_sentences, n_removed, text."""
    found = repeated_runs(docs, run, min_words).groupBy("doc_id").agg(F.collect_set("run").alias("runs"))
    joined = docs.select("doc_id", "text").join(found, "doc_id", "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(lambda it: _rewritten(it, run, min_words), "doc_id bigint, n_sentences bigint, n_removed bigint, text string")
