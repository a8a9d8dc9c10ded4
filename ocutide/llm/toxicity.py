"""Toxicity by weak supervision.

1. Voters: a lexicon of insults, and patterns (words and word beginnings) that
   a bounded sample of labelled training rows shows to be far commoner in toxic
   texts, or in clean ones.  A voter fires where its word occurs, and abstains elsewhere.
2. A generative label model over the votes of *all* texts: each voter has a
   firing rate in toxic and in clean texts, fitted by expectation maximisation over
   the table of vote patterns, begun from the sample's rates, until the voters' weights
   stay; voters that fire together more often than the classes explain share their weight.
3. A linear classifier on words and word beginnings is trained on the model's
   posterior labels, of the sample's texts and of as many that have no label, and
   scores every whole text.

Labels are read only for rows of the training folds.  Score inputs are words of
the text alone.  ``SAMPLE`` bounds the rows of either class, and the rows without a label,
on which the classifier is fitted; votes and rates cover all texts.  The driver holds
counts, and of each sampled row its votes and ``FEATURES`` bits, whatever the length of
its text; words are counted by executors.  Null or empty text: no words, scored by the
intercept.  Labels: the largest toxic value of a doc_id counts, nulls don't; of several
texts of one doc_id the one of least hash is sampled.  Repeated rows get the same
score; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocutide.llm.storage import discard, stored
from ocutide.llm.textbatch import _BYTE, _LOWER, TextBatch, chunks, mix, span_hashes

#: Insults that vote from the start (fixed values); more are found in the sample.
LEXICON = ("bastard", "clown", "creep", "cretin", "disgusting", "dumb", "filth", "fool", "freak", "garbage", "idiot", "imbecile", "loser", "moron", "pathetic", "pig", "scum", "stupid", "trash", "vermin", "worthless")
#: Most rows of either class in the sample and of rows without a label, most voters (clean ones among them), most words of the classifier.
SAMPLE, VOTERS, CLEAN_VOTERS, FEATURES = 2500, 60, 15, 600
#: Bytes of the word beginnings that serve as patterns.
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.7
#: Change of a voter's weight at which the label model is fitted, and rounds after which it counts as such.
TOLERANCE, EM_ROUNDS = 0.01, 40
_GAP = np.array([not (48 <= b < 58 or 97 <= b < 123 or b > 127) for b in _LOWER], bool)


@dataclass(frozen=True)
class Model:
    """A linear classifier over hashed words; ``keys`` sorted."""

    keys: np.ndarray
    weights: np.ndarray
    intercept: float


def held_out(doc_id: Column) -> Column:
    """The test fold: rows whose labels nothing here reads."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def features(b: TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and word beginnings of texts, with the text of each."""
    starts, ends, doc = b.spans(_GAP[b.data])
    values = _BYTE[_LOWER[b.data]]
    out = [span_hashes(values, starts, ends)]
    for i, n in enumerate(BEGINNINGS):
        long = ends - starts >= n
        out.append(np.zeros(len(starts), np.uint64))
        out[-1][long] = mix(span_hashes(values, starts[long], starts[long] + n) + np.uint64(i + 1))
    return np.concatenate(out), np.concatenate([doc] * len(out))


def word_key(word: str) -> int:
    b = TextBatch(pa.array([word]))
    return int(span_hashes(_BYTE[_LOWER[b.data]], np.array([0]), np.array([len(b.data)]))[0])


def _hits(b: TextBatch, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of text and index of one of the sorted ``keys``."""
    h, doc = features(b)
    if not len(h) or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    found = keys[at] == h
    pair = np.unique(doc[found] * len(keys) + at[found])
    return pair // len(keys), pair % len(keys)


def _vote_rows(batches: Iterable[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            b = TextBatch(part.column("text"))
            doc, voter = _hits(b, keys)
            votes = np.zeros(b.n, np.int64)
            np.bitwise_or.at(votes, doc, np.int64(1) << voter)
            pattern, n = np.unique(votes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n.astype(np.int64))], ["votes", "n"])


def _word_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features of each sampled text."""
    for batch in batches:
        for part in chunks(batch):
            b = TextBatch(part.column("text"))
            h, doc = features(b)
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[new], doc[new]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b.n + 1)).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.int32()), part.column("doc_id").cast(pa.int64()), lists], ["toxic", "doc_id", "words"])


def _bit_rows(batches: Iterable[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each sampled row a bit for each of the sorted ``keys``."""
    signed = np.argsort(keys.view(np.int64))
    known = keys.view(np.int64)[signed]
    for batch in batches:
        rows = []
        for words in batch.column("words"):
            bits = np.zeros(len(keys), bool)
            if len(keys):
                w = words.values.to_numpy()
                at = np.minimum(np.searchsorted(known, w), len(known) - 1)
                bits[signed[at[known[at] == w]]] = True
            rows.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("doc_id"), pa.array(rows, pa.binary())], ["toxic", "doc_id", "bits"])


def _scores(batches: Iterable[pa.RecordBatch], m: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            b = TextBatch(part.column("text"))
            doc, key = _hits(b, m.keys)
            z = m.intercept + np.bincount(doc, m.weights[key], minlength=b.n)
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def label_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, float]:
    """Features (toxic, doc_id, words) of at most ``sample`` training rows of either class and as many without a label (toxic -1), and the toxic share of all training labels."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    some = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    other = docs.select("doc_id").where(~held_out(F.col("doc_id"))).join(labels.select("doc_id"), "doc_id", "left_anti").where("doc_id IS NOT NULL").distinct()
    some.append(other.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("toxic", F.lit(-1)))
    chosen = reduce(DataFrame.unionByName, some)  # at most 3 * sample rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return stored(rows.select("toxic", "doc_id", "text").mapInArrow(_word_rows, "toxic int, doc_id bigint, words array<bigint>"), "sample"), (toxic + 1) / (n + 2)


def sampled_bits(rows: DataFrame, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the sampled rows, and which of ``keys`` each has; 3 * SAMPLE rows at most."""
    found = sorted((r[0], r[1], bytes(r[2])) for r in rows.mapInArrow(lambda it: _bit_rows(it, keys), "toxic int, doc_id bigint, bits binary").collect())
    bits = np.array([np.unpackbits(np.frombuffer(x, np.uint8), count=len(keys)) for _, _, x in found], bool).reshape(len(found), len(keys))
    return np.array([t for t, _, _ in found], np.int64), bits


def choose(rows: DataFrame, most: int, least: float, lift: float, few: int = 0, sign: int = 0) -> np.ndarray:
    """The ``most`` words that best tell the classes of (soft) labels ``y`` apart, from rows (y, words).

    ``least``: of the difference of rates in standard errors; ``lift``: of the logarithm of
    their ratio; ``few``: toxic rows that must have the word; ``sign``: 1 toxic words, -1 clean words, 0 both.
    """
    ones, total = rows.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.count("*")).first()
    zeros = total - ones
    a, b = F.col("a"), F.col("b")
    p, q = (a + 0.5) / (ones + 1), (b + 0.5) / (zeros + 1)
    z = (a / max(ones, 1e-9) - b / max(zeros, 1e-9)) / F.sqrt(p * (1 - p) / max(ones, 1) + q * (1 - q) / max(zeros, 1) + 1e-12)
    counts = rows.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    told = counts.select("word", "a", F.log(p / q).alias("lift"), F.round(z, 6).alias("z")).where((F.abs("z") >= least) & (F.abs("lift") >= lift))
    if sign:
        told = told.where((F.signum("z") == sign) & (F.signum("lift") == sign))
    if few:
        told = told.where(a >= few)
    found = told.orderBy(F.abs("z").desc(), "word").limit(most).select("word").collect()  # a bounded number of numbers
    return np.array([r[0] for r in found], np.int64).view(np.uint64)


def odds(prior: float) -> float:
    return float(np.log(prior / (1 - prior)))


def fit_label_model(patterns: DataFrame, a: np.ndarray, b: np.ndarray, none: np.ndarray, prior: float, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, float, float]:
    """Log odds that each voter adds when it fires, log odds of texts where none fires, and of texts where some do, by expectation maximisation.

    ``a``, ``b``: firing rates in toxic and clean texts to begin with; ``none``: shares of
    toxic and clean texts without a vote.  An abstaining voter says nothing by itself.
    Each round moves one small table: sums per pair of voters.
    """
    m, start = len(a), (a, b)
    share, weight = np.ones(m), np.log(a / b)
    bits = F.filter(F.sequence(F.lit(0), F.lit(max(m - 1, 0))), lambda j: F.col("votes").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), j)) != 0)
    table = patterns.select(bits.alias("bits"), "n")
    for _ in range(rounds if m else 0):
        fire = F.array(*map(F.lit, weight.tolist()))
        idle = F.size("bits") == 0
        z = F.lit(odds(prior)) + F.when(idle, float(np.log(none[0] / none[1]))).otherwise(F.aggregate("bits", F.lit(0.0), lambda s, j: s + F.get(fire, j)))
        p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
        # place m stands for all texts, m + 1 for those without a vote
        marks = F.concat("bits", F.when(idle, F.array(F.lit(m), F.lit(m + 1))).otherwise(F.array(F.lit(m))))
        seen = table.select((F.col("n") * p).alias("t"), F.col("n").cast("double").alias("n"), marks.alias("marks"))
        pair = seen.select("t", "n", "marks", F.explode("marks").alias("j")).select("t", "n", "j", F.explode("marks").alias("k"))
        both, toxic = np.zeros((m + 2, m + 2)), np.zeros((m + 2, m + 2))
        for j, k, x, y in pair.groupBy("j", "k").agg(F.sum("t"), F.sum("n")).collect():  # at most VOTERS squared
            toxic[j, k], both[j, k] = x, y
        t, n, t0, n0 = toxic[m, m], both[m, m], toxic[m + 1, m + 1], both[m + 1, m + 1]
        if not n:
            break
        toxic, both = toxic[:m, :m], both[:m, :m]
        raw = np.clip((toxic.diagonal() + 0.1) / (t + 1), 1e-6, 1 - 1e-6)
        # the labelled rates keep half a say: texts with a single vote would else drift to the clean class
        a = np.sqrt(start[0] * raw)
        b = np.sqrt(start[1] * np.clip(((both - toxic).diagonal() + 0.1) / (n - t + 10), 1e-7, 1 - 1e-6))
        none = np.array([(t0 + 0.5) / (t + 1), (n0 - t0 + 0.5) / (n - t + 1)])
        prior = float(np.clip((t + 1) / (n + 2), 1e-4, 0.5))
        # correlation that is left within the toxic class: near twins share one voice
        cov = toxic / max(t, 1e-9) - np.outer(raw, raw)
        rho = np.clip(cov / np.sqrt(np.outer(raw * (1 - raw), raw * (1 - raw))), 0, 1)
        np.fill_diagonal(rho, 0)
        share = 1 / (1 + np.where(rho > 0.6, rho, 0).sum(axis=1))
        before, weight = weight, np.log(a / b) * share
        if np.abs(weight - before).max() < TOLERANCE:
            break
    return weight, odds(prior) + float(np.log(none[0] / none[1])), odds(prior)


def train(x: np.ndarray, y: np.ndarray, keys: np.ndarray, ridge: float = 3e-5, steps: int = 16) -> Model:
    """Logistic regression on presence of the sorted ``keys`` (rows ``x``) by Newton steps; both classes weigh the same in sum."""
    x = np.concatenate([x.astype(np.float32), np.ones((len(x), 1), np.float32)], axis=1)
    w = np.zeros(len(keys) + 1)
    weight = np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y <= 0.5).sum(), 1))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y) * weight) + penalty * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None].astype(np.float32)).T @ x
        w = w - np.linalg.solve(h.astype(np.float64) + np.diag(penalty), g)
    return Model(keys, w[:-1], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows, prior = label_sample(docs, labels, sample)
    known = rows.where("toxic >= 0").select(F.col("toxic").cast("double").alias("y"), "words")
    clean = choose(known, CLEAN_VOTERS, 8.0, 2.0, 0, -1)
    mined = choose(known, VOTERS - len(LEXICON) - len(clean), 4.0, 2.0, 3, 1)
    keys = np.unique(np.concatenate([np.array([word_key(x) for x in LEXICON], np.uint64), mined, clean]))
    toxic, fires = sampled_bits(rows, keys)
    rate = lambda k: (fires[toxic == k].sum(axis=0) + 0.1 * (1 + 9 * k)) / ((toxic == k).sum() + 10)  # noqa: E731  unseen: likelier in toxic texts
    patterns = stored(docs.select("text").mapInArrow(lambda it: _vote_rows(it, keys), "votes bigint, n bigint").groupBy("votes").agg(F.sum("n").alias("n")), "votes")
    none = np.array([((~fires.any(axis=1))[toxic == k].sum() + 0.5) / ((toxic == k).sum() + 1) for k in (1, 0)])
    w, idle, base = fit_label_model(patterns, rate(1), rate(0), none, prior)
    discard(patterns)
    y = 1 / (1 + np.exp(-np.clip(np.where(fires.any(axis=1), base + fires @ w, idle), -30, 30))) if len(fires) else np.zeros(0)
    if not len(y) or not 0 < (y > 0.5).sum() < len(y):  # nothing to train on: the label model itself scores
        return Model(keys, w, idle)
    # the same rows with their posteriors, which depend on their votes alone
    at = {v: p for v, p in zip(map(bytes, np.packbits(fires, axis=1)), y.tolist(), strict=True)}
    soft = rows.mapInArrow(lambda it: _soft_rows(it, keys, at), "y double, words array<bigint>")
    telling = np.unique(np.concatenate([choose(soft, FEATURES, 4.0, 1.5), keys]))
    _, x = sampled_bits(rows, telling)  # rows in the same order as before
    discard(rows)
    return train(x, y, telling)


def _soft_rows(batches: Iterable[pa.RecordBatch], keys: np.ndarray, at: dict[bytes, float]) -> Iterator[pa.RecordBatch]:
    """Posterior label and features of each sampled row."""
    for batch in batches:
        for bits in _bit_rows([batch], keys):
            yield pa.RecordBatch.from_arrays([pa.array([at[v] for v in bits.column("bits").to_pylist()], pa.float64()), batch.column("words")], ["y", "words"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(lambda it: _scores(it, model), "doc_id bigint, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Score of each row of ``docs`` (doc_id, text) under a model fitted to ``labels`` (doc_id, toxic) of the training folds."""
    return score(docs, fit(docs, labels, sample))
