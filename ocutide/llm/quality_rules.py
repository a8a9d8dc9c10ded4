"""Quality rules: heuristic line and word rules, then tokeniser fertility.

Two public vocabularies segment every word: a sentencepiece model with byte fallback,
and byte-level ranks for many languages.  Of each text four figures are taken:
characters per token under either, the share of byte-fallback tokens, and the entropy
of its tokens as a share of the largest that so many tokens can have (``evenness``:
defined at every length).  A text is rejected when a figure leaves the rejection band
of its language, script and length.

Bands are fitted on all rows that pass the base rules, by exact quantiles over a fixed
grid of figures (``Measure.step``): quartiles, widened by ``REACH`` times their
distance.  There is one for each script, each language of a script, and each of those
at each power of two of the number of tokens; a finer band is the mean of its own
fence, which weighs its number of rows, and its parent's, which weighs ``PRIOR`` rows;
the parent of a script is ``Measure.low`` and ``high``.  So a rare language follows its
script, an empty corpus the constants, and nothing switches at any size.

The figures are written once, narrow; bands are sums over the grid, combined before
they are shuffled; rows meet them by a join on a table of a few numbers per band.
Null or empty text: zero words, so the word-count rule rejects it.  Null language:
judged by its script.  Repeated rows are each scored (and count in the bands).
Extra columns of the input are not read, or kept as they are by ``keep_good``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ocutide.llm.storage import free_name, stored
from ocutide.llm.textbatch import _SPACE, TextBatch, chunks, windows

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: Words held per worker with their segmentation; a full table is emptied.
CACHE_WORDS = 200_000
#: Quartile distances from a quartile to the fence, and rows that a parent band counts for.
REACH, PRIOR = 4.0, 50


@dataclass(frozen=True)
class Measure:
    """A figure with the grid on which its quantiles are taken, the least quartile distance, and the band where nothing is known."""

    name: str
    step: float
    spread: float
    low: float
    high: float


MEASURES = (
    Measure("chars_per_token", 0.005, 0.02, 0.25, 12.0),
    Measure("chars_per_token_multi", 0.005, 0.02, 0.25, 12.0),
    Measure("fallback_share", 0.001, 0.01, -1.0, 0.5),
    Measure("evenness", 0.002, 0.02, 0.15, 2.0),
)
#: Scripts by the lead bytes of their letters (fixed values); a text has the script of most of its letters.
SCRIPTS = (("latin", 0x41, 0xCC), ("greek", 0xCD, 0xCF), ("cyrillic", 0xD0, 0xD3), ("near_east", 0xD4, 0xDF), ("south_asia", 0xE0, 0xE0), ("east_asia", 0xE1, 0xEF), ("other", 0xF0, 0xFF))
_SCRIPT = np.full(256, len(SCRIPTS), np.int64)
for _i, (_, _lo, _hi) in enumerate(SCRIPTS):
    _SCRIPT[[b for b in range(_lo, _hi + 1) if b >= 0xC0 or chr(b).isalpha() and b < 128]] = _i

#: What the scan of the texts finds; the verdict is added by the bands.
FIGURES = [
    ("n_words", "bigint", pa.int64()), ("word_chars", "bigint", pa.int64()), ("n_symbols", "bigint", pa.int64()),
    ("n_dup_lines", "bigint", pa.int64()), ("n_repeat_words", "bigint", pa.int64()), ("base_failed", "boolean", pa.bool_()),
    ("n_tokens", "bigint", pa.int64()), *((m.name, "double", pa.float64()) for m in MEASURES),
    ("script", "string", pa.string()), ("octave", "int", pa.int32()),
]
FIGURE_TYPE = "struct<" + ",".join(f"{k}:{t}" for k, t, _ in FIGURES) + ">"


class Segmenter:
    """Token ids of words under a sentencepiece model, and their number under byte-level ranks, kept by word hash."""

    def __init__(self, model: str, ranks: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.n_ids = self.sp.get_piece_size()
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.n_ids)])
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.multi = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.newline = self.multi.encode_ordinary("\n")[0]
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(CACHE_WORDS + 1, np.int64)
        self.others = np.zeros(CACHE_WORDS, np.int32)

    def multi_counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word, as it stands after a space, under the byte-level ranks."""
        ids = np.array(self.multi.encode_ordinary(" " + "\n ".join(words) + "\n "), np.int64)
        ends = np.flatnonzero(ids == self.newline)
        if len(ends) == len(words):
            return np.diff(ends, prepend=-1) - 1
        # a word that ends in white space of its own kind takes the newline with it
        return np.fromiter((len(self.multi.encode_ordinary(" " + w)) for w in words), np.int64, len(words))

    def __call__(self, b: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of all words of a batch in order, their number in each word, and the number of the other vocabulary's."""
        uniq, at, inverse = np.unique(b.hash, return_index=True, return_inverse=True)
        keys = uniq.tolist()
        out = [np.zeros(0, np.int32)]
        first = np.zeros(len(keys), np.int64)
        size = np.zeros(len(keys), np.int64)
        other = np.zeros(len(keys), np.int64)
        base = 0
        missing = [i for i, k in enumerate(keys) if k not in self.slot]
        if len(self.slot) + len(missing) > CACHE_WORDS:
            self.clear()
            missing = list(range(len(keys)))
        room = CACHE_WORDS - len(self.slot)
        raw = b.data.tobytes()
        for lo in range(0, len(missing), 50_000):
            some = missing[lo : lo + 50_000]
            spelled = [raw[b.starts[at[i]] : b.ends[at[i]]].decode("utf-8", "replace") for i in some]
            found = self.sp.encode(spelled, num_threads=1)
            others = self.multi_counts(spelled)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((x for f in found for x in f), np.int32, int(sizes.sum()))
            ends = np.cumsum(sizes)
            if lo + len(some) <= room:
                n, top = len(self.slot), self.first[len(self.slot)]
                while top + len(flat) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
                self.ids[top : top + len(flat)] = flat
                self.first[n + 1 : n + 1 + len(some)] = top + ends
                self.others[n : n + len(some)] = others
                self.slot.update(zip((keys[i] for i in some), range(n, n + len(some)), strict=True))
            else:  # one batch with more new words than the table holds
                first[some], size[some], other[some] = -1 - base - (ends - sizes), sizes, others
                out.append(flat)
                base += len(flat)
        slots = np.fromiter((self.slot.get(k, -1) for k in keys), np.int64, len(keys))
        known = slots >= 0
        first[known] = self.first[slots[known]]
        size[known] = self.first[slots[known] + 1] - first[known]
        other[known] = self.others[slots[known]]
        pool = np.concatenate([self.ids[: self.first[len(self.slot)]], *out])
        first[~known] = self.first[len(self.slot)] - 1 - first[~known]
        per_word = size[inverse]
        ends = np.cumsum(per_word)
        token = np.repeat(first[inverse] - (ends - per_word), per_word) + np.arange(int(ends[-1]) if len(ends) else 0)
        return pool[token], per_word, other[inverse]


def fertility(b: TextBatch, seg: Segmenter) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, tokens of the other vocabulary, byte-fallback tokens and token entropy in bits of each text."""
    ids, per_word, others = seg(b)
    doc = np.repeat(b.doc, per_word)
    n = np.bincount(doc, minlength=b.n)
    multi = np.bincount(b.doc, others, minlength=b.n).astype(np.int64)
    fallback = np.bincount(doc[seg.is_byte[ids]], minlength=b.n)
    key, count = np.unique(doc * seg.n_ids + ids, return_counts=True)
    owner = key // seg.n_ids
    p = count / n[owner]
    return n, multi, fallback, np.bincount(owner, -p * np.log2(p), minlength=b.n) if len(key) else np.zeros(b.n)


def base_figures(b: TextBatch) -> dict[str, np.ndarray]:
    """The word, symbol, line and repetition counts of each text."""
    b.words()
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    starts, ends, doc, line = b.lines()
    worded = np.searchsorted(b.starts, ends, "left") > np.searchsorted(b.starts, starts, "left")
    key = np.unique(np.rec.fromarrays([doc[worded], line[worded]])) if worded.any() else None
    distinct = np.bincount(key["f0"], minlength=b.n) if key is not None else 0
    h, first = windows(b.hash, b.doc, WINDOW)
    repeated = np.zeros(b.n, np.int64)
    if len(h):
        owner = b.doc[first]
        order = np.lexsort((h, owner))
        same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        step = np.zeros(len(b.hash) + 1, np.int64)
        np.add.at(step, first[twice], 1)
        np.add.at(step, first[twice] + WINDOW, -1)
        repeated = np.bincount(b.doc[np.cumsum(step[:-1]) > 0], minlength=b.n)
    return {
        "n_words": b.n_words,
        "word_chars": b.per_doc(((b.data & 0xC0) != 0x80) & ~_SPACE[b.data]),
        "n_symbols": b.per_doc(symbol[b.data]),
        "n_dup_lines": np.bincount(doc[worded], minlength=b.n) - distinct,
        "n_repeat_words": repeated,
    }


def scripts(b: TextBatch) -> np.ndarray:
    """The script of most letters of each text, as its place in SCRIPTS (the first where none has a letter)."""
    if not (b.data >= 0xCD).any():
        return np.zeros(b.n, np.int64)
    counts = np.stack([b.per_doc(_SCRIPT[b.data] == i) for i in range(len(SCRIPTS))])
    return counts.argmax(axis=0)


class Scorer:
    """Figures of the rows of a batch."""

    def __init__(self, model: str, ranks: str):
        self.seg = Segmenter(model, ranks)

    def __call__(self, part: pa.RecordBatch) -> pa.StructArray:
        b = TextBatch(part.column("text"))
        x = base_figures(b)
        tokens, multi, fallback, entropy = fertility(b, self.seg)
        failed = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT_PERCENT * x["n_words"])
        most = np.log2(np.maximum(tokens, 2))
        figures = [x["word_chars"] / np.maximum(tokens, 1), x["word_chars"] / np.maximum(multi, 1), fallback / np.maximum(tokens, 1), entropy / most]
        cols = x | {"base_failed": failed, "n_tokens": tokens, "script": [SCRIPTS[i][0] for i in scripts(b).tolist()], "octave": np.floor(most)} | {m.name: v for m, v in zip(MEASURES, figures, strict=True)}
        return pa.StructArray.from_arrays([pa.array(cols[k], t) for k, _, t in FIGURES], [k for k, _, _ in FIGURES])


def _scored(batches: Iterable[pa.RecordBatch], model: str, ranks: str) -> Iterator[pa.RecordBatch]:
    """The rows with their figures in a last column."""
    score = Scorer(model, ranks)
    for batch in batches:
        for part in chunks(batch):
            yield pa.RecordBatch.from_arrays([*part.columns, score(part)], [*part.schema.names, "figures"])


def with_figures(docs: DataFrame, model: str, ranks: str, name: str) -> DataFrame:
    """``docs`` (text and more) with a struct of figures."""
    at = docs.columns.index("text")
    plain = docs.toDF(*(f"c{i}" if i != at else "text" for i in range(len(docs.columns))))  # names may clash
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + f", figures {FIGURE_TYPE}"
    return plain.mapInArrow(lambda it: _scored(it, model, ranks), schema).toDF(*docs.columns, name)


LEVELS = (("script",), ("script", "lang"), ("script", "lang", "octave"))


def fit_bands(figures: DataFrame) -> DataFrame:
    """Bands of each script, language and octave of rows (lang, and the columns of the figures): script, lang, octave, low and high of each measure.

    Only rows that pass the base rules count.
    """
    bins = F.array(*(F.struct(F.lit(i).alias("m"), F.round(F.col(m.name) / m.step).cast("int").alias("bin")) for i, m in enumerate(MEASURES)))
    rows = figures.where("NOT base_failed").select("script", "lang", "octave", F.explode(bins).alias("x")).select("script", "lang", "octave", "x.m", "x.bin")
    grid = rows.groupBy("script", "lang", "octave", "m", "bin").agg(F.count("*").alias("n"))
    of = lambda values: F.get(F.array(*(F.lit(float(v)) for v in values)), F.col("m"))
    parent = None
    for keys in LEVELS:
        part = grid.groupBy(*keys, "m", "bin").agg(F.sum("n").alias("n"))
        so_far = W.partitionBy(*keys, "m").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)  # a grid's bins at most
        part = part.withColumn("c", F.sum("n").over(so_far)).withColumn("all", F.sum("n").over(W.partitionBy(*keys, "m")))
        quartile = lambda k: F.min(F.when(4 * F.col("c") >= k * F.col("all"), F.col("bin")))
        part = part.groupBy(*keys, "m").agg(F.max("all").alias("all"), quartile(1).alias("a"), quartile(3).alias("b"))
        step = of([m.step for m in MEASURES])
        reach = REACH * F.greatest((F.col("b") - F.col("a")) * step, of([m.spread for m in MEASURES]))
        own = part.select(*keys, "m", "all", (F.col("a") * step - reach).alias("own_low"), (F.col("b") * step + reach).alias("own_high"))
        if parent is None:
            both = own.withColumns({"low": of([m.low for m in MEASURES]), "high": of([m.high for m in MEASURES])})
        else:
            on = reduce(lambda x, y: x & y, [F.col(f"o.{k}").eqNullSafe(F.col(f"p.{k}")) for k in (*keys[:-1], "m")])
            both = own.alias("o").join(parent.alias("p"), on).select("o.*", "p.low", "p.high")
        mean = lambda k: (F.col("all") * F.col(f"own_{k}") + PRIOR * F.col(k)) / (F.col("all") + PRIOR)
        parent = both.select(*keys, "m", mean("low").alias("low"), mean("high").alias("high"))
    pick = lambda i, k: F.max(F.when(F.col("m") == i, F.col(k)))
    return parent.groupBy("script", "lang", "octave").agg(*(pick(i, k).alias(f"{k}_{m.name}") for i, m in enumerate(MEASURES) for k in ("low", "high")))


def judged(rows: DataFrame, bands: DataFrame, lang: Column, figures: str, outside: str) -> DataFrame:
    """``rows`` with a string of the measures (comma-joined, null: base rules failed) by which each leaves its band; empty: kept."""
    names = {c: f"_band_{c}" for c in bands.columns}
    while set(names.values()) & set(rows.columns):
        names = {c: "_" + n for c, n in names.items()}
    b = bands.toDF(*(names[c] for c in bands.columns))
    on = (F.col(f"{figures}.script") == F.col(names["script"])) & (F.col(f"{figures}.octave") == F.col(names["octave"])) & lang.eqNullSafe(F.col(names["lang"]))
    bad = [F.when((F.col(f"{figures}.{m.name}") < F.col(names[f"low_{m.name}"])) | (F.col(f"{figures}.{m.name}") > F.col(names[f"high_{m.name}"])), m.name) for m in MEASURES]
    return rows.join(b, on, "left").select(*(rows[c] for c in rows.columns), F.when(~F.col(f"{figures}.base_failed"), F.concat_ws(",", *bad)).alias(outside))


def quality_rules(docs: DataFrame, model: str, ranks: str, bands: DataFrame | None = None) -> DataFrame:
    """Figures and verdict of each row of ``docs`` (doc_id, text, lang).

    ``model``: path of a sentencepiece model; ``ranks``: of byte-level ranks; ``bands``: of
    ``fit_bands``, to judge by those of another corpus.  ``outside`` names the measures
    that reject a text.

    >>> quality_rules(docs, model, ranks).where("kept")  # doctest: +SKIP
    """
    scored = with_figures(docs.select("doc_id", "lang", "text"), model, ranks, "figures").select("doc_id", "lang", "figures")
    scored = stored(scored, "figures")
    if bands is None:
        bands = fit_bands(scored.select("lang", "figures.*"))
    out = judged(scored, bands, F.col("lang"), "figures", "outside")
    kept = F.coalesce(F.col("outside") == "", F.lit(False))
    first = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rest = [k for k, _, _ in FIGURES if k not in first]
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(f"figures.{k}" for k in first), kept.alias("kept"), *(f"figures.{k}" for k in rest), "outside")


def keep_good(docs: DataFrame, model: str, ranks: str, bands: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; texts are scanned and written once, and not shuffled."""
    name, outside = free_name("_figures", docs), free_name("_outside", docs)
    scored = stored(with_figures(docs, model, ranks, name).where(f"NOT {name}.base_failed"), "figures")
    if bands is None:
        bands = fit_bands(scored.select("lang", f"{name}.*"))
    return judged(scored, bands, scored["lang"], name, outside).where(F.col(outside) == "").select(*docs.columns)
