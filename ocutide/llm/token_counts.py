"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Pre-tokens new to a worker are laid end to end as one ragged array of symbols.
Each round looks up the merge rank of every neighbouring pair, takes the lowest
rank of each sequence, and merges all its occurrences in all sequences at once;
the symbols that survive are the tokens.  Counts of recent pre-tokens are kept in
a table of bounded size, since a corpus repeats most of its pre-tokens.

Nothing is shuffled.  Null or empty text: zero bytes and tokens.  Repeated rows
are each counted; extra columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ocutide.llm.textbatch import chunks

#: The pre-token pattern of the byte-level family (fixed values of the public format).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CACHE = 250_000
BLOCK = 50_000
_NONE = np.int64(1) << 60


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, other = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(other))
        other += b not in plain
    return out


class Merger:
    """Counts tokens of pre-tokens under the merges of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.width = np.int64(max(vocab.values()) + 1)
        key = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.of_byte = np.array([vocab[c] for c in byte_chars()], np.int64)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(PRE_TOKEN)
        self.known: dict[str, int] = {}

    def ranks_of(self, sym: np.ndarray) -> np.ndarray:
        pair = sym[:-1] * self.width + sym[1:]
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], _NONE)

    def count(self, pre_tokens: list[str]) -> np.ndarray:
        """Tokens of each non-empty pre-token."""
        raw = [p.encode("utf-8", "replace") for p in pre_tokens]
        seq = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        sym = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        out = np.bincount(seq, minlength=len(raw))
        while len(sym) > 1:
            rank = self.ranks_of(sym)
            rank[seq[1:] != seq[:-1]] = _NONE
            lowest = np.full(len(raw), _NONE)
            np.minimum.at(lowest, seq[:-1], rank)
            live = lowest[seq] < _NONE
            hit = np.flatnonzero((rank < _NONE) & (rank == lowest[seq[:-1]]))
            if not len(hit):
                break
            # in a run of overlapping hits (a a a ...) every second one merges
            head = np.concatenate([[True], np.diff(hit) > 1])
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(head, np.arange(len(hit)), 0))
            hit = hit[nth % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            live[hit + 1] = False  # merged away, as are all symbols of finished sequences
            out -= np.bincount(seq[hit], minlength=len(raw))
            sym, seq = sym[live], seq[live]
        return out

    def learn(self, pre_tokens: set[str]) -> dict[str, int]:
        new = [p for p in pre_tokens if p not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = list(pre_tokens)
        found: dict[str, int] = {}
        for lo in range(0, len(new), 20_000):
            some = new[lo : lo + 20_000]
            found.update(zip(some, self.count(some).tolist(), strict=True))
        if len(new) <= CACHE:
            short = {p: n for p, n in found.items() if len(p) <= 64}
            self.known.update(short)
            found = {p: n for p, n in found.items() if len(p) > 64} if len(short) < len(found) else {}
        return found

    def batch(self, texts: list[str]) -> list[int]:
        """Tokens of each text; new pre-tokens of all texts are merged together."""
        out, held, room = [0] * len(texts), [], BLOCK

        def settle() -> None:
            found = self.learn({p for _, words in held for p in words})
            count = (_Either(self.known, found) if found else self.known).__getitem__
            for i, words in held:
                out[i] += sum(map(count, words))
            held.clear()

        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special else [text]
            out[i] += len(parts) - 1
            if len(text) < BLOCK:
                words = list(chain.from_iterable(map(self.split.findall, parts)))
                held.append((i, words))
                room -= len(words)
                if room < 0:
                    settle()
                    room = BLOCK
                continue
            words = (m.group() for p in parts for m in self.split.finditer(p))
            while block := list(islice(words, BLOCK)):
                held.append((i, block))
                settle()
        settle()
        return out


class _Either(dict):
    """A view of two tables without a copy of the larger one."""

    def __init__(self, large: dict, small: dict):
        super().__init__(small)
        self.large = large

    def __missing__(self, key: str) -> int:
        return self.large[key]


def _counted(batches: Iterable[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    merger = Merger(path)
    for batch in batches:
        for part in chunks(batch):
            texts = [t or "" for t in part.column("text").to_pylist()]
            tokens = merger.batch(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """Bytes and tokens of each row of ``docs`` (doc_id, text), and whether the tokens exceed ``limit``.

    ``tokenizer``: path of a byte-level BPE file of the tokenizers library.
    Special strings inside a text count as one token each, as in that library.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda it: _counted(it, tokenizer, limit), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
