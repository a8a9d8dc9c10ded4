"""N-gram Jaccard join with signature trees, exact, up to connected components.

Texts become sets of hashed shingles; texts with equal sets form a class, which
the rest treats as one.  Two similar classes share at least m of the first
``n - ceil(t*n) + m`` shingles of either, in an order that all sets have in common
(``m`` grows with n).  The order puts shingles that are frequent in the corpus last,
so a boilerplate passage brings no classes together unless they consist of it.
Classes that share such a shingle form a run; a class that meets others in fewer
than m runs has no partner, and of runs with the same members one is enough.

Every link is found by signature trees over the members of runs.  A tree's nodes
hold the OR of their members' shingle bitmaps, the range of their sizes and the most
shingles that a bitmap hides; a dual traversal drops pairs of nodes that by size or by
the largest possible overlap cannot hold a link, and pairs of nodes that lie in
one component already.  What it leaves is compared exactly, set against set.

1. Spanning rounds.  A traversal takes what it leaves for linked, so it lists a
   forest, not all pairs: m copies cost m - 1 comparisons.  First each class enters the
   tree of its largest run, with ``WITNESS`` further members of that run; then runs in
   which a component has more than ``WITNESS`` members besides others, with so many of
   each, as long as that halves them.
2. The last traversal lists *all* pairs of different components, in all runs that
   still hold several, so no link between components is lost.

Runs of more than ``BLOCK`` members are dealt in blocks to many tasks (in the last
traversal: all pairs of blocks).  Shuffles: prefix shingles (about 1 - t of all), then
only what shares one: rows of runs with bitmaps, and the texts once, to fetch the sets of
classes in runs.  Shingles and classes are told apart by 64-bit hashes.

Null or empty text, or one without words: empty set, linked with nothing.  Rows of
the same doc_id count as one document with several texts.  Null doc_id: linked with
nothing, its component is null.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocutide.llm.components import components, few
from ocutide.llm.storage import discard, stored
from ocutide.llm.textbatch import _BASE, TextBatch, chunks, mix, windows

SHINGLE, PERCENT = 4, 85
#: Shingles of a block of texts that are counted together, how often one must occur there to be reported for certain
#: (rarer ones by a chance of one in SAMPLED for each occurrence, which counts as so many), and the most frequent ones that the order knows.
BLOCK_TOKENS, BLOCK_LEAST, SAMPLED, HEAVY = 1_500_000, 3, 64, 200_000
#: Least and most bits of a bitmap (two for a shingle between them), members of a leaf, classes that a task remembers.
BITS, MOST_BITS, LEAF, SEEN = 2048, 1 << 16, 16, 1_000_000
#: Share of a set by which its prefix is longer than one shared shingle needs.
MORE_PERCENT = 3
#: Members of a run that meet in one tree, and members of a component (or of a run) that stand for the rest in a spanning round.
BLOCK, WITNESS = 2048, 16


def meetings(n, percent: int = 100):
    """How many prefix shingles a class of n must share with one similar class, of its own size or more (``percent``: of that share of it at least)."""
    return 1 + -(-percent * n // 100) * MORE_PERCENT // 100


def required(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of these sizes that are similar enough."""
    return -(-percent * (na + nb) // (100 + percent))


def shingle_sets(b: TextBatch, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingles of each text, and the hash of each set (0: empty)."""
    b.words(lower=True)
    h, first = windows(b.hash, b.doc, k)
    cut = np.searchsorted(b.doc[first], np.arange(b.n + 1))
    words = np.searchsorted(b.doc, np.arange(b.n + 1))
    sets, cls = [], np.zeros(b.n, np.int64)
    for i in range(b.n):
        if cut[i + 1] > cut[i]:
            s = np.unique(h[cut[i] : cut[i + 1]])
        elif words[i + 1] > words[i]:
            whole = np.uint64(words[i + 1] - words[i])
            for x in b.hash[words[i] : words[i + 1]]:
                whole = whole * _BASE + x  # numpy scalars wrap, as the arrays do
            s = mix(np.array([whole], np.uint64))
        else:
            s = np.zeros(0, np.uint64)
        sets.append(s)
        if len(s):
            cls[i] = int(mix(mix(s).sum(keepdims=True) + np.uint64(len(s)))[0].view(np.int64)) or 1
    return sets, cls


def _class_rows(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (false, doc_id, class, size) of texts, and (true, shingle, estimated number, evidence) of shingles in a block of distinct texts.

    A shingle that repeats in a block is counted there (evidence 2); others are sampled (evidence 1), so that one that is
    rare in every block but frequent in the corpus is known too.
    """
    held: list[np.ndarray] = []
    seen: set[int] = set()
    room = BLOCK_TOKENS

    def out(kind: bool, a: pa.Array, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), kind)), a, pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["heavy", "a", "b", "n"])

    def counted() -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
        often = n >= BLOCK_LEAST
        held.clear()
        salt = mix(token.sum(keepdims=True))  # of each block its own
        drawn = ~often & (mix(token ^ salt) % np.uint64(SAMPLED) < n.astype(np.uint64))
        chosen = often | drawn
        return out(True, pa.array(token[chosen].view(np.int64)), np.where(often, n, SAMPLED)[chosen], np.where(often, 2, 1)[chosen])

    with np.errstate(over="ignore"):
        for batch in batches:
            for part in chunks(batch):
                sets, cls = shingle_sets(TextBatch(part.column("text")), k)
                for s, c in zip(sets, cls.tolist(), strict=True):
                    if len(s) and c not in seen:
                        seen.add(c)
                        held.append(s)
                        room -= len(s)
                yield out(False, part.column("doc_id").cast(pa.int64()), cls, np.array([len(s) for s in sets]))
                if room <= 0:
                    yield counted()
                    room = BLOCK_TOKENS
                if len(seen) > SEEN:
                    seen.clear()
        yield counted()


def _prefix_rows(batches: Iterable[pa.RecordBatch], k: int, percent: int, heavy: np.ndarray, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Shingle, class, size and place of the prefix of each class that the task has not met before."""
    seen: set[int] = set()
    with np.errstate(over="ignore"):
        for batch in batches:
            for part in chunks(batch):
                sets, cls = shingle_sets(TextBatch(part.column("text")), k)
                fresh = []
                for i, c in enumerate(cls.tolist()):
                    if c and c not in seen:
                        seen.add(c)
                        fresh.append(i)
                if len(seen) > SEEN:
                    seen.clear()
                if not fresh:
                    continue
                n = np.array([len(sets[i]) for i in fresh])
                keep = n - -(-percent * n // 100) + meetings(n)
                flat, owner = np.concatenate([sets[i] for i in fresh]), np.repeat(np.arange(len(fresh)), n)
                order = np.arange(len(flat))
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, flat), len(heavy) - 1)
                    weight = np.where(heavy[at] == flat, rank[at], -1)
                    order = np.lexsort((flat, weight, owner))  # sets are sorted by hash already
                place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                chosen = place < np.repeat(keep, n)
                who = owner[chosen]
                yield pa.RecordBatch.from_arrays([pa.array(flat[order][chosen].view(np.int64)), pa.array(cls[fresh][who]), pa.array(n[who].astype(np.int32)), pa.array(place[chosen].astype(np.int32))], ["token", "cls", "n", "pos"])


def _met_rows(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows by token, size and class: one of each class, where another of the token has a size that goes with its own.

    Sizes are in order, so the nearest neighbours tell; only one row is carried on.
    """
    names = ["token", "cls", "n", "pos"]
    carry: dict[str, np.ndarray] | None = None
    paired = False  # whether the carried row goes with the one before it

    def out(x: dict[str, np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[c][keep]) for c in names], names)

    for batch in batches:
        x = {c: batch.column(c).to_numpy() for c in names}
        if carry is not None:
            x = {c: np.concatenate([carry[c], x[c]]) for c in names}
        if not len(x["token"]):
            continue
        new = np.ones(len(x["token"]), bool)
        new[1:] = (x["token"][1:] != x["token"][:-1]) | (x["cls"][1:] != x["cls"][:-1])
        x = {c: v[new] for c, v in x.items()}
        n = x["n"].astype(np.int64)
        goes = (x["token"][1:] == x["token"][:-1]) & (100 * n[:-1] >= percent * n[1:])
        keep = np.concatenate([[paired], goes])
        keep[:-1] |= goes
        carry, paired = {c: v[-1:] for c, v in x.items()}, bool(keep[-1])
        keep[-1] = False
        yield out(x, keep)
    if carry is not None:
        yield out(carry, np.array([paired]))


GROUP = ["token", "low", "high"]


def _whole_groups(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of row groups that end where a group does; a group has at most about 2 * BLOCK rows."""
    rest: pa.Table | None = None
    take = lambda t: {c: t.column(c).to_numpy() for c in names}
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        last = np.ones(table.num_rows, bool)
        for c in GROUP:
            key = table.column(c).to_numpy()
            last &= key == key[-1]
        cut = int(last.argmax())
        rest = table.slice(cut)
        if cut:
            yield take(table.slice(0, cut))
    if rest is not None:
        yield take(rest)


def bitmap_bits(n: int) -> int:
    """Bits of the bitmap of a set of n."""
    return min(max(BITS, 1 << (2 * n - 1).bit_length()), MOST_BITS)


def _set_rows(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Class, shingles and bitmap of texts that still have the class they are fetched for."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for part in chunks(batch):
                sets, cls = shingle_sets(TextBatch(part.column("text")), k)
                at = np.flatnonzero(cls == part.column("cls").to_numpy())
                maps = []
                for i in at:
                    width = bitmap_bits(len(sets[i]))
                    bits = np.zeros(width, np.uint8)
                    bits[(sets[i] % np.uint64(width)).astype(np.int64)] = 1
                    maps.append(np.packbits(bits).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array([sets[i].view(np.int64) for i in at], pa.list_(pa.int64())), pa.array(maps, pa.binary())], ["cls", "tokens", "bitmap"])


class SignatureTree:
    """A binary tree over classes sorted by size: OR of bitmaps, size range, and the largest number of shingles that a bitmap hides."""

    def __init__(self, n: np.ndarray, bitmap: np.ndarray):
        self.n, self.bitmap = n, bitmap
        self.hidden = n - np.bitwise_count(bitmap).sum(axis=1)
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, int, int, int]] = {}

    def node(self, lo: int, hi: int) -> tuple[np.ndarray, int, int, int]:
        if (lo, hi) not in self.nodes:
            self.nodes[lo, hi] = np.bitwise_or.reduce(self.bitmap[lo:hi]), int(self.n[lo]), int(self.n[hi - 1]), int(self.hidden[lo:hi].max())
        return self.nodes[lo, hi]

    def leaf_pairs(self, percent: int, label: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Pairs of leaves, as ranges of members, that may hold links between different labels; the traversal of the tree with itself.

        Halves come before what lies between them, so labels that the caller unites on the way prune the rest.
        """
        todo = [(0, len(self.n), 0, len(self.n))]
        while todo:
            a, b, c, d = todo.pop()
            if (label[a:b] == label[a]).all() and (label[c:d] == label[a]).all():
                continue
            (ma, la, ha, sa), (mb, lb, hb, sb) = self.node(a, b), self.node(c, d)
            if (a, b) != (c, d):
                if 100 * min(ha, hb) < percent * max(la, lb):
                    continue
                most = min(sa, sb) + int(np.bitwise_count(ma & mb).sum())
                if most < -(-percent * (la + lb) // (100 + percent)):
                    continue
            if b - a <= LEAF and d - c <= LEAF:
                yield a, b, c, d
            elif (a, b) == (c, d):
                m = (a + b) // 2
                todo += [(a, m, m, b), (a, m, a, m), (m, b, m, b)]
            elif b - a >= d - c:
                m = (a + b) // 2
                todo += [(a, m, c, d), (m, b, c, d)]
            else:
                m = (c + d) // 2
                todo += [(a, b, c, m), (a, b, m, d)]


def run_pairs(n: np.ndarray, pos: np.ndarray, comp: np.ndarray, bitmap: np.ndarray, percent: int, spanning: bool = False, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs of one run, of different components, that could be similar and first share this run's shingle.

    ``spanning``: only a forest that connects all that could be similar, as if each were a link, wherever they first meet.  With ``side``: pairs of unlike sides only.
    """
    order = np.argsort(n, kind="stable")
    n, pos, bitmap = n[order].astype(np.int64), pos[order].astype(np.int64), bitmap[order]
    label = np.unique(comp[order], return_inverse=True)[1]
    side = None if side is None else side[order]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, b, c, d in SignatureTree(n, bitmap).leaf_pairs(percent, label):
        i, j = np.meshgrid(np.arange(a, b), np.arange(c, d), indexing="ij")
        i, j = i.ravel(), j.ravel()
        need = required(n[i], n[j], percent)
        fine = label[i] != label[j]
        if not spanning:
            fine &= np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need
        if (a, b) == (c, d):
            fine &= i < j
        if side is not None:
            fine &= side[i] != side[j]
        i, j, need = i[fine], j[fine], need[fine]
        if not len(i):
            continue
        over_i = n[i] - np.bitwise_count(bitmap[i] & ~bitmap[j]).sum(axis=1)
        over_j = n[j] - np.bitwise_count(bitmap[j] & ~bitmap[i]).sum(axis=1)
        fine = np.minimum(over_i, over_j) >= need
        i, j = i[fine], j[fine]
        if not spanning:
            out.append((order[i], order[j]))
            continue
        while len(i):
            x, y = i[0], j[0]
            out.append((order[x : x + 1], order[y : y + 1]))
            label[label == label[y]] = label[x]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def folded(bitmaps: list[bytes], bits: int) -> np.ndarray:
    """Bitmaps of ``bits`` bits or more, as rows of ``bits``: a bit of the narrower one is set where one of its bits is."""
    out = np.zeros((len(bitmaps), bits // 64), np.uint64)
    for k, x in enumerate(bitmaps):
        np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, bits // 64), axis=0, out=out[k])
    return out


def _group_pairs(x: dict[str, np.ndarray], percent: int, spanning: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group.  Sets of one bitmap width share a tree, with those of the next width, folded, that go with them by size."""
    bits = np.array([8 * len(v) for v in x["bitmap"]])
    side = x["side"] if x["low"][0] != x["high"][0] else None
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for width in np.unique(bits):
        own = bits == width
        at = np.flatnonzero(own | (bits == 2 * width) & (percent * x["n"].astype(np.int64) <= 100 * int(x["n"][own].max())))
        if len(at) > 1:
            i, j = run_pairs(x["n"][at], x["pos"][at], x["comp"][at], folded([x["bitmap"][k] for k in at], int(width)), percent, spanning, None if side is None else side[at])
            out.append((at[i], at[j]))
    return np.concatenate([v for v, _ in out]), np.concatenate([v for _, v in out])


def _tree_rows(batches: Iterable[pa.RecordBatch], percent: int, spanning: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of classes of each group that its tree leaves."""
    for x in _whole_groups(batches, [*GROUP, "cls", "n", "pos", "comp", "side", "bitmap"]):
        new = np.zeros(len(x["token"]) - 1, bool)
        for c in GROUP:
            new |= x[c][1:] != x[c][:-1]
        cut = np.concatenate([[0], np.flatnonzero(new) + 1, [len(x["token"])]])
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if hi - lo > 1:
                i, j = _group_pairs({c: v[lo:hi] for c, v in x.items()}, percent, spanning)
                p, q = x["cls"][lo:hi][i], x["cls"][lo:hi][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["u", "v"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of classes whose sets are similar enough."""
    one, two = sets.select(F.col("cls").alias("u"), F.col("tokens").alias("x")), sets.select(F.col("cls").alias("v"), F.col("tokens").alias("y"))
    both = pairs.join(one, "u").join(two, "v").select("u", "v", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("common"))
    return both.where(f"100 * common >= {percent} * (nx + ny - common)").select("u", "v")


RUN = "token bigint, cls bigint, n int, pos int"


def _tree_pairs(rows: DataFrame, sets: DataFrame, percent: int, spanning: bool) -> DataFrame:
    """Distinct pairs that the trees over runs leave; ``rows``: token, cls, n, pos, comp."""
    rows = rows.select("token", "cls", "n", "pos", "comp")
    size = rows.groupBy("token").agg(F.count("*").alias("size"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")
    dealt = rows.join(size, "token").withColumn("side", F.pmod(F.xxhash64("cls", F.lit(1)), blocks).cast("int"))
    if spanning:  # blocks alone: others come together in a later round
        dealt = dealt.withColumns({"low": F.col("side"), "high": F.col("side")})
    else:
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")})
    dealt = dealt.join(sets.select("cls", "bitmap"), "cls").select(*GROUP, "cls", "n", "pos", "comp", "side", "bitmap")
    return dealt.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(lambda it: _tree_rows(it, percent, spanning), "u bigint, v bigint").distinct()


def _distinct_runs(runs: DataFrame) -> DataFrame:
    """Of runs with the same members the one whose shingle comes first in the common order, with its size."""
    mark = lambda k: F.sum(F.shiftright(F.xxhash64("cls", F.lit(k)), 20)).alias(f"f{k}")
    each = runs.groupBy("token").agg(F.count("*").alias("size"), mark(0), mark(1), F.sum(F.col("pos").cast("bigint")).alias("place"))
    return each.groupBy("size", "f0", "f1").agg(F.min_by("token", F.struct("place", "token")).alias("token")).select("token", "size")


def _first_round(placed: DataFrame) -> DataFrame:
    """Each class in its largest run, and of each of these runs some members more."""
    best = placed.groupBy("cls").agg(F.max_by("token", F.struct("size", "token")).alias("best"))
    used = best.select(F.col("best").alias("token")).distinct()
    some = F.pmod(F.xxhash64("cls", "token"), F.col("size")) < WITNESS
    return placed.join(best, "cls").join(used, "token", "left_semi").where((F.col("token") == F.col("best")) | some).drop("best")


def _crowded(placed: DataFrame, k: int) -> DataFrame:
    """Of runs that hold a component with many members and others besides: some members of each component, others in each round k."""
    inside = placed.groupBy("token", "comp").agg(F.count("*").alias("m"))
    open_ = inside.groupBy("token").agg(F.count("*").alias("comps"), F.max("m").alias("most")).where(f"comps > 1 AND most > {WITNESS}").select("token")
    rows = placed.join(open_, "token", "left_semi").join(inside.withColumnRenamed("comp", "c").withColumnRenamed("token", "t"), (F.col("token") == F.col("t")) & (F.col("comp") == F.col("c")))
    return rows.where(F.pmod(F.xxhash64("cls", F.lit(k)), F.col("m")) < WITNESS).drop("t", "c", "m")


def jaccard_links(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts (doc_id, cls, n); between classes of equal sets, links (u, v) that connect all that are similar; and each linked class with its component (node, label).

    Links hold at least one path between any two similar classes, and only similar pairs.
    """
    texts = docs.select("doc_id", "text")
    found = stored(texts.mapInArrow(lambda it: _class_rows(it, shingle), "heavy boolean, a bigint, b bigint, n bigint"), "classes")
    docs_of = found.where("NOT heavy").select(F.col("a").alias("doc_id"), F.col("b").alias("cls"), "n")
    top = found.where("heavy").groupBy("a").agg(F.sum("b").alias("c"), F.sum("n").alias("seen")).where("seen > 1").orderBy(F.col("c").desc(), "a").limit(HEAVY).collect()  # HEAVY rows of two numbers at most
    by_count = sorted((r["c"], r["a"]) for r in top)
    token = np.array([a for _, a in by_count], np.int64).view(np.uint64)
    order = np.argsort(token)
    heavy, rank = token[order], order.astype(np.int64)
    entries = texts.where("doc_id IS NOT NULL").mapInArrow(lambda it: _prefix_rows(it, shingle, percent, heavy, rank), RUN)
    met_in = lambda df: df.repartition("token").sortWithinPartitions("token", "n", "cls").mapInArrow(lambda it: _met_rows(it, percent), RUN)
    met = stored(met_in(entries), "met")
    often = met.groupBy("cls").agg(F.count("*").alias("c"), F.max("n").alias("n")).where(f"c >= 1 + floor(ceil({percent} * n / 100) * {MORE_PERCENT} / 100)").select("cls")
    # the first shingle that a pair shares lies among these
    first = met.join(often, "cls", "left_semi").where(f"pos <= n - ceil({percent} * n / 100)")
    every = stored(met_in(first), "runs")
    runs = stored(every.join(_distinct_runs(every), "token"), "runs")
    discard(met, every)
    reps = docs_of.where("cls <> 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(runs.select("cls").distinct(), "cls", "left_semi")
    sets = stored(texts.join(reps, "doc_id").select("text", "cls").mapInArrow(lambda it: _set_rows(it, shingle), "cls bigint, tokens array<bigint>, bitmap binary"), "sets")
    n = runs.count()
    placed = runs.withColumn("comp", F.col("cls"))
    links, labels, rows, k, left = [], None, _first_round(placed), 0, None
    while True:
        more = stored(_verified(_tree_pairs(rows, sets, percent, True), sets, percent), "links")
        links.append(more)
        old, labels = labels, components(more if labels is None else more.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))))
        if old is not None:
            discard(old)
        discard(placed)
        placed = stored(few(runs.join(labels.withColumnRenamed("node", "cls"), "cls", "left"), n).select("token", "cls", "n", "pos", "size", F.coalesce("label", "cls").alias("comp")), "placed")
        k += 1
        rows = _crowded(placed, k)
        before, left = left, rows.count()
        if not left or before is not None and 2 * left > before:
            break
    open_ = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    last = stored(_verified(_tree_pairs(placed.join(open_, "token", "left_semi"), sets, percent, False), sets, percent), "links")
    links.append(last)
    final = components(last.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))))
    discard(placed, runs, sets, labels)
    return docs_of, reduce(DataFrame.unionByName, links), final


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with the size of its shingle set and the smallest doc_id that links lead to."""
    docs_of, links, labels = jaccard_links(docs, shingle, percent)
    classes = docs_of.where("cls <> 0").groupBy("cls").agg(F.min("doc_id").alias("rep")).join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    least = classes.where("label IS NOT NULL").groupBy("label").agg(F.min("rep").alias("least"))
    spread = classes.withColumn("label", F.coalesce("label", "cls"))  # null keys would meet in one task
    placed = spread.join(least, "label", "left").select(F.expr("cls ^ 1").alias("k"), F.coalesce("least", "rep").alias("least_id"))
    # keys under another expression: the join gets exchanges that adaptive execution can split where a class is large
    rows = docs_of.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls") == 0, F.coalesce("doc_id", F.lit(0)).bitwiseXOR(F.lit(0x5DEECE66D))).otherwise(F.expr("cls ^ 1")).alias("k"), (F.col("cls") == 0).alias("empty"))
    out = rows.join(placed, "k", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("empty"), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("least_id")).alias("component_id"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS}, []) AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {SHINGLE} THEN [words] ELSE list_transform(range(len(words) - {SHINGLE} + 1), lambda i: words[i + 1 : i + {SHINGLE}]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS m FROM w UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(m) FROM r WHERE r.a = w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)
"""
