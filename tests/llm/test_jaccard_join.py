import random

import numpy as np
from brute import components
from pyspark.sql import functions as F

from ocutide.llm import jaccard_join as J


def corpus(seed=11, groups=6):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.5 else f"w{rng.randrange(3000)}"
    out = ["", None, " \n", "one", "one two", "One Two", "one two three", "a b c d", "A B C D"]
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(20, 150))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(2, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy).upper() if rng.random() < 0.2 else "  ".join(copy))
    shared = [word() for _ in range(60)]
    out += [" ".join([*shared, *(word() for _ in range(rng.randrange(4, 80)))]) for _ in range(25)]
    return out


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_against_all_pairs(docs):
    t = corpus()
    assert result(J.jaccard_components(docs(t))) == components(list(enumerate(t)))


def without_rounds(monkeypatch):
    monkeypatch.setattr(J, "_first_round", lambda placed: placed.where("false"))


def test_last_traversal_finds_all_by_itself(docs, monkeypatch):
    without_rounds(monkeypatch)
    monkeypatch.setattr(J, "LEAF", 2)
    t = corpus(12, 4)
    assert result(J.jaccard_components(docs(t))) == components(list(enumerate(t)))


def test_blocks_of_few_members(docs, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 3)
    monkeypatch.setattr(J, "WITNESS", 1)
    t = corpus(13, 5)
    want = components(list(enumerate(t)))
    assert result(J.jaccard_components(docs(t))) == want
    without_rounds(monkeypatch)
    assert result(J.jaccard_components(docs(t))) == want


def test_every_link_is_similar_and_few_are_listed(docs):
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    copies = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in rng.sample(range(120), 90)]
    _, links, labels = J.jaccard_links(docs(copies))
    assert 89 <= links.count() < 3 * 90 and labels.select("label").distinct().count() == 1


def test_wide_bitmaps_and_long_texts(docs, monkeypatch):
    monkeypatch.setattr(J, "BITS", 64)
    rng = random.Random(9)
    t = []
    for n in (30, 60, 65, 130, 300, 320, 2000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        t += [" ".join(base), " ".join(base[: n - n // 20]), " ".join(base[n // 9 :])]
    want = components(list(enumerate(t)))
    assert result(J.jaccard_components(docs(t))) == want
    without_rounds(monkeypatch)
    assert result(J.jaccard_components(docs(t))) == want


def test_folded_bitmaps_hide_no_shingle():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 60, 50).astype(np.uint64)
    wide = np.zeros(1024, np.uint8)
    wide[(x % np.uint64(1024)).astype(np.int64)] = 1
    narrow = np.zeros(256, np.uint8)
    narrow[(x % np.uint64(256)).astype(np.int64)] = 1
    assert (J.folded([np.packbits(wide).tobytes()], 256).view(np.uint8)[0] == np.packbits(narrow)).all()


def test_rows_that_meet_none_go():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = sorted((int(t), int(n), int(n) * 1000 + int(c)) for t, n, c in zip(rng.integers(0, 40, 300), rng.integers(5, 60, 300), rng.integers(0, 3, 300), strict=True))
    want = sorted({(t, c, n) for t, n, c in rows if any(t == u and c != d and 100 * min(n, m) >= 85 * max(n, m) for u, m, d in rows)})
    for size in (1, 7, 300):
        parts = [rows[i : i + size] for i in range(0, 300, size)]
        batches = [pa.RecordBatch.from_pydict({"token": [r[0] for r in p], "cls": [r[2] for r in p], "n": pa.array([r[1] for r in p], pa.int32()), "pos": pa.array([0] * len(p), pa.int32())}) for p in parts]
        got = [(r["token"], r["cls"], r["n"]) for b in J._met_rows(batches, 85) for r in b.to_pylist()]
        assert sorted(got) == want and len(set(got)) == len(got)


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 40, rng.integers(20, 60))
        sets += [np.unique(np.concatenate([base[rng.random(len(base)) > 0.05], rng.integers(0, 1 << 40, 2)])) for _ in range(3)]
    bits = np.zeros((len(sets), J.BITS), np.uint8)
    for i, s in enumerate(sets):
        bits[i, s % J.BITS] = 1
    n = np.array([len(s) for s in sets])
    i, j = J.run_pairs(n, np.zeros(len(n), np.int64), np.arange(len(n)), np.packbits(bits, axis=1).view(np.uint64), 85)
    found = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    similar = {(a, b) for a in range(len(n)) for b in range(a + 1, len(n)) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert similar and similar <= found and len(found) < len(n) * 4


def test_one_chain_of_links(docs):
    words = [f"w{i}" for i in range(400)]
    t = [" ".join(words[i : i + 200]) for i in range(0, 200, 10)]  # neighbours are similar, others aren't
    assert {v[1] for v in result(J.jaccard_components(docs(t))).values()} == {0}


def test_empty_nulls_repeats(docs):
    assert J.jaccard_components(docs([])).count() == 0
    t = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (3, "A b c d e"), (4, None)]
    rows = sorted(((r.doc_id or -1), r.n_shingles, r.component_id) for r in J.jaccard_components(docs(t).withColumn("cls", F.lit(1))).collect())
    assert rows == [(-1, 2, None), (3, 2, 3), (4, 0, 4), (5, 2, 3), (5, 2, 3)]
