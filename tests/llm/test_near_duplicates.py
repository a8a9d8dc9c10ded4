"""The pipeline's stage of near duplicates at five words and 80 percent."""

import random

import corpus_pipeline as C
from brute import components, shingles


def test_near_copies_go(spark, docs, tmp_path):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(5000)}" for _ in range(100)] for _ in range(4)]
    replaced = [*base[0][:30], "new", *base[0][31:60], "other", *base[0][61:]]
    longer = base[1] + [f"x{i}" for i in range(20)]
    apart = base[2] + [f"y{i}" for i in range(30)]
    t = [" ".join(x) for x in (*base, replaced, longer, apart)]
    similar = lambda a, b, k: len(shingles(t[a], k) & shingles(t[b], k)) / len(shingles(t[a], k) | shingles(t[b], k))
    assert similar(0, 4, 4) < 0.85 and similar(0, 4, 5) >= 0.8 and similar(1, 5, 4) < 0.85 and similar(1, 5, 5) >= 0.8 and similar(2, 6, 5) < 0.8
    got = {r.doc_id for r in C.one_of_each_group(spark, docs(t), str(tmp_path)).collect()}
    assert got == {0, 1, 2, 3, 6} == {c for _, c in components(list(enumerate(t)), 5, 80).values()}
