"""Queries over whole tables, on all keys, epochs and vectors."""

import math
import random

import __spark_entry__ as entry
from ocutide.functions import wavelet
from ocutide.plans.oracle import FRAMES


def run(spark, name, folder):
    return entry.queries()[name](spark, str(folder)).collect()


def lines(spark, folder):
    rng = random.Random(5)
    rows = [(k, float(rng.randrange(1, 9)), float(rng.randrange(1, 7)), rng.randrange(5) / 100) for k in (3, 40, 41, 900, 10**6) for _ in range(rng.randrange(12, 30))]
    rows.append((77, 1.0, 2.0, 0.0))
    spark.createDataFrame(rows, "l_partkey bigint, l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{folder}/lineitem.parquet")
    found = {}
    for k, a, b, c in rows:
        found.setdefault(k, []).append((a, b, c))
    return found


def same(got, want):
    return got is None and want is None or abs(got - want) < 2e-6


def pearson(pairs):
    n = len(pairs)
    if n < 2:
        return None
    ma, mb = (sum(p[i] for p in pairs) / n for i in (0, 1))
    return sum((a - ma) * (b - mb) for a, b in pairs) / math.sqrt(sum((a - ma) ** 2 for a, _ in pairs) * sum((b - mb) ** 2 for _, b in pairs))


def kendall(pairs):
    sign = lambda v: (v > 0) - (v < 0)
    every = [(sign(a - c), sign(b - d)) for i, (a, b) in enumerate(pairs) for c, d in pairs[:i]]
    both = math.sqrt(sum(x * x for x, _ in every) * sum(y * y for _, y in every))
    return sum(x * y for x, y in every) / both if both else None


def test_correlations_of_every_key(spark, tmp_path):
    rows = lines(spark, tmp_path)
    for name, column, plain in (("F2_pearson", 1, pearson), ("F2_kendall", 2, kendall)):
        got = {r.k: r for r in run(spark, name, tmp_path)}
        assert set(got) == set(rows)
        for k, v in rows.items():
            assert got[k].n == len(v) and same(got[k].r, plain([(x[0], x[column]) for x in v]))


def plain_energies(x):
    """Detail energies, finest first, of the levels that the length allows."""
    levels, out = min(int(math.log2(len(x) / (wavelet.TAPS - 1))), wavelet.MAX_LEVEL), []
    for _ in range(levels):
        n = len(x)
        at = lambda m, x=x, n=n: x[m % (2 * n)] if m % (2 * n) < n else x[2 * n - 1 - m % (2 * n)]
        low, high = ([sum(t * at(2 * k + 1 - j) for j, t in enumerate(taps)) for k in range((n + wavelet.TAPS - 1) // 2)] for taps in (wavelet.DEC_LO, wavelet.DEC_HI))
        out.append(sum(v * v for v in high))
        x = low
    return out


def test_wavelet_energies_of_every_vector(spark, tmp_path):
    rng = random.Random(6)
    vectors = {i: [rng.gauss(0, 1) for _ in range(64)] for i in (0, 39, 40, 500)}
    spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in run(spark, "G11_wavelet_energy", tmp_path)}
    assert set(got) == set(vectors)
    for i, x in vectors.items():
        assert len(plain_energies(x)) == 3 and got[i].detail_energy_L4 is None
        for level, want in enumerate(plain_energies(x), 1):
            assert abs(got[i][f"detail_energy_L{level}"] - want) < 1e-4


def test_every_epoch(spark, tmp_path):
    peaks = [130, 430, 730, 1530, 2830]
    value = lambda i: 10.0 + (200.0 if any(p <= i < p + 20 for p in peaks) else 0.0)
    rows = [(i, "click", value(i)) for i in range(3000)]
    spark.createDataFrame(rows, "event_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    want = [p // FRAMES for p in peaks]
    assert sorted(r.epoch_id for r in run(spark, "F21_group_by_epoch", tmp_path)) == want
    assert sorted(r.seg_id for r in run(spark, "C10_segment_rows", tmp_path)) == want
    assert sorted(r.place for r in run(spark, "C9_remap", tmp_path)) == want
    assert sorted(r.start_blink // FRAMES for r in run(spark, "D3_find_blinks_epoch", tmp_path)) == want
