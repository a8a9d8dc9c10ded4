import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocutide.llm import license_scan as L
from ocutide.llm import mixing as M
from ocutide.llm import substring_dedup as S
from ocutide.llm import toxicity as T
from ocutide.llm.components import components

PASSAGE = " ".join(f"Sentence number {i} of the shared passage goes here." for i in range(8))


def test_repeated_passages_go_once(docs):
    own = lambda k: " ".join(f"Own text {k} part {i} is not anywhere else." for i in range(6))
    t = [own(0) + " " + PASSAGE, own(1), "Mid way " + PASSAGE.lower() + " " + own(2), PASSAGE + "\n" + own(3) + "\n" + PASSAGE, "", None, "No. No. No. Yes."]
    got = {r.doc_id: r for r in S.substring_dedup(docs(t)).collect()}
    assert got[0].n_removed == 0 and got[0].text == t[0]
    assert got[1].text == t[1] and got[5].text is None and got[4].text == "" and got[6].text == t[6]
    assert "number 4" not in got[2].text and own(2) in got[2].text
    assert got[3].n_removed == 16 and got[3].text == own(3)


def test_repeats_within_one_text(docs):
    t = [PASSAGE + " " + PASSAGE]
    r = S.substring_dedup(docs(t)).first()
    assert (r.n_sentences, r.n_removed) == (16, 8)


def plain_pieces(text, rank):
    """Sentences of a text, each as pieces of words; ``rank``: the order of words at which they are cut."""
    out, cur = [], ""
    for i, c in enumerate(text):
        cur += c
        if c == "\n" or c in ".!?" and i + 1 < len(text) and text[i + 1] in " \t\n\x0b\x0c\r" or i + 1 == len(text):
            if cur.split():
                out.append(cur.lower().split())
            cur = ""
    words = [w for s in out for w in s]
    cut = [all(rank[w] <= rank[v] for v in words[max(i - S.NEAR, 0) : i + S.NEAR + 1]) for i, w in enumerate(words)]
    at, pieces = 0, []
    for k, s in enumerate(out):
        for i, w in enumerate(s):
            if i == 0 or cut[at + i]:
                pieces.append((k, []))
            pieces[-1][1].append(w)
        at += len(s)
    return len(out), pieces


def plain_runs(pieces):
    """Ranges of pieces."""
    m, size = len(pieces), lambda i, j: sum(len(p) for _, p in pieces[i:j])
    fits = lambda i, j: j - i >= S.RUN and size(i, j) >= S.MIN_WORDS
    found = []
    for i in range(m):
        end = next((j for j in range(i + 1, m + 1) if fits(i, j)), None)
        if end:
            found.append((i, end))
    for j in range(1, m + 1):
        if j == m or pieces[j][0] != pieces[j - 1][0]:
            begin = next((i for i in range(j - 1, -1, -1) if fits(i, j)), None)
            if begin is not None:
                found.append((begin, j))
    return sorted(set(found)) or ([(0, m)] if m else [])


@pytest.mark.parametrize("longest", [6, 40])
def test_repeats_against_plain_python(docs, longest):
    import pyarrow as pa

    from ocutide.llm.textbatch import TextBatch

    rng = random.Random(longest)
    words = ["alpha", "beta", "gamma", "delta"] if longest < 10 else [f"w{i}" for i in range(60)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, longest)))
    pool = [sentence() for _ in range(12)]
    end = lambda: rng.choice([".", "!", ",", ".\n", ";"])
    t = [" ".join((rng.choice(pool) if rng.random() < 0.5 else sentence()) + end() for _ in range(rng.randrange(25 if longest < 10 else 12))) for _ in range(60)]
    t = [x + (" " + " ".join(p + "." for p in pool) if rng.random() < 0.4 else "") for x in t]
    spelled = sorted({w for x in t for w in x.lower().split()})
    b = TextBatch(pa.array([" ".join(spelled)]))
    b.words(lower=True)
    rank = dict(zip(spelled, b.hash.tolist(), strict=True))
    first, want = {}, []
    for d, x in enumerate(t):
        n, pieces = plain_pieces(x, rank)
        gone = set()
        for i, j in plain_runs(pieces):
            run = tuple(w for _, p in pieces[i:j] for w in p)
            if first.setdefault(run, (d, i)) != (d, i):
                gone |= set(range(i, j))
        # stretches of a few words of a sentence that keeps others stay
        for k in range(n):
            own = [i for i, p in enumerate(pieces) if p[0] == k]
            stretch = []
            for i in [*own, None]:
                if i in gone:
                    stretch.append(i)
                    continue
                if stretch and len(stretch) < len(own) and sum(len(pieces[q][1]) for q in stretch) <= S.NEAR:
                    gone -= set(stretch)
                stretch = []
        want.append((n, len({pieces[i][0] for i in gone}), [w for i, (_, p) in enumerate(pieces) if i not in gone for w in p]))
    got = S.substring_dedup(docs(t)).orderBy("doc_id").collect()
    assert [(r.n_sentences, r.n_removed, r.text.lower().split()) for r in got] == want
    assert sum(w[1] > 0 for w in want) > 10


def test_short_texts_are_searched(docs):
    two = "This sentence has eleven words in it, as you can see. And so does this one, which has eleven words too."
    six = "Red is one. Blue is two. Green is six. Grey is ten. Pink is out. Teal is in."
    t = [two] * 5 + [six] * 3 + ["no " * 200] * 3 + ["Unique."]
    got = {r.doc_id: r for r in S.substring_dedup(docs(t)).collect()}
    assert [got[i].n_removed > 0 and not got[i].text for i in range(11)] == [i not in (0, 5, 8) for i in range(11)]
    assert [got[i].n_removed for i in (0, 5, 11)] == [0, 0, 0]
    assert len(got[8].text.split()) < 30  # its own repeats go as well


def test_dedup_empty_and_repeated_rows(docs):
    assert S.substring_dedup(docs([])).count() == 0
    rows = S.substring_dedup(docs([(1, PASSAGE), (1, PASSAGE), (2, PASSAGE), (None, PASSAGE)]).withColumn("run", F.lit(1))).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (1, 0), (1, 0), (2, 8)]


def test_licences(docs):
    mit = L.TEMPLATES["MIT"]
    t = ["text before\nLicensed under the Apache License, Version 2.0.\nafter", "we say licensed under CC BY-NC 4.0. Then more words follow here in one line", mit.replace("person", "people"), "nothing of it", "", None, "Released UNDER the mit license"]
    got = {r.doc_id: r for r in L.license_scan(docs(t)).collect()}
    assert got[0].spans == "Apache-2.0 notice:12:58" and got[0].best_dice == 1.0
    assert got[1].licences == "CC-BY-NC-4.0 notice" and got[2].licences == "MIT" and got[2].best_dice < 1
    assert [got[i].n_notices for i in (3, 4, 5)] == [0, 0, 0] and got[6].licences == "MIT notice"
    assert L.license_scan(docs([])).count() == 0


def test_licence_pruning_changes_nothing():
    import pyarrow as pa

    from ocutide.llm.textbatch import TextBatch

    rng = random.Random(4)
    pool = [w for x in L.TEMPLATES.values() for w in x.split()]
    texts = []
    for _ in range(150):
        x = rng.choice(list(L.TEMPLATES.values())).split()
        texts.append("\n".join(" ".join(rng.choice(pool) if rng.random() < 0.08 else w for w in x * rng.choice([1, 1, 2])) for _ in range(2)))
    s = L.Scanner(L.TEMPLATES, L.THRESHOLD)
    batch = TextBatch(pa.array(texts))
    for text, f, at in zip(texts, s.scan(batch), batch.offsets, strict=False):
        for line in text.split("\n"):
            words = L.normal_words(line)
            bigrams = set(zip(words, words[1:], strict=False))
            best = max(L.dice(bigrams, set(zip(w, w[1:], strict=False))) for w in map(L.normal_words, L.TEMPLATES.values()))
            got = max((v[0] for k, v in f.items() if text.encode()[k[0] - at : k[1] - at].decode() in line), default=0)
            assert (best >= L.THRESHOLD) <= (got >= best - 1e-9)


def test_mix_reaches_its_targets(docs, spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randrange(1, 900), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c"]), 0) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = M.mix(table).toPandas()
    out["w"] = out.weight * out.n_tokens
    for d in M.DIMS:
        natural = out.groupby(d).n_tokens.sum().astype(float) ** M.POWERS[d]
        share = out.groupby(d).w.sum() / out.w.sum()
        assert np.allclose(share[natural.index], natural / natural.sum(), atol=0.002)
    drawn = (out.copies * out.n_tokens).sum()
    assert abs(drawn / out.w.sum() - 1) < 0.1 and set(out.lang) >= {"(none)"}


def test_mix_of_odd_tables(docs):
    assert M.mix(docs([])).count() == 0
    rows = M.mix(docs([(1, None), (1, None), (None, ""), (2, "a b")]).withColumn("weight", F.lit(9)).withColumn("topic", F.lit("x"))).collect()
    assert len(rows) == 4 and {r.weight for r in rows} == {1.0}


def test_toxicity_learns_words_it_was_not_told(docs, spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(700):
        bad = rng.random() < 0.3
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 60))]
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "grukly", "Grukly!", "moron"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(9000, ""), (9001, None)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = T.toxicity(docs(rows), table).join(table, "doc_id", "left").toPandas()
    test = got[got.held_out & got.toxic.notna()]
    assert len(test) > 150 and (test.predicted == test.toxic).mean() > 0.98
    assert got.score.between(0, 1).all() and got[got.doc_id >= 9000].predicted.sum() == 0


def test_clean_words_vote_as_well(docs, spark):
    rng = random.Random(9)
    rows = [(i, " ".join([f"w{rng.randrange(400)}" for _ in range(20)] + (["kindly"] if i % 3 else ["grukly"]))) for i in range(600)]
    known = [(float(i % 3 == 0), t) for i, t in rows]
    import pyarrow as pa

    from ocutide.llm.textbatch import TextBatch

    def words(t):
        h, _ = T.features(TextBatch(pa.array([t])))
        return sorted({int(x) for x in h.view(np.int64)})

    table = spark.createDataFrame([(y, words(t)) for y, t in known], "y double, words array<bigint>")
    key = lambda w: np.uint64(T.word_key(w))
    assert key("kindly") in T.choose(table, 15, 8.0, 2.0, 0, -1) and key("grukly") not in T.choose(table, 15, 8.0, 2.0, 0, -1)
    assert key("grukly") in T.choose(table, 15, 4.0, 2.0, 3, 1)


def plain_label_model(patterns, a, b, none, prior):
    """Expectation maximisation over (set of voters, number of texts), voter by voter."""
    m, a0, b0 = len(a), list(a), list(b)
    w = [math.log(x / y) for x, y in zip(a, b, strict=True)]
    for _ in range(T.EM_ROUNDS):
        post = []
        for votes, n in patterns:
            z = math.log(prior / (1 - prior)) + (sum(w[j] for j in votes) if votes else math.log(none[0] / none[1]))
            post.append((votes, n, n / (1 + math.exp(-max(min(z, 30), -30)))))
        t, n = sum(x[2] for x in post), sum(x[1] for x in post)
        fired = lambda *js: sum(x[2] for x in post if set(js) <= x[0])
        raw = [(fired(j) + 0.1) / (t + 1) for j in range(m)]
        clean = [(sum(x[1] - x[2] for x in post if j in x[0]) + 0.1) / (n - t + 10) for j in range(m)]
        new_a, new_b = ([math.sqrt(x * y) for x, y in zip(p, q, strict=True)] for p, q in ((a0, raw), (b0, clean)))
        t0, n0 = sum(x[2] for x in post if not x[0]), sum(x[1] for x in post if not x[0])
        none = [(t0 + 0.5) / (t + 1), (n0 - t0 + 0.5) / (n - t + 1)]
        prior = min(max((t + 1) / (n + 2), 1e-4), 0.5)
        new = []
        for j in range(m):
            twins = 0.0
            for k in range(m):
                rho = (fired(j, k) / t - raw[j] * raw[k]) / math.sqrt(raw[j] * (1 - raw[j]) * raw[k] * (1 - raw[k]))
                twins += min(rho, 1) if k != j and rho > 0.6 else 0
            new.append(math.log(new_a[j] / new_b[j]) / (1 + twins))
        moved, w = max(abs(x - y) for x, y in zip(w, new, strict=True)), new
        if moved < T.TOLERANCE:
            break
    base = math.log(prior / (1 - prior))
    return w, base + math.log(none[0] / none[1]), base


def test_label_model_against_plain_python(spark):
    rng = random.Random(5)
    counts = {}
    for _ in range(4000):
        toxic = rng.random() < 0.15
        first = rng.random() < (0.5 if toxic else 0.01)
        votes = {0, 1} if first else set()  # twins
        votes |= {j for j in (2, 3) if rng.random() < (0.4 if toxic else 0.02)} | ({4} if rng.random() < (0.02 if toxic else 0.6) else set())
        counts[frozenset(votes)] = counts.get(frozenset(votes), 0) + 1
    a, b, none, prior = np.array([0.4, 0.4, 0.3, 0.3, 0.05]), np.array([0.02, 0.02, 0.05, 0.05, 0.5]), np.array([0.2, 0.4]), 0.2
    table = spark.createDataFrame([(sum(1 << j for j in v), n) for v, n in counts.items()], "votes bigint, n bigint")
    w, idle, base = T.fit_label_model(table, a, b, none, prior)
    want = plain_label_model(list(counts.items()), a, b, none, prior)
    assert np.allclose(w, want[0]) and abs(idle - want[1]) < 1e-9 and abs(base - want[2]) < 1e-9
    assert w[4] < 0 < w[2] and w[0] < w[2]  # twins share a voice


def test_toxicity_of_repeated_rows(docs, spark):
    rows = [(i, f"you are a {'moron' if i % 4 == 0 else 'friend'} w{i}") for i in range(60)] * 2 + [(4, "another text")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)] + [(4, 1, 0), (5, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = T.toxicity(docs(rows), labels).collect()
    assert len(got) == len(rows)
    scores = {}
    for r in got:
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(v) == (2 if k == 4 else 1) for k, v in scores.items())


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, None)]])
def test_toxicity_without_labels_uses_the_lexicon(docs, spark, labels):
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert T.toxicity(docs([]), table).count() == 0
    assert T.toxicity(docs(["a", None]).withColumn("score", F.lit("x")), table).count() == 2


@pytest.mark.parametrize("rows", [200_000, 100])
def test_components(spark, monkeypatch, rows):
    monkeypatch.setattr("ocutide.llm.components.ROWS", rows)
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(1900, 1990)]
    label = {}

    def top(i):
        while label.setdefault(i, i) != i:
            i = label[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        label[y] = x
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: top(i) for i in label if top(i) != i or any(top(j) == i and j != i for j in label)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
