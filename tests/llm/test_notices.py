"""Licence notices side by side and inside prose, against every window."""

import random

import pyarrow as pa

from ocutide.llm import license_scan as L
from ocutide.llm.textbatch import TextBatch

APACHE, MIT = L.TEMPLATES["Apache-2.0 notice"], L.TEMPLATES["MIT notice"]


def test_notices_in_one_line(docs):
    t = [f"{APACHE} {MIT}", "copies of the Software released under the MIT License", f"{MIT} " * 3, f"{APACHE} {L.TEMPLATES['ISC']} {MIT}", L.TEMPLATES["Apache-2.0 header"].replace("compliance", "accord"), "under the terms of the Software"]
    got = {r.doc_id: r for r in L.license_scan(docs(t)).collect()}
    assert (got[0].n_notices, got[0].licences, got[0].best_dice) == (2, "Apache-2.0 notice,MIT notice", 1.0)
    assert got[1].licences == "MIT notice" and got[1].spans == "MIT notice:23:53" and got[2].n_notices == 3
    assert got[3].licences == "Apache-2.0 notice,ISC,MIT notice" and got[4].licences == "Apache-2.0 header" and got[5].n_notices == 0


def test_against_every_window():
    rng = random.Random(9)
    names = ["Apache-2.0 notice", "CC-BY-NC-4.0 notice", "GPL-3.0 notice", "MIT notice", "ISC"]
    pool = [w for n in names for w in L.normal_words(L.TEMPLATES[n])]
    scanner = L.Scanner({n: L.TEMPLATES[n] for n in names}, L.THRESHOLD)
    texts = []
    for _ in range(60):
        words = [rng.choice(pool) for _ in range(rng.randrange(8))]
        for _ in range(rng.randrange(1, 3)):
            words += [w if rng.random() > 0.06 else rng.choice(["other", rng.choice(pool)]) for w in L.normal_words(L.TEMPLATES[rng.choice(names)])]
            words += [rng.choice(pool) for _ in range(rng.randrange(6))]
        texts.append(" ".join(words))
    found = scanner.scan(TextBatch(pa.array(texts)))
    some = 0
    for text, f in zip(texts, found, strict=True):
        w = text.split()
        grams = list(zip(w, w[1:], strict=False))
        for n in names:
            x = L.normal_words(L.TEMPLATES[n])
            goal = set(zip(x, x[1:], strict=False))
            best = max(L.dice(set(grams[i:j]), goal) for i in range(len(grams)) for j in range(i + 1, min(len(grams), i + 2 * len(goal)) + 1))
            if best >= L.THRESHOLD:
                some += 1
                assert max(score for score, _ in f.values()) >= best - 1e-9
    assert some > 40


def test_many_notices_take_time_in_proportion():
    import time

    def seconds(n):
        batch = TextBatch(pa.array(["\n".join(["words before it", APACHE, f"{MIT} and more of this kind"] * (n // 2))]))
        scanner = L.Scanner(L.TEMPLATES, L.THRESHOLD)
        start = time.perf_counter()
        found = L._outermost(scanner.scan(batch)[0])
        assert len(found) == n and {x[3] for x in found} == {"Apache-2.0 notice", "MIT notice"}
        return time.perf_counter() - start

    seconds(1000)
    few, many = seconds(2000), seconds(20_000)
    print("notices", few, many)
    assert many < 30 * few + 1


def test_full_texts_by_their_titles(docs):
    pages = {
        "GPL-2.0": "\t\t    GNU GENERAL PUBLIC LICENSE\n\t\t       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.\n" + L.TEMPLATES["GPL-2.0 header"],
        "GPL-3.0": "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Copyright (C) 2007\n" + L.TEMPLATES["GPL-3.0 header"],
        "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999\n\n Copyright (C) 1991, 1999\n" + L.TEMPLATES["LGPL-2.1 header"],
        "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE\n Version 3, 19 November 2007\n\n Copyright (C) 2007\n" + L.TEMPLATES["AGPL-3.0 header"],
        "MPL-1.1": "MOZILLA PUBLIC LICENSE\n Version 1.1\n ------\n1. Definitions.\n" + L.TEMPLATES["MPL-1.1 header"],
        "BSD-3": "All rights reserved.\n\n" + L.TEMPLATES["BSD-3-Clause"].replace("met: ", "met:\n1. ").replace("Redistributions in", "\n2. Redistributions in").replace("copyright holder nor", "University nor"),
        "GFDL-1.3": "GNU Free Documentation License\n Version 1.3, 3 November 2008\n\n0. PREAMBLE",
    }
    got = {r.doc_id: r for r in L.license_scan(docs(list(pages.values()))).collect()}
    for i, name in enumerate(pages):
        assert got[i].licences and all(x.startswith(name) for x in got[i].licences.split(",")), (name, got[i].licences)


def test_ties_repeats_clashes_and_nulls(docs, spark):
    from pyspark.sql import functions as F

    same = {"B": "one two three four", "A": "one two three four", "C": "nine ten eleven twelve"}
    t = [(1, "one two three four"), (1, "one two three four"), (None, "see nine ten eleven twelve"), (2, None), (3, "x " * 200_000 + "one two three four")]
    rows = sorted(L.license_scan(docs(t).withColumn("spans", F.lit(1)).withColumn("licences", F.lit("x")), same).collect(), key=repr)
    assert [(r.doc_id, r.licences) for r in rows] == [(1, "A"), (1, "A"), (2, ""), (3, "A"), (None, "C")]
    assert rows[3].spans == "A:400000:400018" and rows[4].spans == "C:4:26"
