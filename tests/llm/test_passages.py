"""Repeated passages that begin and end in mid-sentence."""

import random

from ocutide.llm import substring_dedup as S


def words(rng, n, low, high, stops):
    """n words; clauses of low to high words, the first one already begun."""
    out, left = [], rng.randrange(1, high)
    for _ in range(n):
        left -= 1
        out.append(f"w{rng.randrange(4000)}" + ("" if left or not stops else rng.choice(stops)))
        left = left or rng.randrange(low, high + 1)
    return " ".join(out)


def corpus(n, stops, seed, count=150):
    rng = random.Random(seed)
    passages = [words(rng, n, 12, 22, stops) for _ in range(count)]
    around = lambda p: words(rng, rng.randrange(5, 40), 12, 22, stops) + " " + p + " " + words(rng, rng.randrange(5, 40), 12, 22, stops)
    return passages, [around(p) for _ in range(2) for p in passages]


def test_passages_in_mid_sentence(docs):
    for n, stops in ((51, ".,;"), (60, ".,;"), (51, ""), (60, "")):
        passages, t = corpus(n, stops, n)
        got = {r.doc_id: r for r in S.substring_dedup(docs(t)).collect()}
        k = len(passages)
        assert all(got[i].n_removed == 0 and got[i].text == t[i] for i in range(k))
        left = [len(got[k + i].text.split()) - (len(t[k + i].split()) - n) for i in range(k)]
        print(n, repr(stops), sum(x == n for x in left) / k, sum(left) / k)
        assert min(left) >= 0 and sum(x < n for x in left) >= 0.98 * k and sum(left) / k < 16


def test_repeated_words_are_cut(docs):
    rng = random.Random(3)
    for period in (["no"], ["no", "yes"], ["a", "b", "c"]):
        passage = " ".join(period * 60)
        t = [words(rng, 9, 12, 22, "") + " " + passage, words(rng, 30, 12, 22, "") + " " + passage + " " + words(rng, 30, 12, 22, "")]
        got = {r.doc_id: r for r in S.substring_dedup(docs(t)).collect()}
        assert len(got[1].text.split()) < 60 + 20


def test_whole_sentences_leave_nothing(docs):
    rng = random.Random(4)
    passage = "; ".join(words(rng, 4, 9, 9, "") for _ in range(13)) + "."
    t = [words(rng, 30, 12, 22, ".") + ". " + passage, words(rng, 21, 12, 22, ".") + ". " + passage + " " + words(rng, 21, 12, 22, ".")]
    got = {r.doc_id: r for r in S.substring_dedup(docs(t)).collect()}
    assert got[1].text == t[1].replace(passage + " ", "")
