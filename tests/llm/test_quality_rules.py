import math
import random

import public_tokenizers
import sentencepiece
from brute import SPACE_WORD, quality
from pyspark.sql import functions as F

from ocutide.llm import quality_rules as Q

MODEL, RANKS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def texts():
    rng = random.Random(3)
    words = ["the", "of", "ouen", "é", "##", "a|b", "日本", "\x85x", "Reing."]
    out = ["", None, " \n\t", "a\nb\na\n\na\n", "one two three four five six seven eight " * 3, "x" * 70_000]
    return out + ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t", "\x0b"]) for _ in range(rng.randrange(120))) for _ in range(60)]


def test_figures_match_plain_python(docs):
    t = texts()
    got = {r.doc_id: r for r in Q.quality_rules(docs(t), MODEL, RANKS).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, x in enumerate(t):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality(x), x
        assert r.n_tokens == sum(len(sp.encode(w)) for w in SPACE_WORD.findall(x or ""))
        assert not (r.base_failed and r.kept)


def plain_figures(text, sp, multi):
    """Tokens, the four measures, script and octave."""
    words = SPACE_WORD.findall(text or "")
    ids = [x for w in words for x in sp.encode(w)]
    other = sum(len(multi.encode_ordinary(" " + w)) for w in words)
    n, chars = len(ids), sum(map(len, words))
    counts = [ids.count(x) for x in set(ids)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    most = math.log2(max(n, 2))
    letters = {"latin": 0, "greek": 0, "cyrillic": 0, "near_east": 0, "south_asia": 0, "east_asia": 0, "other": 0}
    for c in text or "":
        lead = c.encode()[0]
        for name, lo, hi in Q.SCRIPTS:
            letters[name] += lo <= lead <= hi and (lead >= 0xC0 or c.isalpha())
    return n, (chars / max(n, 1), chars / max(other, 1), sum(sp.is_byte(x) for x in ids) / max(n, 1), entropy / most), max(letters, key=letters.get), int(most)


def plain_bands(rows):
    """(script, lang, octave) -> low and high of each measure, from (script, lang, octave, figures)."""
    out = {}
    for m, measure in enumerate(Q.MEASURES):
        grid = lambda v, step=measure.step: math.floor(v / step + 0.5)  # noqa: E731  the values are none below zero
        fences = {(): (measure.low, measure.high)}
        for depth in (1, 2, 3):
            for key in {r[:depth] for r in rows}:
                bins = sorted(grid(r[3][m]) for r in rows if r[:depth] == key)
                a, b = (next(x for i, x in enumerate(bins, 1) if 4 * i >= k * len(bins)) for k in (1, 3))
                reach = Q.REACH * max((b - a) * measure.step, measure.spread)
                n = len(bins)
                own = a * measure.step - reach, b * measure.step + reach
                fences[key] = tuple((n * x + Q.PRIOR * y) / (n + Q.PRIOR) for x, y in zip(own, fences[key[:-1]], strict=True))
        out[m] = fences
    return {r[:3]: [out[m][r[:3]] for m in range(len(Q.MEASURES))] for r in rows}


def languages(rng):
    """Rows (text, lang) of invented languages, a rare one among them, and junk of several kinds with what should reject it."""
    prose = {
        "en": ["the", "house", "stands", "with", "water", "people", "often", "speak", "about", "morning", "little", "river", "green"],
        "el": ["και", "το", "σπίτι", "νερό", "άνθρωπος", "λέει", "πρωί", "ποτάμι", "πράσινο", "μικρό", "θάλασσα"],
        "ru": ["дом", "вода", "человек", "говорит", "утро", "река", "зелёный", "маленький", "и", "в", "на"],
        None: ["und", "das", "haus", "wasser", "mensch", "spricht", "morgen", "fluss", "klein"],
    }
    rows = []
    for lang, words in prose.items():
        for _ in range(160 if lang else 12):
            rows.append((" ".join(rng.choice(words) + (f"{rng.randrange(90)}" if rng.random() < 0.1 else "") + rng.choice(["", "", ","]) for _ in range(rng.randrange(40, 160))), lang, None))
    letters = lambda k: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(k))
    for _ in range(5):
        rows.append((" ".join(letters(9).upper() + "!!" for _ in range(60)), "en", "chars_per_token"))
        rows.append((" ".join(rng.choice(["the", "house", "water", "people"]) + rng.choice("\U00010330\U00010331\U00010332") for _ in range(60)), "en", "fallback_share"))
    return rows


def test_figures_bands_and_verdicts_match_plain_python(docs, spark):
    rng = random.Random(12)
    rows = languages(rng)
    sp, multi = sentencepiece.SentencePieceProcessor(model_file=MODEL), Q.Segmenter(MODEL, RANKS).multi
    table = spark.createDataFrame([(i, t, lang) for i, (t, lang, _) in enumerate(rows)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in Q.quality_rules(table, MODEL, RANKS).collect()}
    figures = [plain_figures(t, sp, multi) for t, _, _ in rows]
    failed = [quality(t)[-1] for t, _, _ in rows]
    bands = plain_bands([(f[2], lang, f[3], f[1]) for f, bad, (_, lang, _) in zip(figures, failed, rows, strict=True) if not bad])
    outside = {}
    for i, ((t, lang, planted), (n, values, script, octave), bad) in enumerate(zip(rows, figures, failed, strict=True)):
        r = got[i]
        assert (r.n_tokens, r.script, r.octave, r.base_failed) == (n, script, octave, bad), t
        for m, v in zip(Q.MEASURES, values, strict=True):
            assert abs(r[m.name] - v) < 1e-9
        if bad:
            assert r.outside is None and not r.kept
            continue
        want = [m.name for m, v, (lo, hi) in zip(Q.MEASURES, values, bands[script, lang, octave], strict=True) if v < lo or v > hi]
        assert r.outside == ",".join(want) and r.kept == (not want), (t, want, r)
        if planted:
            outside.setdefault(planted, []).append(want)
        else:
            assert not want, (t, lang, values)
    assert all("chars_per_token" in w for w in outside["chars_per_token"])
    assert all("fallback_share" in w for w in outside["fallback_share"])


def test_low_entropy_goes_at_any_length(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(6)) for _ in range(900)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([30, 60, 200]))), "en") for i in range(600)]
    # no 8-word window repeats, but hardly anything new is said
    rows += [(1000 + k, " ".join(rng.choice(words[:4]) for _ in range(n)), "en") for k, n in enumerate((30, 60, 200))]
    got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), MODEL, RANKS).collect()}
    assert all(got[i].kept for i in range(600))
    assert all("evenness" in got[k].outside for k in (1000, 1001, 1002) if not got[k].base_failed) and not got[1000].base_failed


def test_small_cache_gives_the_same(docs, monkeypatch):
    t = texts()[5:20]
    whole = Q.quality_rules(docs(t), MODEL, RANKS).collect()
    import pyarrow as pa

    monkeypatch.setattr(Q, "CACHE_WORDS", 3)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(t))), "text": t, "lang": ["en"] * len(t)})
    rows = [r for b in Q._scored([batch], MODEL, RANKS) for r in b.to_pylist()]
    assert {r["doc_id"]: (r["figures"]["evenness"], r["figures"]["chars_per_token_multi"]) for r in rows} == {r.doc_id: (r.evenness, r.chars_per_token_multi) for r in whole}


def test_empty_table_and_extra_columns(docs):
    assert Q.quality_rules(docs([]), MODEL, RANKS).count() == 0
    odd = docs([(None, "x y"), (3, None), (3, None)]).withColumn("kept", F.lit(1)).withColumn("lang", F.lit(None).cast("string"))
    assert Q.quality_rules(odd, MODEL, RANKS).where("kept").count() == 0
    assert Q.keep_good(odd, MODEL, RANKS).columns == odd.columns
