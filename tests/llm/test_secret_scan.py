import math

import pytest
from brute import base_secrets
from pyspark.sql import functions as F

from ocutide.llm import secret_scan as S

TEXTS = [
    "", None, "nothing here", 'password = "abcdefghijkl" and token: short', "TOKEN=abc_token: abcdefghijklmnop",
    "AKIAABCDEFGHIJKLMN x AKIAAKIA AKIAABCDEFGHIJKLM", "0123456789abcdef0 deadbeefdeadbeef 123", "é😀 secret='0641917ea4e9feb9cda83477b57ac2654884f485' é",
    "api_key=ApiKey=aaaaaaaaaaaaaaa passwd:bbbbbbbbbbbbbbbb" * 3, "x" * 200_000 + " apikey: 9f8e7d6c5b4a39281706f5e4d3c2b1a0",
    "key Zx9Kq2Lm8Pw4Rt6Yv1Bn3 end", "example_Zx9Kq2Lm8Pw4Rt6Yv1Bn3", "12345678901234567890123", "A1B2C3D4E5F60718293A4B5C6D7E8F90",
]


def test_base_spans(docs):
    got = {r.doc_id: r for r in S.secret_digests(S.secret_scan(docs(TEXTS))).collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256) == base_secrets(t), t


def test_entropy_spans(docs):
    got = {r.doc_id: r.spans for r in S.secret_digests(S.secret_scan(docs(TEXTS))).collect()}
    assert got[10] == "entropy_base64:4:25"  # no known format
    assert got[11] == got[12][:0] == ""  # allowed
    assert got[12] == "hex:0:23"
    assert got[13] == "entropy_hex:0:32"


@pytest.mark.parametrize("text", ["0123abcd9876fedc55", "aaaaaaaaaaaaaaaaaaaaaaa", "Zx9Kq2Lm8Pw4Rt6Yv1Bn3Zx9Zx9Zx9Zx9aaaa", "a1" * 30])
def test_incremental_entropy(spark, text):
    for c in S.CLASSES:
        if len(text) < c.window or set(text) - set(c.alphabet):
            continue
        got = spark.range(1).select(S.lowest_window_sum(F.lit(text), c)).first()[0]
        best = min(sum(round(text[i : i + c.window].count(x) * math.log2(text[i : i + c.window].count(x)) * S.SCALE) for x in set(text[i : i + c.window])) for i in range(len(text) - c.window + 1))
        assert got == best


def test_redaction(docs):
    out = {r.doc_id: r for r in S.redact(docs(TEXTS)).collect()}
    assert out[2].text == "nothing here" and out[0].text == "" and out[1].text is None
    assert out[7].text == "é😀 [SECRET]' é" and out[7].n_chars == len(out[7].text)
    assert out[5].text == "[SECRET] x AKIAAKIA AKIAABCDEFGHIJKLM"
    assert all(base_secrets(r.text)[:3] == (0, 0, 0) for r in out.values())


def test_empty_table_repeats_and_clashes(docs):
    assert S.secret_digests(S.secret_scan(docs([]))).count() == 0
    same = docs([(1, TEXTS[6]), (1, TEXTS[6]), (None, None)]).withColumn("kind", F.lit("x")).withColumn("row_id", F.lit(0))
    rows = S.secret_digests(S.secret_scan(same)).collect()
    assert sorted((r.doc_id or 0, r.n_hex) for r in rows) == [(0, 0), (1, 2), (1, 2)]
