import random

import public_tokenizers
from tokenizers import Tokenizer

from ocutide.llm import token_counts as C

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_same_as_the_library(docs):
    rng = random.Random(5)
    letters = "aab tthe  \n\r\t\x0b\x1c\x85\xa0　'sllvéñ日本語😀٣12#$%'re<|endoftext|>ßΏ​"
    t = ["", None, "a" * 5000, "ab" * 3000, "<|endoftext|>x<|endoftext|>", "can't  we'll\n\n go"]
    t += ["".join(rng.choice(letters) for _ in range(rng.randrange(90))) for _ in range(400)]
    tk = Tokenizer.from_file(PATH)
    for r in C.token_counts(docs(t), PATH).collect():
        x = t[r.doc_id] or ""
        n = len(tk.encode(x, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(x.encode()), n, n > 1024), x


def test_small_table_gives_the_same(monkeypatch):
    monkeypatch.setattr(C, "CACHE", 5)
    monkeypatch.setattr(C, "BLOCK", 10)
    t = ["the quick brown fox jumps over the lazy dog " * 5, "x" * 100, "", "a b c d e f g h i j k l m n"]
    tk = Tokenizer.from_file(PATH)
    assert C.Merger(PATH).batch(t) == [len(tk.encode(x, add_special_tokens=False).ids) for x in t]


def test_empty_table_and_repeats(docs):
    assert C.token_counts(docs([]), PATH).count() == 0
    assert C.token_counts(docs([(1, "a b"), (1, "a b"), (None, None)]), PATH).count() == 3
