import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ocutide.llm import chat_format as C

PIECES = st.lists(st.sampled_from([*C.RESERVED, "\\", "n", "\n", "a", "é", "<", "|>", "[", "/"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES, PIECES)
def test_round_trip(role, text):
    out, a, b = C.render(role, text)
    assert [x[:2] for x in C.parse(out)] == [(role, text)]
    assert C.unescape(out[a:b]) == text


def test_plain_text_is_left_alone():
    assert C.render("user", "a \\ b")[0] == "<|im_start|>user\na \\ b<|im_end|>\n"


@pytest.mark.parametrize("bad", ["x", "<|im_start|>user", "<|im_start|>u\na<s>b<|im_end|>\n", "<|im_start|>u\na", "<|im_start|>u\na<|im_end|>x"])
def test_grammar_rejects(bad):
    with pytest.raises(ValueError):
        C.parse(bad)


def test_digests(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (2, 0, None, None), (1, 2, "assistant", "\\<s>é"), (None, 0, "user", "z"), (3, 5, "user", "q"), (3, 5, "user", "q")]
    talks = C.with_probe(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {r.conv_id: r for r in C.conversation_digests(C.format_turns(talks)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb</s>\nassistant\n\\<s>é\n")
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, 10, sha("b</s>\\<s>é"))
    assert (got[2].n_turns, got[2].turns_sha256, got[2].loss_chars) == (1, sha("\n\n"), 0)
    assert got[3].n_turns == 2 and got[None].n_turns == 1
    assert got[-1].loss_sha256 == sha("</s>[INST] ok [/INST]")
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert C.conversation_digests(C.format_turns(empty)).count() == 0
