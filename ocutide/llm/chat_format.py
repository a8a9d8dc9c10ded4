"""Chat formatting with a grammar round trip.

Turns are rendered under a small grammar, parsed again by a deterministic parser
and compared with their source.  A turn that does not come back unchanged (it
holds a reserved string, or a backslash in a place where the parser would read
it) is escaped and rendered again, until both agree.

    turn  := "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"

Inside role and text a backslash before a backslash, before a reserved string or
(role only) before "n" is an escape; any other backslash is plain.  A bare
reserved string is an error.

Rows come out per turn and in order within a partition, one conversation in one
partition, and are streamed: memory does not follow the length of a conversation.
Null role or text: empty.  Null conv_id: one conversation of its own.  Ties of
turn are ordered by role, then text; repeated rows are repeated turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates (fixed values); none is a part of another.
RESERVED = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ANY = "|".join(map(re.escape, RESERVED))
_ESCAPED = re.compile(rf"\\(\\|{_ANY})")
_BODY = re.compile(rf"\\(?:\\|{_ANY})|({_ANY})")
_CONTROL = re.compile(_ANY)

TURN = "conv_id bigint, formatted string, loss_from bigint, loss_to bigint"


def escape(text: str, line: bool = False) -> str:
    """Escape every backslash and reserved string (and, in a line, every newline)."""
    out = _CONTROL.sub(lambda m: "\\" + m.group(), text.replace("\\", "\\\\"))
    return out.replace("\n", "\\n") if line else out


def unescape(text: str, line: bool = False) -> str:
    if line:
        return re.sub(rf"\\(\\|n|{_ANY})", lambda m: "\n" if m.group(1) == "n" else m.group(1), text)
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and the place of the still escaped text of each turn; ValueError where the grammar doesn't hold."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        line = formatted.find("\n", at)
        if line < 0:
            raise ValueError(f"no end of the role at {at}")
        role = formatted[at + len(START) : line]
        if any(m.group(1) for m in _BODY.finditer(role)):
            raise ValueError(f"reserved string in the role at {at}")
        end = next((m for m in _BODY.finditer(formatted, line + 1) if m.group(1)), None)
        if end is None or end.group(1) != END or formatted[end.end() : end.end() + 1] != "\n":
            raise ValueError(f"turn at {at} isn't closed")
        out.append((unescape(role, True), unescape(formatted[line + 1 : end.start()]), line + 1, end.start()))
        at = end.end() + 1
    return out


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn as formatted text, and the place of its text, escaped as far as the round trip needs it."""
    for body in (text, escape(text)):
        for head in (role, escape(role, True)):
            out = f"{START}{head}\n{body}{END}\n"
            try:
                turns = parse(out)
            except ValueError:
                continue
            if [x[:2] for x in turns] == [(role, text)]:
                return out, *turns[0][2:]
    raise AssertionError("an escaped turn always comes back")


def _rendered(batches: Iterable[pa.RecordBatch], trained: frozenset[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [render(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        learn = [(r or "") in trained for r in batch.column("role").to_pylist()]
        cols = [[x[0] for x in rows], *([x[i] if use else None for x, use in zip(rows, learn, strict=True)] for i in (1, 2))]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id").cast(pa.int64()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["conv_id", "formatted", "loss_from", "loss_to"])


def format_turns(conversations: DataFrame, trained: Iterable[str] = ("assistant",)) -> DataFrame:
    """Formatted turns in order, with the code points under the loss mask (null: none) of each.

    ``conversations``: conv_id, turn, role, text.  Concatenating ``formatted`` of a
    conversation gives its whole text.
    """
    ordered = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    roles = frozenset(trained)
    return ordered.mapInArrow(lambda it: _rendered(it, roles), TURN)


def _read_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    open_, state, done = False, None, []

    def close() -> tuple:
        key, n, turns, chars, loss, size = state
        return key, n, turns.hexdigest(), chars, loss.hexdigest(), size

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)
        done.clear()
        return out

    for batch in batches:
        for key, text, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if not open_ or state[0] != key:
                if open_:
                    done.append(close())
                open_, state = True, [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said, _, _ in parse(text):
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            if a is not None:
                learned = unescape(text[a:b])
                state[3] += len(learned)
                state[4].update(learned.encode("utf-8", "surrogatepass"))
            state[5] += len(text)
        if done:
            yield flush()
    if open_:
        done.append(close())
        yield flush()


def conversation_digests(turns: DataFrame) -> DataFrame:
    """What formatted turns of ``format_turns`` say when read back, one row per conversation."""
    return turns.mapInArrow(_read_back, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table with conversation -1, two turns that consist of another template's control strings."""
    probe = conversations.sparkSession.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(probe)


def _sql() -> str:
    reserved = "|".join("".join("\\" + c if c in "[]|<>/" else c for c in x) for x in RESERVED)
    body = "replace(text, '\\', '\\\\')"
    for x in RESERVED:
        body = f"replace({body}, '{x}', '\\{x}')"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (
  SELECT *, CASE WHEN regexp_matches(text, '{reserved}') OR contains(text, '\\\\') OR suffix(text, '\\') THEN {body} ELSE text END AS body FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + length(role) + {len(START) + len(END) + 2}) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""


SQL = _sql()
