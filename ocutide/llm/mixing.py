"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed over cells of source, language and topic.  The cells' weights are
raked: scaled to the target share of each source, then of each language, then of
each topic, and again, until no factor of a round is further than TOLERANCE from 1, so
that all three marginals agree with the targets.  Targets that no weights can meet, as
they never agree, end in an error after MOST_ROUNDS.  A document of a cell is then drawn
``rate * weight / natural share`` times: the whole part for certain, the rest with
that probability, by a number that depends on its doc_id alone.

Topics are given by rules, first match wins.  Targets default to natural shares
raised to a power below 1 and normalised, which lifts small sources and languages.

The texts are read once for the cells and once for the draw, and never shuffled;
only cells move.  Null source or language: a value "(none)" of its own.  Null or
empty text: no tokens, topic of the last rule, weight of its cell (1 where the whole
cell has no tokens).  Repeated rows have the same draw.  Extra columns are not read
by ``mix``; ``mix_rows`` keeps them, and replaces those of the names that it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocutide.llm.storage import discard, free_name, stored

DIMS = ("source", "lang", "topic")
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Largest relative error of a marginal that remains, and rounds after which targets count as impossible.
TOLERANCE, MOST_ROUNDS = 1e-12, 500
#: Topic and the pattern of its texts, in order (fixed values); texts that match none are told apart by length.
TOPICS = (("table", r" \| "), ("markup", r"[#*$%&]{3}"), ("legal", r"[Ll]icen[cs]ed |Copyright"), ("contact", r"@[a-z]+\.|\([0-9]{3}\) [0-9]{3}-"))
LENGTHS = ((50, "note"), (500, "article"))
LAST = "longform"
WORD = r"[^\x20\x09-\x0D]+"
NONE = "(none)"


def topic_of(text: Column, n_tokens: Column) -> Column:
    out = F.when(n_tokens == 0, LAST)
    for name, pattern in TOPICS:
        out = out.when(text.rlike(pattern), name)
    for n, name in LENGTHS:
        out = out.when(n_tokens < n, name)
    return out.otherwise(LAST)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic and number of tokens (words) of each row."""
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    base = docs.select("doc_id", F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("lang"), "text", n.alias("n_tokens"))
    return base.select("doc_id", "source", "lang", topic_of(F.col("text"), F.col("n_tokens")).alias("topic"), "n_tokens")


def default_targets(cells: DataFrame, powers: dict[str, float]) -> dict[str, DataFrame]:
    """Of each dimension its values and target shares."""
    out = {}
    for d, power in powers.items():
        part = cells.groupBy(d).agg(F.sum("n_tokens").alias("n")).select(d, F.pow(F.col("n").cast("double"), F.lit(power)).alias("v"))
        out[d] = stored(part.select(d, (F.col("v") / part.agg(F.sum("v")).scalar()).alias("target")), "targets")
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """Cells (source, lang, topic, n_tokens) with their fitted share ``w``, 1 in all, natural share ``natural`` and the last largest correction ``off``."""
    share = F.col("n_tokens") / cells.agg(F.sum("n_tokens").cast("double")).scalar()
    cur = stored(cells.select(*DIMS, share.alias("natural"), share.alias("w"), F.lit(0.0).alias("off")), "raked")
    for _ in range(most_rounds):
        for d in DIMS:
            factor = cur.groupBy(d).agg(F.sum("w").alias("m")).join(targets[d], d).select(d, (F.col("target") / F.col("m")).alias("f"))
            # each step reads its table twice, so it is written: plans stay of one size
            off = F.abs(F.col("f") - 1)
            step = cur.join(factor, d).select(*DIMS, "natural", (F.col("w") * F.col("f")).alias("w"), (off if d == DIMS[0] else F.greatest("off", off)).alias("off"))
            old, cur = cur, stored(step, "raked")
            discard(old)
        if (cur.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            return cur
    raise ValueError(f"no weights meet the targets: still off by {cur.agg(F.max('off')).first()[0]:.2g}")


NEW = ("topic", "n_tokens", "weight", "copies")


def mix_rows(docs: DataFrame, targets: dict[str, DataFrame] | None = None, powers: dict[str, float] | None = None, rate: float = 1.0) -> DataFrame:
    """``docs`` (doc_id, text, lang, source and more) with the topic, number of tokens, weight and copies of each row; texts are not shuffled.

    ``targets``: tables of (source | lang | topic, target), shares of 1, of all values with tokens.
    """
    rows = measured(docs)
    cells = stored(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("n_tokens")).where("n_tokens > 0"), "cells")
    wanted = default_targets(cells, powers or POWERS)
    fitted = rake(cells, wanted | (targets or {}))
    key = {d: free_name(f"_mix_{d}", docs) for d in (*DIMS, "weight")}
    weights = stored(fitted.select(*(F.col(d).alias(key[d]) for d in DIMS), (F.col("w") / F.col("natural")).alias(key["weight"])), "weights")
    discard(fitted, cells, *wanted.values())
    old = [c for c in docs.columns if c.lower() not in NEW]
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    kept = docs.select(*old, n.alias("n_tokens"))
    kept = kept.select(*old, "n_tokens", topic_of(F.col("text"), F.col("n_tokens")).alias("topic"))
    on = (F.coalesce("source", F.lit(NONE)) == F.col(key["source"])) & (F.coalesce("lang", F.lit(NONE)) == F.col(key["lang"])) & (F.col("topic") == F.col(key["topic"]))
    drawn = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    weight = F.coalesce(key["weight"], F.lit(1.0))
    expected = weight * F.lit(rate)
    copies = F.floor(expected) + F.when(drawn < expected - F.floor(expected), 1).otherwise(0)
    return kept.join(weights, on, "left").select(*old, "topic", "n_tokens", F.round(weight, 6).alias("weight"), copies.cast("bigint").alias("copies"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, powers: dict[str, float] | None = None, rate: float = 1.0) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, lang, source) with its cell, its weight, and how many copies the mix takes."""
    out = mix_rows(docs.select("doc_id", "text", "lang", "source"), targets, powers, rate)
    return out.select("doc_id", F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("lang"), *NEW)


def _sql(rounds: int = 36) -> str:
    """Rounds in one statement are of a fixed number, here so many that the test tables agree to more digits than are compared."""
    topic = f"CASE WHEN n_tokens = 0 THEN '{LAST}' " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS) + " " + " ".join(f"WHEN n_tokens < {n} THEN '{x}'" for n, x in LENGTHS) + f" ELSE '{LAST}' END"
    parts = [
        f"m AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, text, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS n_tokens FROM documents)",
        f"r AS (SELECT doc_id, source, lang, {topic} AS topic, n_tokens FROM m)",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS n FROM r GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for d in DIMS:
        parts.append(f"t_{d} AS MATERIALIZED (SELECT {d}, v / sum(v) OVER () AS target FROM (SELECT {d}, pow(CAST(sum(n) AS DOUBLE), {POWERS[d]}) AS v FROM c GROUP BY {d}))")
    parts.append("w0 AS MATERIALIZED (SELECT source, lang, topic, n / sum(n) OVER () AS nat, n / sum(n) OVER () AS w FROM c)")
    k = 0
    for _ in range(rounds):
        for d in DIMS:
            parts.append(f"w{k + 1} AS MATERIALIZED (SELECT source, lang, topic, nat, w * target / sum(w) OVER (PARTITION BY {d}) AS w FROM w{k} JOIN t_{d} USING ({d}))")
            k += 1
    u = "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / 281474976710656.0"
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, CAST(floor(weight) + CASE WHEN {u} < weight - floor(weight) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM (SELECT r.*, coalesce(w / nat, 1.0) AS weight FROM r LEFT JOIN w{k} USING (source, lang, topic))
"""


SQL = _sql()
