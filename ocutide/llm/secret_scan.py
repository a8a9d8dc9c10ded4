"""Secret scan: known formats, and windows of high entropy in candidate strings.

Known formats are found by pattern.  Candidate strings are maximal runs of a
character class (hexadecimal; base-64) that hold both a letter and a digit.  A
window slides over each of them; the counts of its characters, and with them the
sum of c*log2(c), change only by the character that enters and the one that
leaves.  A candidate whose best window reaches the entropy of its class is
reported, unless the allow list matches it or a known format covers it.

Positions come from the lengths of what a pattern matches and of what lies
between, by a running sum per text, so only native expressions run.  One shuffle of
short rows (matches, without texts) by row.  Spans are in code points, end
exclusive, by start, then kind.

Null or empty text: no spans.  Repeated rows are scanned separately.  Extra
columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ocutide.llm.storage import free_name


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: Patterns of known formats (fixed values), with the least length of what must be long; (?:) groups aside, group 2 of assign is the value.
_NAMES = _either_case("password|passwd|secret|token|api_?key")
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 characters
HEX = r"[0-9a-f]{16,}"
MIN_VALUE = 12


@dataclass(frozen=True)
class CharClass:
    """A character class whose runs are candidates, and the entropy in bits that a window of it must reach."""

    name: str
    pattern: str  # of runs that are long enough
    alphabet: str
    window: int
    bits: float


CLASSES = (
    CharClass("entropy_hex", r"[0-9a-fA-F]{16,}", "0123456789abcdefABCDEF", 16, 3.05),
    CharClass("entropy_base64", r"[A-Za-z0-9+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.55),
)
#: Candidates that match one of these are no secrets: examples, placeholders, UUIDs, runs of the alphabet.
ALLOW = (r"(?i)example|sample|placeholder|changeme|dummy|xxxx", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"(?i)0123456789|abcdefghij")
KINDS = ("assign", "access", "hex", *(c.name for c in CLASSES))
SCALE = 1 << 32


def plogp(window: int) -> list[int]:
    """c*log2(c) for 0 to ``window``, in fixed point: sums and differences are exact."""
    return [0, *(round(c * math.log2(c) * SCALE) for c in range(1, window + 1))]


def least_sum(c: CharClass) -> int:
    """Largest sum of c*log2(c) at which a window still has the entropy of its class."""
    return math.floor((math.log2(c.window) - c.bits) * c.window * SCALE)


def lowest_window_sum(text: Column, c: CharClass) -> Column:
    """The lowest sum of c*log2(c), that is the highest entropy, of all windows of a run of the class."""
    table = F.array(*map(F.lit, plogp(c.window)))
    index = F.transform(F.split(text, ""), lambda x: F.position(x, F.lit(c.alphabet)))
    start = F.struct(
        F.array_repeat(F.lit(0), len(c.alphabet) + 1).alias("counts"),
        F.lit(0).cast("bigint").alias("sum"),
        F.lit(None).cast("bigint").alias("best"),
        F.array().cast("array<int>").alias("held"),
    )

    def slide(acc: Column, x: Column) -> Column:
        full = F.size(acc["held"]) == c.window
        out = F.when(full, acc["held"][0])
        counts = acc["counts"]
        n_in = F.get(counts, x)
        n_out = F.when(full, F.get(counts, F.coalesce(out, F.lit(0))))
        gain = F.get(table, n_in + 1) - F.get(table, n_in)
        loss = F.when(full, F.get(table, n_out) - F.get(table, n_out - 1)).otherwise(0)
        total = F.when(full & (out == x), acc["sum"]).otherwise(acc["sum"] + gain - loss)
        held = F.concat(F.when(full, F.slice(acc["held"], 2, c.window - 1)).otherwise(acc["held"]), F.array(x))
        return F.struct(
            F.transform(counts, lambda n, j: n + F.when(j == x, 1).otherwise(0) - F.when(full & (j == out), 1).otherwise(0)).alias("counts"),
            total.alias("sum"),
            F.when(F.size(held) == c.window, F.least(acc["best"], total)).otherwise(acc["best"]).alias("best"),
            held.alias("held"),
        )

    return F.aggregate(index, start, slide, lambda acc: acc["best"])


def _pieces(kind: int, pattern: str, guard: str | None = None) -> Column:
    """Kind, length before, length and string of each match of a pattern; the last, without a match, has only what follows."""
    text = F.col("text")
    found = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, m: F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), F.length(m).alias("len"), m.alias("hit")),
    )
    return F.when(text.rlike(guard or pattern), found).otherwise(F.array().cast("array<struct<kind:int,gap:int,len:int,hit:string>>"))


def find_spans(docs: DataFrame) -> DataFrame:
    """A row for each span (row_id, doc_id, kind, start, end), and one of null kind for each text without any."""
    pieces = F.concat(_pieces(0, ASSIGN, _NAMES), _pieces(1, ACCESS, "AKIA"), _pieces(2, HEX), *(_pieces(3 + i, c.pattern) for i, c in enumerate(CLASSES)))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", pieces.alias("pieces")).select("row_id", "doc_id", F.posexplode_outer("pieces").alias("at", "p"))
    rows = rows.select("row_id", "doc_id", "at", "p.kind", "p.gap", "p.len", "p.hit").repartition("row_id")
    before = W.partitionBy("row_id", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce("len", F.lit(0))).over(before)
    rows = rows.select("row_id", "doc_id", "kind", "hit", (end - F.col("len")).alias("start"), end.alias("end"))
    fine = (F.col("kind") == 0) & (F.length(F.regexp_extract("hit", ASSIGN, 2)) >= MIN_VALUE) | F.col("kind").isin(1, 2)
    mixed = F.col("hit").rlike("[0-9]") & F.col("hit").rlike("[A-Za-z]")
    for a in ALLOW:
        mixed &= ~F.col("hit").rlike(a)
    for i, c in enumerate(CLASSES):
        fine |= F.when((F.col("kind") == 3 + i) & mixed, lowest_window_sum(F.col("hit"), c) <= least_sum(c)).otherwise(False)
    rows = rows.select("row_id", "doc_id", F.when(F.col("hit").isNotNull() & fine, F.col("kind")).alias("kind"), "start", "end")
    # covered by a known format, or by another candidate (of equal ones the first kind stays)
    so_far = W.partitionBy("row_id").orderBy(F.col("start").asc_nulls_last(), F.col("end").desc(), "kind").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("kind") < 3, F.col("end"))).over(so_far)
    twin = F.max(F.when(F.col("kind") >= 3, F.col("end"))).over(so_far)
    covered = (F.col("kind") >= 3) & ((F.coalesce(reach, F.lit(-1)) >= F.col("end")) | (F.coalesce(twin, F.lit(-1)) >= F.col("end")))
    return rows.select("row_id", "doc_id", F.when(~F.coalesce(covered, F.lit(False)), F.col("kind")).alias("kind"), "start", "end")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, the number of spans of each known kind, and all spans.

    ``found``: array of (start, kind, end), kind an index of ``KINDS``.
    """
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))
    counts = [F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return find_spans(docs).groupBy("row_id", "doc_id").agg(*counts, F.array_sort(F.collect_list(span)).alias("found")).drop("row_id")


def secret_digests(found: DataFrame) -> DataFrame:
    """The scan with its spans as strings and the digest of those of known formats."""
    base = _joined(F.filter("found", lambda s: s["kind"] < 3))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(base, 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span of the scan replaced by ``mark``; n_chars, where there is one, follows the text.

    What is a secret depends on the text alone, so spans find their rows by a digest of it: a doc_id may be null or
    repeated.  Texts without spans stay as they are, and so do all other columns.
    """
    digest, spans_ = free_name("_digest", docs), free_name("_spans", docs)
    of_text = F.md5(F.col("text"))
    found = secret_scan(docs.select(of_text.alias("doc_id"), "text")).where(F.size("found") > 0).dropDuplicates(["doc_id"])
    # spans are in order of start: one that begins inside its predecessors' reach widens it
    start = F.struct(F.array().cast("array<struct<start:bigint,end:bigint>>").alias("done"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"))
    closed = lambda acc: F.when(acc["start"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))

    def merge(acc: Column, s: Column) -> Column:
        joins = F.coalesce(s["start"] <= acc["end"], F.lit(False))
        return F.struct(
            F.when(joins, acc["done"]).otherwise(closed(acc)).alias("done"),
            F.when(joins, acc["start"]).otherwise(s["start"]).alias("start"),
            F.when(joins, F.greatest(acc["end"], s["end"])).otherwise(s["end"]).alias("end"),
        )

    spans = F.aggregate("found", start, merge, closed)
    # what stands before each span and after the last, joined by the mark
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans_, lambda s: s["end"]))
    starts = F.concat(F.transform(spans_, lambda s: s["start"]), F.array(F.length("text").cast("bigint")))
    text = F.array_join(F.zip_with(ends, starts, lambda a, b: F.substr("text", (a + 1).cast("int"), (b - a).cast("int"))), mark)
    keyed = docs.withColumn(digest, F.coalesce(of_text, F.uuid()))  # null texts find nothing, and don't meet in one task
    out = keyed.join(found.select(F.col("doc_id").alias(digest), spans.alias(spans_)), digest, "left").withColumn("text", F.when(F.col(spans_).isNull(), F.col("text")).otherwise(text))
    return (out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out).select(*docs.columns)


def _sql() -> str:
    q = lambda s: s.replace("'", "''")
    kinds = [(0, ASSIGN), (1, ACCESS), (2, HEX), *((3 + i, c.pattern) for i, c in enumerate(CLASSES))]
    found = "\nUNION ALL ".join(
        f"SELECT row_id, {k} AS kind, list_transform(string_split_regex(text, '{q(p)}'), lambda x: length(x)) AS gaps, regexp_extract_all(text, '{q(p)}') AS hits FROM d WHERE regexp_matches(text, '{q(p)}')"
        for k, p in kinds
    )
    entropy = " OR ".join(f"(kind = {3 + i} AND best >= {c.bits})" for i, c in enumerate(CLASSES))
    width = "CASE kind " + " ".join(f"WHEN {3 + i} THEN {c.window}" for i, c in enumerate(CLASSES)) + " END"
    allow = " AND ".join(f"NOT regexp_matches(hit, '{q(a)}')" for a in ALLOW)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
g AS (SELECT row_id, kind, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, unnest(range(len(hits))) AS nth FROM f),
s AS (SELECT row_id, kind, hit, sum(gap + length(hit)) OVER (PARTITION BY row_id, kind ORDER BY nth) AS stop FROM g),
p AS (SELECT row_id, kind, hit, stop - length(hit) AS start, stop FROM s),
w AS (SELECT row_id, kind, start, stop, hit, substr(hit, CAST(i AS BIGINT) + 1, {width}) AS win, i FROM (SELECT *, unnest(range(length(hit) - {width} + 1)) AS i FROM p WHERE kind >= 3 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND {allow})),
c AS (SELECT row_id, kind, start, stop, i, ch, count(*) AS n FROM (SELECT *, unnest(string_split(win, '')) AS ch FROM w) GROUP BY ALL),
e AS (SELECT row_id, kind, start, stop, i, log2({width}) - sum(n * log2(n)) / {width} AS h FROM c GROUP BY row_id, kind, start, stop, i),
b AS (SELECT row_id, kind, start, stop, max(h) AS best FROM e GROUP BY ALL),
k AS (
  SELECT row_id, kind, start, stop FROM p WHERE kind IN (1, 2) OR kind = 0 AND length(regexp_extract(hit, '{q(ASSIGN)}', 2)) >= {MIN_VALUE}
  UNION ALL SELECT row_id, kind, start, stop FROM b WHERE {entropy}),
a AS (
  SELECT * FROM k WHERE kind < 3 OR NOT EXISTS (
    SELECT 1 FROM k AS o WHERE o.row_id = k.row_id AND o.start <= k.start AND o.stop >= k.stop AND (o.kind < k.kind OR o.kind >= 3 AND (o.start < k.start OR o.stop > k.stop))))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg({list(KINDS)}[kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN a USING (row_id) GROUP BY d.row_id, d.doc_id
"""


SQL = _sql()
