"""Benchmark decontamination by a prefix-filtered join with exact verification.

Every benchmark item gives windows of ``WINDOW`` consecutive words (a shorter item
is one window).  A window occurs in a text only where all its words do, so one of
them is enough to look for: words are ordered by their number in the whole corpus,
and each window's rarest word is its necessary prefix.  A scan keeps the places of
prefix words with the few words around them; joined to the windows by that word,
a place is dropped where the window would not fit into the text (position and
length bounds), and the rest are compared word by word.

The texts are read twice (word counts, places) however large the benchmark is, and
never shuffled; what moves are counts of benchmark words and the places of rare words.
Benchmark words reach a scan as a Bloom filter of ``FILTER_BITS`` bits, which executors
build and which has one size for all benchmarks; words that it lets pass by chance
meet no benchmark word in the join that follows.  The driver holds no words.

Null or empty texts and items have no words.  Repeated document rows are treated
apart; repeated items count once each.  Extra columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ocutide.llm.storage import stored

WINDOW = 10
#: Bits of the Bloom filter (half a megabyte): a million words let one other word in seven pass, 100,000 one in 500.
FILTER_BITS = 1 << 22
#: Bytes that separate words once A-Z are folded (fixed value).
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z folded; no empty ones."""
    beyond = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    # lower() folds more than A-Z: only texts whose other letters it leaves alone may use it
    folded = F.when(beyond == F.lower(beyond), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(folded, GAPS), "")


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct windows of ``items`` (item_id, text): win (array of words), and items that hold it."""
    w = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - width, F.lit(0))
    starts = w.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return starts.select("item_id", F.slice("words", F.col("at") + 1, F.lit(width)).alias("win")).groupBy("win").agg(F.collect_set("item_id").alias("items"))


def _cells(word: Column) -> list[Column]:
    """The places of a word in the filter."""
    h = F.xxhash64(word)
    return [F.pmod(h, F.lit(FILTER_BITS)), F.pmod(F.shiftright(h, 32), F.lit(FILTER_BITS))]


def word_filter(names: DataFrame) -> Column:
    """A Bloom filter over the words of a one-column table: an array of FILTER_BITS / 64 numbers, as a scalar of the plan."""
    place = names.select(F.explode(F.array(*_cells(F.col(names.columns[0])))).alias("p"))
    set_ = place.groupBy(F.shiftright("p", 6).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))).alias("bits"))
    every = names.sparkSession.range(FILTER_BITS // 64).join(set_, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")).alias("c"))
    return stored(every.agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["bits"]).alias("bits")), "filter").scalar()


def _passes(bits: Column, word: Column) -> Column:
    one = lambda p: F.call_function("shiftright", F.get(bits, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1
    a, b = _cells(word)
    return one(a) & one(b)


def word_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How often each word of ``vocabulary`` occurs in all texts: word, n."""
    bits = word_filter(vocabulary)
    every = docs.select(F.explode(words(F.col("text"))).alias("word")).where(_passes(bits, F.col("word")))
    return every.groupBy("word").agg(F.count("*").alias("n")).join(vocabulary, "word", "left_semi")


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows with their rarest word and its place; windows with a word that no text has are left out."""
    each = windows.select("win", "items", F.posexplode("win").alias("at", "word")).join(counts, "word")
    best = F.min(F.struct("n", "word", "at"))
    found = each.groupBy("win").agg(best.alias("p"), F.count("*").alias("present"), F.first("items").alias("items")).where(F.col("present") == F.size("win"))
    return found.select("win", "items", F.col("p.word").alias("word"), F.col("p.at").alias("at"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """For each row of ``docs`` (doc_id, text) the words that windows of ``items`` cover and the items.

    Columns: doc_id, n_words, n_hit, items (sorted array of item_id as strings),
    hits (array of start and end word of the covering windows, in order).
    """
    windows = stored(item_windows(items, width), "windows")
    vocabulary = stored(windows.select(F.explode("win").alias("word")).distinct(), "vocabulary")
    # needed for the filter of the scan and for the join
    chosen = stored(prefixes(windows, word_counts(docs, vocabulary)), "prefixes")
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", words(F.col("text")).alias("words"))
    passes = _passes(word_filter(chosen.select("word").distinct()), F.col("word"))
    around = F.slice("words", F.greatest(F.col("pos") - (width - 1), F.lit(0)) + 1, F.lit(2 * width - 1))
    every = rows.select("row_id", "doc_id", F.coalesce(F.size("words"), F.lit(0)).alias("n_words"), "words", F.posexplode_outer("words").alias("pos", "word"))
    # each text keeps a row of its own, that of its first word
    parts = every.where(passes | (F.coalesce("pos", F.lit(0)) == 0)).select("row_id", "doc_id", "n_words", F.when(passes, F.struct("pos", "word", around.alias("near"))).alias("p"))
    # the place of the window's start within the surroundings, and the bounds that it must keep
    skip = F.col("p.pos") - F.greatest(F.col("p.pos") - (width - 1), F.lit(0))
    start = F.col("p.pos") - F.col("at")
    fits = (start >= 0) & (start + F.size("win") <= F.col("n_words"))
    same = F.slice("p.near", F.greatest(skip - F.col("at"), F.lit(0)) + 1, F.size("win")) == F.col("win")
    # texts without a place keep a row of their own; their keys (no word has a space) spread over all partitions
    keyed = parts.withColumn("key", F.coalesce(F.col("p.word"), F.concat(F.lit(" "), F.col("row_id").cast("string"))))
    joined = keyed.join(chosen.withColumnRenamed("word", "prefix"), (F.col("key") == F.col("prefix")) & fits & same, "left")
    hit = F.when(F.col("win").isNotNull(), F.struct(start.alias("start"), (start + F.size("win")).alias("end")))
    # a place may fit several windows of one start (items of unlike length); one row per place and reach
    places = joined.select("row_id", "doc_id", "n_words", hit.alias("hit"), "items")
    order = W.partitionBy("row_id").orderBy("hit.start", "hit.end").rowsBetween(W.unboundedPreceding, -1)
    reach = F.coalesce(F.max("hit.end").over(order), F.lit(0))
    new = F.coalesce(F.greatest(F.col("hit.end") - F.greatest(reach, F.col("hit.start")), F.lit(0)), F.lit(0))
    counted = places.repartition("row_id").withColumn("new", new)
    names = F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda x: x.cast("string")))
    return counted.groupBy("row_id", "doc_id").agg(
        F.max("n_words").cast("bigint").alias("n_words"),
        F.sum("new").cast("bigint").alias("n_hit"),
        names.alias("items"),
        F.array_sort(F.collect_set("hit")).alias("hits"),
    ).drop("row_id")


def decontamination_digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{GAPS}'), lambda w: w <> '')"
SQL = f"""
WITH i AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
w AS (SELECT DISTINCT item_id, words[s + 1 : s + {WINDOW}] AS win FROM (SELECT item_id, words, unnest(range(greatest(len(words) - {WINDOW}, 0) + 1)) AS s FROM i WHERE len(words) > 0)),
z AS (SELECT DISTINCT len(win) AS size FROM w),
d AS (SELECT row_number() OVER () AS row_id, doc_id, {_WORDS} AS words FROM documents),
p AS (SELECT row_id, s, size, words[s + 1 : s + size] AS win FROM (SELECT row_id, words, size, unnest(range(greatest(len(words) - size + 1, 0))) AS s FROM d CROSS JOIN z)),
h AS (SELECT row_id, s, size, item_id FROM p JOIN w USING (win)),
c AS (SELECT row_id, count(DISTINCT w) AS n_hit FROM (SELECT row_id, unnest(range(s, s + size)) AS w FROM h) GROUP BY row_id),
n AS (SELECT row_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT row_id, item_id FROM h) GROUP BY row_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (row_id) LEFT JOIN n USING (row_id)
"""
