"""Filter interaction audit: what each of five filters removes alone, after others, and on average over all orders.

Words are rows: every text is exploded into its words, words are aggregated by (document, word) and then by document to
totals and distinct words.  Texts go to tasks by document once, so that both aggregations find their rows in place; the
task a document was read by deals copies of one row out.  The other flags need no words and are outer-joined.  Five
flags make 32 combinations, which one aggregation counts as 32 columns for each part (all rows, good ones, toxic ones);
every order and step is a sum over those columns, so that the 120 orders never see a document.

Filters, each a condition on which a document fails: A: under 100 words; B: 100 * distinct words < 80 * words; C: 100 *
``[A-Z]`` > 10 * code points; D: any of ``#$%&*|``; E: the same text as a smaller doc_id anywhere in the table.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.base import partitions, stage

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 100, 80, 10, r"[#$%&*|]"
BREAKS = r"[\x20\x09-\x0D]+"
MASKS = 1 << len(FILTERS)
#: Copies of one row, and documents of one text, are dealt to so many groups at most.
COPIES = 16


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, h, words, distinct for each different (doc_id, h) whose text has words; docs has doc_id, h and text.

    A row without a word stands for the document itself: equal rows in one group are counted by it, as each brings all words once more.
    """
    key = ["doc_id", "h", "copy"]
    dealt = docs.withColumn("copy", F.pmod(F.spark_partition_id(), F.lit(COPIES))).repartition(partitions(docs), *key)
    words = dealt.select(*key, F.explode(F.concat(F.array(F.lit(None).cast("string")), F.split("text", BREAKS))).alias("word")).filter("word is null or word <> ''")
    by_word = words.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("n"))
    is_word = F.col("word").isNotNull()
    by_copy = by_word.groupBy(*key).agg(F.sum(F.when(is_word, F.col("n"))).alias("all"), F.max(F.when(~is_word, F.col("n"))).alias("copies"), F.count("word").alias("distinct"))
    return by_copy.groupBy("doc_id", "h").agg(F.max(F.expr("all div copies")).alias("words"), F.max("distinct").alias("distinct"))


def flags(docs: DataFrame, labels: DataFrame | None, *, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """part, mask (bit i set: fails the i-th filter), good, toxic; one row per input row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")).withColumn("h", F.xxhash64("text"))
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    plain = rows.select(
        "doc_id", "part", "h", F.unhex(F.sha2("text", 256)).alias("sha"),
        (100 * capitals > CAPITAL_PERCENT * F.length("text")).alias("C"), F.col("text").rlike(SIGNS).alias("D"),
    )
    plain = stage(plain, "filter-flags")
    # Documents of one text are dealt out, and its first document goes to each group of them.
    first = plain.filter("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    first = first.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    plain = plain.withColumn("copy", F.pmod(F.xxhash64("doc_id"), F.lit(COPIES)).cast("int"))
    counted = word_counts(rows.select("doc_id", "h", "text").filter("text <> ''")).withColumnsRenamed({"doc_id": "w_id", "h": "w_h"})
    joined = plain.join(counted, F.expr("doc_id <=> w_id and h = w_h"), "left").join(first, ["sha", "copy"], "left")
    good = toxic = F.lit(False)
    if labels is not None:
        known = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
        joined, good, toxic = joined.join(known, "doc_id", "left"), F.coalesce("good", F.lit(False)), F.coalesce("bad", F.lit(False))
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct", F.lit(0))
    fails = [words < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * words, F.col("C"), F.col("D"), F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return joined.select("part", mask.alias("mask"), good.alias("good"), toxic.alias("toxic"))


def _bits(letters: Column) -> Column:
    """The mask of a string of filters."""
    bit = lambda c: F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), F.instr(F.lit(FILTERS), c))
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda all_, c: all_ + bit(c))


def _total(counts: str, takes) -> Column:
    """The sum of the counts of the masks that takes accepts."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("long"), lambda sum_, m: sum_ + F.when(takes(m), F.element_at(counts, m + 1)).otherwise(0))


def audit(docs: DataFrame, labels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for each part, order and step.

    kept: left after the step; removed: by its filter here; redundant: fail its filter but went earlier; unique_fails: fail
    no other filter; good_lost, toxic_lost: of those removed, labelled quality 1, toxic 1; shapley: removed by the filter,
    summed over all orders.  Null texts are empty, and fail A; a null part is the empty string.  A null doc_id has no
    smaller id and is smaller than none.  Equal rows count each.  Of several labels of an id one that says 1 counts; ids
    without labels are neither good nor toxic.  An empty table has no part, and no row.  Other columns are not read.
    """
    told = flags(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col)
    kinds = {"everyone": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = told.groupBy("part").agg(*[F.array(*[F.count_if((F.col("mask") == m) & kind) for m in range(MASKS)]).alias(name) for name, kind in kinds.items()])
    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.array(*[F.lit(i + 1) for i in range(len(FILTERS))])))
    order, step = F.col("filter_order"), F.col("step")
    steps = steps.withColumns({"letter": F.substr(order, step, F.lit(1)), "before": _bits(F.substr(order, F.lit(1), step - 1))}).withColumn("bit", _bits(F.col("letter")))
    before, bit = F.col("before"), F.col("bit")
    here = lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(bit) != 0)
    made = steps.select(
        "part", "filter_order", "step", "letter",
        _total("everyone", lambda m: m.bitwiseAND(before + bit) == 0).alias("kept"),
        _total("everyone", here).alias("removed"),
        _total("everyone", lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(bit) != 0)).alias("redundant"),
        F.element_at("everyone", bit + 1).alias("unique_fails"),
        _total("good", here).alias("good_lost"),
        _total("toxic", here).alias("toxic_lost"),
    )
    shapley = made.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return made.join(shapley, ["part", "letter"]).drop("letter")


_ORDERS_SQL = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
#: The same in SQL.
AUDIT_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT part,
  CASE WHEN len(ws) < {LEAST_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '{SIGNS}') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask,
  coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic FROM w LEFT JOIN labels l USING (doc_id)),
o AS (SELECT * FROM (VALUES {_ORDERS_SQL}) AS v(filter_order)),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, 1 << (ascii(substring(filter_order, CAST(step AS INT), 1)) - 65) AS bit,
  coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substring(filter_order, CAST(i AS INT), 1)) - 65))), 0)::INTEGER AS before
  FROM o, range(1, {len(FILTERS) + 1}) AS r(step)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY ALL),
r AS (SELECT part, filter_order, step, bit,
  coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(g) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
  coalesce(sum(x) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""
