"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a share of all words in proportion to its weight, at most ``max_epochs`` times its own size; what a
capped source leaves is shared again by weight.  A source's documents are first taken whole for every complete epoch.
The fraction of an epoch that is left is sampled without replacement: a document gets the exponential key -ln(u) / q,
where q is its quality weight and u a hash of its id, and documents are taken in the order of their keys until their
sizes, prefix-summed within the source, reach the budget.  The document in which the budget ends gives its first
words only, so that a source's words are its target, rounded.

No source is sorted as a whole: keys are cut into ranges whose sizes are summed first, and only the range in which a
budget ends is ordered.  Rows that are equal in id and text have equal keys and are ordered as one, so that a document that is there very
often is one row there.  Nothing is collected but sums over all sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.base import WORD, bounded, numbered, stage


def targets(sources: DataFrame, *, weights=(1, 2, 3), max_epochs: float = 3) -> DataFrame:
    """source, n, target from source and n: words for each source; sources in code point order, null last, weigh weights in turn.

    What is left is shared by weight among the sources that are below their caps.  Shares only grow from round to
    round, so that a round needs no more than the share of the round before.
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    ranked = numbered(sources, F.col("source").asc_nulls_last()).select("source", "n", turn.alias("weight"), (F.col("n") * float(max_epochs)).alias("cap"))
    ranked = stage(ranked, "mix-sources")
    share, before = 0.0, None
    while before != share:
        full = F.col("cap") <= F.lit(share) * F.col("weight")
        r = ranked.agg(F.sum("n").cast("double").alias("all"), F.sum(F.when(full, F.col("cap"))).alias("caps"), F.sum(F.when(~full, F.col("weight"))).alias("weights")).first()
        before = share
        if r["weights"]:
            share = max(r["all"] - (r["caps"] or 0.0), 0.0) / r["weights"]
    return ranked.select("source", "n", F.when(full, F.col("cap")).otherwise(F.lit(share) * F.col("weight")).alias("target"))


def quality_weight(words: Column) -> Column:
    """From 0.5 to 1: half of it is the share of distinct words."""
    n = F.size(words)
    return F.when(n > 0, 0.5 + 0.5 * F.size(F.array_distinct(words)) / n).otherwise(0.5)


def keys(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """doc_id, source, size, h (a hash of id and text), key (exponential, by h and the quality weight), one row per input row."""
    words = F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD), F.lit(0))
    h = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    uniform = (F.shiftrightunsigned(F.col("h"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(words).cast("long").alias("size"), h.alias("h"), quality_weight(words).alias("q"))
    return sized.select("doc_id", "source", "size", "h", (-F.log(uniform) / F.col("q")).alias("key"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), max_epochs: int = 3, seed: int = 42, ranges: int = 4096) -> DataFrame:
    """doc_id, size, source_size, target, taken, one row per input row.

    Null texts and texts without words have size 0 and taken 0.  A null source is a source of its own, the last.  Rows
    with equal ids (and null ids) are documents of their own; rows equal in id and text are interchangeable.  An empty
    table gives an empty result.  Columns besides the three named are not read.
    """
    sized = keys(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed)
    sized = sized.withColumns({"range": F.least(F.lit(ranges - 1), F.floor((1 - F.exp(-F.col("key"))) * ranges)).cast("int"), "part": F.spark_partition_id()})
    sized = stage(sized, "mix-sizes")
    # At most `ranges` rows for each source.
    sums = stage(sized.groupBy("source", "range").agg(F.sum("size").alias("n")), "mix-ranges")
    aims = targets(sums.groupBy("source").agg(F.sum("n").alias("n")), weights=weights, max_epochs=max_epochs)
    epochs = F.when(F.col("n") > 0, F.least(F.floor(F.col("target") / F.col("n")), F.lit(max_epochs))).otherwise(0).cast("long")
    aims = aims.withColumn("epochs", epochs).select(
        F.col("source").alias("p_source"), F.col("n").alias("source_size"), "target", "epochs", (F.bround("target").cast("long") - F.col("epochs") * F.col("n")).alias("budget")
    )
    own = lambda c="source": F.col(c).eqNullSafe(F.col("p_source"))
    # The range in which each budget ends, and what precedes it.
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(aims, own())
    ends = ends.filter("before < budget and before + n >= budget").select(F.col("p_source").alias("e_source"), F.col("range").alias("end_range"), (F.col("budget") - F.col("before")).alias("left"))
    plan = stage(aims.join(ends, F.col("p_source").eqNullSafe(F.col("e_source")), "left").drop("e_source"), "mix-plan")
    # Of that range, the documents in their order, equal rows as one.
    there = sized.filter("size > 0").join(bounded(plan.filter("end_range is not null")), own() & (F.col("range") == F.col("end_range")))
    there = there.groupBy("source", "key", "h", "size", "left").agg(F.count(F.lit(1)).alias("times"))
    order = ["key", "h", "size"]
    inside = F.coalesce(F.sum(F.col("size") * F.col("times")).over(Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = there.withColumn("rest", F.col("left") - inside).filter("rest > 0 and rest <= size * times")
    last = last.select(F.col("source").alias("l_source"), *[F.col(c).alias(f"last_{c}") for c in order], "rest", "times")
    plan = stage(plan.join(last, F.col("p_source").eqNullSafe(F.col("l_source")), "left").drop("l_source"), "mix-cuts")

    placed = sized.join(bounded(plan), own())
    here, there = F.struct(*order), F.struct(*[F.col(f"last_{c}") for c in order])
    whole = F.when(F.col("range") != F.col("end_range"), F.col("range") < F.col("end_range")).otherwise(here < there)
    at_end = F.coalesce((F.col("range") == F.col("end_range")) & (here == there), F.lit(False))
    shown = lambda part: ["doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken")]
    single = at_end & (F.col("times") == 1)
    part = F.when(single, F.col("rest")).when(F.coalesce(whole, F.lit(False)), F.col("size")).otherwise(0)
    out = placed.filter(~at_end | (F.col("times") == 1)).select(*shown(part))
    if plan.filter("times > 1").isEmpty():
        return out
    # The budget ends in rows that are equal: as many as it has room for are taken whole, numbered by the parts they come from.
    equal = placed.filter(at_end & (F.col("times") > 1))
    counts = equal.groupBy("source", "part").agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.withColumn("before", F.coalesce(F.sum("rows").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.select(F.col("source").alias("c_source"), F.col("part").alias("c_part"), "before")
    number = F.row_number().over(Window.partitionBy("source", "part").orderBy("h")) - 1
    taken = equal.withColumn("own", number).join(counts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("part") == F.col("c_part")))
    return out.union(taken.select(*shown(F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("own") + F.col("before")) * F.col("size"))))))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs as often as the mix takes them.

    Whole documents only: where the mix takes part of a document, the document comes once more if that part is half of
    it or more.  Rows that are equal in id, text and source come equally often, the mean of what the mix takes of
    them.  Rows without words are not taken.
    """
    key, times = "__kinloom_row", "__kinloom_times"
    keyed = docs.withColumn(key, F.xxhash64(id_col, text_col, source_col))
    taken = mix(keyed, id_col=key, text_col=text_col, source_col=source_col, **options)
    taken = taken.filter("size > 0").groupBy(F.col("doc_id").alias(key)).agg(F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias(times)).filter(F.col(times) > 0)
    joined = keyed.join(bounded(stage(taken, "mix-times")), key)
    return joined.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
