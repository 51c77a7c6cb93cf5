"""Household matching: person pairs rolled up to the share of a household that is found in another."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators.linked import Linked
from kinloom.operators.matching import fuzzy_parts
from kinloom.storage import staged

OUT = ["row_id", "uuid", "hh_id", "match_percentage", "region_code", "poor_hat_0", "poor_hat_10"]


def household_key(prefix: str = "") -> Column:
    """hh_id, or the person's id where there is none."""
    return F.coalesce(F.col(f"{prefix}hh_id"), F.col(f"{prefix}id").cast("string"))


def _best(pairs: DataFrame, person: str, household: str, keep: list[str]) -> DataFrame:
    """Each person's household of greatest confidence; persons with several such are left out.

    One aggregation gives the last and the first household of greatest confidence, which are one if there is only one.
    """
    hh = F.col(household)
    last = F.max(F.struct("confidence", hh.alias("hh")))
    first = F.min(F.struct((-F.col("confidence")).alias("confidence"), hh.isNull().alias("none"), hh.alias("hh"), *keep))
    one = pairs.groupBy(person).agg(last.alias("last"), first.alias("first")).filter("last.hh = first.hh")
    return one.select(person, F.col("first.hh").alias(household), *[F.col(f"first.{k}").alias(k) for k in keep])


def _share(counts: DataFrame, sizes: DataFrame, by: str) -> DataFrame:
    """Percentage of each household's members that were found, where it is over 50; counts has uuid, hh_id and found."""
    percent = (F.col("found") * 100.0 / F.col("size")).cast("float")
    return counts.join(sizes, by).withColumn("match_percentage", percent).filter("match_percentage > 50")


def _found(best: DataFrame, person: str) -> DataFrame:
    return best.groupBy("uuid", "hh_id").agg(F.countDistinct(person).alias("found"))


def sizes_t1(a: DataFrame) -> DataFrame:
    """Persons of each household of the first table."""
    return a.filter("uuid is not null").groupBy("uuid").agg(F.count(F.lit(1)).alias("size"))


def sizes_t2(b: DataFrame) -> DataFrame:
    """Persons of each household of the second table."""
    return b.groupBy(household_key().alias("hh_id")).agg(F.count(F.lit(1)).alias("size"))


def rolled(counts: DataFrame, sizes: DataFrame, by: str) -> DataFrame:
    """Household rows from the persons found of each pair of households."""
    return _numbered(_share(counts, sizes, by))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows in the order of uuid and hh_id, numbered from 1.

    Households are dealt out by ranges that Spark draws from the rows themselves, and written; a row's number is its
    place in its range and the rows of the ranges before, so that no task orders all households, whatever their ids look like.
    The rows are written while the plan is made.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select("uuid", "hh_id", "match_percentage").repartitionByRange(parts, "uuid", "hh_id").withColumn("range", F.spark_partition_id())
    ranged = staged(ranged, "households")
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # one row for each range
    before = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("uuid", "hh_id"))
    none = {c: F.lit(None).cast("string") for c in ("region_code", "poor_hat_0", "poor_hat_10")}
    numbered = ranged.withColumn("place", place).join(F.broadcast(before), "range")
    return numbered.withColumns(none | {"row_id": (F.col("before") + F.col("place")).cast("long")}).select(*OUT).orderBy("row_id")


def _asked(a: DataFrame, b: DataFrame, first: bool, min_confidence: float, accent_fold: bool, linked: Linked | None, keys: bool) -> DataFrame:
    """Pairs (a_id or b_id, uuid, hh_id, confidence) that tell each person's best household, of A4 or of the given links.

    Persons of names that are linked as classes have two at most, so that no list of all pairs is made.
    """
    plain, by_names = (None, linked) if linked is not None else fuzzy_parts(a, b, middle=False, accent_fold=accent_fold, keys=keys)
    confidence = (F.col("score") / 100).cast("float")
    person = "a_id" if first else "b_id"
    out = []
    if plain is not None:
        out.append(_of_pairs(plain.withColumn("confidence", confidence), person, min_confidence))
    if by_names is not None:
        out.append(_nearest(by_names, first, min_confidence))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _nearest(linked: Linked, first: bool, min_confidence: float) -> DataFrame:
    links = linked.links.withColumn("confidence", (F.col("score") / 100).cast("float")).filter(F.col("confidence") >= F.lit(min_confidence).cast("float"))
    one = linked.one.filter("a_uuid is not null").withColumn("uuid", F.col("a_uuid"))
    near = replace(linked, one=one, two=linked.two.withColumn("hh_id", household_key("b_")), links=links)
    return near.nearest("a" if first else "b", "hh_id" if first else "uuid", "confidence").select("a_id" if first else "b_id", "uuid", "hh_id", "confidence")


def best_pairs(linked: Linked, algorithm: int, min_confidence: float) -> DataFrame:
    """Pairs (a_id for A5, b_id for A6, uuid, hh_id, confidence) that tell each person's best household of these links, two at most."""
    return _nearest(linked, algorithm == 5, min_confidence)


def _of_pairs(pairs: DataFrame, person: str, min_confidence: float) -> DataFrame:
    told = pairs.filter(F.col("a_uuid").isNotNull() & (F.col("confidence") >= F.lit(min_confidence).cast("float")))
    return told.select(person, F.col("a_uuid").alias("uuid"), household_key("b_").alias("hh_id"), "confidence")


def household_t1(a: DataFrame, b: DataFrame, *, min_confidence: float = 0.95, pairs: DataFrame | None = None, linked: Linked | None = None, accent_fold: bool = True, keys: bool = False) -> DataFrame:
    """A5: for each household of the first table (uuid), the share of its persons found in one of the second (hh_id).

    pairs, linked: the pairs to roll up, or links (with score) of both tables' persons, instead of A4's; keys: as fuzzy_pairs.
    """
    told = _asked(a, b, True, min_confidence, accent_fold, linked, keys) if pairs is None else _of_pairs(pairs, "a_id", min_confidence)
    return rolled(_found(_best(told, "a_id", "hh_id", ["uuid"]), "a_id"), sizes_t1(a), "uuid")


def household_t2(a: DataFrame, b: DataFrame, *, min_confidence: float = 0.95, pairs: DataFrame | None = None, linked: Linked | None = None, accent_fold: bool = True, keys: bool = False) -> DataFrame:
    """A6: for each household of the second table, the share of its persons found in one of the first; pairs, linked: as above."""
    told = _asked(a, b, False, min_confidence, accent_fold, linked, keys) if pairs is None else _of_pairs(pairs, "b_id", min_confidence)
    return rolled(_found(_best(told, "b_id", "uuid", ["hh_id"]), "b_id"), sizes_t2(b), "hh_id")


#: Classes of a household's persons up to which households of equal persons are told by them.
SAME = 64


def _alike(counts: DataFrame, household: str, told: list[str]) -> DataFrame:
    """Households with rep, the least household that has the same rows of told, and these rows (entries); staged.

    Only such households stand for each other; one of more than SAME rows stands for itself, and its rows aren't gathered.
    """
    own = counts.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy(household)) > SAME)
    lists = own.groupBy(household).agg(F.sort_array(F.collect_list(F.when(~F.col("many"), F.struct(*told)))).alias("entries"), F.max(F.when(F.col("many"), F.col(household))).alias("alone"))
    rep = F.min(household).over(Window.partitionBy("entries", "alone"))
    return staged(lists.select(household, rep.alias("rep"), F.col("alone").isNotNull().alias("alone"), "entries"), "alike")


def _entries(alike: DataFrame, counts: DataFrame, household: str, told: list[str]) -> DataFrame:
    """The rows of households that stand for others and for themselves: rep and told."""
    some = alike.filter(F.col(household) == F.col("rep"))
    listed = some.filter("not alone").select("rep", F.inline("entries"))
    return listed.unionByName(counts.join(some.filter("alone").select(household), household, "left_semi").select(F.col(household).alias("rep"), *told))


def household_sql(a: DataFrame, b: DataFrame, *, extras: tuple[str, ...] = ()) -> DataFrame:
    """The exact-name variant: matched pairs of a uuid and hh_id over the household's size, over one half.

    Pairs of persons are counted by their names, and households of equal persons together, so that only the result
    has a row for each pair of households, as the last join's output.
    """
    key, most = ["first_name", "last_name", "birthdate"], [f"most_{i}" for i in range(len(extras))]
    sizes = a.filter("uuid is not null").groupBy("uuid").agg(F.count(F.lit(1)).alias("size"))
    known = [t.filter(f"{h} is not null").dropna(subset=key) for t, h in ((a, "uuid"), (b, "hh_id"))]
    names = [t.select(*key).distinct() for t in known]
    mine = known[0].join(names[1], key, "left_semi").groupBy("uuid", *key).agg(F.count(F.lit(1)).alias("na"), *[F.max(c).alias(m) for c, m in zip(extras, most, strict=True)])
    theirs = known[1].join(names[0], key, "left_semi").groupBy("hh_id", *key).agg(F.count(F.lit(1)).alias("nb"))
    # The size is told with each row, so that households of equal rows have equal shares.
    mine, told = mine.join(sizes, "uuid"), [[*key, "na", "size", *most], [*key, "nb"]]
    alike = [_alike(t, h, c) for t, h, c in zip((mine, theirs), ("uuid", "hh_id"), told, strict=True)]
    one, two = (_entries(t, n, h, c).withColumnRenamed("rep", f"{p}_rep") for t, n, h, c, p in zip(alike, (mine, theirs), ("uuid", "hh_id"), told, ("a", "b"), strict=True))
    found = one.join(two, key).groupBy("a_rep", "b_rep").agg(F.sum(F.col("na") * F.col("nb")).alias("found"), F.max("size").alias("size"), *[F.max(m).alias(c) for c, m in zip(extras, most, strict=True)])
    share = F.col("found").cast("double") / F.col("size")
    links = found.filter(share > 0.5).select("a_rep", "b_rep", *extras, (share * 100).cast("decimal(10,2)").alias("match_percentage"))
    persons = [t.select(F.col("rep").alias(f"{p}_rep"), h) for t, p, h in zip(alike, ("a", "b"), ("uuid", "hh_id"), strict=True)]
    linked = Linked(*persons, staged(links, "links"), ("rep",))
    return linked.pairs(second=linked.shorter()).select("uuid", "hh_id", *extras, "match_percentage")
