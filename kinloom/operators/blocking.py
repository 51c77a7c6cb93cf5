"""Blocked candidate joins: year of birth, initials and Soundex, with fallbacks for persons that find nothing.

A person of the first table asks for several keys, each with a tier.  A lower tier counts only where the tiers above
brought no candidate at all, before any birthdate is compared.  Which tiers count depends on a person's block alone, so
they are settled over the different blocks of both tables; persons then get the keys of their block, and pairs are made once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions import phonetic
from kinloom.functions.similarity import birthdate_similarity_pct, composite_score
from kinloom.operators import rules
from kinloom.operators.linked import Linked
from kinloom.operators.matching import _fuzzy, confident, named, to_pairs
from kinloom.operators.prepared import coded, full_names, normalized, side, small, spread
from kinloom.storage import staged


def block_columns(persons: DataFrame) -> DataFrame:
    """persons with year, fi, li, sx; those without birthdate, first or last name have no block."""
    n = normalized(persons).filter("birthdate is not null and n_first is not null and n_last is not null")
    return n.withColumns({"year": F.year("birthdate"), "fi": phonetic.ascii_initial(F.col("n_first")), "li": phonetic.ascii_initial(F.col("n_last")), "sx": phonetic.soundex4(F.col("n_last"))})


KEY = ["year", "fi", "li", "sx"]


def _key(year: Column, fi: Column, sx: Column, tier: int) -> Column:
    return F.struct(year.alias("year"), fi.alias("fi"), F.col("li").alias("li"), sx.alias("sx"), F.lit(tier).alias("tier"))


def _asked(a: DataFrame, b: DataFrame, keys: list[Column]) -> DataFrame:
    """The keys (ask) of each different block of the first table under which the second table has someone; no person is there."""
    blocks = a.select(*KEY).distinct()
    asked = blocks.select(F.struct(*KEY).alias("block"), F.inline(F.array_compact(F.array(*keys))))
    return asked.join(b.select(*KEY).distinct(), KEY)


def _pairs(a: DataFrame, b: DataFrame, settled: DataFrame, *, same_birthdate: bool) -> DataFrame:
    """Candidate pairs (a_*, b_*) of the keys that were settled for each block."""
    ask = settled.select(*[F.col(f"block.{k}").alias(f"a_{k}") for k in KEY], *[F.col(k).alias(f"b_{k}") for k in KEY])
    named = side(a, "a").join(ask, [f"a_{k}" for k in KEY])
    on = [f"b_{k}" for k in KEY]
    two = side(b, "b")
    if same_birthdate:
        named, two, on = named.withColumn("date", F.col("a_birthdate")), two.withColumn("date", F.col("b_birthdate")), [*on, "date"]
    # Else the few keys may stay one task, in which all pairs of two small tables are made.
    if small(a):
        named = named.repartition(a.sparkSession.sparkContext.defaultParallelism, *on)
    return named.join(two, on).select(*side(a, "a").columns, *two.columns).drop("date")


def blocked_candidates(a: DataFrame, b: DataFrame, *, same_birthdate: bool = False) -> DataFrame:
    """Tier 1: same year, initials and Soundex; 2: a partner without a first initial; 3: the coarse Soundex.

    Each person meets its lowest tier that isn't empty.  same_birthdate: of those only persons of its birthdate.
    """
    year, fi, sx = F.col("year"), F.col("fi"), F.col("sx")
    coarse = phonetic.coarse_soundex(sx)
    asked = _asked(a, b, [_key(year, fi, sx, 1), F.when(fi != "?", _key(year, F.lit("?"), sx, 2)), F.when(sx != coarse, _key(year, fi, coarse, 3))])
    lowest = asked.withColumn("lowest", F.min("tier").over(Window.partitionBy("block"))).filter("tier = lowest")
    return _pairs(a, b, lowest, same_birthdate=same_birthdate)


def neighbour_year_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tiers 1 and 2 as above; the years before and after always count (3); the coarse Soundex if nothing else does (4)."""
    year, fi, sx = F.col("year"), F.col("fi"), F.col("sx")
    coarse = phonetic.coarse_soundex(sx)
    keys = [_key(year, fi, sx, 1), F.when(fi != "?", _key(year, F.lit("?"), sx, 2)), _key(year - 1, fi, sx, 3), _key(year + 1, fi, sx, 3), F.when(sx != coarse, _key(year, fi, coarse, 4))]
    asked, own = _asked(a, b, keys), Window.partitionBy("block")
    has = {f"has_{t}": F.max((F.col("tier") == t).cast("int")).over(own) for t in (1, 2, 3)}
    counts = (F.col("tier").isin(1, 3)) | ((F.col("tier") == 2) & (F.col("has_1") == 0)) | ((F.col("tier") == 4) & (F.col("has_1") + F.col("has_2") + F.col("has_3") == 0))
    return _pairs(a, b, asked.withColumns(has).filter(counts), same_birthdate=False)


#: What a class of blocked persons has equal besides its names.
_OWN = ["fi", "li", "sx"]


def _linked(a: DataFrame, b: DataFrame, by: list[str], candidates: Callable[[DataFrame, DataFrame], DataFrame], coded_names: Callable[[DataFrame], DataFrame], linking: Callable[[DataFrame], DataFrame]) -> Linked:
    """Persons with names and blocks, and the links of their classes: different names of a birthdate and block meet, not persons."""
    by = [*by, *_OWN]
    classes = [coded_names(spread(staged(t.select(*by, "year").distinct(), "names"), "sx")) for t in (a, b)]
    links = linking(candidates(*classes))
    on = [f"{p}_{c}" for p in ("a", "b") for c in by]
    return Linked(side(a, "a"), side(b, "b"), links.select(*on, *[c for c in links.columns if not c.startswith(("a_", "b_"))]), tuple(by))


def _named(persons: DataFrame, accent_fold: bool, middle: bool = False) -> DataFrame:
    return block_columns(full_names(spread(persons), middle=middle, accent_fold=accent_fold))


def _same_date(a: DataFrame, b: DataFrame) -> DataFrame:
    return blocked_candidates(a, b, same_birthdate=True)


def linked_blocked(a: DataFrame, b: DataFrame, *, middle: bool = False, accent_fold: bool = True) -> Linked:
    """fuzzy_blocked's pairs as links of classes, with score and label."""
    one, two = (_named(t, accent_fold, middle) for t in (a, b))
    return _linked(one, two, named(middle), _same_date, coded, lambda pairs: rules.classify(pairs, middle=middle))


def fuzzy_blocked(a: DataFrame, b: DataFrame, *, middle: bool = False, min_confidence: float = 0.0, accent_fold: bool = True) -> DataFrame:
    """A4 (with middle names A3) over blocked candidates with equal birthdates; a subset of what the unblocked rule finds."""
    return _fuzzy(linked_blocked(a, b, middle=middle, accent_fold=accent_fold).pairs(), min_confidence)


def linked_reclassified(a: DataFrame, b: DataFrame, *, accent_fold: bool = True) -> Linked:
    """fuzzy_blocked_reclassified's pairs as links of classes, with score and label."""

    def both(persons: DataFrame) -> DataFrame:
        """Names with middle names (full_3) and without them (full_4), below the join."""
        three = full_names(spread(persons), middle=True, accent_fold=accent_fold).withColumnRenamed("full", "full_3")
        four = full_names(three.drop("s_first", "s_mid", "s_last"), middle=False, accent_fold=accent_fold)
        return block_columns(four.withColumnRenamed("full", "full_4"))

    def codes(names: DataFrame) -> DataFrame:
        for n in (3, 4):
            names = coded(names.withColumn("full", F.col(f"full_{n}"))).withColumnRenamed("code", f"code_{n}")
        return names.drop("full")

    def by(pairs: DataFrame, n: int) -> DataFrame:
        return pairs.withColumns({f"{p}_{c}": F.col(f"{p}_{c}_{n}") for p in ("a", "b") for c in ("full", "code")})

    def linking(pairs: DataFrame) -> DataFrame:
        three = rules.classify(by(pairs, 3), middle=True).drop("label", "score")
        return rules.classify(by(three, 4), middle=False)

    names = ["birthdate", "s_first", "s_mid", "s_last", "full_3", "full_4"]
    return _linked(both(a), both(b), names, _same_date, codes, linking)


def fuzzy_blocked_reclassified(a: DataFrame, b: DataFrame, *, min_confidence: float = 0.0, accent_fold: bool = True) -> DataFrame:
    """Pairs that blocked A3 finds and A4 accepts as well, with A4's label and score."""
    return _fuzzy(linked_reclassified(a, b, accent_fold=accent_fold).pairs(), min_confidence)


def linked_birthdate(a: DataFrame, b: DataFrame, *, min_confidence: float = 0.0, accent_fold: bool = True) -> Linked:
    """fuzzy_birthdate's pairs as links of classes, with score and fields."""

    def linking(pairs: DataFrame) -> DataFrame:
        alike = rules.classify(pairs, middle=False).withColumn("bd", birthdate_similarity_pct(F.col("a_birthdate"), F.col("b_birthdate")))
        score = composite_score(F.col("score"), F.col("bd"))
        fields = F.array(F.lit("fuzzy7"), F.col("label"), F.format_string("birthdate:%.0f%%", F.col("bd")))
        return alike.withColumns({"score": score, "fields": fields}).drop("label", "bd")

    return confident(_linked(*(_named(t, accent_fold) for t in (a, b)), named(False), neighbour_year_candidates, coded, linking), min_confidence)


def fuzzy_birthdate(a: DataFrame, b: DataFrame, *, min_confidence: float = 0.0, accent_fold: bool = True) -> DataFrame:
    """A7 (deprecated): blocked names by the case rule, scored together with the birthdates' similarity."""
    pairs = linked_birthdate(a, b, min_confidence=min_confidence, accent_fold=accent_fold).pairs()
    return to_pairs(pairs, F.col("score"), F.col("fields"), flag="fuzzy7")


def candidate_estimate(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: the number of pairs that a join on keys compares, and its largest block.  No pair is made."""
    one, two = (t.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for t, n in ((a, "na"), (b, "nb")))
    product = F.col("na") * F.col("nb")
    return one.join(two, keys).agg(F.coalesce(F.sum(product), F.lit(0)).cast("long").alias("candidates"), F.coalesce(F.max(product), F.lit(0)).cast("long").alias("largest_block"), F.count(F.lit(1)).alias("blocks"))
