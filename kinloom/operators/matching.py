"""Person matching: exact and fuzzy joins of two person tables.

Every rule needs equal birthdates, so every join is an equi-join that Catalyst plans; hot birthdates are split by the
adaptive skew join.  Derived columns are computed once for each person, below the join.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions.normalize import normalize_text
from kinloom.functions.phonetic import first_char_initial
from kinloom.operators import rules
from kinloom.operators.linked import Linked
from kinloom.operators.prepared import coded, full_names, normalized, scored_names, side, spread
from kinloom.schema import NAMES
from kinloom.storage import staged

FIELDS_1 = ["id", "uuid", "first_name", "last_name", "birthdate"]
FIELDS_2 = ["id", "uuid", "first_name", "middle_name", "last_name", "birthdate"]


def pair_columns(pairs: DataFrame) -> list:
    """Both persons' canonical columns, a_* and b_*."""
    return [F.col(f"{p}_{n}") for p in ("a", "b") for n in NAMES if f"{p}_{n}" in pairs.columns]


def to_pairs(pairs: DataFrame, score, fields, *, flag: str) -> DataFrame:
    """The pair relation: persons, confidence (0 to 1, float), matched_fields, and the flag of the rule that matched."""
    return pairs.select(
        *pair_columns(pairs), (score / 100).cast("float").alias("confidence"), fields.alias("matched_fields"), F.lit(flag == "infnbd").alias("is_matched_infnbd"), F.lit(flag == "infnmnbd").alias("is_matched_infnmnbd")
    )


def exact_side(persons: DataFrame, punctuation: bool = False) -> DataFrame:
    """persons with normalised names, of those that exact rules can match."""
    return normalized(persons, punctuation=punctuation).filter("n_first is not null and n_last is not null and birthdate is not null")


def _exact(a: DataFrame, b: DataFrame, middle: bool, punctuation: bool) -> DataFrame:
    one, two = (side(exact_side(t, punctuation), p) for t, p in ((a, "a"), (b, "b")))
    on = (F.col("a_n_first") == F.col("b_n_first")) & (F.col("a_n_last") == F.col("b_n_last")) & (F.col("a_birthdate") == F.col("b_birthdate"))
    if middle:
        on = on & F.col("a_n_mid").eqNullSafe(F.col("b_n_mid"))
    return one.join(two, on)


def exact_linked(a: DataFrame, b: DataFrame, *, middle: bool, punctuation: bool = False) -> Linked:
    """A1, or with middle names A2, as classes that match where they are equal; n_mid_key is the middle name's, never null."""
    one, two = (exact_side(spread(t), punctuation).withColumn("n_mid_key", middle_key()) for t in (a, b))
    return Linked(side(one, "a"), side(two, "b"), None, exact_class(middle))


def exact_class(middle: bool) -> tuple[str, ...]:
    return ("n_first", "n_last", "birthdate", *(["n_mid_key"] if middle else []))


def middle_key() -> Column:
    """Equal where middle names are equal or both are missing."""
    return F.coalesce(F.concat(F.lit("="), F.col("n_mid")), F.lit(""))


def exact_pairs(pairs: DataFrame, *, middle: bool) -> DataFrame:
    """Joined persons as pairs of A1, or with middle names A2."""
    return to_pairs(pairs, F.lit(100.0), F.array(*map(F.lit, FIELDS_2 if middle else FIELDS_1)), flag="infnmnbd" if middle else "infnbd")


def exact_first_last_dob(a: DataFrame, b: DataFrame, *, punctuation: bool = False) -> DataFrame:
    """A1: equal normalised first name, last name and birthdate, none of them null."""
    return exact_pairs(_exact(a, b, False, punctuation), middle=False)


def exact_first_mid_last_dob(a: DataFrame, b: DataFrame, *, punctuation: bool = False) -> DataFrame:
    """A2: A1, and equal middle names, or neither has one."""
    return exact_pairs(_exact(a, b, True, punctuation), middle=True)


def _initial(prefix: str) -> Column:
    return F.coalesce(first_char_initial(normalize_text(F.col(f"{prefix}last_name"))), F.lit(""))


#: Pairs of persons of one birthdate from which its different names are compared.
NAMED_FROM = 10_000
#: Pairs of different names of one birthdate from which they meet by keys.
HEAVY = 250_000
#: Groups that names of one heavy birthdate are dealt to where names of other scripts meet everyone.
DEALT = 16


def heavy_dates(a: DataFrame, b: DataFrame, least: int) -> DataFrame | None:
    """The birthdates that make at least so many pairs, with their number (pairs), written; None if there are none.

    Runs jobs over the birthdates of both tables.  Such dates are in the calendar: of all years from 1 to 9999 it has under four million.
    """
    one, two = (t.filter("birthdate is not null").groupBy("birthdate").agg(F.count(F.lit(1)).alias(n)) for t, n in ((a, "na"), (b, "nb")))
    dates = staged(one.join(two, "birthdate").select("birthdate", (F.col("na") * F.col("nb")).alias("pairs")).filter(F.col("pairs") >= least), "heavy")
    return None if dates.isEmpty() else dates


def _edits(n: Column) -> Column:
    """The most edits between a name of ASCII of n characters and any that is alike by PASS percent."""
    return F.floor(F.floor(n * 100 / F.lit(rules.PASS)) * F.lit(100 - rules.PASS) / 100).cast("int")


def _part(n: Column, edits: Column, i: Column) -> tuple[Column, Column]:
    """Place (from 1) and length of the i-th of the edits + 1 parts of a name of n characters."""
    at = lambda k: F.floor(n * k / (edits + 1)).cast("int")
    return at(i) + 1, at(i + 1) - at(i)


def _range(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))


def name_keys(held: bool) -> Column:
    """Keys of full, such that a held name and an asking one share a key if they can match.

    A held name of ASCII is cut into one part more than the edits that a match may need; one part is whole in the other
    name, and moved by no more than these edits.  Its keys are the parts, each with the name's length.  An asking name has
    the stretches of it that could be such a part of a held name, for every length that such a name can have.  Names of equal
    code share that.  Other names meet everyone: they are in every one of DEALT groups of the other side, whose names are in one.
    """
    full, n = F.col("full"), F.length("full")
    none = F.array().cast("array<bigint>")
    key = lambda length, i, at, size: F.xxhash64(length, i, F.substr(full, at, size))
    if held:
        own = F.transform(_range(F.lit(0), _edits(n)), lambda i: key(n, i, *_part(n, _edits(n), i)))
    else:

        def stretches(length: Column, i: Column) -> Column:
            at, size = _part(length, _edits(length), i)
            return F.transform(_range(F.greatest(at - _edits(length), F.lit(1)), F.least(at + _edits(length), n - size + 1)), lambda p: key(length, i, p, size))

        lengths = _range(F.ceil(n * F.lit(rules.PASS) / 100).cast("int"), F.floor(n * 100 / F.lit(rules.PASS)).cast("int"))
        own = F.flatten(F.transform(lengths, lambda length: F.flatten(F.transform(_range(F.lit(0), _edits(length)), lambda i: stretches(length, i)))))
    code = F.coalesce(F.when(F.col("code") != "", F.array(F.xxhash64(F.lit("code"), "code"))), none)
    dealt = F.pmod(F.xxhash64("full"), F.lit(DEALT))
    group = lambda side: F.array(F.xxhash64(F.lit(side), dealt))
    groups = lambda side: F.array(*[F.xxhash64(F.lit(side), F.lit(i).cast("bigint")) for i in range(DEALT)])
    ascii_ = F.octet_length("full") == n
    # Asking names of ASCII wait in "asking" for held ones of other scripts; all held names wait in "held" for asking ones of other scripts.
    if held:
        return F.array_distinct(F.when(ascii_, F.concat(own, code, group("held"))).otherwise(F.concat(groups("asking"), group("held"))))
    return F.array_distinct(F.when(ascii_, F.concat(own, code, group("asking"))).otherwise(groups("held")))


def keyed(scored: DataFrame, heavy: DataFrame | None, *, held: bool) -> DataFrame:
    """scored names with heavy, keys and key, a row for each key: one, 0, on light birthdates, and name_keys on heavy ones.

    heavy: a table of birthdates, which is broadcast; None: all of them.
    """
    told = scored.withColumn("heavy", F.lit(True)) if heavy is None else scored.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), "birthdate", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    light = F.array(F.lit(0).cast("bigint"))
    # Outer, as Spark puts a filter of the keys, and so the codes once more, below an explode; no row is without a key.
    return told.withColumn("keys", F.when(F.col("heavy"), name_keys(held)).otherwise(light)).withColumn("key", F.explode_outer("keys"))


def met(one: DataFrame, two: DataFrame) -> DataFrame:
    """Pairs of keyed sides (columns a_*, b_*) of equal birthdate that share a key, once: under the least that they share."""
    on = (F.col("a_birthdate") == F.col("b_birthdate")) & (F.col("a_key") == F.col("b_key"))
    once = ~F.col("a_heavy") | (F.col("a_key") == F.array_min(F.array_intersect("a_keys", "b_keys")))
    return one.join(two, on).filter(once).drop(*[f"{p}_{c}" for p in ("a", "b") for c in ("key", "keys", "heavy")])


def named(middle: bool, last_initial: bool = False) -> list[str]:
    """The columns of compared names: persons who have them equal have the same matches."""
    return ["birthdate", "s_first", *(["s_mid"] if middle else []), "s_last", "full", *(["s_initial"] if last_initial else [])]


def _by_names(a: DataFrame, b: DataFrame, dates: DataFrame | None, *, middle: bool, accent_fold: bool, heavy: int, last_initial: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Persons of those birthdates (None: all) of both sides (a_*, b_*), and the pairs of their different names that can match.

    The different names are written; only they get codes and are compared: all of a birthdate, or by keys where that makes
    `heavy` pairs.
    """
    own = [t if dates is None else t.join(F.broadcast(dates.select("birthdate")), "birthdate", "left_semi") for t in (a, b)]
    persons = [full_names(t, middle=middle, accent_fold=accent_fold) for t in own]
    if last_initial:
        persons = [t.withColumn("s_initial", _initial("")) for t in persons]
    names = [spread(staged(t.select(*named(middle, last_initial)).distinct(), "names"), "full") for t in persons]
    many = heavy_dates(*names, heavy)
    if many is None:
        pairs = [side(coded(t), p) for t, p in zip(names, ("a", "b"), strict=True)]
        met_names = pairs[0].join(pairs[1], F.col("a_birthdate") == F.col("b_birthdate"))
    else:
        met_names = met(*[side(keyed(coded(t), many.select("birthdate"), held=held), p) for t, p, held in zip(names, ("a", "b"), (False, True), strict=True)])
    if last_initial:
        met_names = met_names.filter("a_s_initial = b_s_initial")
    return side(persons[0], "a"), side(persons[1], "b"), met_names


def linked(a: DataFrame, b: DataFrame, dates: DataFrame | None, *, middle: bool, accent_fold: bool, heavy: int, last_initial: bool = False) -> Linked:
    """Persons of those birthdates (None: all) and the links (score, label) of their names, of equal last initial on request."""
    one, two, names = _by_names(a, b, dates, middle=middle, accent_fold=accent_fold, heavy=heavy, last_initial=last_initial)
    return Linked(one, two, rules.classify(names, middle=middle), tuple(named(middle, last_initial)))


def _confident(scored: DataFrame, least: float) -> DataFrame:
    return scored.filter((F.col("score") / 100).cast("float") >= F.lit(least).cast("float")) if least > 0 else scored


def confident(linked: Linked, least: float) -> Linked:
    """The links of at least this confidence, compared as floats."""
    return linked if linked.links is None else replace(linked, links=_confident(linked.links, least))


def linked_pairs(linked: Linked) -> DataFrame:
    """All pairs of links of A1 to A4, as their match gives them."""
    if linked.links is None:
        return exact_pairs(linked.pairs(), middle="n_mid_key" in linked.by)
    return _fuzzy(linked.pairs(), 0.0)


def fuzzy_parts(a: DataFrame, b: DataFrame, *, middle: bool, accent_fold: bool = True, last_initial: bool = False, keys: bool = False, heavy: int | None = HEAVY) -> tuple[DataFrame | None, Linked | None]:
    """Classified pairs of persons of light birthdates, and the links of names of the others; None where there are none of a kind."""
    a, b = spread(a), spread(b)
    same = lambda on: on & (_initial("a_") == _initial("b_")) if last_initial else on
    dates = None if keys or heavy is None else heavy_dates(a, b, min(heavy, NAMED_FROM))
    plain = by_names = None
    if not keys:
        light = [t if dates is None else t.join(F.broadcast(dates.select("birthdate")), "birthdate", "left_anti") for t in (a, b)]
        one, two = (side(scored_names(t, middle=middle, accent_fold=accent_fold), p) for t, p in zip(light, ("a", "b"), strict=True))
        plain = rules.classify(one.join(two, same(F.col("a_birthdate") == F.col("b_birthdate"))), middle=middle)
    if keys or dates is not None:
        by_names = linked(a, b, dates, middle=middle, accent_fold=accent_fold, heavy=HEAVY if heavy is None else heavy, last_initial=last_initial)
    return plain, by_names


def fuzzy_shown(parts: tuple[DataFrame | None, Linked | None], one: list[Column], two: list[Column], told: list[Column], *, min_confidence: float = 0.0) -> DataFrame:
    """These columns of fuzzy_parts' pairs: one and two of persons (a_*, b_*), told of score and label.

    Of names that are linked as classes they are made once for each person and link, not for each pair.
    """
    plain, by_names = parts
    out = []
    if plain is not None:
        out.append(_confident(plain, min_confidence).select(*one, *two, *told))
    if by_names is not None:
        shown = confident(by_names, min_confidence).shown(one, two, told)
        classes = {f"{p}_{c}" for p in ("a", "b") for c in shown.by}
        out.append(shown.pairs().select(*[c for t in (shown.one, shown.two, shown.links) for c in t.columns if c not in classes]))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def fuzzy_pairs(a: DataFrame, b: DataFrame, *, middle: bool, accent_fold: bool = True, last_initial: bool = False, keys: bool = False, heavy: int | None = HEAVY) -> DataFrame:
    """Classified pairs (score, label) of equal birthdate, with both sides' persons and compared names (columns a_*, b_*).

    Persons of a birthdate that makes fewer than NAMED_FROM pairs (`heavy`, if that is less) are all compared.  Of another, such
    as a default for unknown dates, the different names are compared, and persons then get the matches of their names;
    where these make `heavy` pairs, only names that share a key (name_keys) are.  No match is lost, and comparisons don't grow with
    the square of the persons.  keys: names are compared on all birthdates; heavy=None: on none.  A number for heavy
    runs jobs over the birthdates while the plan is made; where no birthdate has so many, the plan is that of None.
    last_initial: the first characters of the last names have to agree as well (two persons without last name do), and are part
    of the join's key.
    """
    plain, by_names = fuzzy_parts(a, b, middle=middle, accent_fold=accent_fold, last_initial=last_initial, keys=keys, heavy=heavy)
    if by_names is None:
        return plain
    both = by_names.pairs().drop("a_s_initial", "b_s_initial")
    return both if plain is None else plain.unionByName(both)


def compared_pairs(a: DataFrame, b: DataFrame, *, middle: bool, accent_fold: bool = True, heavy: int | None = HEAVY) -> DataFrame:
    """One row: the pairs of persons of light birthdates and of different names of the others that fuzzy_pairs compares."""
    dates = None if heavy is None else heavy_dates(a, b, min(heavy, NAMED_FROM))
    one, two = (t.filter("birthdate is not null") for t in (a, b))
    light = one if dates is None else one.join(F.broadcast(dates.select("birthdate")), "birthdate", "left_anti")
    counts = [t.groupBy("birthdate").agg(F.count(F.lit(1)).alias(n)) for t, n in ((light, "na"), (two, "nb"))]
    plain = counts[0].join(counts[1], "birthdate").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("persons"))
    names = 0 if dates is None else _by_names(a, b, dates, middle=middle, accent_fold=accent_fold, heavy=heavy)[2].count()
    return plain.withColumn("names", F.lit(names).cast("long"))


def _fuzzy(pairs: DataFrame, min_confidence: float) -> DataFrame:
    out = to_pairs(pairs, F.col("score"), F.array(F.lit("fuzzy"), F.col("label"), F.lit("birthdate")), flag="fuzzy")
    return out.filter(F.col("confidence") >= F.lit(min_confidence).cast("float")) if min_confidence > 0 else out


def fuzzy(a: DataFrame, b: DataFrame, *, min_confidence: float = 0.0, **how) -> DataFrame:
    """A3: equal birthdates, and first, middle and last name by the case rule; how: as fuzzy_pairs."""
    return _fuzzy(fuzzy_pairs(a, b, middle=True, **how), min_confidence)


def fuzzy_no_middle(a: DataFrame, b: DataFrame, *, min_confidence: float = 0.0, **how) -> DataFrame:
    """A4: A3 without middle names."""
    return _fuzzy(fuzzy_pairs(a, b, middle=False, **how), min_confidence)
