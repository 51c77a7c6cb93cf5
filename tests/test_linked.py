"""Pairs as links of classes: what is compared and shuffled doesn't grow with the square of the persons."""

import pytest
from pyspark.sql import functions as F

from kinloom.generate import dirty_dataset
from kinloom.operators import blocking, household, matching
from kinloom.schema import PERSON


@pytest.fixture(scope="module")
def tables(spark):
    """Two tables whose persons are there 12 times, with ids and households of their own."""
    copies = lambda t: t.crossJoin(F.broadcast(spark.range(12).withColumnRenamed("id", "n"))).withColumns({"id": F.col("id") * 12 + F.col("n"), "uuid": F.concat("uuid", F.lit("-"), F.col("n").cast("string")), "hh_id": F.concat("hh_id", F.lit("-"), (F.col("n") % 3).cast("string"))}).select(*[f.name for f in PERSON])
    return tuple(copies(t).cache() for t in dirty_dataset(spark, 60))


def rows_of(pairs):
    return sorted((r["a_id"], r["b_id"], round(r["confidence"], 6), tuple(r["matched_fields"])) for r in pairs.collect())


def test_copies_are_compared_once(spark, tables):
    by_names = matching.fuzzy_parts(*tables, middle=False, keys=True)[1]
    links = by_names.links.count()
    assert links * 100 < by_names.pairs().count()  # 12 by 12 copies of every pair


@pytest.mark.parametrize("run", [household.household_t1, household.household_t2])
def test_households_of_links_are_those_of_pairs(spark, tables, run):
    a, b = tables
    pairs = matching.fuzzy_no_middle(a, b, heavy=None)
    assert [tuple(r) for r in run(a, b, keys=True).collect()] == [tuple(r) for r in run(a, b, pairs=pairs).collect()]


def test_households_never_list_their_pairs(spark, tables):
    a, b = tables
    for first in (True, False):
        told = household._asked(a, b, first, 0.95, True, None, True)
        assert told.count() <= 2 * (a if first else b).count()


def test_a_household_without_id_is_no_ones_match(spark):
    d = "date '1990-01-01'"
    a = spark.sql(f"select * from values (1L, 'u1', 'Ann', null, 'Lee', {d}, null), (2L, null, 'Ann', null, 'Lee', {d}, null), (3L, 'u2', 'Bob', null, 'Ray', {d}, null), (4L, 'u3', 'Bob', null, 'Ray', {d}, null)").toDF(*[f.name for f in PERSON])
    b = spark.sql(f"select * from values (11L, null, 'Ann', null, 'Lee', {d}, 'h1'), (12L, null, 'Bob', null, 'Ray', {d}, null)").toDF(*[f.name for f in PERSON])
    for run in (household.household_t1, household.household_t2):
        assert [tuple(r) for r in run(a, b, keys=True).collect()] == [tuple(r) for r in run(a, b, pairs=matching.fuzzy_no_middle(a, b, heavy=None)).collect()]


def person_pairs(a, b, candidates, middle):
    """Blocked pairs of persons, compared one by one."""
    from kinloom.operators import rules
    from kinloom.operators.prepared import scored_names

    one, two = (blocking.block_columns(scored_names(t, middle=middle)) for t in (a, b))
    return rules.classify(candidates(one, two), middle=middle)


@pytest.mark.parametrize("middle", [False, True])
def test_blocked_classes_are_compared_once(spark, tables, middle):
    a, b = tables
    linked = blocking.linked_blocked(a, b, middle=middle)
    want = person_pairs(a, b, lambda x, y: blocking.blocked_candidates(x, y, same_birthdate=True), middle)
    assert rows_of(matching._fuzzy(linked.pairs(), 0.0)) == rows_of(matching._fuzzy(want, 0.0))
    assert linked.links.count() * 100 < want.count()


def test_neighbour_years_by_classes(spark, tables):
    a, b = tables
    want = person_pairs(a, b, blocking.neighbour_year_candidates, False)
    got = blocking.fuzzy_birthdate(a, b)
    assert sorted(map(tuple, got.select("a_id", "b_id").collect())) == sorted(map(tuple, want.select("a_id", "b_id").collect()))
    assert "ArrowEvalPython [_jaro_winkler_pct" in (plan := got._jdf.queryExecution().executedPlan().toString())
    assert plan.index("Join") < plan.index("ArrowEvalPython [_jaro_winkler_pct")  # persons get the matches of their classes afterwards


def above_the_last_join(df):
    """What the plan does with pairs, after they are made."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan[: plan.index("Join")]


RENDERING = ("round(", "array_join(", "concat_ws(", "format_string(", "as float", "as string")


def test_birthdate_pairs_show_what_their_links_tell(spark, tables):
    from kinloom.plans import catalog

    got = catalog._linked_out(blocking.linked_birthdate(*tables), F.array_join("fields", ","))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, catalog._pairs_out(blocking.fuzzy_birthdate(*tables)).collect()))
    least = blocking.fuzzy_birthdate(*tables, min_confidence=0.97)
    assert 0 < least.count() == blocking.fuzzy_birthdate(*tables).filter(F.col("confidence") >= F.lit(0.97).cast("float")).count() < got.count()
    for df in (got, catalog.fuzzy_birthdate(spark, "/root/testdata/sf0.001")):
        assert not [r for r in RENDERING if r in above_the_last_join(df)]


@pytest.mark.parametrize("least", [0.0, 0.97])
def test_fuzzy_pairs_show_what_their_names_tell(tables, least):
    from kinloom.plans import catalog

    for how in ({"heavy": 1}, {"heavy": 2000}, {"keys": True}, {"heavy": None}):
        got = catalog._fuzzy_out(matching.fuzzy_parts(*tables, middle=False, **how), min_confidence=least)
        want = catalog._pairs_out(matching.fuzzy_no_middle(*tables, min_confidence=least, heavy=None))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    by_names = catalog._fuzzy_out(matching.fuzzy_parts(*tables, middle=False, keys=True), min_confidence=least)
    assert not [r for r in RENDERING if r in above_the_last_join(by_names)]


def test_default_birthdates_show_what_their_names_tell(spark):
    from kinloom.plans import catalog

    plan = catalog.fuzzy_default_birthdate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    parts = plan.split("\n+- ")
    assert len(parts) == 2  # persons of light birthdates, and of the others by their names
    assert not [r for r in RENDERING if r in parts[1][: parts[1].index("Join")]]


def test_last_initials_are_compared_once(tables):
    from kinloom.plans import catalog

    want = catalog._pairs_out(matching.fuzzy_no_middle(*tables, last_initial=True, heavy=None))
    plain, by_names = matching.fuzzy_parts(*tables, middle=False, last_initial=True, heavy=1)
    got = catalog._fuzzy_out((plain, by_names))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert by_names.pairs().filter("a_s_initial <> b_s_initial").isEmpty()
    assert "s_initial" in by_names.by  # pairs need no comparison


def test_fuzzy_reports_show_what_their_links_tell(spark):
    from kinloom.plans import catalog

    for query in (catalog.export_fuzzy_pairs, catalog.export_fuzzy_pairs_no_middle):
        assert not [r for r in RENDERING if r in above_the_last_join(query(spark, "/root/testdata/sf0.001"))]


def test_reclassified_pairs_show_what_their_links_tell(spark, tables):
    from kinloom.plans import catalog

    got = catalog._linked_out(blocking.linked_reclassified(*tables))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, catalog._pairs_out(blocking.fuzzy_blocked_reclassified(*tables)).collect()))
    assert not [r for r in RENDERING if r in above_the_last_join(catalog.fuzzy_blocked_reclassified(spark, "/root/testdata/sf0.001"))]


def household_pairs(a, b):
    """household_sql over the list of all pairs of persons."""
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("first_name", "last_name", "birthdate")]
    sizes = a.groupBy("uuid").agg(F.count(F.lit(1)).alias("size"))
    pairs = a.alias("x").join(b.filter("hh_id is not null").alias("y"), on)
    found = pairs.groupBy("x.uuid", "y.hh_id").agg(F.count(F.lit(1)).alias("found"), F.max("x.middle_name").alias("middle_name")).join(sizes, "uuid")
    share = F.col("found").cast("double") / F.col("size")
    return found.filter(share > 0.5).select("uuid", "hh_id", "middle_name", (share * 100).cast("decimal(10,2)").alias("match_percentage"))


@pytest.mark.parametrize("same", [0, 1, 64])
def test_equal_households_are_counted_once(tables, monkeypatch, same):
    monkeypatch.setattr(household, "SAME", same)
    a, b = tables
    # Households of one and of several persons, some without any, and a person who is there twice.
    a = a.withColumn("uuid", F.when(F.col("id") % 36 > 2, F.concat(F.lit("u"), F.floor(F.col("id") / F.when(F.col("id") % 5 == 0, 1).otherwise(36)).cast("string")))).union(a.limit(20)).cache()
    b = b.withColumn("hh_id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("h"), F.floor(F.col("id") / 6).cast("string")))).cache()
    got = household.household_sql(a, b, extras=("middle_name",))
    rows = sorted(map(repr, got.collect()))
    assert rows and rows == sorted(map(repr, household_pairs(a, b).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]  # the list of pairs of households is the last join's output


def test_the_shorter_way_to_pairs(spark):
    from kinloom.operators.linked import Linked

    one, two = spark.range(20).selectExpr("id a_id", "0 a_k"), spark.range(3).selectExpr("id b_id", "id b_k")
    linked = Linked(one, two, spark.range(3).selectExpr("0 a_k", "id b_k"), ("k",))
    assert linked.shorter() and not Linked(two.toDF("a_id", "a_k"), one.toDF("b_id", "b_k"), spark.range(3).selectExpr("id a_k", "0 b_k"), ("k",)).shorter()
    ways = [sorted(map(tuple, linked.pairs(second=s).select("a_id", "b_id").collect())) for s in (False, True)]
    assert ways[0] == ways[1] and len(ways[0]) == 60
