"""Matching: golden rows, a scalar model run over all pairs, invariants, plans."""

from datetime import date
from itertools import product

import pytest
from pyspark.sql import functions as F

from kinloom.generate import clean_dataset, dirty_dataset, households
from kinloom.operators import blocking, household, matching, rules, setops
from kinloom.plans import engine
from kinloom.plans.algorithms import Algorithm, MatchOptions, match
from kinloom.schema import PERSON

D = date(1990, 1, 1)


def table(spark, rows):
    """rows: (id, first, middle, last, birthdate[, uuid[, hh_id]])."""
    full = [(r[0], r[5] if len(r) > 5 else None, r[1], r[2], r[3], r[4], r[6] if len(r) > 6 else None) for r in rows]
    return spark.createDataFrame(full, PERSON)


def ids(pairs):
    return sorted((r["a_id"], r["b_id"]) for r in pairs.select("a_id", "b_id").collect())


def test_exact_golden(spark):
    a = table(spark, [(1, "José", None, "García", D), (2, "Ann", "B", "Lee", date(1985, 5, 5)), (4, "Ann", None, "Lee", None), (5, None, None, "Lee", D)])
    b = table(spark, [(10, "Jose", None, "Garcia", D), (20, "Ann", "B", "Lee", date(1985, 5, 5)), (21, "Ann", "C", "Lee", date(1985, 5, 5)), (22, "Ann", None, "Lee", None), (23, None, None, "Lee", D)])
    assert ids(matching.exact_first_last_dob(a, b)) == [(1, 10), (2, 20), (2, 21)]
    assert ids(matching.exact_first_mid_last_dob(a, b)) == [(1, 10), (2, 20)]
    row = matching.exact_first_mid_last_dob(a, b).filter("a_id = 1").first()
    assert (row["confidence"], row["is_matched_infnbd"], row["is_matched_infnmnbd"], row["matched_fields"]) == (1.0, False, True, matching.FIELDS_2)


def test_punctuation(spark):
    a, b = table(spark, [(1, "Ann.", None, "Smith-Jones", D)]), table(spark, [(2, "ann", None, "smith jones", D)])
    assert ids(matching.exact_first_last_dob(a, b)) == []
    assert ids(matching.exact_first_last_dob(a, b, punctuation=True)) == [(1, 2)]


def test_fuzzy_golden(spark):
    a, b = table(spark, [(1, "Jon", None, "Smith", D), (2, None, None, None, D)]), table(spark, [(3, "John", None, "Smith", D), (4, None, None, None, D), (5, "John", None, "Smith", date(1991, 1, 1))])
    four = matching.fuzzy_no_middle(a, b).collect()
    assert [(r["a_id"], r["b_id"], r["matched_fields"]) for r in four] == [(1, 3, ["fuzzy", "CASE 1", "birthdate"])]
    assert four[0]["confidence"] == pytest.approx((90 + 97.3333 + 100) / 300, abs=1e-5)
    assert ids(matching.fuzzy(a, b)) == [(1, 3)]


def test_fuzzy_equals_scalar_model(spark):
    a, b = dirty_dataset(spark, 60)
    b = b.withColumn("birthdate", F.lit(D))  # everyone against everyone
    a = a.withColumn("birthdate", F.lit(D))
    rows_a, rows_b = a.collect(), b.collect()
    for middle in (True, False):
        got = {(r["a_id"], r["b_id"]): (r["matched_fields"][1], r["confidence"]) for r in (matching.fuzzy if middle else matching.fuzzy_no_middle)(a, b).collect()}
        want = {}
        for x, y in product(rows_a, rows_b):
            parts = ("first_name", "middle_name", "last_name") if middle else ("first_name", "last_name")
            fold = engine.N.normalize_text_scalar
            hit = engine.compare_names([fold(x[p]) for p in parts], [fold(y[p]) for p in parts])
            if hit:
                want[x["id"], y["id"]] = (hit[1], hit[0] / 100)
        assert got.keys() == want.keys() and len(want) > 40
        assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-6) for k in want)


def test_invariants(spark):
    a, b = (t.cache() for t in clean_dataset(spark, 400))
    one, two = matching.exact_first_last_dob(a, b), matching.exact_first_mid_last_dob(a, b)
    assert set(ids(two)) <= set(ids(one)) and ids(one)
    four = matching.fuzzy_no_middle(a, b).cache()
    direct = four.filter(F.col("matched_fields")[1] == rules.DIRECT)
    assert set(ids(one)) <= set(ids(direct))
    assert four.filter((F.col("matched_fields")[1].isin("CASE 2", "CASE 3")) & (F.col("confidence") >= 0.95)).isEmpty()
    assert set(ids(matching.fuzzy_no_middle(a, b, min_confidence=0.95))) <= set(ids(matching.fuzzy_no_middle(a, b, min_confidence=0.9))) <= set(ids(four))
    assert set(ids(blocking.fuzzy_blocked(a, b))) <= set(ids(four))
    sizes = setops.set_sizes(one, two).first()
    assert sizes["any"] == sizes["overlap"] + sizes["unique_1"] + sizes["unique_2"] == len(set(ids(one)))
    assert setops.overlap(one, two).count() == sizes["overlap"] and setops.either(one, two).count() == sizes["any"]
    assert setops.unmatched_left(a, one).count() + setops.pair_keys(one).select("id1").distinct().count() == a.count()


def test_accents_can_count(spark):
    a, b = table(spark, [(1, "José", None, "Núñez", D)]), table(spark, [(2, "Jose", None, "Nunez", D)])
    assert matching.fuzzy_no_middle(a, b).first()["matched_fields"][1] == rules.DIRECT
    raw = matching.fuzzy_no_middle(a, b, accent_fold=False).collect()
    assert all(r["matched_fields"][1] != rules.DIRECT for r in raw)


G5_A = [(1, "John", None, "Doe", D, "A-UUID"), (2, "Jane", None, "Doe", date(1992, 2, 2), "A-UUID"), (3, "Jimmy", None, "Doe", date(2010, 3, 3), "A-UUID"), (4, "Alice", None, "Smith", date(1985, 5, 5), "B-UUID"), (5, "Bob", None, "Smith", date(1987, 6, 6), "B-UUID")]
G5_B = [(11, "John", None, "Doe", D, None, "100"), (12, "Jane", None, "Doe", date(1992, 2, 2), None, "100"), (13, "Alice", None, "Smith", date(1985, 5, 5), None, "101"), (14, "Bob", None, "Smith", date(1987, 6, 6), None, "101"), (15, "Jimmy", None, "Doe", date(2010, 3, 3), None, "102")]


def shares(rows):
    return [(r["row_id"], r["uuid"], r["hh_id"], round(float(r["match_percentage"]), 2)) for r in rows.orderBy("row_id").collect()]


def test_household_golden(spark):
    a, b = table(spark, G5_A), table(spark, G5_B)
    assert shares(household.household_t1(a, b)) == [(1, "A-UUID", "100", 66.67), (2, "B-UUID", "101", 100.0)]
    assert shares(household.household_t2(a, b)) == [(1, "A-UUID", "100", 100.0), (2, "A-UUID", "102", 100.0), (3, "B-UUID", "101", 100.0)]


def test_household_ties_halves_and_fallback(spark):
    a = table(spark, [(1, "Ann", None, "Lee", D, "T"), (2, "Bo", None, "Lee", D, "H"), (3, "Cy", None, "Lee", D, "H"), (4, "Di", None, "Lee", D, "F")])
    b = table(spark, [(10, "Ann", None, "Lee", D, None, "1"), (11, "Ann", None, "Lee", D, None, "2"), (12, "Bo", None, "Lee", D, None, "3"), (20, "Di", None, "Lee", D)])
    assert shares(household.household_t1(a, b)) == [(1, "F", "20", 100.0)]  # a tie drops T, exactly half drops H
    c = table(spark, [*[(30 + i, n, None, "Lee", D, None, "100") for i, n in enumerate(("Bo", "Cy", "Di", "Zed"))]])
    one = table(spark, [(i, n, None, "Lee", D, "u1") for i, n in enumerate(("Bo", "Cy", "Di"))])
    assert shares(household.household_t2(one, c)) == [(1, "u1", "100", 75.0)]


def test_household_sql_counts_pairs(spark):
    rows = household.household_sql(table(spark, G5_A), table(spark, G5_B)).collect()
    assert {(r["uuid"], r["hh_id"], float(r["match_percentage"])) for r in rows} == {("A-UUID", "100", 66.67), ("B-UUID", "101", 100.0)}


def test_block_tiers(spark):
    a = table(spark, [(1, "Ann", None, "Lopez", D), (2, "Ann", None, "Smith", D)])
    b = table(spark, [(10, "Ann", None, "Lopez", D), (11, "王", None, "Lopez", D), (12, "Ann", None, "Smi", D), (13, "Ann", None, "Lopez", date(1991, 1, 1))])
    ba, bb = blocking.block_columns(a), blocking.block_columns(b)
    # Smith finds nothing but the coarse Soundex of Smi
    assert ids(blocking.blocked_candidates(ba, bb)) == [(1, 10), (2, 12)]
    assert ids(blocking.neighbour_year_candidates(ba, bb)) == [(1, 10), (1, 13), (2, 12)]
    got = blocking.fuzzy_birthdate(a, b).filter("b_id = 13").first()
    assert got["matched_fields"] == ["fuzzy7", "DIRECT MATCH", "birthdate:40%"] and got["confidence"] == pytest.approx(0.82)


def test_candidate_estimate(spark):
    a, b = dirty_dataset(spark, 200)
    est = blocking.candidate_estimate(a, b, ["last_name"]).first()
    assert est["candidates"] == a.select("last_name").join(b.select("last_name"), "last_name").count()


def test_dispatch(spark):
    a, b = households(spark, 200)
    for algorithm in Algorithm:
        match(a, b, algorithm).count()
    blocked = match(a, b, 4, MatchOptions(blocking="soundex"))
    assert set(ids(blocked)) <= set(ids(match(a, b, 4)))
    with pytest.raises(ValueError):
        match(a, b, 4, MatchOptions(blocking="other"))
    with pytest.raises(ValueError):
        match(a, b, 9)


def test_plans(spark):
    a, b = dirty_dataset(spark, 100)
    plan = matching.fuzzy_no_middle(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("ArrowEvalPython [_jaro_winkler_pct") == 1 and plan.count("ArrowEvalPython [metaphone_code") == 2
    assert plan.index("ArrowEvalPython [_jaro_winkler_pct") < plan.index("Join") < plan.index("ArrowEvalPython [metaphone_code")


def test_engine(spark):
    a, b = table(spark, [(1, "Ann", None, "Lee", D)]), table(spark, [(2, "Anne", None, "Lee", D), (3, "Zed", None, "Lee", D)])

    class First:
        def compare(self, x, y):
            return (90.0, "near") if x["first_name"][:3] == y["first_name"][:3] else None

    got = engine.keyed_join(a, b, ["birthdate"], First()).collect()
    assert [(r["a_id"], r["b_id"], r["score"], r["explanation"]) for r in got] == [(1, 2, 90.0, "near")]
    with pytest.raises(ValueError):
        engine.keyed_join(a, b, [], First())


def test_single_pairs():
    p = engine.Person
    jon, john = p(1, "Jon", None, "Smith", D), p(2, "John", None, "Smith", D)
    assert engine.compare_pair_fuzzy_no_middle(jon, john) == (96, "CASE 1")
    assert engine.compare_pair_fuzzy(jon, p(2, "John", None, "Smith", date(1991, 1, 1))) is None
    assert engine.compare_pair_exact(p(1, "José", None, "García", D), p(2, "Jose", None, "Garcia", D), middle=True)
    assert not engine.compare_pair_exact(p(1, "A", "B", "C", D), p(2, "A", None, "C", D), middle=True)
    assert engine.compare_pair_fuzzy_birthdate(jon, p(2, "Jon", None, "Smith", date(1990, 1, 2))) == (97, "fuzzy7|DIRECT MATCH|birthdate:90%")
