"""Results kept as persons and links of classes: files grow with the persons, pairs are made where they are read."""

import pytest
from pyspark.sql import functions as F

from kinloom import export
from kinloom.generate import dirty_dataset
from kinloom.operators import matching
from kinloom.operators.partition import BirthYears
from kinloom.plans import engine
from kinloom.plans.algorithms import MatchOptions, match, match_classes
from kinloom.schema import PERSON
from kinloom.streaming import households
from kinloom.streaming import match as stream
from kinloom.streaming.index import build_index


@pytest.fixture(scope="module")
def tables(spark):
    """Two tables whose persons are there 8 times, some without a middle name or a uuid, with marks that CSV has to quote."""
    copies = lambda t: t.crossJoin(F.broadcast(spark.range(8).withColumnRenamed("id", "n"))).withColumns({"id": F.col("id") * 8 + F.col("n"), "uuid": F.when(F.col("n") > 0, F.concat("uuid", F.lit('-"a",'), F.col("n").cast("string")))}).select(*[f.name for f in PERSON])
    return tuple(copies(t).cache() for t in dirty_dataset(spark, 60))


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("algorithm", [1, 2, 3, 4])
def test_reports_of_classes_are_those_of_pairs(spark, tables, tmp_path, algorithm):
    a, b = tables
    want = export.pair_report(match(a, b, algorithm), algorithm, separator=";")
    linked = export.linked_report(match_classes(a, b, algorithm), algorithm, separator=";")
    got = export.report_pairs(linked, algorithm, separator=";")
    assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    assert rows_of(got) == rows_of(want)
    export.write_csv_classes(linked, f"{tmp_path}/csv")
    back = export.read_csv_classes(linked, f"{tmp_path}/csv")
    assert rows_of(export.report_pairs(back, algorithm, separator=";")) == rows_of(want)
    files = [spark.read.option("header", True).csv(f"{tmp_path}/csv/{n}").count() for n in ("first", "second")]
    assert files[0] <= a.count() and files[1] <= b.count() and sum(files) < want.count()


def test_classes_of_a_least_confidence(tables):
    want = export.pair_report(match(*tables, 4), 4, min_confidence=0.97)
    for linked in (export.linked_report(match_classes(*tables, 4), 4, min_confidence=0.97), export.linked_report(match_classes(*tables, 4, MatchOptions(min_confidence=0.97)), 4)):
        assert rows_of(export.report_pairs(linked, 4)) == rows_of(want)


def pairs_of(pairs):
    return sorted((r["a_id"], r["b_id"], round(r["confidence"], 6), tuple(r["matched_fields"])) for r in pairs.collect())


@pytest.mark.parametrize("algorithm", [2, 4])
def test_streams_and_pages_write_links_not_pairs(spark, tables, tmp_path, algorithm):
    a, b = tables
    want = match(a, b, algorithm)
    n = want.count()
    b.repartition(3).write.parquet(f"{tmp_path}/in")
    out = f"file://{tmp_path}/out"
    for _ in range(2):  # the second time nothing is left, and what was kept is opened
        stream.match_stream(stream.person_stream(spark, f"{tmp_path}/in", files_per_batch=2), a, algorithm, out=out, checkpoint=f"{tmp_path}/cp", stream_is_first=False, linked=True).awaitTermination()
    assert pairs_of(matching.linked_pairs(stream.streamed_links(spark, out))) == pairs_of(want)
    written = [spark.read.parquet(f"{out}/{x}").count() for x in ("persons", *(["links"] if algorithm == 4 else []))]
    assert written[0] <= b.count() and sum(written[1:]) * 10 < n
    built, states = build_index(b, algorithm, path=f"file://{tmp_path}/i"), stream.MemoryCheckpointer()
    for pages in (2, None):
        state = stream.match_pages(a, built, algorithm, out=f"{tmp_path}/pages", checkpointer=states, job="j", page=150, pages=pages, linked=True)
        got = matching.linked_pairs(stream.paged_links(spark, f"{tmp_path}/pages", state, built))
        assert pairs_of(got) == pairs_of(match(a.filter(F.col("id") <= state.next_offset), b, algorithm))
    assert state.next_offset == a.agg(F.max("id")).first()[0]
    names = stream.match_partitions(a, b, algorithm, BirthYears(30, 1930, 2019), out=f"{tmp_path}/parts", checkpointer=stream.MemoryCheckpointer(), job="p", linked=True)
    assert pairs_of(matching.linked_pairs(stream.partitioned_links(spark, f"{tmp_path}/parts", names, algorithm))) == pairs_of(want)


def test_an_index_compares_names_once(spark, tables, tmp_path):
    a, b = tables
    built = build_index(b, 4, path=f"file://{tmp_path}/i")
    assert built.table(spark).count() * 4 < built.persons(spark).count()


def test_linked_streams_refuse_what_they_have_not(tables, tmp_path):
    for more in ({"linked": True, "csv": "x"}, {"linked": True, "households": 5}, {"households": 4}):
        with pytest.raises(ValueError):
            stream.match_stream(tables[0], tables[1], 4, out=str(tmp_path), checkpoint="", **more)


@pytest.mark.parametrize("algorithm", [5, 6])
def test_streamed_households_list_two_pairs_a_person(spark, tables, tmp_path, algorithm):
    a, b = tables
    want = [tuple(r) for r in match(a, b, algorithm).collect()]
    b.repartition(3).write.parquet(f"{tmp_path}/in")
    run = lambda out, **how: stream.match_stream(stream.person_stream(spark, f"{tmp_path}/in", files_per_batch=2), a, 4, out=f"file://{tmp_path}/{out}", checkpoint=f"{tmp_path}/{out}-cp", stream_is_first=False, **how).awaitTermination()
    run("pairs", households=algorithm)
    pairs = spark.read.parquet(f"{tmp_path}/pairs/batch=*")
    assert pairs.groupBy("a_id" if algorithm == 5 else "b_id").count().filter("count > 2 * 2").count() == 0  # two a batch
    households.roll_up_stream(households.pair_stream(spark, f"{tmp_path}/pairs", pairs.schema), algorithm, out=f"{tmp_path}/places", checkpoint=f"{tmp_path}/roll-cp").awaitTermination()
    assert [tuple(r) for r in households.rolled_up(spark, f"{tmp_path}/places", a if algorithm == 5 else b, algorithm).collect()] == want
    run("links", linked=True)
    got = stream.household_from_stream(spark, f"file://{tmp_path}/links", a, b, algorithm, linked=stream.streamed_links(spark, f"file://{tmp_path}/links"))
    assert [tuple(r) for r in got.collect()] == want


def test_a_page_ends_where_its_rows_do(spark):
    ids = sorted([*range(-50, 3000, 7), 5, 5, 5, 2**62, -(2**62), *range(10**9, 10**9 + 500)])
    table = spark.createDataFrame([(i,) for i in ids], "id long")
    ordered, stream.ORDERED = stream.ORDERED, 20
    try:
        for after in (-(2**63), -50, 5, 10**9 + 498, 2**62):
            left = [i for i in ids if i > after]
            for page in (1, 4, 300, 5000):
                assert stream.page_end(table, after, page) == (left[min(page, len(left)) - 1] if left else None)
    finally:
        stream.ORDERED = ordered


class _Native:
    def score(self):
        return F.when(F.coalesce("a_last_name", F.lit("?")) == F.coalesce("b_last_name", F.lit("?")), 50.0)

    def explanation(self):
        return F.lit("same")


def matchers():
    """The same three times; local, so that tasks get the classes themselves."""

    class Pairs:
        def compare(self, a, b):
            return (50.0, "same") if (a["last_name"] or "?") == (b["last_name"] or "?") else None

    class Groups:
        seen = []

        def compare_groups(self, a, b):
            one, two = ([x or "?" for x in t.column("last_name").to_pylist()] for t in (a, b))
            hits = [(i, j) for i, x in enumerate(one) for j, y in enumerate(two) if x == y]
            return [i for i, _ in hits], [j for _, j in hits], [50.0] * len(hits), ["same"] * len(hits)

    return [_Native(), Pairs(), Groups()]


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_matchers_that_tell_their_columns_compare_values_once(spark, tables, kind):
    none = lambda t: t.withColumn("last_name", F.when(F.col("id") % 5 > 0, F.col("last_name")))
    a, b = map(none, tables)
    plain, told = matchers()[kind], matchers()[kind]
    told.columns = ("last_name",)
    by_year = lambda p: [F.year(f"{p}_birthdate")]
    for key in (["birthdate"], by_year):
        got, want = (engine.keyed_join(a, b, key, m) for m in (told, plain))
        assert got.columns == want.columns and rows_of(got) == rows_of(want) != []
    plan = engine.keyed_join(a, b, ["birthdate"], told)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") + plan.count("FlatMapCoGroups") >= 3 and plan.count("Aggregate [") >= 2  # the values, then their rows


@pytest.mark.parametrize("algorithm", [1, 2])
def test_sheets_of_classes_have_every_pair(spark, tables, tmp_path, algorithm):
    a, b = tables
    want = export.pair_report(match(a, b, algorithm), algorithm, separator=";")
    back = export.write_sheet_classes(export.linked_report(match_classes(a, b, algorithm), algorithm), f"file://{tmp_path}/sheet")
    assert rows_of(export.report_pairs(back, algorithm, separator=";")) == rows_of(want)
    files = [spark.read.parquet(f"file://{tmp_path}/sheet/{n}").count() for n in ("first", "second")]
    assert files[0] <= a.count() and files[1] <= b.count() and sum(files) < want.count()
