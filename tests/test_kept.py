"""Kept indexes, databases as streams, paged jobs that resume, progress, heavy birthdates, array Jaro."""

import random
import sqlite3
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.functions import similarity
from kinloom.generate import dirty_dataset
from kinloom.metrics import Progress
from kinloom.operators import blocking, household, matching
from kinloom.operators.prepared import side
from kinloom.plans import engine
from kinloom.plans.algorithms import MatchOptions, match
from kinloom.schema import PERSON
from kinloom.sources import database
from kinloom.streaming import households
from kinloom.streaming import index as kept
from kinloom.streaming import match as stream

D = date(1900, 1, 1)


def rows_of(pairs):
    return sorted((r["a_id"], r["b_id"], round(r["confidence"], 6), tuple(r["matched_fields"])) for r in pairs.collect())


@pytest.fixture(scope="module")
def tables(spark):
    """Two tables; three in ten persons have a default birthdate, and some have names of other scripts."""
    a, b = dirty_dataset(spark, 160)
    default = lambda t: t.withColumn("birthdate", F.when(F.col("id") % 10 < 3, F.lit(D)).otherwise(F.col("birthdate")))
    odd = [(9001, "u", "Анна", None, "Петрова", D, "h"), (9002, "u", "Anna", None, "Petrova", D, "h"), (9003, "u", "山田", None, "太郎", D, "h"), (9004, "u", "", None, "", D, "h"), (9005, None, None, None, "X", D, None), (9006, "u", "Ann", None, "Lee", None, "h")]
    more = spark.createDataFrame(odd, PERSON)
    return default(a).unionByName(more).cache(), default(b).unionByName(more).unionByName(more).cache()


# ---- heavy birthdates ----


@pytest.mark.parametrize("how", [{"heavy": 100}, {"heavy": 100, "last_initial": True}, {"keys": True, "accent_fold": False}])
def test_heavy_birthdates_lose_no_pair(spark, tables, how):
    plain = {k: v for k, v in how.items() if k in ("last_initial", "accent_fold")} | {"heavy": None}
    run = matching.fuzzy if "accent_fold" in how else matching.fuzzy_no_middle
    assert rows_of(run(*tables, **how)) == rows_of(run(*tables, **plain))


def test_heavy_birthdates_compare_fewer(spark, tables):
    own = [t.filter("id < 9000") for t in tables]  # names of ASCII
    plain, by_names = (matching.compared_pairs(*own, middle=False, heavy=h).first() for h in (None, 100))
    assert by_names["persons"] < plain["persons"] and plain["names"] == 0
    assert by_names["names"] < (plain["persons"] - by_names["persons"]) / 5


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_names_that_can_match_are_shared(spark):
    """Held and asking keys of names within the edits that PASS allows, of every length."""
    rng, rows = random.Random(8), []
    for n in list(range(1, 40)) * 12:
        name = "".join(rng.choice("abcde ") for _ in range(n))
        other = list(name)
        for _ in range(rng.randint(0, 1 + n * 15 // 100)):
            k, r = rng.randrange(len(other) + 1), rng.random()
            other[k : k + (r < 0.7)] = "" if r < 0.35 else rng.choice("abcde ")
        rows.append((name, "".join(other)))
    pairs = spark.createDataFrame(rows, "x string, y string").filter("y <> '' and (1 - levenshtein(x, y) / greatest(length(x), length(y))) * 100 >= 85")
    keys = lambda c, held: pairs.select(F.col(c).alias("full"), F.lit("").alias("code"), "x", "y").select("x", "y", matching.name_keys(held).alias(f"k{held}"))
    for one, two in (("x", "y"), ("y", "x")):
        both = keys(one, True).join(keys(two, False), ["x", "y"])
        assert both.count() > 200 and both.filter("not arrays_overlap(kTrue, kFalse)").count() == 0


def test_names_are_coded_below_the_comparisons(spark, tables):
    plan = plan_of(matching.fuzzy_no_middle(*tables, heavy=100))
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert plan.count("ArrowEvalPython") == 6  # codes of persons on either side and of names on either side; Jaro-Winkler of both


# ---- array Jaro ----


def names(n, seed=5):
    rng = random.Random(seed)
    kinds = ["abcde", "abcdefghijklmnopqrstuvwxyz -'", "日本語テ ñé\x00𝄞"]
    out = ["".join(rng.choice(rng.choices(kinds, [5, 4, 1])[0]) for _ in range(rng.choice([0, 1, 2, 3, 7, 12, 20, 40]))) for _ in range(n)]
    return out + ["x" * 63, "x" * 64, "x" * 65, "ab" * 60, "y" + "x" * 63]


@pytest.mark.parametrize(("how", "plain"), [({}, similarity.jaro), ({"gate": 0.7}, similarity.jaro_winkler), ({"gate": -1.0, "whole_transpositions": False}, lambda a, b: similarity.jaro_winkler(a, b, gate=-1.0, whole_transpositions=False))])
def test_array_jaro_is_jaro(how, plain):
    rng = np.random.default_rng(3)
    one, two = names(400), names(300, 6) + names(40)
    i, j = rng.integers(0, len(one), 30_000), rng.integers(0, len(two), 30_000)
    got = similarity.jaro_of(similarity.Names(one), similarity.Names(two), i, j, **how)
    assert got.tolist() == [plain(one[x], two[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)]


def test_array_jaro_of_nothing():
    none = similarity.Names([])
    assert similarity.jaro_of(none, none, np.zeros(0, int), np.zeros(0, int)).tolist() == []


# ---- households ----


def test_best_household_in_one_aggregation(spark):
    rows = [(1, "u1", "h1", 0.9), (1, "u1", "h1", 0.9), (1, "u1", "h2", 0.8), (2, "u1", "h1", 0.9), (2, "u1", "h2", 0.9), (3, "u2", None, 0.99), (3, "u2", "h3", 0.9), (4, "u2", None, 0.9), (4, "u2", "h3", 0.9), (5, "u3", "h5", 0.7), (5, "u2", "h5", 0.7)]
    found = household._best(spark.createDataFrame(rows, "a_id long, uuid string, hh_id string, confidence float"), "a_id", "hh_id", ["uuid"])
    assert plan_of(found).count("Exchange") == 1 and "Window" not in plan_of(found)
    assert sorted(map(tuple, found.collect())) == [(1, "h1", "u1"), (4, "h3", "u2"), (5, "h5", "u2")]


def test_blocks_settle_tiers(spark, tables):
    """Tiers by blocks as tiers person by person."""
    a, b = (blocking.block_columns(t).select("id", "birthdate", *blocking.KEY).collect() for t in tables)
    have = {}
    for r in b:
        have.setdefault((r["year"], r["fi"], r["li"], r["sx"]), []).append(r)
    want = []
    for r in a:
        coarse = r["sx"][:2] + "00"
        for key in ((r["year"], r["fi"], r["li"], r["sx"]), (r["year"], "?", r["li"], r["sx"]), (r["year"], r["fi"], r["li"], coarse)):
            if key in have:
                want += [(r["id"], y["id"]) for y in have[key] if y["birthdate"] == r["birthdate"]]
                break
    got = blocking.blocked_candidates(*map(blocking.block_columns, tables), same_birthdate=True)
    assert sorted((r["a_id"], r["b_id"]) for r in got.select("a_id", "b_id").collect()) == sorted(want)


# ---- kept index ----


@pytest.mark.parametrize("algorithm", [1, 2, 3, 4])
@pytest.mark.parametrize("first_side", [False, True])
def test_index_gives_the_pairs_of_a_match(spark, tables, tmp_path, algorithm, first_side):
    a, b = tables
    built = kept.build_index(a if first_side else b, algorithm, path=f"file://{tmp_path}/i", first_side=first_side, heavy=60)
    spark.sql(f"DROP TABLE {built.name}")  # as in a new application
    opened = kept.open_index(spark, f"file://{tmp_path}/i")
    assert opened == built
    pairs = opened.pairs(b if first_side else a)
    assert rows_of(pairs) == rows_of(match(a, b, algorithm))
    assert rows_of(opened.pairs(b if first_side else a, min_confidence=0.97)) == rows_of(match(a, b, algorithm, MatchOptions(min_confidence=0.97)))


def below(plan, name):
    """Lines of the plan under the scan of a table, up to the join: what its rows go through before they meet the batch."""
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if name in x and "Scan" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    out, d = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < d:
            d = depth(x)
            if "Join" in x:
                return out
            out.append(x)
    return out


@pytest.mark.parametrize("algorithm", [1, 2, 3, 4])
def test_index_is_neither_shuffled_nor_coded_again(spark, tables, tmp_path, algorithm):
    a, b = tables
    built = kept.build_index(b, algorithm, path=f"file://{tmp_path}/i", heavy=60)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(built.pairs(a))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    above = "\n".join(below(plan, built.name))
    assert "Exchange" not in above and "Python" not in above, plan


def test_index_refuses_what_it_is_not_for(spark, tables, tmp_path):
    with pytest.raises(ValueError):
        kept.build_index(tables[1], 7, path=f"file://{tmp_path}/i")
    built = kept.build_index(tables[1], 1, path=f"file://{tmp_path}/i")
    with pytest.raises(ValueError):
        stream.match_stream(tables[0], built, 2, out="", checkpoint="")


def test_stream_against_an_index(spark, tables, tmp_path):
    a, b = tables
    a.repartition(3).write.parquet(str(tmp_path / "in"))
    built, told = kept.build_index(b, 4, path=f"file://{tmp_path}/i", heavy=60), []
    progress = Progress(lambda p: told.append(p.line()), total=a.count(), interval=0.0)
    stream.match_stream(stream.person_stream(spark, str(tmp_path / "in")), built, 4, out=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"), progress=progress).awaitTermination()
    got = stream.streamed_pairs(spark, str(tmp_path / "out"))
    assert rows_of(got) == rows_of(match(a, b, 4))
    assert (progress.counts.processed, progress.counts.matches, progress.counts.batches) == (a.count(), got.count(), 3)
    assert len(told) == 3 and progress.seconds_left() == 0 and "pairs" in told[-1]


# ---- databases ----


def put(path, table, rows, id_type="INTEGER"):
    with sqlite3.connect(path) as connection:
        connection.execute(f"CREATE TABLE IF NOT EXISTS {table} (pid {id_type}, uuid TEXT, first_name TEXT, middle_name TEXT, last_name TEXT, born TEXT, hh_id TEXT)")
        connection.executemany(f"INSERT INTO {table} VALUES (?, ?, ?, ?, ?, ?, ?)", [(*r[:5], None if r[5] is None else r[5].isoformat(), r[6]) for r in rows])


def held(path, table):
    return database.Database("sqlite3", {"database": str(path)}, table, id="pid", columns={"id": "pid", "birthdate": "born"})


def test_a_database_is_read_by_ranges(spark, tables, tmp_path):
    rows = [tuple(r) for r in tables[1].collect()]
    put(tmp_path / "d", "two", rows)
    put(tmp_path / "d", "none", [])
    got = database.scan(spark, held(tmp_path / "d", "two"), ranges=5)
    assert got.schema == PERSON and sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)
    assert database.scan(spark, held(tmp_path / "d", "none")).count() == 0
    put(tmp_path / "d", "odd", [(1, None, None, None, None, None, None)] * 3 + [(5, "u", "A", "B", "C", D, "h")])
    assert database.scan(spark, held(tmp_path / "d", "odd")).count() == 4


def test_pages_by_keyset(tmp_path):
    put(tmp_path / "d", "t", [(i, *[None] * 6) for i in [-5, 1, 2, 2, 2, 3, 10, 11]])
    pages = database.Pages(held(tmp_path / "d", "t"), 3, 2)
    at, seen = pages.initialOffset(), []
    while True:
        ranges, end = pages.read(at)
        ranges = list(ranges)
        if end == at:
            break
        assert ranges == list(pages.readBetweenOffsets(at, end)) and ranges[0][0] == at["after"] and ranges[-1][1] == end["after"]
        seen.append([r[0] for lo, hi in ranges for b in pages.database.fetch(lo, hi) for r in zip(*(c.to_pylist() for c in b.columns))])
        at = end
    assert seen == [[-5, 1, 2, 2, 2], [3, 10, 11]]


def test_two_databases_streamed_killed_and_resumed(spark, tables, tmp_path):
    a, b = tables
    put(tmp_path / "one", "first", [tuple(r) for r in a.collect()])
    put(tmp_path / "two", "second", [tuple(r) for r in b.collect()])

    def run(**more):
        return stream.match_sources(spark, held(tmp_path / "one", "first"), held(tmp_path / "two", "second"), "second", 4, out=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"), index=f"file://{tmp_path}/index", page=40, **more)

    class Killed(Exception):
        pass

    def die(number, pairs):
        if number == 1:
            raise Killed  # the pairs are written, the batch is not committed

    query = run(on_batch=die)
    with pytest.raises(Exception, match="Killed"):
        query.processAllAvailable()
    assert {p.name for p in (tmp_path / "out").glob("batch=*")} == {"batch=0", "batch=1"}
    put(tmp_path / "one", "first", [(20_000, "u", "Zoe", None, "Late", date(2001, 2, 3), "h")])
    query = run()
    query.processAllAvailable()
    put(tmp_path / "one", "first", [(20_001, "u", "Anna", None, "Petrova", D, "h")])  # while the stream runs
    stream.finish(query)
    late = spark.createDataFrame([(20_000, "u", "Zoe", None, "Late", date(2001, 2, 3), "h"), (20_001, "u", "Anna", None, "Petrova", D, "h")], PERSON)
    got = stream.streamed_pairs(spark, str(tmp_path / "out"))
    assert rows_of(got) == rows_of(match(a.unionByName(late), b, 4)) and got.filter("a_id = 20001").count() > 0


# ---- paged jobs ----


def test_a_paged_job_resumes_where_it_was_committed(spark, tables, tmp_path):
    a, b = tables
    out, told = str(tmp_path / "out"), []

    class Dies(stream.FileCheckpointer):
        saves = 0

        def save(self, job, partition, token):
            self.saves += 1
            if self.saves == 3:
                raise KeyboardInterrupt  # after a page's pairs were written, before it is committed
            super().save(job, partition, token)

    with pytest.raises(KeyboardInterrupt):
        stream.match_pages(a, b, 4, out=out, checkpointer=Dies(str(tmp_path / "cp")), job="j", page=30)
    assert len(list((tmp_path / "out").glob("after=*"))) == 3
    files = stream.FileCheckpointer(str(tmp_path / "cp"))
    state = stream.match_pages(a, b, 4, out=out, checkpointer=files, job="j", page=30, pages=0)
    committed = stream.paged_pairs(spark, out, state)
    assert state.next_offset < a.agg(F.max("id")).first()[0]
    assert rows_of(committed) == rows_of(match(a.filter(F.col("id") <= state.next_offset), b, 4))
    built = kept.build_index(b, 4, path=f"file://{tmp_path}/i")
    progress = Progress(told.append, interval=1e9)
    state = stream.match_pages(a, built, 4, out=out, checkpointer=files, job="j", page=47, progress=progress)  # other pages, and an index
    assert rows_of(stream.paged_pairs(spark, out, state)) == rows_of(match(a, b, 4))
    assert state.next_offset == a.agg(F.max("id")).first()[0] and len(told) == 1 and progress.counts.processed == a.count() - 60
    again = stream.match_pages(a, b, 4, out=out, checkpointer=files, job="j", page=30)
    assert again.next_offset == state.next_offset
    other = stream.match_pages(a, b, 1, out=str(tmp_path / "other"), checkpointer=stream.MemoryCheckpointer(), job="j")
    assert rows_of(stream.paged_pairs(spark, str(tmp_path / "other"), other)) == rows_of(match(a, b, 1))


# ---- progress ----


def test_progress_is_told_at_intervals():
    now, told = [0.0], []
    p = Progress(lambda p: told.append((p.counts.processed, p.seconds_left())), total=100, interval=10.0, clock=lambda: now[0])
    assert p.seconds_left() is None
    for at in (1, 2, 3, 12, 13):
        now[0] = float(at)
        p.batch(10, 1)
    assert told == [(10, 9.0), (40, 18.0)]
    assert p.line() == "50 of 100 rows, 5 pairs, 4 rows a second, 13 s left" and Progress(clock=lambda: 1.0).seconds_left() is None


# ---- matchers over groups ----


def alike():
    """Matchers of Jaro-Winkler of last names, over arrays and pair by pair; local, so that tasks get the classes themselves."""

    class Groups:
        def compare_groups(self, a, b):
            one, two = ([x or "" for x in t.column("last_name").to_pylist()] for t in (a, b))
            i, j = (g.ravel() for g in np.meshgrid(np.arange(len(one)), np.arange(len(two)), indexing="ij"))
            scores = similarity.jaro_of(similarity.Names(one), similarity.Names(two), i, j, gate=0.7)
            good = scores >= 0.9
            return i[good], j[good], scores[good], [f"{len(one)} x {len(two)}"] * int(good.sum())

    class Pairs:
        def compare(self, a, b):
            s = similarity.jaro_winkler(a["last_name"] or "", b["last_name"] or "")
            return (s, "pair") if s >= 0.9 else None

    return Groups(), Pairs()


@pytest.mark.parametrize("cell", [10, 1000])
def test_group_matchers_see_bounded_cells(spark, tables, cell):
    a, b = (t.dropDuplicates(["id"]) for t in tables)
    parts = engine.on_columns("birthdate")
    got = engine._grouped_join(side(a, "a"), side(b, "b"), parts("a"), parts("b"), alike()[0], cell).collect()
    want = engine.keyed_join(a, b, ["birthdate"], alike()[1]).collect()
    pairs = lambda rows: sorted((r["a_id"], r["b_id"], r["score"]) for r in rows)
    assert pairs(got) == pairs(want) and len(got) > 100
    sizes = [int(x) for r in got for x in r["explanation"].split(" x ")]
    assert max(sizes) <= 3 * 10 if cell == 10 else max(sizes) > 30


def test_group_matchers_of_nothing(spark, tables):
    a, b = tables
    assert engine.keyed_join(a.limit(0), b, ["birthdate"], alike()[0]).count() == 0
    assert engine.keyed_join(a.filter("birthdate is null"), b, ["birthdate"], alike()[0]).count() == 0


# ---- households over streams ----


@pytest.mark.parametrize("algorithm", [5, 6])
def test_roll_up_after_every_batch_is_that_of_all_pairs(spark, tmp_path, algorithm):
    rng, rows = random.Random(algorithm), []
    for _ in range(160):
        a_id, b_id = rng.randint(1, 24), rng.randint(101, 124)
        rows.append((a_id, None if a_id == 7 else f"u{a_id // 3}", b_id, None if b_id % 5 == 0 else f"h{b_id // 3}", rng.choice([0.9, 0.95, 0.97, 1.0])))
    schema = "a_id long, a_uuid string, b_id long, b_hh_id string, confidence float"
    a = spark.createDataFrame([(i, None if i == 7 else f"u{i // 3}", None, None, None, None, None) for i in range(1, 25)], PERSON)
    b = spark.createDataFrame([(i, None, None, None, None, None, None if i % 5 == 0 else f"h{i // 3}") for i in range(101, 125)], PERSON)
    seen = spark.createDataFrame([], schema)
    for n in range(3):
        part = spark.createDataFrame(rows[n * 50 : (n + 1) * 50 + 5], schema)  # some pairs come twice
        part.write.parquet(f"{tmp_path}/pairs/batch={n}")
        seen = seen.unionByName(part)
        households.roll_up_stream(households.pair_stream(spark, f"{tmp_path}/pairs", part.schema, files_per_batch=3), algorithm, out=f"{tmp_path}/out", checkpoint=f"{tmp_path}/cp").awaitTermination()
        got = households.rolled_up(spark, f"{tmp_path}/out", a if algorithm == 5 else b, algorithm)
        run = household.household_t1 if algorithm == 5 else household.household_t2
        want = run(a, b, pairs=seen)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert got.count() > 0
