"""Blocked and keyed variants, databases, workbooks, streams of the user's own matchers, numbering, folders."""

import random
import zipfile
import zlib
from collections import Counter
from datetime import date
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from kinloom import cli, export, storage
from kinloom.functions import similarity
from kinloom.generate import dirty_dataset, households
from kinloom.operators import blocking, household, matching
from kinloom.plans import engine
from kinloom.plans.algorithms import MatchOptions, match
from kinloom.schema import PERSON
from kinloom.sources import tables
from kinloom.streaming import match as stream

D = date(1990, 1, 1)


def pairs(df):
    return sorted((r["a_id"], r["b_id"], r["matched_fields"][1], round(r["confidence"], 6)) for r in df.collect())


def test_blocked_rules_are_parts_of_the_whole(spark):
    a, b = (t.cache() for t in dirty_dataset(spark, 300))
    three, four = set(pairs(matching.fuzzy(a, b))), set(pairs(matching.fuzzy_no_middle(a, b)))
    blocked_3, blocked_4 = set(pairs(match(a, b, 3, MatchOptions(blocking="soundex")))), set(pairs(match(a, b, 4, MatchOptions(blocking="soundex"))))
    assert blocked_3 and blocked_3 <= three and blocked_4 <= four
    both = set(pairs(blocking.fuzzy_blocked_reclassified(a, b)))
    ids = {p[:2] for p in blocked_3}
    assert both == {p for p in blocked_4 if p[:2] in ids} and both


def test_keys_lose_nothing(spark):
    """Candidates by shared keys against all pairs of a birthdate: random names, short ones, repeated letters, other scripts."""
    import random

    rng = random.Random(4)
    name = lambda: "".join(rng.choice("abno ") for _ in range(rng.randint(0, 9))) + rng.choice(["", "é", "王", "łó"]) * (rng.random() < 0.2)

    def near(s):
        s = list(s)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(s) + 1)
            s[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "n", "x"])
        return "".join(s)

    one = [(i, None, name(), rng.choice([None, "B"]), name(), D, None) for i in range(150)]
    two = [(i, None, near(r[2]), r[3], near(r[4]), D, None) for i, r in enumerate(one)] + [(1000, None, None, None, "王", D, None), (1001, None, "a", None, "", D, None), (1002, None, "a", None, None, None, None)]
    a, b = spark.createDataFrame(one, PERSON), spark.createDataFrame(two, PERSON)
    for algorithm in (3, 4):
        for fold in (True, False):
            want = pairs(match(a, b, algorithm, MatchOptions(accent_fold=fold)))
            assert pairs(match(a, b, algorithm, MatchOptions(accent_fold=fold, blocking="keys"))) == want and len(want) > 100
    assert pairs(match(a, b, 4, MatchOptions(last_initial=True, blocking="keys"))) == pairs(match(a, b, 4, MatchOptions(last_initial=True)))
    c, d = dirty_dataset(spark, 200)
    assert pairs(match(c, d, 3, MatchOptions(blocking="keys"))) == pairs(match(c, d, 3))
    plan = match(c, d, 3, MatchOptions(blocking="keys"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_shared_checkpointer(spark, tmp_path):
    c = stream.SharedCheckpointer(spark, f"file://{tmp_path}/cp")
    assert c.load("job/1", "") is None
    for token in ("one", "zwei é"):
        c.save("job/1", "", token)
        assert c.load("job/1", "") == token
    state = stream.Checkpoint("t1", "t2", "A1", 10, 20, 30, "p")
    c.save_state("j", state)
    assert stream.SharedCheckpointer(spark, f"file://{tmp_path}/cp").load_state("j", state).next_offset == 20
    c.remove("job/1", "")
    assert c.load("job/1", "") is None


def test_last_initial(spark):
    names = [(1, "Ann", "Lee"), (2, "Ann", "lee"), (3, "Ann", "Zee"), (4, "Ann", None), (5, "Ann", "Élan"), (6, "Ann", "")]
    rows = [(i, None, f, None, n, D, None) for i, f, n in names]
    a = spark.createDataFrame(rows, PERSON)
    free, held = (set(pairs(match(a, a, 4, MatchOptions(last_initial=x)))) for x in (False, True))
    initial = {i: (n or " ").replace("É", "e")[0].upper() for i, _, n in names}
    assert held == {p for p in free if initial[p[0]] == initial[p[1]]} and held < free
    plan = match(a, a, 4, MatchOptions(last_initial=True))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_database(spark, tmp_path):
    """A database in memory: tables, ranges of ids, the command line's read of it."""
    url, driver = "jdbc:derby:memory:kin;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    a, b = (t.fillna("") for t in households(spark, 200))  # the driver writes no nulls of text
    for name, t in (("ONE", a), ("TWO", b)):
        t.select(*[F.col(c).alias(c.upper()) for c in t.columns]).write.format("jdbc").options(url=url, dbtable=name, driver=driver, createTableColumnTypes="UUID VARCHAR(64), FIRST_NAME VARCHAR(64), MIDDLE_NAME VARCHAR(64), LAST_NAME VARCHAR(64), HH_ID VARCHAR(64)").save()
    source = tables.Source("jdbc", url, {"driver": driver})
    assert source.tables(spark) == ["ONE", "TWO"]
    ranged = tables.in_ranges(spark, source, "ONE", partitions=4)
    assert ranged.options["numPartitions"] == "4" and tables.in_ranges(spark, ranged, "ONE") is ranged and tables.in_ranges(spark, tables.Source("parquet", "x"), "ONE").options == {}
    got = tables.persons(spark, ranged, "ONE", role=1)
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == sorted(map(tuple, a.collect()))
    assert tables.person_count(spark, source, "ONE", where="ID < 10") == a.filter("id < 10").count()
    a.filter("id < 0").select(F.col("id").alias("ID")).write.format("jdbc").options(url=url, dbtable="NONE_YET", driver=driver).save()
    assert tables.in_ranges(spark, source, "NONE_YET") is source
    a.write.parquet(str(tmp_path / "in"))
    query = stream.match_sources(spark, str(tmp_path / "in"), source, "TWO", 1, out=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"), csv=str(tmp_path / "csv"))
    query.awaitTermination()
    want = match(a, b, 1)
    assert pairs(stream.streamed_pairs(spark, str(tmp_path / "out"))) == pairs(want)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).drop("batch")
    assert back.columns == export.pair_report(want, 1).columns and back.count() == want.count() > 0


class Near:
    def score(self):
        return F.when(F.lower("a_last_name") == F.lower("b_last_name"), 90.0)

    def explanation(self):
        return F.lit("near")


def test_matchers_in_streams_and_partitions(spark, tmp_path):
    from kinloom.operators import partition

    a, b = dirty_dataset(spark, 150)
    by_year = lambda prefix: [F.year(f"{prefix}_birthdate"), F.substring(F.lower(f"{prefix}_last_name"), 1, 1)]
    own = lambda x, y: engine.keyed_join(x, y, by_year, Near())
    ids = lambda df: sorted((r["a_id"], r["b_id"]) for r in df.collect())
    want = ids(own(a, b))
    sql = a.alias("x").join(b.alias("y"), F.expr("year(x.birthdate) = year(y.birthdate) and lower(x.last_name) = lower(y.last_name)"))
    assert want == sorted((r[0], r[1]) for r in sql.select("x.id", "y.id").collect()) and want
    a.write.parquet(str(tmp_path / "in"))
    stream.match_stream(stream.person_stream(spark, str(tmp_path / "in")), b, own, out=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp")).awaitTermination()
    assert ids(stream.streamed_pairs(spark, str(tmp_path / "out"))) == want
    done = stream.match_partitions(a, b, own, partition.BirthYears(30, 1950, 2009), out=str(tmp_path / "parts"), checkpointer=stream.MemoryCheckpointer(), job="j")
    assert ids(spark.read.parquet(*[str(tmp_path / "parts" / n) for n in done])) == want


def test_workbook_and_csv(spark, tmp_path, monkeypatch):
    a, b = households(spark, 60)
    one, two = match(a, b, 1), match(a, b, 2)
    sheets = export.pair_sheets(one, two, spark.createDataFrame([("k <&> \"x\"", "v\x01")], "Key string, Value string"))
    monkeypatch.setattr(export, "_SHEET_ROWS", 4)
    export.write_workbook(sheets, str(tmp_path / "book.xlsx"))
    read = {}
    with zipfile.ZipFile(tmp_path / "book.xlsx") as z:
        space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", space)]
        for part in ("[Content_Types].xml", "_rels/.rels", "xl/_rels/workbook.xml.rels"):
            ElementTree.fromstring(z.read(part))
        for i, name in enumerate(names, 1):
            rows = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{{{space['m']}}}row")
            read[name] = [["".join(c.itertext()) for c in r] for r in rows]
    assert read["Summary"] == [["Key", "Value"], ['k <&> "x"', "v"]]
    for title, want in (("Algorithm_1_Results", sheets["Algorithm_1_Results"]), ("Algorithm_2_Results", sheets["Algorithm_2_Results"])):
        parts = [n for n in names if n == title or n.startswith(title + "_")]
        assert all(read[n][0] == want.columns and len(read[n]) <= 4 for n in parts)
        assert sorted(r[0] for n in parts for r in read[n][1:]) == sorted(r["Table1_ID"] for r in want.collect())
    assert len(names) > 3
    report = export.pair_report(one, 1)
    with export.CsvWriter(str(tmp_path / "x" / "one.csv"), report.columns, flush_every=2) as out:
        assert out.append(report.limit(3)) == min(3, report.count())
        out.write([None, True, "a,b"])
    lines = (tmp_path / "x" / "one.csv").read_text().splitlines()
    assert lines[0].split(",") == report.columns and lines[-1] == ',true,"a,b"'
    args = cli.parser().parse_args(["a", "b", "5", str(tmp_path / "hh.xlsx"), "xlsx", "--source", str(tmp_path), "--workbook"])
    a.write.parquet(str(tmp_path / "a.parquet"))
    b.write.parquet(str(tmp_path / "b.parquet"))
    monkeypatch.setattr(export, "_SHEET_ROWS", 1_048_576)
    cli.run(spark, args, {})
    with zipfile.ZipFile(tmp_path / "hh.xlsx") as z:
        assert b"match_percentage" in z.read("xl/worksheets/sheet1.xml")


def test_workbook_blocks(spark, tmp_path):
    """Blocks that tasks compressed make the same cells, in order, as rows written one by one."""
    rng = random.Random(5)
    for _ in range(50):
        x, y = rng.randbytes(rng.randrange(300)), rng.randbytes(rng.randrange(70_000))
        assert export.joined_crc(zlib.crc32(x), zlib.crc32(y), len(y)) == zlib.crc32(x + y)
    rows = spark.range(0, 25_000, numPartitions=3).select(
        "id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("näme <&> "), F.col("id"))).alias("a.b"), (F.col("id") % 2 == 0).alias("even"), (F.col("id") / 3).cast("float").alias("third"),
        F.when(F.col("id") == 5, F.lit(float("nan"))).otherwise(F.lit(1.5)).alias("odd one"), F.timestamp_seconds("id").alias("at"), F.lit("2020-01-02").cast("date").alias("on"),
    )
    cells = lambda path, n: [["".join(c.itertext()) for c in r] for r in ElementTree.fromstring(zipfile.ZipFile(path).read(f"xl/worksheets/sheet{n}.xml"))[0]]
    export.write_workbook({"one": rows, "none": rows.limit(0)}, str(tmp_path / "blocks.xlsx"))
    with export.WorkbookWriter(str(tmp_path / "rows.xlsx")) as book:
        book.begin("one", rows.columns)
        for r in rows.collect():
            book.write(r)
    assert zipfile.ZipFile(tmp_path / "blocks.xlsx").testzip() is None
    got = cells(tmp_path / "blocks.xlsx", 1)
    assert got == cells(tmp_path / "rows.xlsx", 1) and len(got) == 25_001 and cells(tmp_path / "blocks.xlsx", 2) == [rows.columns]
    with export.WorkbookWriter(str(tmp_path / "mixed.xlsx")) as book:  # rows before, between and after blocks
        book.begin("s", ["id"])
        for part in (rows.select("id").limit(3), rows.select("id").limit(0), rows.select("id").limit(2)):
            book.write(["x"])
            book.append(part)
        book.write([None])
    assert [r[0] for r in cells(tmp_path / "mixed.xlsx", 1)] == ["id", "x", "0", "1", "2", "x", "x", "0", "1", ""]
    assert export.row_blocks(rows, export._csv_rows, most=1000).agg(F.sum("rows"), F.max("rows")).first()[:] == (25_000, 1000)


def test_household_numbers_follow_the_order(spark):
    """Ids that begin alike: numbers are whole and in order, and no range holds all rows."""
    rows = spark.range(5000).select(F.concat(F.lit("usr-2024-"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("uuid"), F.lit("h").alias("hh_id"), F.lit(75.0).cast("float").alias("match_percentage"))
    got = household._numbered(rows.repartition(7)).collect()
    assert [r["row_id"] for r in got] == list(range(1, 5001)) and [r["uuid"] for r in got] == sorted(r["uuid"] for r in got)
    assert household._numbered(rows.limit(0)).count() == 0


def test_household_sql_extras(spark):
    a = spark.createDataFrame([(1, "u", "Ann", "Lee", D, "r1", "0"), (2, "u", "Bo", "Lee", D, "r2", None), (3, "v", "Cy", "Lee", D, None, None)], "id long, uuid string, first_name string, last_name string, birthdate date, region_code string, poor_hat_0 string")
    b = spark.createDataFrame([(i, "1", n, "Lee", D) for i, n in enumerate(("Ann", "Bo", "Cy"))], "id long, hh_id string, first_name string, last_name string, birthdate date")
    got = household.household_sql(a, b, extras=("region_code", "poor_hat_0")).collect()
    assert sorted((r["uuid"], r["hh_id"], r["region_code"], r["poor_hat_0"], float(r["match_percentage"])) for r in got) == sorted([("u", "1", "r2", "0", 100.0), ("v", "1", None, None, 100.0)], key=str)


def test_fnv(spark):
    keys = ["", "a", "foobar", "ñandú", None, "x" * 1000, "\x00", "foobar"]
    got = [r[0] for r in spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string").coalesce(1).orderBy("i").select(similarity.fnv1a64_hash("k")).collect()]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    assert got == [None if k is None else signed(similarity.fnv1a64(k.encode())) for k in keys]
    assert similarity.fnv1a64(b"foobar") == 0x85944171F73967E8


def test_jaro_columns(spark):
    names = [("martha", "marhta"), ("dixon", "dicksonx"), ("", ""), ("a", ""), ("é" * 40, "é" * 31 + "x" * 9), (None, "a"), ("abcd", "badc")]
    df = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "i int, a string, b string")
    got = df.select("i", similarity.jaro_pct(F.col("a"), F.col("b")).alias("j"), similarity.device_jaro_winkler_pct(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()
    for (a, b), r in zip(names, got, strict=True):
        if a is None:
            assert r["j"] is None and r["d"] is None
        else:
            one, two = (x.encode()[:64].decode("latin-1") for x in (a, b))
            assert r["j"] == pytest.approx(similarity.jaro(a, b) * 100) and r["d"] == pytest.approx(similarity.jaro_winkler(one, two, gate=-1.0, whole_transpositions=False) * 100)
    assert got[0]["j"] == pytest.approx(94.4444, abs=1e-3)


def test_folders_need_sharing(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.work_folder(Cluster, "x")
    assert Counter(storage.staged(spark.range(5), "t").collect()) == Counter(spark.range(5).collect())
