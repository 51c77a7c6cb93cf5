"""Scalar functions: golden values, the scalar twins, and the bundled phonetic codec."""

from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinloom.functions import normalize as N
from kinloom.functions import phonetic as P
from kinloom.functions import similarity as S
from kinloom.generate import FIRST, LAST, MIDDLE

NAMES = [*FIRST, *LAST, *MIDDLE, "Álvaro", "ÉÉ", "  José  ", "Łukasz", "Việt Nguyễn", "", " ", "Ann.", "Pfister", "Robert", "Rupert", "Ng", "王", "Straße", "Ærø", "đặng", "a  b\tc", "x. y-z", None]


def column(spark, function, values=NAMES):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, s string").coalesce(1)
    return [r["o"] for r in df.select("i", function(F.col("s")).alias("o")).orderBy("i").collect()]


def test_normalize_golden(spark):
    got = dict(zip(NAMES, column(spark, N.normalize_text), strict=True))
    assert (got["Álvaro"], got["ÉÉ"], got["  José  "], got["Łukasz"]) == ("alvaro", "ee", "jose", "łukasz")


@pytest.mark.parametrize(("native", "scalar"), [(N.normalize_text, N.normalize_text_scalar), (N.normalize_simple, N.normalize_simple_scalar), (N.normalize_phonetic, N.normalize_phonetic_scalar), (P.soundex4, P.soundex4_scalar)])
def test_native_equals_scalar(spark, native, scalar):
    values = [n for n in NAMES if n is not None]
    assert column(spark, native, values) == [scalar(v) for v in values]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="aábcçdeéëfghijklłmnñoóøpqrsßtuüvwxyzAÁBZ .-'", max_size=14), min_size=1, max_size=30))
def test_native_equals_scalar_random(spark, values):
    for native, scalar in ((N.normalize_text, N.normalize_text_scalar), (N.normalize_phonetic, N.normalize_phonetic_scalar), (P.soundex4, P.soundex4_scalar)):
        assert column(spark, native, values) == [scalar(v) for v in values]


def test_soundex_golden():
    assert [P.soundex4_scalar(x) for x in ("Pfister", "Robert", "Rupert", "Ng", "", "王")] == ["P123", "R163", "R163", "N200", "0000", "0000"]


def test_initials(spark):
    assert column(spark, P.ascii_initial, ["Émile", "zoe", "王", "", None]) == ["M", "Z", "?", "?", None]
    assert column(spark, P.first_char_initial, ["émile", "zoe", "", None]) == ["é", "Z", "", None]


def test_double_metaphone_golden():
    want = {"jon smith": "JNSM", "john smith": "JNSM", "jose garcia": "HSKR", "maria garcia": "MRKR", "jane doe": "JNT", "mc donald": "MKTN", "xavier lopez": "SFRL", "ann lee": "ANL", "ann b lee": "ANPL", "michael smith": "MKLS", "micheal smyth": "MXLS"}
    assert {k: P.double_metaphone(k) for k in want} == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("sch wicz witz ch cz gh gn kn ps wr th tia tion sio sia cia cc ck ci ce jose san van mac mc augh umb er ie ai oi iau x zz zh sz sh heim sugar caesar isl ewski w wh ll mm rr ss tt dg dt bb ph q jj v a e i o u y g agg li ney ach chia harac arch orchid".split() + [" "]), min_size=1, max_size=7))
def test_double_metaphone_equals_codec(spark, parts):
    text = " ".join("".join(parts).split())
    codec = spark._jvm.org.apache.commons.codec.language.DoubleMetaphone()
    assert P.double_metaphone(text) == (codec.doubleMetaphone(text) or "")


def test_metaphone_column(spark):
    assert column(spark, P.metaphone_code, ["jon smith", "", None, "jon smith"]) == ["JNSM", "", None, "JNSM"]


def test_jaro_winkler(spark):
    assert S.jaro_winkler("jon smith", "john smith") * 100 == pytest.approx(97.3333, abs=1e-3)
    assert S.jaro("", "") == 1 and S.jaro("a", "") == 0
    df = spark.createDataFrame([("jon smith", "john smith"), (None, "x"), ("abcd", "wxyz")], "a string, b string").coalesce(1)
    got = [r[0] for r in df.select(S.jaro_winkler_pct(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(97.3333, abs=1e-3) and got[1] is None and got[2] == 0


@given(st.text("abcdé", max_size=8), st.text("abcdé", max_size=8))
def test_similarity_bounds(a, b):
    assert 0 <= S.jaro_winkler(a, b) <= 1 and S.jaro_winkler(a, a) == 1
    assert S.levenshtein_scalar(a, b) == S.levenshtein_scalar(b, a)


def test_levenshtein_pct(spark):
    df = spark.createDataFrame([("jon smith", "john smith"), ("", ""), ("josé", "jose")], "a string, b string").coalesce(1)
    got = [r[0] for r in df.select(S.levenshtein_pct(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([90.0, 100.0, 80.0]) == [S.levenshtein_pct_scalar(*p) for p in (("jon smith", "john smith"), ("", ""), ("josé", "jose"))]


BIRTHDATES = [((1990, 1, 1), 100), ((1990, 1, 2), 90), ((1990, 1, 3), 70), ((1990, 2, 1), 50), ((1989, 1, 1), 40), ((1989, 12, 31), 90), ((1980, 1, 1), 0)]


def test_birthdate_similarity(spark):
    pairs = [(date(1990, 1, 1), date(*d), float(p)) for d, p in BIRTHDATES] + [(date(1990, 3, 5), date(1990, 5, 3), 85.0), (date(1990, 2, 13), date(1990, 1, 13), 50.0)]
    df = spark.createDataFrame(pairs, "a date, b date, p double")
    assert df.filter(S.birthdate_similarity_pct(F.col("a"), F.col("b")) != F.col("p")).count() == 0
    assert all(S.birthdate_similarity_scalar(a, b) == p for a, b, p in pairs)


def test_thresholds():
    assert [S.parse_threshold(x) for x in ("95", "95%", "0.95", "", "bad", None, "10", "200")] == [0.95, 0.95, 0.95, 0.95, 0.95, 0.95, 0.6, 1.0]
    assert S.parse_threshold("40", least=0.5) == 0.5


def test_fnv_and_keys(spark):
    assert S.fnv1a64(b"") == 0xCBF29CE484222325 and S.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    got = spark.createDataFrame([("a",), (None,)], "s string").coalesce(1).select(S.fnv1a64_hash("s")).collect()
    assert got[0][0] & ((1 << 64) - 1) == 0xAF63DC4C8601EC8C and got[1][0] is None
    df = spark.createDataFrame([("f", None, "l", date(2000, 1, 2)), (None, "m", "l", date(2000, 1, 2))], "f string, m string, l string, d date").coalesce(1)
    c = F.col
    assert [r[0] for r in df.select(S.join_key(c("f"), c("l"), c("d"), c("m"))).collect()] == ["l\x1ff\x1f\x1f2000-01-02", None]


def test_rounded_percent(spark):
    df = spark.createDataFrame([(101.0,), (-1.0,), (95.5,)], "s double").coalesce(1)
    assert [r[0] for r in df.select(S.rounded_percent(F.col("s"))).collect()] == [100, 0, 96]
