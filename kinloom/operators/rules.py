"""The case rule of fuzzy matching: from three metrics of a pair of names to a label and a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions.similarity import jaro_winkler_pct, levenshtein_pct, within

PASS, CLOSE, EDITS = 85.0, 88.0, 2
DIRECT, CASE_1, CASE_2, CASE_3 = "DIRECT MATCH", "CASE 1", "CASE 2", "CASE 3"


def candidates(pairs: DataFrame) -> DataFrame:
    """pairs (columns a_*, b_* of scored names) that can match, with lev and mp.

    A match has two of three metrics over the bar, so Levenshtein or the phonetic code is among them: both are native,
    and only what is left needs Jaro-Winkler.
    """
    one, two = F.col("a_full"), F.col("b_full")
    lev = levenshtein_pct(one, two)
    # Over PASS there are few edits, and no more than these are counted where names are further apart.
    most = F.floor(F.greatest(F.octet_length(one), F.octet_length(two)) * ((100 - PASS) / 100) + 1e-6).cast("int")
    near = (F.abs(F.length(one) - F.length(two)) <= most) & (F.call_function("levenshtein", one, two, most) >= 0) & (lev >= PASS)
    same_code = F.coalesce((F.col("a_code") == F.col("b_code")) & (F.col("a_code") != ""), F.lit(False))
    return pairs.filter(same_code | near).withColumns({"lev": lev, "mp": F.when(same_code, 100.0).otherwise(0.0)})


def classify(pairs: DataFrame, *, middle: bool) -> DataFrame:
    """Matching pairs with score (0 to 100) and label."""
    direct = F.col("a_full") == F.col("b_full")
    asked = candidates(pairs).withColumn("jw", jaro_winkler_pct(F.when(~direct, F.col("a_full")), F.col("b_full")))
    lev, jw, mp = F.col("lev"), F.col("jw"), F.col("mp")
    passed = sum(((m >= PASS).cast("int") for m in (lev, jw, mp)), F.lit(0))
    mean = (lev + jw + mp) / 3
    parts = ["first", "last"] + (["mid"] if middle else [])
    near: Column = F.lit(True)
    for p in parts:
        near = near & within(F.col(f"a_s_{p}"), F.col(f"b_s_{p}"), EDITS)
    label = (
        F.when(direct, DIRECT)
        .when(passed == 3, CASE_1)
        .when((passed >= 2) & (mean >= CLOSE) & near, CASE_3)
        .when(passed >= 2, CASE_2)
    )
    return asked.withColumns({"label": label, "score": F.when(direct, 100.0).otherwise(mean)}).filter(F.col("label").isNotNull()).drop("lev", "jw", "mp")
