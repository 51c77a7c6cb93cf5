"""Columns that matching derives once for each person, below every join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import normalize, phonetic


def normalized(persons: DataFrame, *, punctuation: bool = False) -> DataFrame:
    """persons with n_first, n_mid, n_last; punctuation=True also evens out full stops and hyphens."""

    def norm(name: str) -> Column:
        c = normalize.normalize_text(F.col(name))
        return normalize.normalize_simple(c) if punctuation else c

    return persons.withColumns({"n_first": norm("first_name"), "n_mid": norm("middle_name"), "n_last": norm("last_name")})


#: Bytes of a task's share of a scan.
SPLIT = 128 << 20


def small(table: DataFrame) -> bool:
    """Spark estimates the table to be less than a scan's share for every core."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return not table.isStreaming and int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * SPLIT


def spread(table: DataFrame, by: str = "id") -> DataFrame:
    """A small table dealt out by id, or another column, to as many tasks as there are cores; others as they are.

    Names are costly beside the reading of a row; a small table's scan has a task or two.
    """
    return table.repartition(table.sparkSession.sparkContext.defaultParallelism, by) if small(table) else table


def full_names(persons: DataFrame, *, middle: bool, accent_fold: bool = True) -> DataFrame:
    """persons with s_first, s_mid, s_last and full, their compared forms, for fuzzy rules.

    Persons without any name or without a birthdate can't match and are left out.
    """

    def part(name: str) -> Column:
        return normalize.normalize_text(F.col(name)) if accent_fold else F.col(name)

    first, mid, last = part("first_name"), part("middle_name"), part("last_name")
    simple = {n: F.coalesce(normalize.normalize_simple(c), F.lit("")) for n, c in (("s_first", first), ("s_mid", mid), ("s_last", last))}
    df = persons.filter(F.col("birthdate").isNotNull()).withColumns(simple | {"full": normalize.full_name(first, last, mid if middle else None)})
    return df.filter(F.trim("full") != "")


def coded(named: DataFrame) -> DataFrame:
    """Named rows with code, the Double Metaphone of full; declared non-deterministic, so that no filter computes it once more."""
    return named.withColumn("code", phonetic.metaphone_code.asNondeterministic()(normalize.normalize_phonetic(F.col("full"))))


def scored_names(persons: DataFrame, *, middle: bool, accent_fold: bool = True) -> DataFrame:
    """full_names with their codes."""
    return coded(full_names(persons, middle=middle, accent_fold=accent_fold))


def side(df: DataFrame, prefix: str) -> DataFrame:
    """df with every column's name prefixed, for joins."""
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])
