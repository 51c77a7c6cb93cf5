"""Seeded person tables for tests and benchmarks: rows are integer arithmetic on spark.range, alike in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = ["Maria", "José", "John", "Jon", "Ann", "Anne", "Michael", "Micheal", "Robert", "Jane", "Juan", "Ana", "Peter", "Björn", "Zoë", "Mark"]
LAST = ["Santos", "Santoz", "Smith", "Smyth", "García", "Garcia", "Reyes", "Reyez", "O'Neil", "Smith-Jones", "Dela Cruz", "Müller", "Lee", "Lopez", "Brown", "Browne"]
MIDDLE = ["A", "B.", "Lee", "Marie", "De la"]


def pick(words: list[str], index: Column) -> Column:
    """words[index] as a native expression."""
    return F.element_at(F.array(*map(F.lit, words)), (index + 1).cast("int"))


def draw(key: Column, seed: int, n: int) -> Column:
    """A number from 0 to n - 1 that depends on key and seed."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n))


def add_typo(name: Column, key: Column, seed: int) -> Column:
    """name with one substituted, deleted, inserted or transposed character; names of one character stay."""
    at = (draw(key, seed, 1 << 20) % F.greatest(F.length(name) - 1, F.lit(1)) + 1).cast("int")
    kind, letter = draw(key, seed + 1, 4), F.chr(F.lit(97) + draw(key, seed + 2, 26))
    before, c, after = F.substring(name, F.lit(1), at - 1), F.substring(name, at, F.lit(1)), F.substring(name, at + 1, F.lit(1 << 20))
    swapped = F.concat(before, F.substring(after, 1, 1), c, F.substring(after, F.lit(2), F.lit(1 << 20)))
    changed = F.when(kind == 0, F.concat(before, letter, after)).when(kind == 1, F.concat(before, after)).when(kind == 2, F.concat(before, c, letter, after)).otherwise(swapped)
    return F.when(F.length(name) < 2, name).otherwise(changed)


def truncate_name(name: Column, length: int = 3) -> Column:
    return F.substring(name, 1, length)


def _people(spark: SparkSession, n: int, seed: int, number: Column) -> DataFrame:
    df = spark.range(n).withColumn("k", number)
    day = draw(F.col("k"), seed + 3, 60 * 365)
    return df.select(
        "id", F.concat(F.lit("u"), F.floor(F.col("k") / 4).cast("string")).alias("uuid"), pick(FIRST, draw(F.col("k"), seed, 16)).alias("first_name"), F.when(F.col("k") % 3 == 0, pick(MIDDLE, draw(F.col("k"), seed + 1, 5))).alias("middle_name"), pick(LAST, draw(F.col("k"), seed + 2, 16)).alias("last_name"), F.date_add(F.lit("1950-01-01").cast("date"), day.cast("int")).alias("birthdate"), F.floor(F.col("k") / 4).cast("string").alias("hh_id")
    )


def clean_dataset(spark: SparkSession, n: int, *, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Two tables: a fifth of each repeats an earlier row, and half of the second are persons of the first."""
    own = F.when(draw(F.col("id"), seed + 9, 5) == 0, F.floor(F.col("id") / 2)).otherwise(F.col("id"))
    shared = F.when(draw(F.col("id"), seed + 8, 2) == 0, F.col("id")).otherwise(F.col("id") + F.lit(10 * n))
    return _people(spark, n, seed, own), _people(spark, n, seed, shared)


def dirty_dataset(spark: SparkSession, n: int, *, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Two tables: two fifths of the second are persons of the first, and 30 of 100 of those have a typo, a cut name or no middle name."""
    shared = F.when(draw(F.col("id"), seed + 8, 5) < 2, F.col("id")).otherwise(F.col("id") + F.lit(10 * n))
    b, kind = _people(spark, n, seed, shared), draw(F.col("id"), seed + 7, 100)
    first = F.when(kind < 10, add_typo(F.col("first_name"), F.col("id"), seed)).when(kind < 15, truncate_name(F.col("first_name"))).otherwise(F.col("first_name"))
    last = F.when(kind.between(15, 24), add_typo(F.col("last_name"), F.col("id"), seed + 20)).otherwise(F.col("last_name"))
    middle = F.when(kind.between(25, 29), None).otherwise(F.col("middle_name"))
    return _people(spark, n, seed, F.col("id")), b.withColumns({"first_name": first, "last_name": last, "middle_name": middle})


def households(spark: SparkSession, n: int, *, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Two tables of households of four; in three of ten households most members are persons of the second table."""
    a = _people(spark, n, seed, F.col("id")).withColumn("hh_id", F.lit(None).cast("string"))
    group = F.floor(F.col("id") / 4)
    matchy = (draw(group, seed + 5, 10) < 3) & (draw(F.col("id"), seed + 6, 10) < 8)
    b = _people(spark, n, seed, F.when(matchy, F.col("id")).otherwise(F.col("id") + F.lit(10 * n)))
    return a, b.withColumns({"hh_id": F.concat(F.lit("H"), F.floor(F.col("id") / 4).cast("string")), "uuid": F.lit(None).cast("string")})
