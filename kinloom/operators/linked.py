"""Pairs of persons as links of classes: persons of equal compared columns have the same matches, and are compared once.

What grows with the square of the persons is the list of pairs alone.  Classes are linked without it, and roll-ups that
need a person's best matches only never make it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Linked:
    """Persons of both sides (columns a_*, b_*) and the links of their classes; by: the columns of a class, never null.

    links: a row for each pair of classes that match, with a_* and b_* of by, and what the link's score is; None: classes
    match where they are equal.
    """

    one: DataFrame
    two: DataFrame
    links: DataFrame | None
    by: tuple[str, ...]

    def _on(self, prefix: str) -> list[str]:
        return [f"{prefix}_{c}" for c in self.by]

    def pairs(self, *, second: bool = False) -> DataFrame:
        """All pairs of persons; they are the last join's output, and are not shuffled.  second: links meet the second side first."""
        if self.links is None:
            return self.one.join(self.two, [F.col(x) == F.col(y) for x, y in zip(self._on("a"), self._on("b"), strict=True)])
        if second:
            return self.two.join(self.links, self._on("b")).join(self.one, self._on("a"))
        return self.one.join(self.links, self._on("a")).join(self.two, self._on("b"))

    def shorter(self) -> bool:
        """Whether links make fewer rows with the second side's persons than with the first's: what the last join gets.  Runs a job."""
        made = [t.groupBy(*self._on(p)).agg(F.count(F.lit(1)).alias("n")).join(self.links, self._on(p)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias(p)) for t, p in ((self.one, "a"), (self.two, "b"))]
        row = made[0].crossJoin(made[1]).first()
        return row["b"] < row["a"]

    def shown(self, one: list[Column], two: list[Column], told: list[Column]) -> Linked:
        """The same with these columns alone: one and two of persons, told of links (columns of pairs, where links is None).

        What a pair shows is then made once for each person and link, below the joins, and not for each pair.
        """
        links = None if self.links is None else self.links.select(*self._on("a"), *self._on("b"), *told)
        return replace(self, one=self.one.select(*self._on("a"), *one), two=self.two.select(*self._on("b"), *two), links=links)

    def nearest(self, prefix: str, household: str, confidence: str) -> DataFrame:
        """For each person of a side (prefix), two of its pairs: with the first and the last household of greatest confidence.

        household: a column of the other side, null for persons who have none; they are no one's match.  Returns the
        person's columns, household and confidence.
        """
        persons, side, table = (self.one, "b", self.two) if prefix == "a" else (self.two, "a", self.one)
        ends = table.filter(F.col(household).isNotNull()).groupBy(*self._on(side)).agg(F.min(household).alias("low"), F.max(household).alias("high"))
        linked = self.links.join(ends, self._on(side))
        last = F.max(F.struct(F.col(confidence).alias("c"), F.col("high").alias("h")))
        first = F.min(F.struct((-F.col(confidence)).alias("c"), F.col("low").alias("h")))
        top = linked.groupBy(*self._on(prefix)).agg(last.alias("last"), first.alias("first"))
        top = top.select(*self._on(prefix), F.col("last.c").alias(confidence), F.explode(F.array_distinct(F.array("first.h", "last.h"))).alias(household))
        return persons.join(top, self._on(prefix))
