"""The algorithms by number and name, and one function that runs any of them."""

from __future__ import annotations

import enum
from dataclasses import dataclass

from pyspark.sql import DataFrame

from kinloom.operators import blocking, household, matching
from kinloom.operators.linked import Linked


class Algorithm(enum.IntEnum):
    FIRST_LAST_DOB = 1
    FIRST_MID_LAST_DOB = 2
    FUZZY = 3
    FUZZY_NO_MIDDLE = 4
    HOUSEHOLD_T1 = 5
    HOUSEHOLD_T2 = 6
    FUZZY_BIRTHDATE = 7


HOUSEHOLD = (Algorithm.HOUSEHOLD_T1, Algorithm.HOUSEHOLD_T2)


@dataclass(frozen=True)
class MatchOptions:
    """What a run can vary; there are no process-wide switches."""

    min_confidence: float = 0.0
    accent_fold: bool = True  # fuzzy rules compare folded names; False compares them as they are
    punctuation: bool = False  # exact rules even out full stops and hyphens
    blocking: str | None = None  # "soundex": blocked candidates for A3, A4 and households; "keys": A3, A4 and households by shared keys of names, with the same result as without
    last_initial: bool = False  # unblocked fuzzy rules compare persons of equal last initial only


def match(a: DataFrame, b: DataFrame, algorithm: Algorithm | int, options: MatchOptions | None = None) -> DataFrame:
    """Pairs (A1 to A4, A7) or household rows (A5, A6; min_confidence 0 stands for 0.95 there)."""
    o, algorithm = options or MatchOptions(), Algorithm(algorithm)
    if o.blocking not in (None, "soundex", "keys"):
        raise ValueError(f"unknown blocking: {o.blocking}")
    if algorithm == Algorithm.FIRST_LAST_DOB:
        return matching.exact_first_last_dob(a, b, punctuation=o.punctuation)
    if algorithm == Algorithm.FIRST_MID_LAST_DOB:
        return matching.exact_first_mid_last_dob(a, b, punctuation=o.punctuation)
    fuzzy = {"min_confidence": o.min_confidence, "accent_fold": o.accent_fold}
    whole = {"last_initial": o.last_initial, "keys": o.blocking == "keys"}
    if algorithm == Algorithm.FUZZY:
        return blocking.fuzzy_blocked(a, b, middle=True, **fuzzy) if o.blocking == "soundex" else matching.fuzzy(a, b, **whole, **fuzzy)
    if algorithm == Algorithm.FUZZY_BIRTHDATE:
        return blocking.fuzzy_birthdate(a, b, **fuzzy)
    if algorithm == Algorithm.FUZZY_NO_MIDDLE:
        return blocking.fuzzy_blocked(a, b, **fuzzy) if o.blocking == "soundex" else matching.fuzzy_no_middle(a, b, **whole, **fuzzy)
    run = household.household_t1 if algorithm == Algorithm.HOUSEHOLD_T1 else household.household_t2
    how = {"min_confidence": o.min_confidence or 0.95, "accent_fold": o.accent_fold}
    if o.blocking == "soundex":
        return run(a, b, linked=blocking.linked_blocked(a, b, accent_fold=o.accent_fold), **how)
    return run(a, b, keys=o.blocking == "keys", **how)


def match_classes(a: DataFrame, b: DataFrame, algorithm: Algorithm | int, options: MatchOptions | None = None) -> Linked:
    """A1 to A4 without blocking as persons and links of their classes (links: score, label), whose pairs are those of match."""
    o, algorithm = options or MatchOptions(), Algorithm(algorithm)
    if algorithm > Algorithm.FUZZY_NO_MIDDLE or o.blocking == "soundex" or o.last_initial:
        raise ValueError("classes are linked by A1 to A4 without blocking")
    if algorithm in (Algorithm.FIRST_LAST_DOB, Algorithm.FIRST_MID_LAST_DOB):
        return matching.exact_linked(a, b, middle=algorithm == Algorithm.FIRST_MID_LAST_DOB, punctuation=o.punctuation)
    linked = matching.linked(a, b, None, middle=algorithm == Algorithm.FUZZY, accent_fold=o.accent_fold, heavy=matching.HEAVY)
    return matching.confident(linked, o.min_confidence)
