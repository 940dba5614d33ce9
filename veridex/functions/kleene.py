"""Three-valued results as small integers.

FALSE 0, UNKNOWN 1 (a caveat lacks context), OPEN 2 (not yet resolved, or failed), TRUE 3. In this order OR is the
greatest; with UNKNOWN and OPEN swapped AND is the least. So both are plain max and min aggregates with map-side
combine, which bool_or and bool_and (they skip nulls) are not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cel import FALSE, OPEN, TRUE, UNKNOWN_CODE as UNKNOWN


def _look_up(c: Column, *values: int) -> Column:
    """By table, so that the operand stands in the plan once."""
    return F.element_at(F.array(*map(F.lit, values)), c + 1)


def swap(c: Column) -> Column:
    return _look_up(c, FALSE, OPEN, UNKNOWN, TRUE)


def k_or(*cs: Column) -> Column:
    return F.greatest(*cs) if len(cs) > 1 else cs[0]


def k_and(*cs: Column) -> Column:
    return swap(F.least(*map(swap, cs))) if len(cs) > 1 else cs[0]


def k_not(c: Column) -> Column:
    return _look_up(c, TRUE, UNKNOWN, OPEN, FALSE)


def any_of(c: Column) -> Column:
    """Aggregate: Kleene OR of a group."""
    return F.max(c)


def all_of(c: Column) -> Column:
    """Aggregate: Kleene AND of a group."""
    return swap(F.min(swap(c)))


def missing_of(code: Column, missing: Column) -> Column:
    """Aggregate: the missing names of the unknown rows, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(code == UNKNOWN, missing)))))


def union_missing(*ms: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*ms))) if len(ms) > 1 else ms[0]


def verdict(code: Column) -> Column:
    return F.when(code == TRUE, "member").when(code == FALSE, "not_member").when(code == UNKNOWN, "caveated")


def boolean(code: Column) -> Column:
    """TRUE, FALSE or NULL."""
    return F.when(code == TRUE, F.lit(True)).when(code == FALSE, F.lit(False))
