"""String distances as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_MARK = "\u0000"


def _char(s: Column, i: Column) -> Column:
    return F.substr(s, i, F.lit(1))


def _put(s: Column, i: Column, ch: str) -> Column:
    return F.overlay(s, F.lit(ch), i, F.lit(1))


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro similarity with the four-letter prefix bonus.

    Letters of ``a`` are matched left to right against unused letters of ``b`` inside the match
    window; used letters of ``b`` are overwritten with a mark, so the state is two short strings.
    """
    la, lb = F.length(a), F.length(b)
    reach = F.greatest(F.floor(F.greatest(la, lb) / 2) - 1, F.lit(0)).cast("int")
    start_state = F.struct(F.lit("").alias("hit"), b.alias("left"))

    def step(acc, i):
        low = F.greatest(i - reach, F.lit(1)).cast("int")
        high = F.least(i + reach, lb).cast("int")
        window = F.when(high >= low, F.substr(acc["left"], low, high - low + 1)).otherwise(F.lit(""))
        at = F.instr(window, _char(a, i))
        found = at > 0
        return F.struct(
            F.when(found, F.concat(acc["hit"], _char(a, i))).otherwise(acc["hit"]).alias("hit"),
            F.when(found, _put(acc["left"], low + at - 1, _MARK)).otherwise(acc["left"]).alias("left"),
        )

    def finish(acc):
        used = F.array_join(
            F.transform(
                F.filter(F.sequence(F.lit(1), lb), lambda j: _char(acc["left"], j) == _MARK),
                lambda j: _char(b, j),
            ),
            "",
        )
        m = F.length(acc["hit"]).cast("double")
        swaps = F.size(
            F.filter(
                F.sequence(F.lit(1), F.greatest(F.length(acc["hit"]), F.lit(1))),
                lambda k: _char(acc["hit"], k) != _char(used, k),
            )
        )
        jaro = (F.try_divide(m, la) + F.try_divide(m, lb) + F.try_divide(m - swaps / 2, m)) / 3
        prefix = F.aggregate(
            F.sequence(F.lit(1), F.least(F.lit(4), la, lb)),
            F.lit(0),
            lambda n, k: F.when((n == k - 1) & (_char(a, k) == _char(b, k)), n + 1).otherwise(n),
        )
        return F.when(m == 0, F.lit(0.0)).otherwise(jaro + prefix * 0.1 * (1 - jaro))

    folded = F.aggregate(F.sequence(F.lit(1), la), start_state, step, finish)
    return F.when(a == b, F.lit(1.0)).when((la == 0) | (lb == 0), F.lit(0.0)).otherwise(folded)


def jaro_winkler_at_least(a: Column, b: Column, floor: float) -> Column:
    """``jaro_winkler(a, b) >= floor`` behind an exact upper bound that skips hopeless pairs.

    Letters of ``a`` that do not occur in ``b`` can never match, which bounds the matches, and so
    the Jaro value; the prefix adds at most 0.4 of the remainder.
    """
    la, lb = F.length(a).cast("double"), F.length(b).cast("double")
    shared = F.size(F.filter(F.split(a, ""), lambda ch: (ch != "") & b.contains(ch)))
    matches = F.least(shared.cast("double"), lb)
    bound = (F.try_divide(matches, la) + F.try_divide(matches, lb) + 1) / 3
    hopeful = F.coalesce(bound + 0.4 * (1 - bound) >= floor - 1e-9, F.lit(False))
    return F.when(hopeful, jaro_winkler(a, b) >= floor).otherwise(a == b)


def edit_distance_at_most_one(a: Column, b: Column) -> Column:
    """Optimal string alignment distance of exactly one: one edit, or one swap of neighbours."""
    n = F.length(a)
    swap = F.exists(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.concat(
            F.substr(a, F.lit(1), i - 1), _char(a, i + 1), _char(a, i), F.substr(a, i + 2, n)
        )
        == b,
    )
    return (a != b) & ((F.levenshtein(a, b) == 1) | ((n == F.length(b)) & (n > 1) & swap))


def alignment_distance(a: Column, b: Column) -> Column:
    """Optimal string alignment distance (adjacent swaps count once), one row of the table per letter."""
    la, lb = F.length(a), F.length(b)
    zero_row = F.sequence(F.lit(0), lb)
    state = F.struct(
        F.transform(zero_row, lambda x: x + 1_000_000).alias("before"), zero_row.alias("row")
    )

    def step(acc, i):
        start = F.array(i)

        def cell(row, j):
            # row holds the new row up to j - 1; acc.row is row i - 1 and acc.before is row i - 2.
            cost = F.when(_char(a, i) == _char(b, j), F.lit(0)).otherwise(F.lit(1))
            plain = F.least(
                F.try_element_at(acc["row"], j + 1) + 1,
                F.try_element_at(row, j) + 1,
                F.try_element_at(acc["row"], j) + cost,
            )
            swapped = (i > 1) & (j > 1) & (_char(a, i) == _char(b, j - 1)) & (_char(a, i - 1) == _char(b, j))
            best = F.when(
                swapped, F.least(plain, F.try_element_at(acc["before"], F.greatest(j - 1, F.lit(1))) + 1)
            ).otherwise(plain)
            return F.concat(row, F.array(best))

        return F.struct(
            acc["row"].alias("before"),
            F.aggregate(F.sequence(F.lit(1), lb), start, cell).alias("row"),
        )

    folded = F.aggregate(F.sequence(F.lit(1), la), state, step, lambda acc: F.try_element_at(acc["row"], F.lit(-1)))
    return F.when(la == 0, lb).when(lb == 0, la).otherwise(folded)
