"""Edit distance with transpositions, and the deletion keys that make it joinable."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tablemend.functions.expr import col


def _distance_udf():
    # Defined inside a function so that Spark ships the code itself to the executors,
    # which then need no copy of this package.
    def distance(a: str, b: str) -> int:
        # Unrestricted form: letters between two swapped ones may themselves be edited.
        far = len(a) + len(b)
        table = {(-1, -1): far}
        for i in range(len(a) + 1):
            table[i, -1], table[i, 0] = far, i
        for j in range(len(b) + 1):
            table[-1, j], table[0, j] = far, j
        last_row: dict[str, int] = {}
        for i, ca in enumerate(a, 1):
            last_col = 0
            for j, cb in enumerate(b, 1):
                row, column = last_row.get(cb, 0), last_col
                if ca == cb:
                    last_col = j
                table[i, j] = min(
                    table[i - 1, j - 1] + (ca != cb),
                    table[i - 1, j] + 1,
                    table[i, j - 1] + 1,
                    table[row - 1, column - 1] + (i - row - 1) + 1 + (j - column - 1),
                )
            last_row[ca] = i
        return table[len(a), len(b)]

    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b)], dtype="Int32")

    # Nondeterministic only to the optimizer: it then neither evaluates the call twice
    # nor moves it below the step that makes the pairs distinct.
    return F.pandas_udf(batch, IntegerType()).asNondeterministic()


def _swaps(w: Column) -> Column:
    """Every string one swap of neighbours away."""
    return F.when(
        F.length(w) > 1,
        F.transform(
            F.sequence(F.lit(1), F.length(w) - 1),
            lambda i: F.concat(
                F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.lit(1)), F.substr(w, i, F.lit(1)), F.substr(w, i + 2, F.length(w))
            ),
        ),
    ).otherwise(F.array().cast("array<string>"))


def _distance_up_to_2(a: Column, b: Column, changed: Column | None = None) -> Column:
    # Two edits are two single steps.  Without a swap among them plain Levenshtein already
    # says 2; otherwise undoing the swap on one side leaves at most one plain edit, or a
    # swap on the other side.  Swaps keep a word's letters and the other edit changes one,
    # so most pairs are settled by comparing the letters.
    plain = F.levenshtein(a, b, 4)
    same_size = F.length(a) == F.length(b)
    new_letters = [F.length(F.call_function("translate", x, y, F.lit(""))) for x, y in ((a, b), (b, a))]
    one_swap = same_size & (new_letters[0] == 0) & F.array_contains(_swaps(a), b)
    swap_and_edit = (
        F.exists(_swaps(a), lambda x: F.levenshtein(x, b, 1) >= 0)
        | F.exists(_swaps(b), lambda y: F.levenshtein(a, y, 1) >= 0)
    )
    two_swaps = same_size & (new_letters[0] == 0) & F.arrays_overlap(_swaps(a), _swaps(b))
    few_new = (new_letters[0] <= 1) & (new_letters[1] <= 1)
    if changed is not None:
        one_swap, two_swaps, few_new = (changed == 0) & one_swap, (changed == 0) & two_swaps, (changed <= 2) & few_new
    return (
        F.when(plain.between(0, 1), plain)
        .when(plain == 2, F.when(one_swap, 1).otherwise(2))
        .when(plain < 0, 3)
        .when(two_swaps, 2)
        .when((plain == 3) & few_new & swap_and_edit, 2)
        .otherwise(3)
    )


def edit_distance(a: Column | str, b: Column | str, bound: int | None = None, changed: Column | str | None = None) -> Column:
    """Exact distance, or for ``bound`` <= 2 the distance if within it and 3 beyond.  ``changed``: a number that swaps leave
    0 and that any other edit raises by at most 2, if one is known.

    The bounded form stays in the JVM.  The other one starts with it, so that only pairs more
    than two edits apart reach Python.
    """
    a, b = col(a), col(b)
    if bound is not None and bound <= 2:
        return _distance_up_to_2(a, b, None if changed is None else col(changed))
    near = _distance_up_to_2(a, b)
    far = _distance_udf()(F.when(near > 2, a), F.when(near > 2, b))
    return F.when(near <= 2, near).otherwise(far)


def deletion_keys(word: Column | str, k: int) -> Column:
    """All strings left after deleting at most ``k`` letters, as (hash, letters dropped).

    Two words at edit distance <= k (swaps included) always share one: every
    insertion, deletion, substitution or swap is undone by dropping at most one
    letter on each side, and such drops compose.
    """

    def drop_one(w: Column) -> Column:
        return F.when(
            F.length(w) > 0,
            F.transform(
                F.sequence(F.lit(1), F.length(w)),
                lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.length(w))),
            ),
        ).otherwise(F.array().cast("array<string>"))

    def labelled(level: Column, dropped: int) -> Column:
        return F.transform(level, lambda v: F.struct(F.xxhash64(v).alias("v"), F.lit(dropped).alias("d")))

    level = F.array(col(word))
    keys = [labelled(level, 0)]
    for dropped in range(1, k + 1):
        level = F.array_distinct(F.flatten(F.transform(level, drop_one)))
        keys.append(labelled(level, dropped))
    return F.concat(*keys)
