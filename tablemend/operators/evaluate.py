"""Cell-level accuracy of a repair against known truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemend.session import cut_lineage

COUNTS = ("errors", "changed", "cleaned", "imputed", "correctly_imputed")


def pair_rows(dirty: DataFrame, clean: DataFrame, ours: DataFrame, key: str = "row_id") -> DataFrame:
    """Dirty, clean and repaired version of each record side by side, matched on its key.  A record
    that the repair lost counts as not repaired: its own cells stand for the missing ones."""

    def packed(df: DataFrame, name: str) -> DataFrame:
        rest = [F.col(f"`{c}`") for c in df.columns if c != key]
        return df.select(key, F.struct(*rest).alias(name))

    pairs = packed(dirty, "dirty").join(packed(clean, "clean"), key).join(packed(ours, "ours"), key, "left")
    held = pairs.schema["dirty"].dataType.names
    own = F.struct(*[
        (F.col(f"dirty.`{f.name}`") if f.name in held else F.lit(None)).cast(f.dataType).alias(f.name) for f in pairs.schema["ours"].dataType.fields
    ])
    return pairs.withColumn("ours", F.coalesce("ours", own))


def _shared(pairs: DataFrame) -> list[str]:
    dirty = set(pairs.schema["dirty"].dataType.names)
    return [c for c in pairs.schema["clean"].dataType.names if c in dirty]


def cell_flags(column: str, mapped: bool) -> dict[str, Column]:
    """What happened to one cell.  A missing dirty cell is never an error; it counts as
    imputed when the column is mapped and the truth is known."""
    d, k, o = (F.col(f"{side}.`{column}`") for side in ("dirty", "clean", "ours")) if mapped else (
        F.col(f"dirty.`{column}`"), F.col(f"clean.`{column}`"), F.lit(None))
    errors = d.isNotNull() & ~d.eqNullSafe(k)
    if not mapped:
        no = F.lit(False)
        return {"errors": errors, "changed": no, "cleaned": no, "imputed": no, "correctly_imputed": no}
    changed = d.isNotNull() & ~o.eqNullSafe(d)
    right = F.coalesce(o == k, F.lit(False))
    imputed = d.isNull() & k.isNotNull()
    return {
        "errors": errors,
        "changed": changed,
        "cleaned": changed & right,
        "imputed": imputed,
        "correctly_imputed": imputed & right,
    }


def _row_counts(pairs: DataFrame, mapped: Sequence[str]) -> dict[str, Column]:
    flags = [cell_flags(c, c in mapped) for c in _shared(pairs)]
    total: dict[str, Column] = {}
    for name in COUNTS:
        total[name] = F.lit(0).cast("long")
        for f in flags:
            total[name] = total[name] + f[name].cast("long")
    return total


def with_ratios(totals: DataFrame, missing: str = "imputed") -> DataFrame:
    right = F.col("cleaned") + F.col("correctly_imputed")
    precision = F.try_divide(right.cast("double"), F.col("changed") + F.col("imputed"))
    recall = F.try_divide(right.cast("double"), F.col("errors") + F.col(missing))
    out = totals.withColumn("precision", precision).withColumn("recall", recall)
    return out.withColumn("f1", F.try_divide(F.lit(2.0), F.try_divide(F.lit(1.0), F.col("precision")) + F.try_divide(F.lit(1.0), F.col("recall"))))


def accuracy(dirty: DataFrame, clean: DataFrame, ours: DataFrame, mapped: Sequence[str], key: str = "row_id") -> DataFrame:
    """Errors, changes, repairs, imputations, precision, recall and F1, in one pass over the joined rows."""
    pairs = pair_rows(dirty, clean, ours, key)
    counts = _row_counts(pairs, mapped)
    return with_ratios(pairs.agg(*[F.sum(counts[n]).alias(n) for n in COUNTS]))


def accuracy_prefix(
    dirty: DataFrame, clean: DataFrame, ours: DataFrame, mapped: Sequence[str], positions: DataFrame, first: int, key: str = "row_id"
) -> DataFrame:
    """Accuracy when only the first ``first`` records have been repaired; errors and missing
    cells of all records stay in the recall's denominator."""
    pairs = pair_rows(dirty, clean, ours, key).join(positions.select(key, "row_no"), key)
    counts = _row_counts(pairs, mapped)
    done = F.col("row_no") <= first
    sums = [F.sum(counts["errors"]).alias("errors"), F.sum(counts["imputed"]).alias("missing")]
    sums += [F.coalesce(F.sum(F.when(done, counts[n])), F.lit(0)).alias(n) for n in COUNTS[1:]]
    return with_ratios(pairs.agg(*sums), "missing")


def learning_curve(
    dirty: DataFrame, clean: DataFrame, ours: DataFrame, mapped: Sequence[str], key: str = "row_id", prefix: int = 4
) -> DataFrame:
    """F1 after each record in key order.

    ``key`` is an md5 text.  Totals per key prefix are added up first (a bounded list),
    so each prefix continues from its start and no window spans all rows.
    """
    pairs = pair_rows(dirty, clean, ours, key)
    counts = _row_counts(pairs, mapped)
    names = ["row_no", *COUNTS]
    rows = pairs.select(key, F.substring(key, 1, prefix).alias("_bucket"), F.lit(1).cast("long").alias("row_no"),
                        *[counts[n].alias(n) for n in COUNTS])
    sums = cut_lineage(rows.groupBy("_bucket").agg(*[F.sum(n).alias(n) for n in names]))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_bucket", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in names])
    within = Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    running = rows.join(F.broadcast(starts), "_bucket").select(
        key, *[(F.col(f"_{n}") + F.sum(n).over(within)).alias(n) for n in names]
    )
    whole = sums.agg(F.sum("errors").alias("e"), F.sum("imputed").alias("m"))
    running = running.withColumn("errors", whole.select("e").scalar()).withColumn("missing", whole.select("m").scalar())
    return with_ratios(running, "missing")


def error_report(dirty: DataFrame, clean: DataFrame, ours: DataFrame, mapped: Sequence[str], key: str = "row_id") -> DataFrame:
    """Wrong cells of mapped columns, counted: changed to a wrong value, or left unchanged."""
    pairs = pair_rows(dirty, clean, ours, key)
    wrong = []
    for c in _shared(pairs):
        if c not in mapped:
            continue
        d, k, o = (F.col(f"{side}.`{c}`") for side in ("dirty", "clean", "ours"))
        flags = cell_flags(c, True)
        bad_change = flags["changed"] & ~flags["cleaned"]
        left = flags["errors"] & ~flags["changed"]
        kind = F.when(bad_change, F.lit("changed")).when(left, F.lit("left"))
        wrong.append(F.when(bad_change | left, F.struct(
            F.lit(c).alias("column"), kind.alias("kind"), d.cast("string").alias("dirty"),
            o.cast("string").alias("ours"), k.cast("string").alias("clean"))))
    cells = pairs.select(F.explode(F.array_compact(F.array(*wrong))).alias("c")).select("c.*")
    return cells.groupBy("column", "kind", "dirty", "ours", "clean").agg(F.count("*").alias("n"))


def repair_log(before: DataFrame, after: DataFrame, columns: Sequence[str], key: str = "row_id") -> DataFrame:
    """One row per changed cell between two versions; a record gone from one side has nulls there."""
    b, a = before.alias("b"), after.alias("a")
    joined = b.join(a, F.col(f"b.{key}") == F.col(f"a.{key}"), "full_outer")
    changes = [
        F.when(
            ~F.col(f"b.`{c}`").eqNullSafe(F.col(f"a.`{c}`")),
            F.struct(F.lit(c).alias("column"), F.col(f"b.`{c}`").cast("string").alias("old"), F.col(f"a.`{c}`").cast("string").alias("new")),
        )
        for c in columns
    ]
    return joined.select(
        F.coalesce(f"b.{key}", f"a.{key}").alias(key), F.explode(F.array_compact(F.array(*changes))).alias("c")
    ).select(key, "c.*")
