"""Comparing states: changed files, tables after an edit, steps of a run that failed or were superseded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str, signature: str) -> DataFrame:
    """key and change: added, removed or changed; what is equal is left out."""
    both = old.select(key, F.col(signature).alias("__old"), F.lit(True).alias("__was")).join(new.select(key, F.col(signature).alias("__new"), F.lit(True).alias("__is")), key, "full")
    kind = F.when(F.col("__was").isNull(), "added").when(F.col("__is").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return both.select(key, kind.alias("change")).filter("change is not null")


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """All tables without the rows of deleted keys."""
    return {name: t.join(gone.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def fresh_results(results: DataFrame, current: DataFrame, key: str, version: str) -> DataFrame:
    """Results made for the version that is current."""
    return results.join(current.select(key, version), [key, version], "left_semi")


def circuit(log: DataFrame, run: str, order: str, failed: Column, most: int = 4) -> DataFrame:
    """A run's log with broken: whether `most` failures in a row stand before a row."""
    turn = W.partitionBy(run).orderBy(order)
    ok_before = F.coalesce(F.sum((~failed).cast("int")).over(turn.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    streak = F.sum(failed.cast("int")).over(W.partitionBy(run, "__ok").orderBy(order))
    marked = log.withColumn("__ok", ok_before).withColumn("__streak", streak)
    return marked.withColumn("broken", F.coalesce(F.max((F.col("__streak") >= most).cast("int")).over(turn.rowsBetween(W.unboundedPreceding, -1)) == 1, F.lit(False))).drop("__ok", "__streak")


def reconciled(old: DataFrame, new: DataFrame, key: str, exact: list[str], alike: list[str], order: str) -> DataFrame:
    """For each new layer the old one whose state it takes over: of the same key and the same `exact` columns, else the
    k-th old one left with the same `alike` columns for the k-th new one left."""
    old = old.select(F.col(key).alias("old_key"), *[F.col(c).alias(f"o_{c}") for c in exact], F.col(order).alias("o_order"), *[F.col(c).alias(f"a_{c}") for c in alike])
    same = F.col(key) == F.col("old_key")
    for c in exact:
        same &= F.col(c).eqNullSafe(F.col(f"o_{c}"))
    by_key = new.join(old, same).select(key, "old_key")
    place = lambda cols, o: F.row_number().over(W.partitionBy(*cols).orderBy(o))
    left_new = new.join(by_key, key, "left_anti").withColumn("__k", place(alike, order))
    left_old = old.join(by_key.select("old_key"), "old_key", "left_anti").withColumn("__ok", place([f"a_{c}" for c in alike], "o_order"))
    like = F.col("__k") == F.col("__ok")
    for c in alike:
        like &= F.col(c).eqNullSafe(F.col(f"a_{c}"))
    return by_key.unionByName(left_new.join(left_old, like).select(key, "old_key"))
