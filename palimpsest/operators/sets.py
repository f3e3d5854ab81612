"""Set operations, upserts and reference checks; state changes are functions from old state and change set to new state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def introduced(later: DataFrame, earlier: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``later`` whose keys ``earlier`` lacks."""
    return later.join(earlier.select(*keys), keys, "left_anti")


def merge_membership(current: DataFrame, resolved: DataFrame, key: str, keep_removed: bool = True) -> DataFrame:
    """Members after a resolution: kept and new ones active, the rest removed (or dropped)."""
    a = current.select(key, F.lit(True).alias("_was")).distinct()
    b = resolved.select(key, F.lit(True).alias("_is")).distinct()
    state = F.when(F.col("_is"), "active").otherwise("removed")
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").otherwise("kept")
    out = a.join(b, key, "full").select(key, state.alias("state"), change.alias("change"))
    return out if keep_removed else out.where("state = 'active'")


def upsert_heads(state: DataFrame, changes: DataFrame, key: str, version: list[str]) -> DataFrame:
    """The newest row of each key over old state and changes."""
    rows = state.select(*state.columns).unionByName(changes.select(*state.columns))
    rest = [c for c in state.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def missing_references(rows: DataFrame, key: str, target: DataFrame, target_key: str, kind: str, ident: str) -> DataFrame:
    """A finding (kind, ident) for each row whose reference has no target."""
    there = target.select(F.col(target_key).alias(key))
    return rows.where(F.col(key).isNotNull()).join(there, key, "left_anti").select(F.lit(kind).alias("kind"), F.col(ident).cast("long").alias("ident"))


def without_any(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows that have no counterpart."""
    return rows.join(others.select(key), key, "left_anti")


def with_any(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows that have a counterpart."""
    return rows.join(others.select(key), key, "left_semi")
