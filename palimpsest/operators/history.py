"""Time-ordered operators over revisions: as-of slices, newest-N, since-date prefixes, chains, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _newest_first(time: str, ident: str) -> list[Column]:
    return [F.col(time).desc(), F.col(ident).desc()]


def as_of(pages: DataFrame, revisions: DataFrame, page: str, time: str, ident: str, cutoff: str, keep: list[str]) -> DataFrame:
    """Every page with its newest revision at or before ``cutoff`` (ties: the larger id); pages without one stay.

    The newest row is a ``max_by`` aggregate, combined on the map side, so no
    page's history is sorted or held by one task.
    """
    best = F.max_by(F.struct(*keep), F.struct(time, ident))
    newest = revisions.where(F.col(time) <= F.lit(cutoff).cast("timestamp")).groupBy(page).agg(best.alias("_r"))
    return pages.join(newest, page, "left").select(*[c for c in pages.columns], *[F.col(f"_r.{c}").alias(c) for c in keep])


def newest(revisions: DataFrame, page: str, time: str, ident: str, keep: list[str]) -> DataFrame:
    """The newest revision of each page."""
    return revisions.groupBy(page).agg(F.max_by(F.struct(*keep), F.struct(time, ident)).alias("_r")).select(page, *[F.col(f"_r.{c}").alias(c) for c in keep])


def adjacency(revisions: DataFrame, page: str, time: str, ident: str) -> DataFrame:
    """Each revision with the ids before and after it in its page's history."""
    w = Window.partitionBy(page).orderBy(time, ident)
    return revisions.withColumn("previous_id", F.lag(ident).over(w)).withColumn("next_id", F.lead(ident).over(w))


def last_n(revisions: DataFrame, page: str, time: str, ident: str, n: int) -> DataFrame:
    """The ``n`` newest revisions of each page, with their rank from 1; ranks over the limit are dropped before the shuffle (a window group limit)."""
    rank = F.row_number().over(Window.partitionBy(page).orderBy(*_newest_first(time, ident)))
    return revisions.withColumn("rank", rank).where(F.col("rank") <= n)


def since_prefix(revisions: DataFrame, page: str, time: str, ident: str, since: str) -> DataFrame:
    """From the newest id of each page down, all revisions until the first one before ``since``."""
    w = Window.partitionBy(page).orderBy(F.col(ident).desc())
    old = (F.col(time) < F.lit(since).cast("timestamp")).cast("int")
    return revisions.withColumn("_old", F.max(old).over(w)).where("_old = 0").drop("_old")


def parent_gaps(revisions: DataFrame, page: str, ident: str) -> DataFrame:
    """Revisions with the parent that history implies and whether the chain is whole there (no gap to the one before)."""
    w = Window.partitionBy(page).orderBy(ident)
    before = F.lag(ident).over(w)
    return revisions.withColumn("parent_id", before).withColumn("chain_ok", F.coalesce(F.col(ident) == before + 1, F.col(ident) == 0))


def budget_cut(objects: DataFrame, scope: str, order: str, size: str, budget: int, slices: int = 256) -> DataFrame:
    """In each scope the objects, in order, whose running total stays within the budget.

    A scope of any size is cut into slices of the order: sums of the slices come
    first, small rows by which each slice knows what stands before it. Slices
    that begin beyond the budget are dropped, and only the others are ordered within themselves.
    """
    ends = objects.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    lo, hi = int(ends["lo"] or 0), int(ends["hi"] or 0)
    step = max(1, -(-(hi - lo + 1) // slices))
    cut = objects.withColumn("_slice", F.floor((F.col(order) - lo) / step).cast("long"))
    before = Window.partitionBy(scope).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(scope, "_slice").agg(F.sum(size).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    near = sums.where(F.col("_before") <= budget).select(scope, "_slice", "_before")
    w = Window.partitionBy(scope, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(near, [scope, "_slice"]).withColumn("running", F.col("_before") + F.sum(size).over(w)).where(F.col("running") <= budget).drop("_slice", "_before")


def recent(revisions: DataFrame, time: str, source: str, ident: str, limit: int) -> DataFrame:
    """The most recent revisions over all sources: time down, source up, id down (a top-k, no full sort)."""
    return revisions.orderBy(F.col(time).desc(), F.col(source), F.col(ident).desc()).limit(limit)


def keyset_page(rows: DataFrame, key: str, after: int | None, limit: int) -> DataFrame:
    """The page of rows after a key."""
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(limit)
