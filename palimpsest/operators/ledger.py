"""Runs, jobs, schedules and stored copies: roll-ups, claims, conditional changes and cursors over a control ledger.

State changes are functions from old state and offered changes to a table that
says what became of each change, so that repeated tasks give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_rollup(jobs: DataFrame, run: str, state: str, states: list[str]) -> DataFrame:
    """Per run the number of its jobs and of those in each state (columns named like the states)."""
    return jobs.groupBy(run).agg(F.count(F.lit(1)).alias("jobs"), *[F.count_if(F.col(state) == s).alias(s) for s in states])


def with_latest(rows: DataFrame, events: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """Each row with columns ``keep`` of its newest event, null without one: a left join to a map-side maximum."""
    newest = events.groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_e"))
    return rows.join(newest, key, "left").select(*rows.columns, *[F.col(f"_e.{c}").alias(c) for c in keep])


def library_state(runs: DataFrame, running: Column, failed: Column) -> DataFrame:
    """One row, ``state``: attention if a running run has failures, running if any runs, else idle."""
    worst = F.max(F.when(running & failed, 2).when(running, 1).otherwise(0))
    return runs.agg(F.when(worst == 2, "attention").when(worst == 1, "running").otherwise("idle").alias("state"))


def claim_lowest(jobs: DataFrame, scope: str, ident: str, queued: Column) -> DataFrame:
    """The job that each scope works on next: its lowest queued id."""
    return jobs.where(queued).groupBy(scope).agg(F.min(ident).alias(ident))


def committable(jobs: DataFrame, run: str, succeeded: Column, time: str) -> DataFrame:
    """Runs all of whose jobs succeeded, with the latest time that they may commit."""
    done = jobs.groupBy(run).agg(F.bool_and(F.coalesce(succeeded, F.lit(False))).alias("_all"), F.max(time).alias("committed_through"))
    return done.where("_all").drop("_all")


def compare_and_swap(state: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """What becomes of each change (key, expected version): key, outcome, actual version.

    Outcome is applied (the version matches), stale (another version) or
    missing. Of several changes of one key against one version, each is
    applied in the sense of the same write: they carry the same row.
    """
    offered = changes.select(key, F.col(version).alias("_expected")).distinct()
    joined = offered.join(state.select(key, F.col(version).alias("actual"), F.lit(True).alias("_there")), key, "left")
    outcome = F.when(F.col("_there").isNull(), "missing").when(F.col("_expected").eqNullSafe(F.col("actual")), "applied").otherwise("stale")
    return joined.select(key, outcome.alias("outcome"), "actual")


def insert_or_conflict(state: DataFrame, offered: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """Each offered row with outcome inserted, existing (same identity columns) or conflict."""
    old = state.select(key, F.struct(*identity).alias("_old"))
    joined = offered.join(old, key, "left")
    outcome = F.when(F.col("_old").isNull(), "inserted").when(F.struct(*identity).eqNullSafe(F.col("_old")), "existing").otherwise("conflict")
    return joined.select(*offered.columns, outcome.alias("outcome"))


def removable(sources: DataFrame, key: str, dependants: list[DataFrame]) -> DataFrame:
    """Sources that no dependant table (each with column ``key``) uses: one anti join a table."""
    for d in dependants:
        sources = sources.join(d.select(key).distinct(), key, "left_anti")
    return sources


def tombstone(collections: DataFrame, members: DataFrame, key: str, which: Column) -> DataFrame:
    """Members after the chosen collections are given up: theirs are removed, the rest as before; idempotent."""
    gone = collections.where(which).select(key, F.lit(True).alias("_gone")).distinct()
    return members.join(gone, key, "left").select(*members.columns, F.when(F.col("_gone"), "removed").otherwise("active").alias("state"))


def choose_copy(copies: DataFrame, object_id: str, order: list[str], keep: list[str]) -> DataFrame:
    """For each object the copy to keep, least in ``order``, and the number of those that may go."""
    best = F.min_by(F.struct(*keep), F.struct(*order))
    return copies.groupBy(object_id).agg(best.alias("_c"), (F.count(F.lit(1)) - 1).alias("spare")).select(object_id, *[F.col(f"_c.{c}").alias(c) for c in keep], "spare")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count: empty where a uniqueness assertion holds."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def lookback(objects: DataFrame, scope: str, order: str, back: int = 16) -> DataFrame:
    """Each object with the ``back`` ones before it in its scope, nearest first: its candidates for a delta."""
    w = Window.partitionBy(scope).orderBy(order).rowsBetween(-back, -1)
    return objects.withColumn("candidates", F.reverse(F.collect_list(order).over(w)))


def record_cursor(tables: list[tuple[DataFrame, str, str]], after: tuple[int, int, int] | None, limit: int) -> DataFrame:
    """A page of (category, k1, k2) over several tables in order, behind the cursor ``after``.

    The cursor's bound is put on each table before the union, so it reaches
    the scans; a table before the cursor's category is not read.
    """
    parts = []
    for category, (df, k1, k2) in enumerate(tables):
        rows = df.select(F.lit(category).alias("category"), F.col(k1).cast("long").alias("k1"), F.col(k2).cast("long").alias("k2"))
        if after and category < after[0]:
            rows = rows.where(F.lit(False))
        elif after and category == after[0]:
            rows = rows.where((F.col("k1") > after[1]) | ((F.col("k1") == after[1]) & (F.col("k2") > after[2])))
        parts.append(rows)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("category", "k1", "k2").limit(limit)


def cutoff_of(revisions: DataFrame, ident: str, time: str, value: int) -> DataFrame:
    """The time of one revision as a cutoff: a row only if exactly one of the rows has that id."""
    return revisions.where(F.col(ident) == value).agg(F.count(F.lit(1)).alias("_n"), F.max(time).alias("cutoff")).where("_n = 1").select("cutoff")


def rename(state: DataFrame, wanted: DataFrame, key: str, name: str, removed: Column) -> DataFrame:
    """Each wanted (key, name) row with its outcome: missing, removed, taken (another key has the name) or renamed."""
    there = state.select(key, removed.alias("_gone"))
    holders = state.groupBy(name).agg(F.count(F.lit(1)).alias("_n"), F.max(key).alias("_holder"))
    rows = wanted.join(there, key, "left").join(holders, name, "left")
    taken = F.coalesce((F.col("_n") > 1) | (F.col("_holder") != F.col(key)), F.lit(False))
    outcome = F.when(F.col("_gone").isNull(), "missing").when(F.col("_gone"), "removed").when(taken, "taken").otherwise("renamed")
    return rows.select(*wanted.columns, outcome.alias("outcome"))


def capture_outcome(known: Column, revision: Column, at: Column, head: Column, head_at: Column) -> Column:
    """What a captured revision becomes: no page, new head, history behind the head, or a conflict in time."""
    return F.when(known.isNull(), "no page").when(revision > head, "new head").when(at < head_at, "kept as history").otherwise("conflict")


def settle(result: Column, attempts: Column, most: int) -> tuple[Column, Column]:
    """(state, attempts) of a job after a result (done, retry, null: still running): a retry goes back to the queue until its attempts are used up."""
    again = (result == "retry") & (attempts < most)
    state = F.when(result == "done", "succeeded").when(again, "queued").when(result == "retry", "failed").otherwise("running")
    return state, F.when(again, attempts + 1).otherwise(attempts)
