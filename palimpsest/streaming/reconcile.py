"""The sync loop as set operations: runs, jobs, forward gaps of all pages at once, and what to do next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of one page's reconciliation.
MOST_REVISIONS = 1_000_000


def window_start(committed: Column, overlap: Column) -> Column:
    """First second of the next run's window: the checkpoint less the overlap, never below zero; zero without a checkpoint."""
    return F.greatest(F.coalesce(committed - overlap, F.lit(0)), F.lit(0))


def start_or_resume(runs: DataFrame, offered: DataFrame, checkpoints: DataFrame, scope: list[str], overlap: int) -> DataFrame:
    """For each offered scope (scope columns, candidate): the running run to resume, else a new window.

    ``runs`` (scope columns, run, running, low, high); ``checkpoints`` (scope columns, through). Scopes are compared null-safe.
    """
    at = F.struct(*scope)
    going = runs.where("running").groupBy(at.alias("_s")).agg(F.min_by(F.struct("run", "low", "high"), "run").alias("_r"))
    marks = checkpoints.groupBy(at.alias("_m")).agg(F.max("through").alias("_through"))
    rows = offered.withColumn("_o", at)
    rows = rows.join(going, rows["_o"].eqNullSafe(going["_s"]), "left").join(marks, rows["_o"].eqNullSafe(marks["_m"]), "left")
    resumed = F.col("_r").isNotNull()
    low = F.when(resumed, F.col("_r.low")).otherwise(window_start(F.col("_through"), F.lit(overlap)))
    high = F.when(resumed, F.col("_r.high")).otherwise(F.greatest("candidate", low))
    return rows.select(*scope, F.when(resumed, "resumed").otherwise("started").alias("outcome"), F.col("_r.run").alias("run"), low.alias("low"), high.alias("high"))


def enqueue_checked(queue: DataFrame, offered: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Each distinct offered job: queued, existing (same payload) or conflict (another payload, in the queue or among the offered)."""
    old = queue.groupBy(*keys).agg(F.min(payload).alias("_old"), F.lit(True).alias("_there"))
    new = offered.groupBy(*keys).agg(F.min(payload).alias("_low"), F.max(payload).alias("_high"))
    rows = new.join(old, keys, "left")
    same = F.col("_low").eqNullSafe(F.col("_high")) & (F.col("_there").isNull() | F.col("_old").eqNullSafe(F.col("_low")))
    return rows.select(*keys, F.when(~same, "conflict").when(F.col("_there").isNull(), "queued").otherwise("existing").alias("outcome"))


def job_outcome(state: Column, event: Column) -> Column:
    """What an event (complete, fail, retry, cancel) makes of a job: its new state, or null where the state does not allow it."""
    running, open_ = state == "running", state.isin("queued", "running", "retryable")
    return F.when((event == "complete") & running, "succeeded").when((event == "fail") & running, "failed").when((event == "retry") & running, "retryable").when((event == "cancel") & open_, "cancelled")


def forward_gaps(tips: DataFrame, listed: DataFrame, page: str, known: DataFrame | None = None, most: int = MOST_REVISIONS) -> DataFrame:
    """One verdict for each page between its newest durable revision and the remote head.

    ``tips`` (page, tip, head); ``listed`` (page, revision, parent) is what the source lists from the tip on; ``known`` (revision)
    is captured already. The list must begin with the tip, and each revision name the one before it as parent. Verdicts:
    same head, identity changed, disconnected, over the limit, head not reached, connected; with the numbers enumerated and reused.
    """
    w = Window.partitionBy(page).orderBy("revision")
    rows = listed.select(page, "revision", "parent")
    if known is not None:
        rows = rows.join(known.select("revision", F.lit(True).alias("_known")).distinct(), "revision", "left")
    else:
        rows = rows.withColumn("_known", F.lit(None).cast("boolean"))
    rows = rows.join(tips.where("tip <> head"), page)
    rows = rows.where("revision >= tip AND revision <= head").withColumn("_before", F.lag("revision").over(w))
    after = F.col("revision") > F.col("tip")
    sums = rows.groupBy(page).agg(
        F.min("revision").alias("_first"), F.max("revision").alias("_last"), F.count_if(after).alias("enumerated"), F.count_if(after & F.col("_known")).alias("reused"),
        F.count_if(F.col("_before").isNotNull() & ~F.col("parent").eqNullSafe(F.col("_before"))).alias("_breaks"),
    )
    out = tips.join(sums, page, "left")
    changed = F.col("_first").isNull() | (F.col("_first") != F.col("tip"))
    verdict = F.when(F.col("tip") == F.col("head"), "same head").when(changed, "identity changed").when(F.col("_breaks") > 0, "disconnected").when(F.col("enumerated") > most, "over the limit").when(F.col("_last") != F.col("head"), "head not reached").otherwise("connected")
    none = F.lit(0)
    return out.select(page, verdict.alias("verdict"), F.coalesce("enumerated", none).alias("enumerated"), F.coalesce("reused", none).alias("reused"))


def within_bytes(current: Column, more: Column, most: Column) -> Column:
    """Whether a capture keeps its collection within its bytes; no limit if null."""
    return F.coalesce(current + more <= most, F.lit(True))


def next_steps(collections: DataFrame, runs: DataFrame, collection: str) -> DataFrame:
    """What each active collection does next: resume a running run, bootstrap without a committed run, else reconcile."""
    sums = runs.groupBy(collection).agg(F.bool_or(F.col("state") == "running").alias("_running"), F.bool_or(F.col("state") == "succeeded").alias("_committed"))
    rows = collections.join(sums, collection, "left")
    step = F.when(F.coalesce("_running", F.lit(False)), "resume").when(F.coalesce("_committed", F.lit(False)), "reconcile").otherwise("bootstrap")
    return rows.select(collection, step.alias("step"))
