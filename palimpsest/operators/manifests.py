"""Manifests of runs: canonical JSON, identities, the append-only log, its repair and its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Version that every manifest states first.
VERSION = 1


def sequence_of(name: Column) -> Column:
    """The number in a manifest's file name (twelve digits and ``.json``); null for other names and number 0."""
    return F.when(F.regexp_extract(name, r"\A(\d{12})\.json\z", 1).try_cast("long") > 0, F.regexp_extract(name, r"\A(\d{12})\.json\z", 1).try_cast("long"))


def file_name(sequence: Column) -> Column:
    return F.concat(F.lpad(sequence.cast("string"), 12, "0"), F.lit(".json"))


def encode(run: Column, scope: Column, completed: Column, revisions: Column) -> Column:
    """Canonical JSON: fields in a fixed order, revisions (array of struct(page, revision, object)) by page and revision, no white space."""
    row = F.struct(F.lit(VERSION).alias("version"), run.cast("long").alias("run"), scope.alias("scope"), completed.alias("completed"), F.sort_array(revisions).alias("revisions"))
    return F.to_json(row, {"ignoreNullFields": "false"})


def identity(body: Column) -> Column:
    """The name of a manifest by its content."""
    return F.concat(F.lit("m256:"), F.sha2(body, 256))


SCHEMA = "version int, run long, scope string, completed string, revisions array<struct<page:long,revision:long,object:string>>"


def is_canonical(body: Column) -> Column:
    """Whether a body decodes and encodes to the same bytes again."""
    row = F.from_json(body, SCHEMA, {"mode": "PERMISSIVE"})
    again = encode(row["run"], row["scope"], row["completed"], row["revisions"])
    return F.coalesce((again == body) & (row["version"] == VERSION) & row["run"].isNotNull(), F.lit(False))


def unmanifested(runs: DataFrame, log: DataFrame, run: str, succeeded: Column, configuration: str) -> DataFrame:
    """Successful runs that have a configuration and no manifest yet."""
    return runs.where(succeeded & F.col(configuration).isNotNull()).join(log.select(run), run, "left_anti").select(run)


def run_manifests(captured: DataFrame, run: str, scope: str, time: str, page: str, revision: str, obj: str) -> DataFrame:
    """run, body, manifest_id for each run of captured revisions; a run's rows are bounded by the limit on its entries."""
    entry = F.struct(F.col(page).cast("long").alias("page"), F.col(revision).cast("long").alias("revision"), F.col(obj).alias("object"))
    rows = captured.groupBy(run, scope).agg(F.date_format(F.max(time), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("_at"), F.collect_list(entry).alias("_all"))
    out = rows.select(run, encode(F.col(run), F.col(scope), F.col("_at"), F.col("_all")).alias("body"))
    return out.withColumn("manifest_id", identity(F.col("body")))


def append(log: DataFrame, fresh: DataFrame, run: str) -> DataFrame:
    """sequence, run, manifest_id, previous_id: the log after appending manifests (run, manifest_id) it lacks, oldest run first.

    Runs that are in the log already change nothing. Sequence numbers of the new
    rows come from ranks in slices of the runs, so no task orders them all.
    """
    new = fresh.join(log.select(run), run, "left_anti").dropDuplicates([run])
    head = log.agg(F.max("sequence").alias("s"), F.max_by("manifest_id", "sequence").alias("id")).first()
    base = head["s"] or 0
    ranked = _ranked(new, run, base)
    after = ranked.select((F.col("sequence") + 1).alias("sequence"), F.col("manifest_id").alias("_before"))
    added = ranked.join(after, "sequence", "left").withColumn("previous_id", F.when(F.col("sequence") == base + 1, F.lit(head["id"])).otherwise(F.col("_before")))
    return log.select("sequence", run, "manifest_id", "previous_id").unionByName(added.select("sequence", run, "manifest_id", "previous_id"))


def _ranked(rows: DataFrame, key: str, base: int, slices: int = 256) -> DataFrame:
    """``rows`` with sequence, gapless from base + 1 in the order of a whole-number key."""
    ends = rows.agg(F.min(key), F.max(key)).first()
    lo, hi = ends[0] or 0, ends[1] or 0
    step = max(1, -(-(hi - lo + 1) // slices))
    cut = rows.withColumn("_slice", F.floor((F.col(key) - lo) / step))
    starts = cut.groupBy("_slice").count().withColumn("_from", F.coalesce(F.sum("count").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most ``slices`` rows
    rank = F.row_number().over(Window.partitionBy("_slice").orderBy(key))
    return cut.join(F.broadcast(starts.select("_slice", "_from")), "_slice").withColumn("sequence", (F.lit(base) + F.col("_from") + rank).cast("long")).drop("_slice", "_from")
