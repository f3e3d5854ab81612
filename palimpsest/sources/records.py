"""Sources and sinks: recorded API payloads, title lists, manifest logs, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import content_id

PAYLOAD = (
    "error struct<code:string,info:string>, continue map<string,string>, query struct<normalized:array<struct<`from`:string,`to`:string>>, redirects:array<struct<`from`:string,`to`:string>>, "
    "pages:array<struct<pageid:long,ns:int,title:string,missing:boolean,revisions:array<struct<revid:long,parentid:long,timestamp:string,user:string,comment:string,size:long,sha1:string,slots:struct<main:struct<content:string>>>>>>>"
)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Recorded responses, one JSON object a file."""
    return spark.read.schema(PAYLOAD).option("multiLine", "true").json(path)


def revisions_of(payloads: DataFrame) -> DataFrame:
    """Revision rows of the good responses."""
    page = payloads.where("error IS NULL").select(F.explode("query.pages").alias("p"))
    r = page.where(~F.coalesce(F.col("p.missing"), F.lit(False))).select("p.pageid", "p.title", F.explode("p.revisions").alias("r"))
    return r.select(F.col("pageid").alias("page_id"), "title", F.col("r.revid").alias("revision_id"), F.col("r.parentid").alias("parent_id"), F.to_timestamp("r.timestamp").alias("revision_time"), F.col("r.comment").alias("comment"), F.col("r.size").alias("size"), F.col("r.slots.main.content").alias("content"))


def resolutions(payloads: DataFrame) -> DataFrame:
    """title, page_id, found for each page of the good responses."""
    page = payloads.where("error IS NULL").select(F.explode("query.pages").alias("p"))
    return page.select(F.col("p.title").alias("title"), F.col("p.pageid").alias("page_id"), (~F.coalesce(F.col("p.missing"), F.lit(False))).alias("found"))


def rejects(payloads: DataFrame) -> DataFrame:
    """Failed responses."""
    return payloads.where("error IS NOT NULL").select("error.code", "error.info")


def title_list(spark: SparkSession, path: str, limit: int = 10_000) -> DataFrame:
    """Distinct titles of a newline-delimited file, in order; an error beyond ``limit``."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("title"))
    out = lines.where("title <> ''").distinct()
    if (n := out.count()) > limit:
        raise ValueError(f"{n} titles; at most {limit}")
    return out.orderBy("title")


def chain_manifests(manifests: DataFrame) -> DataFrame:
    """Findings of a manifest log (sequence, previous_id, body): wrong numbering or a predecessor whose hash differs.

    Each row is joined to the one before it by number, so no single task orders the whole log.
    """
    ids = manifests.select((F.col("sequence") + 1).alias("sequence"), content_id(F.col("body")).alias("_expected"))
    checked = manifests.join(ids, "sequence", "left")
    first = F.col("sequence") == 1
    problem = F.when(first & F.col("previous_id").isNotNull(), "first has a predecessor").when(~first & F.col("_expected").isNull(), "gap").when(~first & ~F.col("previous_id").eqNullSafe(F.col("_expected")), "broken link")
    return checked.select("sequence", problem.alias("problem")).where("problem IS NOT NULL")


def export_index(rows: DataFrame, path: str, order: list[str]) -> None:
    """An export's index as JSON lines."""
    rows.orderBy(*order).write.mode("overwrite").json(path)
