"""Verification of an archive: references, stored objects, bounded reports and what they amount to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Objects that a quick verification hashes, and findings that a report keeps.
QUICK_OBJECTS, MOST_FINDINGS = 100, 1_000


@dataclass(frozen=True)
class Reference:
    """Rows of ``table`` whose ``columns`` must be found as ``target_columns`` of ``target``; ``where`` narrows the rows. ``problem`` names the finding."""

    problem: str
    table: str
    columns: tuple[str, ...]
    target: str
    target_columns: tuple[str, ...]
    ident: str
    where: str | None = None


def reference_findings(tables: dict[str, DataFrame], references: list[Reference]) -> DataFrame:
    """problem, ident for each row with a reference that has no target; a reference with a null in it is none.

    One anti join for each check; all are one plan, so that tables are scanned in parallel.
    """
    out = None
    for r in references:
        rows = tables[r.table] if r.where is None else tables[r.table].where(r.where)
        rows = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in r.columns)).select(F.col(r.ident).cast("long").alias("ident"), *[F.col(c).alias(f"_k{k}") for k, c in enumerate(r.columns)])
        target = tables[r.target].select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(r.target_columns)])
        found = rows.join(target, [f"_k{k}" for k in range(len(r.columns))], "left_anti").select(F.lit(r.problem).alias("problem"), "ident")
        out = found if out is None else out.unionByName(found)
    return out


def self_references(rows: DataFrame, ident: str, parent: str, problem: str) -> DataFrame:
    """Rows that are their own parent."""
    return rows.where(F.col(ident).eqNullSafe(F.col(parent))).select(F.lit(problem).alias("problem"), F.col(ident).cast("long").alias("ident"))


def object_findings(objects: DataFrame, ident: str, content: str, digest: str, size: str, quick: bool = False) -> DataFrame:
    """problem, ident of stored objects that are missing, of another size or of another digest; ``quick`` looks at the first ``QUICK_OBJECTS`` by id."""
    rows = objects.orderBy(ident).limit(QUICK_OBJECTS) if quick else objects
    wrong = F.when(F.col(content).isNull(), "object missing").when(F.octet_length(content) != F.col(size), "object size").when(F.sha2(content, 256) != F.col(digest), "object digest")
    return rows.select(wrong.alias("problem"), F.col(ident).cast("long").alias("ident")).where("problem IS NOT NULL")


def report(findings: DataFrame, checked: int, total: int, most: int = MOST_FINDINGS) -> DataFrame:
    """problem, findings (how many), first (the smallest ids, bounded), coverage (complete or partial) by kind of problem."""
    first = F.slice(F.sort_array(F.collect_set(F.when(F.col("_rank") <= most, F.col("ident")))), 1, most)
    ranked = findings.withColumn("_rank", F.row_number().over(Window.partitionBy("problem").orderBy("ident")))
    counts = findings.groupBy("problem").agg(F.count(F.lit(1)).alias("findings"))
    kept = ranked.where(F.col("_rank") <= most).groupBy("problem").agg(first.alias("first"))
    return counts.join(kept, "problem").withColumn("coverage", F.lit("complete" if checked == total else "partial"))


def classify(authentic: Column, signature_valid: Column, same_head: Column, clean: Column) -> Column:
    """What a report says against a trusted head, the first that holds: verified, invalid signature, different head, failed."""
    return F.when(authentic & clean & signature_valid & same_head, "verified").when(~signature_valid, "invalid signature").when(~same_head, "different head").otherwise("failed")
