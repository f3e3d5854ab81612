"""Resolutions, budgets and checks of single rows: what a request may rely on before it changes anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400
#: Bounds of an interval and of a jitter, in seconds.
LEAST_INTERVAL, MOST_INTERVAL, MOST_JITTER = 60, 366 * DAY, DAY


def exactly_one(requests: DataFrame, rows: DataFrame, key: str, ident: str, scope: str, wanted: str | None = None) -> DataFrame:
    """key, outcome (found, missing, ambiguous), ident and scope of the only match of each request.

    Where ``requests`` have a scope of their own (``wanted``, may be null), only rows of that scope match.
    Matches are counted, never gathered.
    """
    asked = requests.select(F.col(key).alias("_key"), *([F.col(wanted).alias("_wanted")] if wanted else [])).distinct()
    held = rows.select(F.col(key).alias("_title"), F.col(ident).alias("_i"), F.col(scope).alias("_s"))
    on = F.col("_key") == F.col("_title")
    if wanted:
        on = on & (F.col("_wanted").isNull() | (F.col("_wanted") == F.col("_s")))
    by = ["_key", "_wanted"] if wanted else ["_key"]
    found = asked.join(held, on, "left").groupBy(*by).agg(F.count("_i").alias("n"), F.min(F.struct("_i", "_s")).alias("one"))
    only = lambda c: F.when(F.col("n") == 1, F.col(f"one.{c}"))
    outcome = F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "found").otherwise("ambiguous")
    return found.select(F.col("_key").alias(key), *([F.col("_wanted").alias(wanted)] if wanted else []), outcome.alias("outcome"), only("_i").alias(ident), only("_s").alias(scope))


def permits(pages: Column, size: Column, max_pages: Column, max_bytes: Column) -> Column:
    """Whether a selection is within its budgets; a null budget is none."""
    return F.coalesce(pages <= max_pages, F.lit(True)) & F.coalesce(size <= max_bytes, F.lit(True))


def budget_verdict(predicted: Column, current: Column, budget: Column) -> Column:
    """fits, exceeded or unknown: what is there counts even where nothing is predicted."""
    return F.when(budget.isNull(), "fits").when(current > budget, "exceeded").when(predicted.isNull(), "unknown").when(F.greatest(predicted, current) > budget, "exceeded").otherwise("fits")


def schedule_problem(cadence: Column, every: Column, jitter: Column, next_run: Column) -> Column:
    """What is wrong with a schedule (cadence manual, interval, daily, weekly), or null."""
    return (
        F.when(jitter > MOST_JITTER, "jitter above a day")
        .when((cadence == "manual") & ((jitter > 0) | next_run.isNotNull()), "manual with jitter or next run")
        .when((cadence == "interval") & ~F.coalesce(every.between(LEAST_INTERVAL, MOST_INTERVAL), F.lit(False)), "interval out of range")
        .when((cadence == "interval") & (jitter > every), "jitter above interval")
        .when((cadence != "manual") & next_run.isNull(), "no next run")
    )


def preview_problems(members: DataFrame, group: str, page: str, title: str, size: str, max_pages: int | None, max_bytes: int | None) -> DataFrame:
    """group, problem: budgets exceeded, page ids or titles that occur more than once."""
    totals = members.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"))
    over = [totals.where(F.col(c) > most).select(group, F.lit(f"{name} budget").alias("problem")) for c, most, name in (("n", max_pages, "page"), ("b", max_bytes, "byte")) if most is not None]
    twice = [members.groupBy(group, c).count().where("count > 1").select(group, F.lit(f"repeated {name}").alias("problem")).distinct() for c, name in ((page, "page"), (title, "title"))]
    out = twice[0].unionByName(twice[1])
    for x in over:
        out = out.unionByName(x)
    return out


def broken_rows(rows: DataFrame, ident: str, rules: dict[str, Column]) -> DataFrame:
    """ident, rule for each rule that a row does not hold; a rule that is null holds, as a CHECK does."""
    failed = F.filter(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return rows.select(F.col(ident).alias(ident), F.explode(failed).alias("rule"))
