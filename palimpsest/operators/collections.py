"""Collections, their members and their pages' heads: changes as functions from old state and offered rows to outcomes and new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def create_or_reopen(state: DataFrame, wanted: DataFrame, keys: list[str], removed: str) -> DataFrame:
    """Each distinct wanted collection: created, reopened (it had been removed) or existing."""
    old = state.groupBy(*keys).agg(F.bool_and(removed).alias("_gone"))
    rows = wanted.select(*keys).distinct().join(old, keys, "left")
    return rows.select(*keys, F.when(F.col("_gone").isNull(), "created").when(F.col("_gone"), "reopened").otherwise("existing").alias("outcome"))


def reason_problem(rule_kind: Column, rule_title: Column, rule_depth: Column, kind: Column, title: Column, depth: Column) -> Column:
    """Why a member's reason does not fit its collection's rule, else null; fixed titles may differ, as titles redirect."""
    walk = rule_kind == "category"
    return F.when(~kind.eqNullSafe(rule_kind), "other kind").when(walk & ~title.eqNullSafe(rule_title), "other category").when(walk & ~F.coalesce(depth <= rule_depth, F.lit(False)), "too deep")


def commit_members(current: DataFrame, incoming: DataFrame, budgets: DataFrame, group: str, page: str) -> DataFrame:
    """Members after a resolution: group, page, state, first_at, verdict.

    ``current`` (group, page, active, first_at), ``incoming`` (group, page, at), ``budgets`` (group, most, keep). Members that
    the resolution lacks are removed, or stay where ``keep`` is set. Both the incoming and the resulting active members must be
    within ``most`` (null: any number); a group beyond it, or without a budget row, keeps its old state. A member's first time stays.
    """
    old = current.groupBy(group, page).agg(F.bool_or("active").alias("_active"), F.min("first_at").alias("_first"))
    new = incoming.groupBy(group, page).agg(F.min("at").alias("_at"))
    rows = old.join(new, [group, page], "full").join(budgets, group, "left")
    came = F.col("_at").isNotNull()
    stays = came | (F.coalesce("_active", F.lit(False)) & F.coalesce("keep", F.lit(False)))
    sums = rows.groupBy(group).agg(F.count_if(came).alias("_in"), F.count_if(stays).alias("_all"), F.max("most").alias("_most"), F.bool_or(F.col("keep").isNotNull()).alias("_known"))
    verdict = F.when(~F.col("_known"), "not configured").when(F.col("_in") > F.col("_most"), "incoming over budget").when(F.col("_all") > F.col("_most"), "members over budget").otherwise("committed")
    judged = rows.join(sums.select(group, verdict.alias("verdict")), group)
    done = F.col("verdict") == "committed"
    active = F.when(done, stays).otherwise(F.coalesce("_active", F.lit(False)))
    kept = judged.where(done | F.col("_active").isNotNull())
    return kept.select(group, page, F.when(active, "active").otherwise("removed").alias("state"), F.coalesce("_first", "_at").alias("first_at"), "verdict")


def give_up(collection: Column, gone: Column, state: Column, running: tuple[str, ...], to: str) -> Column:
    """New state of a row that depends on a collection: ``to`` if the collection is given up and the row is in a running state."""
    return F.when(collection.isNotNull() & gone & state.isin(*running), to).otherwise(state)


def title_history(seen: DataFrame, keys: list[str], title: str, at: str) -> DataFrame:
    """Every title of a page with the first and last time it was seen."""
    return seen.groupBy(*keys, title).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def pages_by_any_title(history: DataFrame, asked: DataFrame, keys: list[str], title: str) -> DataFrame:
    """Pages that have ever had an asked title, with their current one: the title seen last (ties: the greater)."""
    current = history.groupBy(*keys).agg(F.max_by(title, F.struct("last_seen", title)).alias("current_title"))
    return history.select(*keys, title).join(asked.select(title).distinct(), title, "left_semi").join(current, keys)


def capture_heads(pages: DataFrame, captured: DataFrame, page: str) -> DataFrame:
    """What a captured head does to its page (page, head_at, missing, removed): refused for a page of removed members only,
    created, moved (time not before the head's) or older; and whether a missing page is back."""
    rows = captured.join(pages.select(page, "head_at", "missing", "removed", F.lit(True).alias("_there")), page, "left")
    outcome = F.when(F.col("removed"), "refused").when(F.col("_there").isNull(), "created").when(F.col("head_at").isNull() | (F.col("at") >= F.col("head_at")), "moved").otherwise("older")
    back = F.coalesce(F.col("missing"), F.lit(False)) & (outcome != "refused")
    return rows.select(*captured.columns, outcome.alias("outcome"), back.alias("reactivated"))


def set_heads(revisions: DataFrame, wanted: DataFrame, page: str, revision: str) -> DataFrame:
    """Heads set whatever their time: set where the revision is captured and the page's own, else other page or not captured."""
    known = revisions.select(revision, F.col(page).alias("_page"))
    rows = wanted.join(known, revision, "left")
    return rows.select(page, revision, F.when(F.col("_page").isNull(), "not captured").when(F.col("_page") != F.col(page), "other page").otherwise("set").alias("outcome"))


def mark_missing(pages: DataFrame, reported: DataFrame, page: str, revision: str) -> DataFrame:
    """Pages with ``state``: missing if reported so; head and history stay."""
    gone = reported.select(page, F.lit(True).alias("_gone")).distinct()
    return pages.join(gone, page, "left").select(page, revision, F.when(F.col("_gone"), "missing").otherwise("present").alias("state"))


def stored_rule(kind: Column, title: Column, depth: Column) -> Column:
    """A stored rule's tagged columns as one text: ``titles``, ``list`` or ``category:<title>/<depth>``; null where they do not fit together."""
    bare = title.isNull() & depth.isNull()
    walk = (kind == "category") & title.isNotNull() & F.coalesce(depth >= 0, F.lit(False))
    return F.when(kind.isin("titles", "list") & bare, kind).when(walk, F.concat(F.lit("category:"), title, F.lit("/"), depth.cast("string")))


def summaries(collections: DataFrame, members: DataFrame, collection: str, removed: str, with_removed: bool) -> DataFrame:
    """Collections with their number of active members; removed ones only if asked for. Members are counted before the join."""
    counts = members.where("active").groupBy(collection).agg(F.count(F.lit(1)).alias("members"))
    rows = collections if with_removed else collections.where(~F.col(removed))
    return rows.join(counts, collection, "left").withColumn("members", F.coalesce("members", F.lit(0)))
