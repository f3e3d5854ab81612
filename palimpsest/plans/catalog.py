"""Registered queries of the revision-archive engine, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import schedule, text, wikitext
from palimpsest.operators import diff, graph, history, ledger, search, sets
from palimpsest.plans import archive, store
from palimpsest.streaming import sync

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- history


@_register("""
SELECT c_custkey, c_name, c_nationkey, o_orderkey, o_orderdate FROM customer LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01') o ON o.o_custkey = c_custkey AND rn = 1
""")
def asof_order_per_customer(spark, sf):
    customers = _t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    orders = _t(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return history.as_of(customers, orders, "c_custkey", "o_orderdate", "o_orderkey", "1996-01-01", ["o_orderkey", "o_orderdate"])


@_register("SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def newest_revision(spark, sf):
    return history.newest(_t(spark, sf, "events"), "user_id", "ts", "event_id", ["event_id", "ts", "event_type"])


@_register("""
SELECT event_id, user_id, lag(event_id) OVER w AS previous_id, lead(event_id) OVER w AS next_id
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def history_adjacency(spark, sf):
    return history.adjacency(_t(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").drop("ts")


@_register("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events QUALIFY rank <= 5")
def last_n_history(spark, sf):
    return history.last_n(_t(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 5).select("user_id", "event_id", "rank")


@_register("""
SELECT user_id, event_id FROM (SELECT *, max(CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS old FROM events) WHERE old = 0
""")
def since_prefix_history(spark, sf):
    return history.since_prefix(_t(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", "2024-01-15").select("user_id", "event_id")


@_register("""
SELECT conv_id, turn, lag(turn) OVER w AS parent_id, coalesce(turn = lag(turn) OVER w + 1, turn = 0) AS chain_ok
FROM (SELECT conv_id, turn FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def parent_chain_check(spark, sf):
    return history.parent_gaps(_t(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@_register("""
SELECT lang, doc_id, n_chars, CAST(running AS BIGINT) AS running FROM (SELECT *, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running <= 100000
""")
def cumulative_budget_cut(spark, sf):
    return history.budget_cut(_t(spark, sf, "documents").select("lang", "doc_id", "n_chars"), "lang", "doc_id", "n_chars", 100_000)


@_register("SELECT o_orderkey, o_orderdate, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_orderdate DESC, c_nationkey, o_orderkey DESC LIMIT 100")
def recent_changes_topk(spark, sf):
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    rows = orders.join(_t(spark, sf, "customer").select("c_custkey", "c_nationkey"), orders["o_custkey"] == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "c_nationkey")
    return history.recent(rows, "o_orderdate", "c_nationkey", "o_orderkey", 100)


@_register("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100")
def keyset_page(spark, sf):
    return history.keyset_page(_t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", 1000, 100)


# ---- lookups and rollups


@_register("SELECT n_name AS title, c_custkey AS page_id, c_name AS current_title FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM nation WHERE n_nationkey < 3)")
def title_lookup_any_alias(spark, sf):
    names = _t(spark, sf, "nation").where("n_nationkey < 3").select("n_nationkey", "n_name")
    pages = _t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    return pages.join(names, pages["c_nationkey"] == names["n_nationkey"]).select(F.col("n_name").alias("title"), F.col("c_custkey").alias("page_id"), F.col("c_name").alias("current_title"))


@_register("SELECT c_mktsegment, count(DISTINCT c_custkey) AS members, count(o_orderkey) AS captured FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def collection_counts(spark, sf):
    # orders are counted per page first, so the join moves one row a page
    captured = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    pages = _t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return pages.join(captured, pages["c_custkey"] == captured["o_custkey"], "left").groupBy("c_mktsegment").agg(F.count("c_custkey").alias("members"), F.coalesce(F.sum("n"), F.lit(0)).alias("captured"))


@_register("""
SELECT l_orderkey, count(*) AS jobs, count(*) FILTER (l_returnflag = 'A') AS failed, count(*) FILTER (l_returnflag = 'R') AS retried, count(*) FILTER (l_returnflag = 'N') AS pending FROM lineitem GROUP BY 1
""")
def run_status_rollup(spark, sf):
    flag = F.col("l_returnflag")
    return _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(flag == "A").alias("failed"), F.count_if(flag == "R").alias("retried"), F.count_if(flag == "N").alias("pending"))


@_register("""
SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS pages, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS collections,
  (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS revisions FROM nation
""")
def source_usage(spark, sf):
    customers = _t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    per_page = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    pages = customers.join(per_page, "c_custkey", "left").groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("revisions"))
    suppliers = _t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("collections"))
    out = _t(spark, sf, "nation").select("n_nationkey", "n_name").join(pages, "n_nationkey", "left").join(suppliers, "n_nationkey", "left")
    return out.select("n_nationkey", "n_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pages", "collections", "revisions")])


@_register("SELECT lang, count(*) AS objects, CAST(sum(n) AS BIGINT) AS bytes FROM (SELECT lang, sha256(text) AS h, max(octet_length(encode(text))) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1, 2) GROUP BY 1")
def distinct_object_bytes(spark, sf):
    docs = sets.with_any(_t(spark, sf, "documents"), _t(spark, sf, "labels"), "doc_id")
    return docs.groupBy("lang", F.sha2("text", 256).alias("h")).agg(F.max(F.octet_length("text")).cast("long").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("objects"), F.sum("n").alias("bytes"))


@_register("SELECT source, CASE WHEN count(quality) = count(*) THEN CAST(sum(n_chars) AS BIGINT) END AS predicted, count(*) AS members FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def predicted_bytes_null_poison(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", "source", "n_chars").join(_t(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("source").agg(F.when(F.count("quality") == F.count(F.lit(1)), F.sum("n_chars")).alias("predicted"), F.count(F.lit(1)).alias("members"))


@_register("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1997-01-01')")
def due_schedules(spark, sf):
    due = _t(spark, sf, "orders").where((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp"))).select(F.col("o_custkey").alias("c_custkey"))
    return sets.with_any(_t(spark, sf, "customer").select("c_custkey"), due, "c_custkey")


@_register("SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unpacked_objects(spark, sf):
    return sets.without_any(_t(spark, sf, "documents").select("doc_id", "n_chars"), _t(spark, sf, "labels"), "doc_id")


@_register("""
SELECT 'order-customer' AS kind, o_orderkey AS ident FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'line-order', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
""")
def reference_findings(spark, sf):
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    a = sets.missing_references(orders, "o_custkey", _t(spark, sf, "customer"), "c_custkey", "order-customer", "o_orderkey")
    b = sets.missing_references(_t(spark, sf, "lineitem").select("l_orderkey"), "l_orderkey", orders, "o_orderkey", "line-order", "l_orderkey")
    return a.unionByName(b)


@_register("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')")
def introduced_revisions(spark, sf):
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cut = F.lit("1996-01-01").cast("timestamp")
    return sets.introduced(orders.where(F.col("o_orderdate") >= cut), orders.where(F.col("o_orderdate") < cut), ["o_custkey"]).select("o_orderkey")


@_register("""
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'active' END AS state,
  CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'kept' END AS change
FROM (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01') a FULL JOIN (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01') b ON a.c_custkey = b.c_custkey
""")
def membership_merge(spark, sf):
    orders = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    cut = F.lit("1996-01-01").cast("timestamp")
    return sets.merge_membership(orders.where(F.col("o_orderdate") < cut), orders.where(F.col("o_orderdate") >= cut), "c_custkey")


@_register("SELECT o_custkey, o_orderdate, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def head_upsert(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    cut = F.lit("1997-01-01").cast("timestamp")
    return sets.upsert_heads(o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut), "o_custkey", ["o_orderdate", "o_orderkey"])


@_register("SELECT c_nationkey AS source, c_custkey AS page FROM customer UNION SELECT s_nationkey, s_suppkey FROM supplier")
def distinct_pages_union(spark, sf):
    a = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("source"), F.col("c_custkey").alias("page"))
    return a.unionByName(_t(spark, sf, "supplier").select(F.col("s_nationkey").alias("source"), F.col("s_suppkey").alias("page"))).distinct()


@_register("SELECT 's256:' || sha256(text) AS object_id, min(doc_id) AS first_doc, count(*) AS copies, max(octet_length(encode(text))) AS bytes FROM documents GROUP BY 1")
def content_dedup(spark, sf):
    rows = _t(spark, sf, "documents").select(text.content_id(F.col("text")).alias("object_id"), "doc_id", F.octet_length("text").cast("long").alias("n"))
    return rows.groupBy("object_id").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("bytes"))


@_register("SELECT lang, count(*) AS records, count(*) FILTER (length(text) <> n_chars) AS wrong_length, count(DISTINCT sha256(text)) AS objects FROM documents GROUP BY 1")
def verification_summary(spark, sf):
    return _t(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.length("text") != F.col("n_chars")).alias("wrong_length"), F.count_distinct(F.sha2("text", 256)).alias("objects"))


@_register("SELECT count(*) AS articles, max(o_orderdate) AS captured, round(sum(o_totalprice), 2) AS total, count(DISTINCT c_nationkey) AS sources FROM orders JOIN customer ON c_custkey = o_custkey")
def export_manifest_rollup(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    rows = o.join(_t(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == o["o_custkey"])
    return rows.agg(F.count(F.lit(1)).alias("articles"), F.max("o_orderdate").alias("captured"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_distinct("c_nationkey").alias("sources"))


# ---- text and search


_BM25 = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t, list_filter(regexp_split_to_array(lower(source), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS s FROM documents),
f AS (SELECT doc_id, len(t) + len(s) AS dl, len(list_filter(t, lambda x: x = 'this')) + 10.0 * len(list_filter(s, lambda x: x = 'this')) AS a, len(list_filter(t, lambda x: x = 'license')) + 10.0 * len(list_filter(s, lambda x: x = 'license')) AS b FROM d),
g AS (SELECT count(*) AS n, avg(dl) AS av, count(*) FILTER (a > 0) AS na, count(*) FILTER (b > 0) AS nb FROM f)
SELECT doc_id, round(0.0 - greatest(ln((n - nb + 0.5) / (nb + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / av)) - greatest(ln((n - na + 0.5) / (na + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / av)), 6) AS score
FROM f, g WHERE a > 0 AND b > 0 ORDER BY score, doc_id LIMIT 50
"""


@_register(_BM25)
def bm25_search(spark, sf):
    return search.search(archive.stored_index(spark, sf), "this license", 50).withColumnRenamed("ident", "doc_id")


_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _collapsed(column: str) -> str:
    return rf"regexp_replace(regexp_replace({column}, '[{_SPACE}]+', ' ', 'g'), '^ | $', '', 'g')"


@_register(f"""
WITH l AS (SELECT doc_id, {_collapsed("text")} AS line FROM documents)
SELECT doc_id, CASE WHEN length(line) > 240 THEN substr(line, 1, 240) || '…' ELSE line END AS excerpt FROM l
""")
def lead_excerpt(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@_register(rf"""
WITH s AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, coalesce(list_filter(x, lambda y: contains(lower(y), 'license') OR contains(lower(y), 'safety'))[1], list_filter(x, lambda y: {_collapsed("y")} <> '')[1], '') AS line FROM s),
c AS (SELECT doc_id, {_collapsed("line")} AS line FROM l)
SELECT doc_id, CASE WHEN length(line) > 200 THEN substr(line, 1, 199) || '…' ELSE line END AS excerpt FROM c
""")
def query_excerpt(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.query_excerpt(F.col("text"), "license? safety").alias("excerpt"))


@_register("SELECT p_partkey, coalesce(nullif(substr(lower(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g')), 1, 64), ''), 'article') AS slug FROM part")
def slug(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@_register("SELECT c_custkey, replace(url_encode(c_name || ' / ' || c_mktsegment), '+', '%20') AS path FROM customer")
def percent_encode(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", text.percent_encode(F.concat_ws(" / ", "c_name", "c_mktsegment")).alias("path"))


@_register("SELECT o_orderkey, 'https://a.test/w/index.php?title=' || replace(url_encode('Order of ' || o_custkey), '+', '%20') || '&oldid=' || o_orderkey AS url FROM orders")
def permanent_urls(spark, sf):
    title = F.concat(F.lit("Order of "), F.col("o_custkey").cast("string"))
    return _t(spark, sf, "orders").select("o_orderkey", text.source_url(F.lit("https://a.test/w/api.php?x=1"), title, F.col("o_orderkey")).alias("url"))


@_register("""
WITH d AS (SELECT doc_id, sha256(text) AS h, CAST(octet_length(encode(text)) AS BIGINT) * 1000 AS n, source FROM documents)
SELECT doc_id, 'objects/loose/b3/' || h[1:2] || '/' || h[3:4] || '/' || h AS path,
  CASE WHEN n >= 1073741824 THEN printf('%.1f GiB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MiB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KiB', n / 1024.0) ELSE n || ' B' END AS size,
  replace(replace(replace(replace(replace('<' || source || '> & "' || chr(39), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS label FROM d
""")
def object_labels(spark, sf):
    label = F.concat(F.lit("<"), F.col("source"), F.lit("> & \"'"))
    return _t(spark, sf, "documents").select(
        "doc_id", text.loose_path(F.sha2("text", 256)).alias("path"), text.format_bytes(F.octet_length("text").cast("long") * 1000).alias("size"), text.escape_html(label).alias("label")
    )


# ---- ledger


@_register("""
SELECT CASE WHEN bool_or(pending > 0 AND failed > 0) THEN 'attention' WHEN bool_or(pending > 0) THEN 'running' ELSE 'idle' END AS state
FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS failed, count(*) FILTER (l_returnflag = 'N') AS pending FROM lineitem GROUP BY 1)
""")
def library_state(spark, sf):
    runs = ledger.run_rollup(_t(spark, sf, "lineitem").select("l_orderkey", "l_returnflag"), "l_orderkey", "l_returnflag", ["A", "N"])
    return ledger.library_state(runs, F.col("N") > 0, F.col("A") > 0)


@_register("""
SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'A' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) = 1) ON l_orderkey = o_orderkey
""")
def latest_run_error(spark, sf):
    errors = _t(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return ledger.with_latest(_t(spark, sf, "orders").select("o_orderkey"), errors, "o_orderkey", ["l_linenumber", "l_partkey"], ["l_linenumber", "l_partkey"])


@_register("SELECT l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1")
def claim_next_job(spark, sf):
    return ledger.claim_lowest(_t(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_returnflag"), "l_suppkey", "l_orderkey", F.col("l_returnflag") == "N")


@_register("SELECT l_orderkey, max(l_shipdate) AS committed_through FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag <> 'A')")
def committable_runs(spark, sf):
    return ledger.committable(_t(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate"), "l_orderkey", F.col("l_returnflag") != "A", "l_shipdate")


@_register("""
SELECT s_suppkey AS c_custkey, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN c_nationkey = s_nationkey THEN 'applied' ELSE 'stale' END AS outcome, c_nationkey AS actual
FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey
""")
def compare_and_swap(spark, sf):
    state = _t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    changes = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"))
    return ledger.compare_and_swap(state, changes, "c_custkey", "c_nationkey")


@_register("""
SELECT s_suppkey AS c_custkey, s_nationkey AS c_nationkey, CASE WHEN c_custkey IS NULL THEN 'inserted' WHEN c_nationkey = s_nationkey THEN 'existing' ELSE 'conflict' END AS outcome
FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey
""")
def insert_or_conflict(spark, sf):
    state = _t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    offered = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"))
    return ledger.insert_or_conflict(state, offered, "c_custkey", ["c_nationkey"])


@_register("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def removable_sources(spark, sf):
    pages = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    collections = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return ledger.removable(_t(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", [pages, collections])


@_register("SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 'removed' ELSE 'active' END AS state FROM customer")
def tombstoned_members(spark, sf):
    members = _t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return ledger.tombstone(members.select("c_mktsegment").distinct(), members, "c_mktsegment", F.col("c_mktsegment") == "BUILDING")


@_register("SELECT sha256(text) AS object_id, arg_min(doc_id, (source, doc_id)) AS doc_id, min(source) AS source, count(*) - 1 AS spare FROM documents GROUP BY 1")
def kept_copy(spark, sf):
    copies = _t(spark, sf, "documents").select(F.sha2("text", 256).alias("object_id"), "doc_id", "source")
    return ledger.choose_copy(copies, "object_id", ["source", "doc_id"], ["doc_id", "source"])


@_register("SELECT user_id, event_type, count(*) AS copies FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf):
    return ledger.repeated_keys(_t(spark, sf, "events"), ["user_id", "event_type"])


@_register("""
SELECT o_custkey, o_orderkey, coalesce(array_to_string(list_reverse(list(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING)), ','), '') AS candidates FROM orders
""")
def delta_lookback(spark, sf):
    rows = ledger.lookback(_t(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")
    return rows.withColumn("candidates", F.concat_ws(",", F.col("candidates").cast("array<string>")))


@_register("""
SELECT category, k1, k2 FROM (SELECT 0 AS category, CAST(n_regionkey AS BIGINT) AS k1, CAST(n_nationkey AS BIGINT) AS k2 FROM nation UNION ALL SELECT 1, c_nationkey, c_custkey FROM customer UNION ALL SELECT 2, s_nationkey, s_suppkey FROM supplier)
WHERE (category, k1, k2) > (1, 20, 50) ORDER BY category, k1, k2 LIMIT 200
""")
def integrity_cursor(spark, sf):
    tables = [(_t(spark, sf, "nation"), "n_regionkey", "n_nationkey"), (_t(spark, sf, "customer"), "c_nationkey", "c_custkey"), (_t(spark, sf, "supplier"), "s_nationkey", "s_suppkey")]
    return ledger.record_cursor(tables, (1, 20, 50), 200)


@_register("SELECT max(o_orderdate) AS cutoff FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders) HAVING count(*) = 1")
def revision_cutoff(spark, sf):
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return ledger.cutoff_of(orders, "o_orderkey", "o_orderdate", orders.agg(F.max("o_orderkey")).first()[0])


@_register("SELECT c_mktsegment AS cadence, count(*) AS schedules, count(*) FILTER (c_acctbal < 0) AS paused FROM customer GROUP BY 1")
def schedules_by_cadence(spark, sf):
    return _t(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("cadence")).agg(F.count(F.lit(1)).alias("schedules"), F.count_if(F.col("c_acctbal") < 0).alias("paused"))


# ---- graph


@_register("""
WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS parent, 'n' || n_nationkey AS child FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
b AS (SELECT 'r1' AS node, 0 AS depth UNION SELECT child, depth + 1 FROM b JOIN e ON parent = node WHERE depth < 3)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY 1
""")
def category_bfs(spark, sf):
    nation, customer = _t(spark, sf, "nation"), _t(spark, sf, "customer")
    edges = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child")).unionByName(
        customer.select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child"))
    )
    return graph.category_bfs(edges, spark.range(1).select(F.lit("r1").alias("node")), 3)


# ---- incremental


@_register("SELECT event_id, user_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' - INTERVAL 300 SECOND AND ts <= TIMESTAMP '2024-01-20'")
def overlap_window_batch(spark, sf):
    return sync.overlap_batch(_t(spark, sf, "events").select("event_id", "user_id", "ts"), "ts", "2024-01-10", "2024-01-20")


@_register("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem")
def idempotent_enqueue(spark, sf):
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    queued = lines.where("l_returnflag = 'N'").select("l_orderkey", "l_partkey").distinct()
    return sync.enqueue(queued, lines.drop("l_returnflag"), ["l_orderkey", "l_partkey"])


@_register("""
SELECT event_id, (e // 3600 + 1) * 3600 AS next_at, CASE WHEN e % 86400 < 21600 THEN e - e % 86400 + 21600 ELSE e - e % 86400 + 108000 END AS daily_at
FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS e FROM events)
""")
def next_cadence(spark, sf):
    at = F.unix_timestamp(F.date_trunc("second", "ts"))
    nominal = [schedule.next_nominal(c, at).alias(n) for c, n in ((schedule.Cadence.interval(3600), "next_at"), (schedule.Cadence.daily(21_600), "daily_at"))]
    return _t(spark, sf, "events").select("event_id", *nominal)


def _mix_sql(v: str) -> str:
    """splitmix64 of an unsigned value; products modulo 2 ** 64 by way of 128 bits."""
    wrap = "CAST(({0}) % 18446744073709551616::UHUGEINT AS UBIGINT)"
    v = wrap.format(f"CAST({v} AS UHUGEINT) + {schedule.STEP}")
    for right, times in ((30, schedule.FIRST), (27, schedule.SECOND)):
        v = f"list_transform([{v}], lambda v: " + wrap.format(f"CAST(xor(v, v >> {right}) AS UHUGEINT) * {times}") + ")[1]"
    return f"list_transform([{v}], lambda v: xor(v, v >> 31))[1]"


def _jitter_sql(ident: str, nominal: str, most: int) -> str:
    """Jitter of a nominal time below 2 ** 35."""
    mixed = f"xor(xor({schedule.JITTER_DOMAIN}::UBIGINT, {_mix_sql(f'CAST({ident} AS UBIGINT)')}), {_mix_sql(f'CAST({nominal} AS UBIGINT) * 536870912')})"
    return f"CAST({_mix_sql(mixed)} % {most + 1} AS BIGINT)"


@_register(f"""
SELECT o_orderkey, CASE WHEN t <= 852076800 THEN t END AS due_at, CASE WHEN t > 852076800 THEN t WHEN j > 0 THEN 852076800 + j ELSE 852163200 + k END AS next_run_at
FROM (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS t, {_jitter_sql("o_custkey", "852076800", 600)} AS j, {_jitter_sql("o_custkey", "852163200", 600)} AS k FROM orders)
""")
def schedule_recovery(spark, sf):
    at, now = F.unix_timestamp("o_orderdate"), F.lit(852_076_800)
    due, following = schedule.recover(schedule.Cadence.interval(86_400), F.col("o_custkey"), 600, at, now)
    return _t(spark, sf, "orders").select("o_orderkey", due.alias("due_at"), following.alias("next_run_at"))


@_register()
def diff_turns(spark, sf):
    turns = _t(spark, sf, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    lines = turns.join(before, ["conv_id", "turn"]).withColumn("lines", diff.diff_udf("before", "text"))
    return lines.select("conv_id", "turn", diff.has_changes(F.col("lines")).alias("changed"), F.size(F.filter("lines", lambda x: x["tag"] == "insert")).alias("inserted"), F.size(F.filter("lines", lambda x: x["tag"] == "delete")).alias("deleted"))


@_register()
def wikitext_render(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", wikitext.wikitext_to_text("text").alias("rendered"), wikitext.wikitext_to_markdown("text").alias("markdown"))


@_register()
def wikitext_search_content(spark, sf):
    shown = _t(spark, sf, "documents").select("doc_id", wikitext.search_content("text").alias("c"))
    return shown.select("doc_id", "c.headings", "c.body")


def _digits_sql(value: str, count: int) -> str:
    """The ``count`` lowest digits of an unsigned value in base 36."""
    powers = ", ".join(f"'{36**k}'::UHUGEINT" for k in reversed(range(count)))
    return f"array_to_string(list_transform([{powers}], lambda p: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST({value} // p % 36 AS INTEGER) + 1, 1)), '')"


# 160 bits as four limbs of 40, divided by 36 ** 15 so that quotient and remainder fit into 128 bits
@_register(f"""
WITH l AS (SELECT doc_id, list_transform(range(4), lambda i: CAST(CAST('0x' || substr(sha1(text), CAST(10 * i + 1 AS INTEGER), 10) AS UBIGINT) AS UHUGEINT)) AS n, '{1 << 40}'::UHUGEINT AS b, '{36**15}'::UHUGEINT AS m FROM documents),
d AS (SELECT *, n[1] * b + n[2] AS c2 FROM l), e AS (SELECT *, c2 % m * b + n[3] AS c3 FROM d), f AS (SELECT *, c3 % m * b + n[4] AS c4 FROM e),
g AS (SELECT doc_id, (c2 // m) * b * b + (c3 // m) * b + c4 // m AS high, c4 % m AS low FROM f)
SELECT doc_id, {_digits_sql("high", 16)} || {_digits_sql("low", 15)} AS sha1_base36, {_jitter_sql("doc_id", "1", 600)} AS jitter FROM g
""")
def object_base36(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.base36_sha1(F.col("text")).alias("sha1_base36"), schedule.jitter(F.col("doc_id"), F.lit(1), 600).alias("jitter"))


def queries() -> dict[str, Query]:
    """Every query, by name."""
    return _QUERIES | archive.queries() | store.queries()


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL, by query name."""
    return _SQL | archive.oracle_sql() | store.oracle_sql()
