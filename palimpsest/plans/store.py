"""Queries of objects and packs, exports, collections and the sync loop, each with its DuckDB equivalent.

Documents stand in for objects and articles, parts for objects with many copies (lines), orders for packs and
revisions, suppliers for collections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import wikitext
from palimpsest.operators import collections, exports, history, ledger, objects
from palimpsest.streaming import reconcile

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


# ---- objects and packs


@_register(r"SELECT doc_id, 'o256:' || sha256(encode('palimpsest-object') || '\x01'::BLOB || unhex(printf('%016x', octet_length(encode(text)))) || encode(text)) AS object_id FROM documents")
def object_ids(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", objects.object_id(F.col("text")).alias("object_id"))


@_register("""
WITH o AS (SELECT DISTINCT sha256(text) AS object, lang AS kind, octet_length(encode(text)) AS bytes FROM documents)
SELECT o.object, o.kind, o.bytes, CASE WHEN s.object IS NULL THEN 'stored' WHEN s.kind = o.kind AND s.bytes = o.bytes THEN 'existing' ELSE 'conflict' END AS outcome FROM o LEFT JOIN (SELECT * FROM o WHERE kind = 'en') s ON s.object = o.object
""")
def put_objects(spark, sf):
    offered = _t(spark, sf, "documents").select(F.sha2("text", 256).alias("object"), F.col("lang").alias("kind"), F.octet_length("text").cast("long").alias("bytes"))
    return objects.put(offered.where("kind = 'en'"), offered, "object", "kind", "bytes")


_USABLE = """
u AS (SELECT l_partkey AS object, pack, location, generation FROM (SELECT l_partkey, CASE WHEN l_returnflag <> 'A' THEN l_orderkey END AS pack, l_orderkey * 10 + l_linenumber AS location FROM lineitem WHERE l_discount < 0.08)
  LEFT JOIN (SELECT o_orderkey, year(o_orderdate) AS generation FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = pack WHERE pack IS NULL OR o_orderkey IS NOT NULL)
"""


def _usable(spark: SparkSession, sf: str) -> DataFrame:
    lines = _t(spark, sf, "lineitem")
    copies = lines.select(F.col("l_partkey").alias("object"), F.when(F.col("l_returnflag") != "A", F.col("l_orderkey")).alias("pack"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("location"), (F.col("l_discount") < 0.08).alias("verified"))
    packs = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("pack"), F.year("o_orderdate").alias("generation"), (F.col("o_orderstatus") != "P").alias("verified"))
    return objects.usable_locations(copies, packs)


@_register(f"WITH {_USABLE} SELECT object, pack, location, copies FROM (SELECT *, count(*) OVER (PARTITION BY object) AS copies, row_number() OVER (PARTITION BY object ORDER BY pack IS NOT NULL DESC, coalesce(generation, -1) DESC, location DESC) AS n FROM u) WHERE n = 1")
def best_copies(spark, sf):
    return objects.best_location(_usable(spark, sf))


@_register(f"WITH {_USABLE} SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT object FROM u)")
def contained_objects(spark, sf):
    held = _usable(spark, sf).select(F.col("object").alias("p_partkey"))
    return _t(spark, sf, "part").select("p_partkey", "p_name").join(held, "p_partkey", "left_semi")


@_register(f"""
WITH {_USABLE}, w AS (SELECT object, min(location) AS oldest FROM u WHERE pack IS NULL AND object IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') AND object NOT IN (SELECT object FROM u WHERE pack % 2 = 0) GROUP BY 1),
f AS (SELECT object, oldest, CAST(p_size AS BIGINT) AS bytes FROM w JOIN part ON p_partkey = object ORDER BY oldest, object LIMIT 256)
SELECT object, oldest, bytes, CAST(running AS BIGINT) AS running FROM (SELECT *, sum(bytes) OVER (ORDER BY oldest, object) AS running FROM f) WHERE running <= 2000
""")
def next_pack(spark, sf):
    usable = _usable(spark, sf).where("pack IS NULL OR pack % 2 = 0")  # packs of odd numbers are retired
    sizes = _t(spark, sf, "part").select(F.col("p_partkey").alias("object"), F.col("p_size").cast("long").alias("bytes"))
    return objects.next_pack(usable, sizes, budget=2000)


@_register(f"WITH {_USABLE} SELECT object, location, CASE WHEN object IN (SELECT object FROM u WHERE pack IS NOT NULL) THEN 'obsolete' ELSE 'verified' END AS state FROM u WHERE pack IS NULL")
def pruned_copies(spark, sf):
    return objects.prunable(_usable(spark, sf))


@_register(f"""
WITH {_USABLE}, p AS (SELECT DISTINCT object, pack FROM u WHERE pack IS NOT NULL)
SELECT pack, count(*) AS objects, bool_and(EXISTS (SELECT 1 FROM u WHERE u.object = p.object AND u.pack IS DISTINCT FROM p.pack)) AS may_go FROM p GROUP BY 1
""")
def retirable_packs(spark, sf):
    return objects.retirement(_usable(spark, sf))


@_register("""
SELECT conv_id, bool_or(good) AS found, min(turn) FILTER (good) AS turn, count(*) FILTER (NOT good) AS bad_copies, CASE WHEN bool_or(good) THEN 'read' ELSE 'corrupt' END AS outcome
FROM (SELECT c.conv_id, turn, sha256(text) = sha256(CASE WHEN c.conv_id % 5 = 0 THEN 'lost' ELSE w END) AS good FROM conversations c JOIN (SELECT conv_id, arg_max(text, turn) AS w FROM conversations GROUP BY 1) d ON d.conv_id = c.conv_id) GROUP BY 1
""")
def verified_reads(spark, sf):
    turns = _t(spark, sf, "conversations").select("conv_id", "turn", "text")
    wanted = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("w")).select("conv_id", F.sha2(F.when(F.col("conv_id") % 5 == 0, "lost").otherwise(F.col("w")), 256).alias("digest"))
    read = objects.read_verified(turns.join(wanted, "conv_id"), "conv_id", "digest", "text", ["turn"])
    return read.select("conv_id", (F.col("outcome") == "read").alias("found"), "turn", "bad_copies", "outcome")


@_register("""
WITH p AS (SELECT a.conv_id, b.turn, b.text, hex(encode(a.text)) AS x, hex(encode(b.text)) AS y, octet_length(encode(a.text)) AS n, octet_length(encode(b.text)) AS m FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
s AS (SELECT *, coalesce(list_position(list_transform(range(0, least(n, m)), lambda i: substr(x, 2 * i + 1, 2) = substr(y, 2 * i + 1, 2)), false) - 1, least(n, m)) AS start FROM p),
e AS (SELECT *, coalesce(list_position(list_transform(range(0, least(n, m) - start), lambda i: substr(x, 2 * (n - i) - 1, 2) = substr(y, 2 * (m - i) - 1, 2)), false) - 1, least(n, m) - start) AS tail FROM s)
SELECT conv_id, turn, CAST(start AS BIGINT) AS start, CAST(tail AS BIGINT) AS tail, CAST(16 + m - start - tail AS BIGINT) AS delta_bytes, sha256(text) AS digest FROM e
""")
def delta_turns(spark, sf):
    turns = _t(spark, sf, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("base"))
    rows = turns.join(before, ["conv_id", "turn"]).withColumn("d", objects.delta_of("base", "text"))
    return rows.select("conv_id", "turn", F.col("d.start").alias("start"), F.col("d.end").alias("tail"), F.col("d.delta_bytes").alias("delta_bytes"), F.col("d.digest").alias("digest"))


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select(F.floor(F.col("doc_id") / objects.MOST_OBJECTS).alias("pack"), F.col("doc_id").alias("ident"), F.col("text").alias("content"))
    return objects.pack_entries(docs)


@_register("SELECT doc_id // 256 AS pack, count(*) AS objects, CAST(sum(octet_length(encode(text))) AS BIGINT) AS whole_bytes, count(*) AS restored, true AS sound FROM documents GROUP BY 1")
def pack_reports(spark, sf):
    return objects.pack_report(_packed(spark, sf))


# ---- exports


_PAGES = """
d AS (SELECT doc_id, text, lang, ascii(lang) AS wiki_id, 'https://' || lang || '.example.org/w/api.php' AS endpoint, source || ' [' || doc_id || ']' AS title FROM documents),
a AS (SELECT d.*, o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS revision_time, CAST(epoch(o_orderdate) AS BIGINT) + 3600 AS captured_at, CASE WHEN doc_id % 3 > 0 THEN o_orderpriority END AS author, 's256:' || sha256(text) AS hash, octet_length(encode(text)) AS bytes
  FROM d LEFT JOIN (SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = doc_id)
"""


def _export_pages(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.col("lang")
    pages = _t(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), "text", lang.alias("wiki"), F.ascii(lang).alias("wiki_id"), F.concat(F.lit("https://"), lang, F.lit(".example.org/w/api.php")).alias("endpoint"),
        F.concat("source", F.lit(" ["), "doc_id", F.lit("]")).alias("title"), F.concat(F.lit("s256:"), F.sha2("text", 256)).alias("content_hash"), F.octet_length("text").cast("long").alias("source_size"),
    )
    revisions = _t(spark, sf, "orders").withColumnRenamed("o_custkey", "page_id")
    rows = history.as_of(pages, revisions, "page_id", "o_orderdate", "o_orderkey", "1996-01-01", ["o_orderkey", "o_orderdate", "o_orderpriority"])
    at = F.col("o_orderdate")
    return rows.withColumns({"revision_id": F.col("o_orderkey"), "revision_time": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "captured_at": F.unix_timestamp(at) + 3600, "author": F.when(F.col("page_id") % 3 > 0, F.col("o_orderpriority"))})


def _articles(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    rows = _export_pages(spark, sf).where("revision_id IS NOT NULL")
    extension = "md" if kind == "markdown" else "txt"
    return exports.with_paths(rows, "wiki_id", "page_id", "title", extension).withColumn("record", exports.metadata(kind, f"{kind}/1"))


_URL = "'https://' || lang || '.example.org/w/index.php?title=' || replace(replace(replace(title, ' ', '%20'), '[', '%5B'), ']', '%5D') || '&oldid=' || o_orderkey"
_PATH = "'articles/' || doc_id || '-' || replace(replace(title, ' [', '-'), ']', '') || '.'"
_FULL = "CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN text ELSE text || chr(10) END"
_NOTICE = exports.NOTICE.replace("'", "''")


@_register(f"""
WITH {_PAGES}, x AS (SELECT *, {_URL} AS url, {_PATH} || 'md' AS path FROM a WHERE o_orderkey IS NOT NULL)
SELECT doc_id AS page_id, '{{"author":' || coalesce('"' || author || '"', 'null') || ',"capture_time_unix":' || captured_at || ',"content_hash":"' || hash || '","content_hash_algorithm":"{exports.HASH_NAME}","format":"markdown","page_id":' || doc_id || ',"relative_path":"' || path || '","revision_id":' || o_orderkey ||
  ',"revision_time":"' || revision_time || '","source_api_endpoint":"' || endpoint || '","source_url":"' || url || '","title":"' || title || '","transformer_version":"markdown/1","wiki":"' || lang || '","wiki_id":' || wiki_id || '}}' AS line FROM x
""")
def export_index(spark, sf):
    return _articles(spark, sf, "markdown").select("page_id", exports.index_line(F.col("record")).alias("line"))


@_register(f"""
WITH {_PAGES}, x AS (SELECT *, {_URL} AS url FROM a WHERE o_orderkey IS NOT NULL)
SELECT doc_id AS page_id, sha256('---' || chr(10) || 'wiki: "' || lang || '"' || chr(10) || 'wiki_id: ' || wiki_id || chr(10) || 'page_id: ' || doc_id || chr(10) || 'title: "' || title || '"' || chr(10) || 'revision_id: ' || o_orderkey || chr(10) || 'revision_time: "' || revision_time || '"' || chr(10) ||
  'source_url: "' || url || '"' || chr(10) || 'source_api_endpoint: "' || endpoint || '"' || chr(10) || 'capture_time_unix: ' || captured_at || chr(10) || 'content_hash: "' || hash || '"' || chr(10) || 'content_hash_algorithm: "{exports.HASH_NAME}"' || chr(10) || 'transformer_version: "markdown/1"' || chr(10) || '---' || chr(10) || chr(10) || {_FULL} ||
  chr(10) || '## Source and attribution' || chr(10) || chr(10) || 'Source: [' || replace(replace(title, '[', '\\['), ']', '\\]') || '](' || url || '), revision ' || o_orderkey || ' (' || revision_time || ').' || chr(10) || chr(10) || 'Revision author: ' || coalesce(author, 'not available') || '.' || chr(10) || chr(10) || '{_NOTICE}') AS digest FROM x
""")
def export_markdown_files(spark, sf):
    return _articles(spark, sf, "markdown").select("page_id", F.sha2(exports.markdown_file(F.col("record"), F.col("text")), 256).alias("digest"))


@_register(f"""
WITH {_PAGES}, x AS (SELECT *, {_URL} AS url FROM a WHERE o_orderkey IS NOT NULL)
SELECT doc_id AS page_id, sha256('Title: ' || title || chr(10) || 'Wiki: ' || lang || ' (local ID ' || wiki_id || ')' || chr(10) || 'Page ID: ' || doc_id || chr(10) || 'Revision ID: ' || o_orderkey || chr(10) || 'Revision time: ' || revision_time || chr(10) || 'Source URL: ' || url || chr(10) ||
  'Source API endpoint: ' || endpoint || chr(10) || 'Capture time (Unix): ' || captured_at || chr(10) || 'Content hash: ' || hash || chr(10) || 'Content hash algorithm: {exports.HASH_NAME}' || chr(10) || 'Transformer: text/1' || chr(10) || chr(10) || {_FULL} || chr(10) || 'SOURCE AND ATTRIBUTION' || chr(10) ||
  'Source: ' || title || ' (revision ' || o_orderkey || ', ' || revision_time || ').' || chr(10) || 'Revision author: ' || coalesce(author, 'not available') || '.' || chr(10) || 'Permanent source URL: ' || url || chr(10) || '{_NOTICE}') AS digest FROM x
""")
def export_text_files(spark, sf):
    return _articles(spark, sf, "text").select("page_id", F.sha2(exports.text_file(F.col("record"), F.col("text")), 256).alias("digest"))


@_register()
def export_rendered_files(spark, sf):
    body = wikitext.wikitext_to_markdown("text")
    return _articles(spark, sf, "markdown").withColumn("body", body).select("page_id", "relative_path", exports.markdown_file(F.col("record"), F.col("body")).alias("content"))


@_register(f"""
WITH {_PAGES} SELECT count(o_orderkey) AS article_count, count(*) FILTER (o_orderkey IS NULL) AS uncaptured_page_count, CAST(coalesce(sum(bytes) FILTER (o_orderkey IS NOT NULL), 0) AS BIGINT) AS canonical_source_bytes, max(captured_at) AS maximum_capture_time_unix,
  CASE WHEN count(*) > 10000 THEN 'too many pages' WHEN sum(bytes) FILTER (o_orderkey IS NOT NULL) > 536870912 THEN 'too many bytes' END AS problem FROM a
""")
def export_summary(spark, sf):
    return exports.summary(_export_pages(spark, sf), "revision_id", "source_size", "captured_at")


@_register("""
SELECT p_partkey, 'articles/' || s || CASE WHEN row_number() OVER (PARTITION BY s ORDER BY p_partkey) > 1 THEN '-wiki-' || p_partkey ELSE '' END || '.txt' AS relative_path
FROM (SELECT p_partkey, p_size || '-' || lower(left(regexp_replace(regexp_replace(p_type, '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 64)) AS s FROM part)
""")
def export_paths(spark, sf):
    return exports.with_paths(_t(spark, sf, "part").select("p_partkey", "p_size", "p_type"), "p_partkey", "p_size", "p_type", "txt").select("p_partkey", "relative_path")


@_register("SELECT DISTINCT l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag <> 'R' AND s_acctbal > 0")
def export_selection(spark, sf):
    members = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey", (F.col("l_returnflag") != "R").alias("active"))
    return exports.selected_pages(members, _t(spark, sf, "supplier").where("s_acctbal > 0"), "s_suppkey", ["l_partkey"])


# ---- collections


@_register("""
WITH w AS (SELECT DISTINCT s_nationkey AS wiki, CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'AUTOMOBILE' ELSE 'NEW' END AS name FROM supplier), s AS (SELECT c_nationkey AS wiki, c_mktsegment AS name, bool_and(c_acctbal < 3000) AS gone FROM customer GROUP BY 1, 2)
SELECT w.wiki, w.name, CASE WHEN gone IS NULL THEN 'created' WHEN gone THEN 'reopened' ELSE 'existing' END AS outcome FROM w LEFT JOIN s ON s.wiki = w.wiki AND s.name = w.name
""")
def open_collections(spark, sf):
    state = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("wiki"), F.col("c_mktsegment").alias("name"), (F.col("c_acctbal") < 3000).alias("removed"))
    name = F.when(F.col("s_suppkey") % 3 == 0, "BUILDING").when(F.col("s_suppkey") % 3 == 1, "AUTOMOBILE").otherwise("NEW")
    return collections.create_or_reopen(state, _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("wiki"), name.alias("name")), ["wiki", "name"], "removed")


@_register("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN k <> rk THEN 'other kind' WHEN rk = 'category' AND t <> s_nationkey THEN 'other category' WHEN rk = 'category' AND l_linenumber > s_suppkey % 5 THEN 'too deep' END AS problem
FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'titles' ELSE 'category' END AS k, l_partkey % 4 AS t, CASE WHEN s_suppkey % 4 = 0 THEN 'titles' ELSE 'category' END AS rk FROM lineitem JOIN (SELECT s_suppkey, s_nationkey % 4 AS s_nationkey FROM supplier) ON s_suppkey = l_suppkey)
""")
def reason_problems(spark, sf):
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("s_suppkey"), "l_returnflag")
    rules = _t(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, "titles").otherwise("category").alias("rk"), (F.col("s_nationkey") % 4).cast("long").alias("rt"), (F.col("s_suppkey") % 5).alias("rd"))
    kind = F.when(F.col("l_returnflag") == "R", "titles").otherwise("category")
    problem = collections.reason_problem(F.col("rk"), F.col("rt"), F.col("rd"), kind, F.col("l_partkey") % 4, F.col("l_linenumber"))
    return lines.join(rules, "s_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", problem.alias("problem"))


@_register("""
WITH c AS (SELECT l_suppkey AS g, l_partkey AS p, bool_or(l_returnflag <> 'R') AS a, min(l_shipdate) AS f FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1, 2),
i AS (SELECT l_suppkey AS g, l_partkey AS p, min(l_shipdate) AS t FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2),
b AS (SELECT s_suppkey AS g, CASE WHEN s_suppkey % 4 > 0 THEN 150 * (s_suppkey % 4) END AS most, s_acctbal > 2000 AS keep FROM supplier WHERE s_nationkey <> 3),
r AS (SELECT coalesce(c.g, i.g) AS g, coalesce(c.p, i.p) AS p, a, f, t FROM c FULL JOIN i ON c.g = i.g AND c.p = i.p),
x AS (SELECT r.*, most, keep, t IS NOT NULL OR (coalesce(a, false) AND coalesce(keep, false)) AS stays FROM r LEFT JOIN b ON b.g = r.g),
v AS (SELECT g, CASE WHEN NOT bool_or(keep IS NOT NULL) THEN 'not configured' WHEN count(t) > max(most) THEN 'incoming over budget' WHEN count(*) FILTER (stays) > max(most) THEN 'members over budget' ELSE 'committed' END AS verdict FROM x GROUP BY 1)
SELECT x.g AS collection, p AS page, CASE WHEN CASE WHEN verdict = 'committed' THEN stays ELSE coalesce(a, false) END THEN 'active' ELSE 'removed' END AS state, coalesce(f, t) AS first_at, verdict FROM x JOIN v ON v.g = x.g WHERE verdict = 'committed' OR a IS NOT NULL
""")
def committed_members(spark, sf):
    lines = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("collection"), F.col("l_partkey").alias("page"), (F.col("l_returnflag") != "R").alias("active"), F.col("l_shipdate").alias("first_at"))
    cut = F.lit("1996-01-01").cast("timestamp")
    incoming = lines.where(F.col("first_at") >= cut).select("collection", "page", F.col("first_at").alias("at"))
    key = F.col("s_suppkey")
    budgets = _t(spark, sf, "supplier").where("s_nationkey <> 3").select(key.alias("collection"), F.when(key % 4 > 0, key % 4 * 150).alias("most"), (F.col("s_acctbal") > 2000).alias("keep"))
    return collections.commit_members(lines.where(F.col("first_at") < cut), incoming, budgets, "collection", "page")


@_register("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s_acctbal < 0 AND state IN ('queued', 'running') THEN 'cancelled' ELSE state END AS state FROM (SELECT *, CASE l_returnflag WHEN 'N' THEN 'running' WHEN 'A' THEN 'succeeded' ELSE 'queued' END AS state FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey)")
def given_up_jobs(spark, sf):
    jobs = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("s_suppkey"), F.when(F.col("l_returnflag") == "N", "running").when(F.col("l_returnflag") == "A", "succeeded").otherwise("queued").alias("state"))
    owners = _t(spark, sf, "supplier").select("s_suppkey", F.col("s_suppkey").alias("owner"), (F.col("s_acctbal") < 0).alias("gone"))
    state = collections.give_up(F.col("owner"), F.col("gone"), F.col("state"), ("queued", "running"), "cancelled")
    return jobs.join(owners, "s_suppkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", state.alias("state"))


@_register("SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2")
def title_history(spark, sf):
    return collections.title_history(_t(spark, sf, "events").select("user_id", "event_type", "ts"), ["user_id"], "event_type", "ts")


@_register("""
WITH h AS (SELECT user_id, event_type, max(ts) AS seen FROM events GROUP BY 1, 2), c AS (SELECT user_id, arg_max(event_type, (seen, event_type)) AS current_title FROM h GROUP BY 1)
SELECT h.user_id, event_type, current_title FROM h JOIN c ON c.user_id = h.user_id WHERE event_type IN (SELECT event_type FROM events WHERE value > 90)
""")
def pages_by_any_title(spark, sf):
    events = _t(spark, sf, "events")
    seen = collections.title_history(events.select("user_id", "event_type", "ts"), ["user_id"], "event_type", "ts")
    return collections.pages_by_any_title(seen, events.where("value > 90").select("event_type"), ["user_id"], "event_type")


@_register("""
WITH p AS (SELECT c_custkey AS page, head_at, c_acctbal < 0 AS missing, c_mktsegment = 'BUILDING' AS removed FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS head_at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey WHERE c_nationkey < 20)
SELECT o_orderkey AS revision, o_custkey AS page, o_orderdate AS at, CASE WHEN removed THEN 'refused' WHEN page IS NULL THEN 'created' WHEN head_at IS NULL OR o_orderdate >= head_at THEN 'moved' ELSE 'older' END AS outcome, coalesce(missing, false) AND NOT coalesce(removed, false) AS reactivated
FROM orders LEFT JOIN p ON page = o_custkey WHERE o_orderstatus <> 'F'
""")
def captured_heads(spark, sf):
    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("revision"), F.col("o_custkey").alias("page"), F.col("o_orderdate").alias("at"), "o_orderstatus")
    heads = orders.where("o_orderstatus = 'F'").groupBy("page").agg(F.max("at").alias("head_at"))
    state = _t(spark, sf, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("page"), (F.col("c_acctbal") < 0).alias("missing"), (F.col("c_mktsegment") == "BUILDING").alias("removed"))
    return collections.capture_heads(state.join(heads, "page", "left"), orders.where("o_orderstatus <> 'F'").drop("o_orderstatus"), "page")


@_register("SELECT DISTINCT l_suppkey AS page, l_orderkey AS revision, CASE WHEN o_custkey IS NULL THEN 'not captured' WHEN o_custkey <> l_suppkey THEN 'other page' ELSE 'set' END AS outcome FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey")
def heads_set(spark, sf):
    revisions = _t(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("revision"), F.col("o_custkey").alias("page"))
    wanted = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_orderkey").alias("revision")).distinct()
    return collections.set_heads(revisions, wanted, "page", "revision")


@_register("SELECT c_custkey, c_nationkey, CASE WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN 'missing' ELSE 'present' END AS state FROM customer")
def missing_pages(spark, sf):
    return collections.mark_missing(_t(spark, sf, "customer"), _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey")), "c_custkey", "c_nationkey")


@_register("SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size > 25 THEN 'titles' WHEN p_size % 3 = 1 AND p_size <= 25 THEN 'category:' || p_brand || '/' || p_size END AS rule FROM part")
def stored_rules(spark, sf):
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "titles").when(size % 3 == 1, "category").otherwise("unknown")
    return _t(spark, sf, "part").select("p_partkey", collections.stored_rule(kind, F.when(size <= 25, F.col("p_brand")), F.when(size <= 25, size)).alias("rule"))


@_register("SELECT s_suppkey, s_name, s_acctbal < 0 AS removed, count(l_partkey) FILTER (l_returnflag <> 'R') AS members FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2, 3 ORDER BY lower(s_name), s_suppkey")
def collection_summaries(spark, sf):
    rows = _t(spark, sf, "supplier").select("s_suppkey", "s_name", (F.col("s_acctbal") < 0).alias("removed"))
    members = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), (F.col("l_returnflag") != "R").alias("active"))
    return collections.summaries(rows, members, "s_suppkey", "removed", True).orderBy(F.lower("s_name"), "s_suppkey")


# ---- runs and the sync loop


@_register("""
WITH r AS (SELECT o_orderkey AS run FROM orders ORDER BY 1 DESC LIMIT 100)
SELECT run, count(l_orderkey) AS jobs, count(*) FILTER (l_returnflag = 'A') AS failed, count(*) FILTER (l_returnflag = 'R') AS retried, max(l_shipdate) FILTER (l_returnflag = 'A') AS error_at FROM r LEFT JOIN lineitem ON l_orderkey = run GROUP BY 1
""")
def run_statuses(spark, sf):
    runs = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("run")).orderBy(F.desc("run")).limit(100)
    jobs = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_returnflag").alias("state"), F.col("l_shipdate").alias("error_at")).join(runs, "run", "left_semi")
    rows = runs.join(ledger.run_rollup(jobs, "run", "state", ["A", "R"]), "run", "left")
    rows = rows.select("run", *[F.coalesce(a, F.lit(0)).alias(b) for a, b in (("jobs", "jobs"), ("A", "failed"), ("R", "retried"))])
    return ledger.with_latest(rows, jobs.where("state = 'A'").select("run", "error_at"), "run", ["error_at"], ["error_at"])


@_register("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > 500 ORDER BY 1 LIMIT 1000")
def succeeded_runs_after(spark, sf):
    return history.keyset_page(_t(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", 500, 1000)


@_register("""
WITH r AS (SELECT s_nationkey AS wiki, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 4 END AS part, min(s_suppkey) AS run FROM supplier WHERE s_acctbal > 5000 GROUP BY 1, 2),
m AS (SELECT p_size % 25 AS wiki, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 END AS part, max(p_partkey) AS through FROM part WHERE p_size < 30 GROUP BY 1, 2),
o AS (SELECT c_nationkey AS wiki, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 END AS part, max(c_custkey) AS candidate FROM customer GROUP BY 1, 2)
SELECT o.wiki, o.part, CASE WHEN run IS NULL THEN 'started' ELSE 'resumed' END AS outcome, run, CASE WHEN run IS NOT NULL THEN run * 10 ELSE greatest(coalesce(through - 300, 0), 0) END AS low, CASE WHEN run IS NOT NULL THEN run * 10 + 100 ELSE greatest(candidate, coalesce(through - 300, 0), 0) END AS high
FROM o LEFT JOIN r ON r.wiki = o.wiki AND r.part IS NOT DISTINCT FROM o.part LEFT JOIN m ON m.wiki = o.wiki AND m.part IS NOT DISTINCT FROM o.part
""")
def started_runs(spark, sf):
    part = lambda c: F.when(F.col(c) % 4 > 0, F.col(c) % 4).alias("part")
    key = F.col("s_suppkey")
    runs = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("wiki"), part("s_suppkey"), key.alias("run"), (F.col("s_acctbal") > 5000).alias("running"), (key * 10).alias("low"), (key * 10 + 100).alias("high"))
    marks = _t(spark, sf, "part").where("p_size < 30").select((F.col("p_size") % 25).alias("wiki"), part("p_partkey"), F.col("p_partkey").alias("through"))
    offered = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("wiki"), part("c_custkey"), "c_custkey").groupBy("wiki", "part").agg(F.max("c_custkey").alias("candidate"))
    return reconcile.start_or_resume(runs, offered, marks, ["wiki", "part"], 300)


@_register("""
WITH o AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem GROUP BY 1, 2), q AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)
SELECT o.l_orderkey, o.l_linenumber, CASE WHEN a <> b OR p <> a THEN 'conflict' WHEN p IS NULL THEN 'queued' ELSE 'existing' END AS outcome FROM o LEFT JOIN q ON q.l_orderkey = o.l_orderkey AND q.l_linenumber = o.l_linenumber
""")
def checked_queue(spark, sf):
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return reconcile.enqueue_checked(lines.where("l_returnflag = 'N'"), lines, ["l_orderkey", "l_linenumber"], "l_partkey")


@_register("""
SELECT event_id, CASE WHEN e = 'complete' AND s = 'running' THEN 'succeeded' WHEN e = 'fail' AND s = 'running' THEN 'failed' WHEN e = 'retry' AND s = 'running' THEN 'retryable' WHEN e = 'cancel' AND s <> 'succeeded' THEN 'cancelled' END AS state
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'fail' WHEN 2 THEN 'retry' ELSE 'cancel' END AS e, CASE user_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'retryable' ELSE 'succeeded' END AS s FROM events)
""")
def job_states(spark, sf):
    e, u = F.col("event_id") % 4, F.col("user_id") % 4
    event = F.when(e == 0, "complete").when(e == 1, "fail").when(e == 2, "retry").otherwise("cancel")
    state = F.when(u == 0, "queued").when(u == 1, "running").when(u == 2, "retryable").otherwise("succeeded")
    return _t(spark, sf, "events").select("event_id", reconcile.job_outcome(state, event).alias("state"))


@_register("""
WITH o AS (SELECT o_custkey AS page, o_orderkey AS revision, o_orderstatus AS s, CASE WHEN o_orderpriority LIKE '1%' AND o_orderstatus = 'P' THEN NULL ELSE lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS parent, o_totalprice, o_orderdate FROM orders),
t AS (SELECT page, max(revision) FILTER (o_orderdate < TIMESTAMP '1996-01-01') AS tip, max(revision) AS head FROM o GROUP BY 1 HAVING tip IS NOT NULL),
l AS (SELECT o.page, revision, parent, s, tip, head, lag(revision) OVER (PARTITION BY o.page ORDER BY revision) AS before FROM o JOIN t ON t.page = o.page WHERE revision BETWEEN tip AND head AND tip <> head AND o_totalprice > 30000),
g AS (SELECT page, min(revision) AS first, max(revision) AS last, count(*) FILTER (revision > tip) AS enumerated, count(*) FILTER (revision > tip AND s = 'F') AS reused, count(*) FILTER (before IS NOT NULL AND parent IS DISTINCT FROM before) AS breaks FROM l GROUP BY 1)
SELECT t.page, CASE WHEN tip = head THEN 'same head' WHEN first IS NULL OR first <> tip THEN 'identity changed' WHEN breaks > 0 THEN 'disconnected' WHEN enumerated > 12 THEN 'over the limit' WHEN last <> head THEN 'head not reached' ELSE 'connected' END AS verdict, coalesce(enumerated, 0) AS enumerated, coalesce(reused, 0) AS reused FROM t LEFT JOIN g ON g.page = t.page
""")
def forward_gaps(spark, sf):
    orders = _t(spark, sf, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("revision"), "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")
    listed = history.adjacency(orders, "page", "revision", "revision")
    parent = F.when(~(F.col("o_orderpriority").startswith("1") & (F.col("o_orderstatus") == "P")), F.col("previous_id"))
    tips = orders.groupBy("page").agg(F.max(F.when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"), F.col("revision"))).alias("tip"), F.max("revision").alias("head")).where("tip IS NOT NULL")
    return reconcile.forward_gaps(tips, listed.withColumn("parent", parent).where("o_totalprice > 30000"), "page", orders.where("o_orderstatus = 'F'").select("revision"), 12)


@_register("""
SELECT s_suppkey, CASE WHEN coalesce(bool_or(l_linenumber = 7 AND l_quantity > 45), false) THEN 'resume' WHEN coalesce(bool_or(l_returnflag = 'A' AND l_discount > 0.09), false) THEN 'reconcile' ELSE 'bootstrap' END AS step FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1
""")
def next_steps(spark, sf):
    running, done = (F.col("l_linenumber") == 7) & (F.col("l_quantity") > 45), (F.col("l_returnflag") == "A") & (F.col("l_discount") > 0.09)
    runs = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.explode(F.array_compact(F.array(F.when(running, "running"), F.when(done, "succeeded")))).alias("state"))
    return reconcile.next_steps(_t(spark, sf, "supplier"), runs, "s_suppkey")


@_register("SELECT o_orderkey, coalesce(total + o_totalprice <= CASE WHEN c_nationkey > 4 THEN 2000000.0 END, true) AS permitted FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON k = o_custkey")
def captures_within_bytes(spark, sf):
    orders = _t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    held = orders.groupBy("c_custkey").agg(F.sum("o_totalprice").alias("total"))
    limits = _t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_nationkey") > 4, F.lit(2000000.0)).alias("most"))
    return orders.join(held, "c_custkey").join(limits, "c_custkey").select("o_orderkey", reconcile.within_bytes(F.col("total"), F.col("o_totalprice"), F.col("most")).alias("permitted"))


def queries() -> dict[str, Query]:
    """Every query of this module, by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL, by query name."""
    return dict(_SQL)
