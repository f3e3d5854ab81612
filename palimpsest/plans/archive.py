"""Queries of lookups, budgets, instants, manifests, integrity and search, each with its DuckDB equivalent.

The tables stand in for an archive's: nations for wikis, customers for pages,
orders for revisions, suppliers for collections, lines for jobs, documents for objects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import times
from palimpsest.operators import integrity, ledger, manifests, resolve, search
from palimpsest.session import shared_folder

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


# ---- resolutions and lookups


@_register("""
SELECT t.title, CASE count(p_partkey) WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS outcome, CASE WHEN count(p_partkey) = 1 THEN min(p_partkey) END AS page_id, CASE WHEN count(p_partkey) = 1 THEN min(p_brand) END AS wiki
FROM (SELECT DISTINCT p_name AS title FROM part UNION SELECT s_name FROM supplier) t LEFT JOIN part ON p_name = t.title GROUP BY 1
""")
def unique_page_by_title(spark, sf):
    part = _t(spark, sf, "part").select(F.col("p_name").alias("title"), F.col("p_partkey").alias("page_id"), F.col("p_brand").alias("wiki"))
    asked = part.select("title").unionByName(_t(spark, sf, "supplier").select(F.col("s_name").alias("title")))
    return resolve.exactly_one(asked, part, "title", "page_id", "wiki")


@_register("""
SELECT a.title, a.wanted, CASE count(p_partkey) WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS outcome, CASE WHEN count(p_partkey) = 1 THEN min(p_partkey) END AS page_id, CASE WHEN count(p_partkey) = 1 THEN min(p_brand) END AS wiki
FROM (SELECT DISTINCT p_name AS title, CASE WHEN p_size > 25 THEN p_brand END AS wanted FROM part) a LEFT JOIN part ON p_name = a.title AND (a.wanted IS NULL OR a.wanted = p_brand) GROUP BY 1, 2
""")
def unique_page_in_wiki(spark, sf):
    part = _t(spark, sf, "part").select(F.col("p_name").alias("title"), F.col("p_partkey").alias("page_id"), F.col("p_brand").alias("wiki"), "p_size")
    asked = part.select("title", F.when(F.col("p_size") > 25, F.col("wiki")).alias("wanted"))
    return resolve.exactly_one(asked, part.drop("p_size"), "title", "page_id", "wiki", "wanted")


@_register("""
SELECT o_orderkey, o_custkey, o_orderdate, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus = 'P'
""")
def revisions_with_page_and_wiki(spark, sf):
    orders = _t(spark, sf, "orders").where((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")) & (F.col("o_orderstatus") == "P")).select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    pages = _t(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    wikis = _t(spark, sf, "nation").select("n_nationkey", "n_name")
    return orders.join(pages, "c_custkey").join(wikis, "n_nationkey").select("o_orderkey", F.col("c_custkey").alias("o_custkey"), "o_orderdate", "c_name", "n_name")


@_register("SELECT l_orderkey, l_linenumber, l_partkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey % 5 = p_size % 5 WHERE l_returnflag = 'R'")
def jobs_of_matching_scope(spark, sf):
    jobs = _t(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = _t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", (F.col("p_size") % 5).alias("scope"))
    owners = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 5).alias("scope"))
    return jobs.join(parts, "l_partkey").join(owners, ["l_suppkey", "scope"]).select("l_orderkey", "l_linenumber", "l_partkey", "p_name")


@_register("SELECT c_custkey, c_name, o.n AS revisions, o.newest FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS newest FROM orders GROUP BY 1) o ON o_custkey = c_custkey WHERE c_acctbal < 0")
def pages_with_history_size(spark, sf):
    history = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("revisions"), F.max("o_orderdate").alias("newest"))
    return _t(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey", "c_name").join(history, "c_custkey", "left")


@_register("SELECT a.c_custkey, b.c_custkey AS other FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND round(a.c_acctbal) = round(b.c_acctbal) AND a.c_custkey < b.c_custkey")
def pages_alike(spark, sf):
    rows = _t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.round("c_acctbal").alias("b"))
    other = rows.withColumnRenamed("c_custkey", "other")
    return rows.join(other, ["c_nationkey", "c_mktsegment", "b"]).where("c_custkey < other").select("c_custkey", "other")


@_register("SELECT doc_id, source, CASE WHEN toxic IS NOT DISTINCT FROM quality THEN 'same' ELSE 'other' END AS scope FROM documents LEFT JOIN labels USING (doc_id)")
def null_safe_scope(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", "source").join(_t(spark, sf, "labels"), "doc_id", "left")
    return rows.select("doc_id", "source", F.when(F.col("toxic").eqNullSafe(F.col("quality")), "same").otherwise("other").alias("scope"))


# ---- budgets and row rules


@_register("""
SELECT c_mktsegment, count(*) AS pages, round(sum(c_acctbal), 2) AS bytes, count(*) <= 320 AND sum(c_acctbal) <= 1300000 AS permitted FROM customer GROUP BY 1
""")
def budget_permits(spark, sf):
    sums = _t(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("pages"), F.sum("c_acctbal").alias("b"))
    return sums.select("c_mktsegment", "pages", F.round("b", 2).alias("bytes"), resolve.permits(F.col("pages"), F.col("b"), F.lit(320), F.lit(1_300_000)).alias("permitted"))


@_register("""
SELECT c_custkey, CASE WHEN b IS NULL THEN 'fits' WHEN cur > b THEN 'exceeded' WHEN p IS NULL THEN 'unknown' WHEN greatest(p, cur) > b THEN 'exceeded' ELSE 'fits' END AS verdict
FROM (SELECT c_custkey, c_acctbal AS cur, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal * 2 END AS p, CASE WHEN c_nationkey > 3 THEN 5000.0 END AS b FROM customer)
""")
def budget_verdicts(spark, sf):
    rows = _t(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("cur"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal") * 2).alias("p"), F.when(F.col("c_nationkey") > 3, F.lit(5000.0)).alias("b"))
    return rows.select("c_custkey", resolve.budget_verdict(F.col("p"), F.col("cur"), F.col("b")).alias("verdict"))


@_register("""
WITH s AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'interval' WHEN 2 THEN 'daily' ELSE 'weekly' END AS cadence, p_size * 5 AS every, p_size * p_size * 50 AS jitter, CASE WHEN p_retailprice > 950 THEN p_partkey END AS nxt FROM part)
SELECT p_partkey, CASE WHEN jitter > 86400 THEN 'jitter above a day' WHEN cadence = 'manual' AND (jitter > 0 OR nxt IS NOT NULL) THEN 'manual with jitter or next run'
  WHEN cadence = 'interval' AND NOT (every BETWEEN 60 AND 31622400) THEN 'interval out of range' WHEN cadence = 'interval' AND jitter > every THEN 'jitter above interval' WHEN cadence <> 'manual' AND nxt IS NULL THEN 'no next run' END AS problem FROM s
""")
def schedule_problems(spark, sf):
    size = F.col("p_size")
    cadence = F.when(size % 4 == 0, "manual").when(size % 4 == 1, "interval").when(size % 4 == 2, "daily").otherwise("weekly")
    return _t(spark, sf, "part").select("p_partkey", resolve.schedule_problem(cadence, size * 5, size * size * 50, F.when(F.col("p_retailprice") > 950, F.col("p_partkey"))).alias("problem"))


@_register("""
WITH m AS (SELECT l_orderkey AS g, l_partkey AS p, l_suppkey AS t, l_quantity AS b FROM lineitem)
SELECT g, 'repeated page' AS problem FROM (SELECT DISTINCT g FROM (SELECT g, p FROM m GROUP BY 1, 2 HAVING count(*) > 1)) UNION ALL SELECT g, 'repeated title' FROM (SELECT DISTINCT g FROM (SELECT g, t FROM m GROUP BY 1, 2 HAVING count(*) > 1))
UNION ALL SELECT g, 'page budget' FROM m GROUP BY g HAVING count(*) > 6 UNION ALL SELECT g, 'byte budget' FROM m GROUP BY g HAVING sum(b) > 250
""")
def preview_problems(spark, sf):
    members = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("t"), F.col("l_quantity").alias("b"))
    return resolve.preview_problems(members, "g", "p", "t", "b", 6, 250)


@_register("""
SELECT l_orderkey, rule FROM (SELECT l_orderkey, unnest([CASE WHEN l_quantity <= 0 THEN 'quantity' END, CASE WHEN l_returnflag = 'N' AND l_linestatus <> 'O' THEN 'pending is open' END, CASE WHEN l_tax > l_discount AND l_discount > 0.06 THEN 'tax within discount' END]) AS rule FROM lineitem) WHERE rule IS NOT NULL
""")
def row_constraint_findings(spark, sf):
    rules = {"quantity": F.col("l_quantity") > 0, "pending is open": (F.col("l_returnflag") != "N") | (F.col("l_linestatus") == "O"), "tax within discount": (F.col("l_tax") <= F.col("l_discount")) | (F.col("l_discount") <= 0.06)}
    return resolve.broken_rows(_t(spark, sf, "lineitem"), "l_orderkey", rules)


# ---- instants


@_register("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS canonical, CAST(epoch(o_orderdate) AS BIGINT) AS lenient, CAST(epoch(o_orderdate) AS BIGINT) - 5400 AS shifted, CAST(day(last_day(o_orderdate)) AS INTEGER) AS month_days, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS civil FROM orders
""")
def instants(spark, sf):
    at = F.col("o_orderdate")
    canonical = times.canonical(F.unix_timestamp(at))
    offset = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'.250+01:30'")
    civil = times.days_from_civil(F.year(at), F.month(at), F.dayofmonth(at))
    return _t(spark, sf, "orders").select("o_orderkey", canonical.alias("canonical"), times.lenient_epoch(canonical).alias("lenient"), times.rfc3339(offset)["seconds"].alias("shifted"), times.days_in_month(F.year(at), F.month(at)).alias("month_days"), civil.alias("civil"))


@_register("""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id END AS revision_id, CASE WHEN event_id % 2 = 1 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS seconds, CASE WHEN event_id % 2 = 1 THEN CAST(epoch_us(ts) % 1000000 * 1000 AS INTEGER) END AS nanos FROM events WHERE event_id > 0
""")
def cutoffs(spark, sf):
    rows = _t(spark, sf, "events").where("event_id > 0")
    given = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return rows.select("event_id", times.cutoff(given).alias("c")).select("event_id", "c.revision_id", "c.seconds", "c.nanos")


# ---- manifests


_MANIFEST = """
SELECT o_custkey AS run, '{"version":1,"run":' || o_custkey || ',"scope":"' || c_mktsegment || '","completed":"' || strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') || '","revisions":[' ||
  string_agg('{"page":' || o_custkey || ',"revision":' || o_orderkey || ',"object":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']}' AS body
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey, c_mktsegment
"""


def _manifests(spark: SparkSession, sf: str) -> DataFrame:
    scopes = _t(spark, sf, "customer").select(F.col("c_custkey").alias("run"), F.col("c_mktsegment").alias("scope"))
    captured = _t(spark, sf, "orders").select(F.col("o_custkey").alias("run"), "o_orderkey", "o_orderdate", "o_orderstatus").join(scopes, "run").withColumn("page", F.col("run"))
    return manifests.run_manifests(captured, "run", "scope", "o_orderdate", "page", "o_orderkey", "o_orderstatus")


@_register(f"SELECT run, body, 'm256:' || sha256(body) AS manifest_id, true AS canonical FROM ({_MANIFEST})")
def manifest_bodies(spark, sf):
    return _manifests(spark, sf).select("run", "body", "manifest_id", manifests.is_canonical(F.col("body")).alias("canonical"))


@_register(f"""
WITH m AS (SELECT run, 'm256:' || sha256(body) AS manifest_id FROM ({_MANIFEST}))
SELECT row_number() OVER (ORDER BY run) AS sequence, run, manifest_id, lag(manifest_id) OVER (ORDER BY run) AS previous_id FROM m
""")
def manifest_log(spark, sf):
    log = spark.createDataFrame([], "sequence long, run long, manifest_id string, previous_id string")
    return manifests.append(log, _manifests(spark, sf).select("run", "manifest_id"), "run")


@_register("SELECT c_custkey AS run FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01')")
def unmanifested_runs(spark, sf):
    runs = _t(spark, sf, "customer").select(F.col("c_custkey").alias("run"), "c_acctbal", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("configuration"))
    log = _t(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("1998-07-01").cast("timestamp")).select(F.col("o_custkey").alias("run"))
    return manifests.unmanifested(runs, log, "run", F.col("c_acctbal") > 0, "configuration")


@_register("SELECT l_orderkey, printf('%012d', l_orderkey) || '.json' AS name, CASE WHEN l_orderkey > 0 THEN l_orderkey END AS sequence FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def manifest_names(spark, sf):
    rows = _t(spark, sf, "lineitem").select("l_orderkey").distinct().withColumn("name", manifests.file_name(F.col("l_orderkey")))
    return rows.select("l_orderkey", "name", manifests.sequence_of(F.col("name")).alias("sequence"))


# ---- integrity


REFERENCES = [
    integrity.Reference("page without wiki", "customer", ("c_nationkey",), "nation", ("n_nationkey",), "c_custkey"),
    integrity.Reference("collection without wiki", "supplier", ("s_nationkey",), "nation", ("n_nationkey",), "s_suppkey"),
    integrity.Reference("wiki without family", "nation", ("n_regionkey",), "region", ("r_regionkey",), "n_nationkey"),
    integrity.Reference("revision without page", "orders", ("o_custkey",), "customer", ("c_custkey",), "o_orderkey"),
    integrity.Reference("page without revision", "customer", ("c_custkey",), "orders", ("o_custkey",), "c_custkey"),
    integrity.Reference("job without run", "lineitem", ("l_orderkey",), "orders", ("o_orderkey",), "l_orderkey"),
    integrity.Reference("run without job", "orders", ("o_orderkey",), "lineitem", ("l_orderkey",), "o_orderkey"),
    integrity.Reference("job without object", "lineitem", ("l_partkey",), "part", ("p_partkey",), "l_orderkey"),
    integrity.Reference("job without collection", "lineitem", ("l_suppkey",), "supplier", ("s_suppkey",), "l_orderkey"),
    integrity.Reference("object without job", "part", ("p_partkey",), "lineitem", ("l_partkey",), "p_partkey"),
    integrity.Reference("collection without job", "supplier", ("s_suppkey",), "lineitem", ("l_suppkey",), "s_suppkey"),
    integrity.Reference("event without page", "events", ("user_id",), "customer", ("c_custkey",), "event_id"),
    integrity.Reference("failed job without object", "lineitem", ("l_partkey",), "part", ("p_partkey",), "l_orderkey", "l_returnflag = 'A'"),
    integrity.Reference("label without document", "labels", ("doc_id",), "documents", ("doc_id",), "doc_id"),
    integrity.Reference("document without label", "documents", ("doc_id",), "labels", ("doc_id",), "doc_id"),
    integrity.Reference("good document without good label", "documents", ("doc_id",), "labels", ("doc_id",), "doc_id", "lang = 'en'"),
    integrity.Reference("page and wiki unused by a collection", "customer", ("c_nationkey",), "supplier", ("s_nationkey",), "c_custkey"),
]


def _reference_sql(r: integrity.Reference) -> str:
    on = " AND ".join(f"b.{y} = a.{x}" for x, y in zip(r.columns, r.target_columns, strict=True))
    return f"SELECT '{r.problem}' AS problem, CAST(a.{r.ident} AS BIGINT) AS ident FROM {r.table} a WHERE {r.where or 'true'} AND NOT EXISTS (SELECT 1 FROM {r.target} b WHERE {on})"


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    names = {x for r in REFERENCES for x in (r.table, r.target)}
    return integrity.reference_findings({n: _t(spark, sf, n) for n in names}, REFERENCES)


_FINDINGS_SQL = " UNION ALL ".join(_reference_sql(r) for r in REFERENCES)


@_register(_FINDINGS_SQL)
def integrity_findings(spark, sf):
    return _findings(spark, sf)


@_register(f"WITH f AS ({_FINDINGS_SQL}) SELECT problem, count(*) AS findings, array_to_string(list_sort(list(DISTINCT ident) FILTER (rank <= 20)), ',') AS first, 'complete' AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY ident) AS rank FROM f) GROUP BY 1")
def integrity_report(spark, sf):
    return integrity.report(_findings(spark, sf), 1, 1, 20).withColumn("first", F.concat_ws(",", F.col("first").cast("array<string>")))


@_register("SELECT CASE WHEN octet_length(encode(text)) <> n_chars THEN 'object size' ELSE 'object digest' END AS problem, doc_id AS ident FROM documents WHERE octet_length(encode(text)) <> n_chars OR source = 'src0'")
def object_findings(spark, sf):
    stored = _t(spark, sf, "documents").withColumn("digest", F.when(F.col("source") == "src0", "x").otherwise(F.sha2("text", 256)))
    return integrity.object_findings(stored, "doc_id", "text", "digest", "n_chars")


@_register("SELECT c_custkey, CASE WHEN v AND h AND c AND a THEN 'verified' WHEN NOT v THEN 'invalid signature' WHEN NOT h THEN 'different head' ELSE 'failed' END AS verdict FROM (SELECT c_custkey, c_acctbal > 0 AS a, c_nationkey <> 3 AS v, c_mktsegment <> 'BUILDING' AS h, c_custkey % 5 > 0 AS c FROM customer)")
def report_classes(spark, sf):
    a, v, h, c = F.col("c_acctbal") > 0, F.col("c_nationkey") != 3, F.col("c_mktsegment") != "BUILDING", F.col("c_custkey") % 5 > 0
    return _t(spark, sf, "customer").select("c_custkey", integrity.classify(a, v, h, c).alias("verdict"))


# ---- rollups


@_register("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM supplier) AS records, (SELECT max(o_orderkey) + 1 FROM orders) AS next_id, (SELECT count(*) FILTER (o_orderstatus = 'F') FROM orders) AS finished")
def archive_totals(spark, sf):
    counts = [_t(spark, sf, n).agg(F.count(F.lit(1)).alias("n")) for n in ("customer", "orders", "lineitem", "supplier")]
    total = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3]).agg(F.sum("n").alias("records"))
    return total.crossJoin(_t(spark, sf, "orders").agg((F.max("o_orderkey") + 1).alias("next_id"), F.count_if(F.col("o_orderstatus") == "F").alias("finished")))  # one row each


@_register("SELECT user_id, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors, count(*) AS events, round(sum(value), 2) AS total, arg_max(event_type, (ts, event_id)) AS latest FROM events GROUP BY 1")
def run_reports(spark, sf):
    return _t(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("total"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))


@_register("SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS predicted FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def latest_prediction(spark, sf):
    return _t(spark, sf, "orders").where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("predicted"))


@_register("SELECT c_mktsegment, c_nationkey, count(*) AS pages FROM customer GROUP BY 1, 2 ORDER BY lower(c_mktsegment), c_nationkey")
def collections_by_name(spark, sf):
    return _t(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("pages")).orderBy(F.lower("c_mktsegment"), "c_nationkey")


# ---- changes with rules


@_register("""
SELECT s_suppkey AS c_custkey, s_name AS c_name, CASE WHEN c.c_custkey IS NULL THEN 'missing' WHEN c.c_mktsegment = 'BUILDING' THEN 'removed' WHEN EXISTS (SELECT 1 FROM customer d WHERE d.c_name = replace(s_name, 'Supplier', 'Customer') AND d.c_custkey <> s_suppkey) THEN 'taken' ELSE 'renamed' END AS outcome
FROM supplier LEFT JOIN customer c ON c.c_custkey = s_suppkey
""")
def rename_collections(spark, sf):
    state = _t(spark, sf, "customer").select("c_custkey", "c_name", (F.col("c_mktsegment") == "BUILDING").alias("gone"))
    wanted = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.regexp_replace("s_name", "Supplier", "Customer").alias("c_name"), F.col("s_name").alias("shown"))
    return ledger.rename(state, wanted, "c_custkey", "c_name", F.col("gone")).withColumnRenamed("shown", "c_name_shown").select("c_custkey", F.col("c_name_shown").alias("c_name"), "outcome")


@_register("""
SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'no page' WHEN o_orderkey <= head THEN CASE WHEN o_orderdate < seen THEN 'kept as history' ELSE 'conflict' END ELSE 'new head' END AS outcome
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT o_custkey AS k, max(o_orderkey) AS head, max(o_orderdate) AS seen FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON k = o_custkey WHERE o_orderstatus = 'P' AND head IS NOT NULL
""")
def capture_revisions(spark, sf):
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    heads = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("head"), F.max("o_orderdate").alias("at"))
    pages = _t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    rows = orders.where("o_orderstatus = 'P'").join(heads, "o_custkey").join(pages, "o_custkey", "left")
    return rows.select("o_orderkey", ledger.capture_outcome(F.col("known"), F.col("o_orderkey"), F.col("o_orderdate"), F.col("head"), F.col("at")).alias("outcome"))


@_register("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_linenumber < 4 THEN 'queued' WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'succeeded' ELSE 'running' END AS state, CASE WHEN l_returnflag = 'R' AND l_linenumber < 4 THEN l_linenumber + 1 ELSE l_linenumber END AS attempts FROM lineitem")
def settle_jobs(spark, sf):
    jobs = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    state, attempts = ledger.settle(F.when(F.col("l_returnflag") == "R", "retry").when(F.col("l_returnflag") == "A", "done"), F.col("l_linenumber"), 4)
    return jobs.select("l_orderkey", "l_linenumber", state.alias("state"), attempts.alias("attempts"))


# ---- search


def _leaf_sql(words: list[str], prefix: bool, column: str) -> str:
    tests = [f"{column}[i + {k}] = '{w}'" for k, w in enumerate(words)]
    if prefix:
        tests[-1] = f"starts_with({column}[i + {len(words) - 1}], '{words[-1]}')"
    return f"len(list_filter(range(1, len({column}) + 1), lambda i: coalesce({' AND '.join(tests)}, false)))"


def _search_sql(leaves: list[tuple[list[str], bool, str]], condition: str) -> str:
    """BM25 over phrases: ``leaves`` are (words, prefix, fields: b, t or bt), ``condition`` says which f0, f1 … must be."""
    f = ", ".join(" + ".join([_leaf_sql(w, p, "t") + " * 1.0"] * ("b" in where) + [_leaf_sql(w, p, "s") + " * 10.0"] * ("t" in where)) + f" AS f{k}" for k, (w, p, where) in enumerate(leaves))
    d = ", ".join(f"count(*) FILTER (f{k} > 0) AS d{k}" for k in range(len(leaves)))
    score = " ".join(f"- greatest(ln((n - d{k} + 0.5) / (d{k} + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / av))" for k in range(len(leaves)))
    words = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return f"""WITH d AS (SELECT doc_id, {words.format('text')} AS t, {words.format('source')} AS s FROM documents),
x AS (SELECT doc_id, len(t) + len(s) AS dl, {f} FROM d), g AS (SELECT count(*) AS n, avg(dl) AS av, {d} FROM x)
SELECT doc_id, round(0.0 {score}, 6) AS score FROM x, g WHERE {condition} ORDER BY score, doc_id LIMIT 50"""


_INDEXES: dict[tuple[str, str], str] = {}


def stored_index(spark: SparkSession, sf: str) -> search.Index:
    """The stored index of the documents, built once for a session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        path = f"{shared_folder(spark)}/palimpsest/search-{abs(hash(key)):x}"
        search.write_index(search.build_index(_t(spark, sf, "documents").select("doc_id", "text", "source"), "doc_id", {"text": "body", "source": "title"}), path)
        _INDEXES[key] = path
    return search.read_index(spark, _INDEXES[key])


def _search(spark: SparkSession, sf: str, query: str) -> DataFrame:
    return search.search(stored_index(spark, sf), query, 50).withColumnRenamed("ident", "doc_id")


@_register(_search_sql([(["license"], False, "bt"), (["copyright"], False, "bt"), (["this"], False, "bt")], "(f0 > 0 OR f1 > 0) AND NOT f2 > 0"))
def search_or_not(spark, sf):
    return _search(spark, sf, "(license OR copyright) NOT this")


@_register(_search_sql([(["under", "the"], False, "bt")], "f0 > 0"))
def search_phrase(spark, sf):
    return _search(spark, sf, '"under the"')


@_register(_search_sql([(["licen"], True, "bt"), (["src1"], True, "t")], "f0 > 0 AND f1 > 0"))
def search_prefix_and_field(spark, sf):
    return _search(spark, sf, "licen* AND title:src1*")


@_register(_search_sql([(["under", "th"], True, "b"), (["src3"], False, "bt")], "f0 > 0 OR f1 > 0"))
def search_phrase_prefix(spark, sf):
    return _search(spark, sf, 'body:"under th"* OR src3')


@_register(r"""
WITH d AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term, doc_id, 'body' AS field FROM documents UNION ALL SELECT unnest(list_filter(regexp_split_to_array(lower(source), '[^\p{L}\p{N}]+'), lambda x: x <> '')), doc_id, 'title' FROM documents)
SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM d GROUP BY 1
""")
def index_terms(spark, sf):
    return stored_index(spark, sf).postings.groupBy("term").agg(F.count_distinct("ident").alias("documents"), F.sum(F.size("positions")).alias("occurrences"))


def queries() -> dict[str, Query]:
    """Every query of this module, by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL, by query name."""
    return dict(_SQL)
