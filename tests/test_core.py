"""The engine's queries against DuckDB, and operators against small cases."""

import json
import os
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import schedule, text, wikitext
from palimpsest.operators import diff, graph, history, ledger, search, sets
from palimpsest.plans import catalog
from palimpsest.sources import records
from palimpsest.streaming import sync


def _norm(row):
    return tuple(round(v, 5) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in row)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(_norm(r) for r in df.select(*cols).collect())
    if name not in catalog.oracle_sql():
        assert got
        return
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as from '{sf}/{f}'")
    r = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == Counter(_norm([row[names.index(c)] for c in cols]) for row in r.fetchall())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_edit_script_is_shortest(a, b):
    script = diff.edit_script(a, b)
    assert [a[i] for t, i, _ in script if t != "insert"] == a and [b[j] for t, _, j in script if t != "delete"] == b
    assert all(a[i] == b[j] for t, i, j in script if t == "equal")
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    assert sum(t == "equal" for t, _, _ in script) == row[-1]


@settings(max_examples=100, deadline=None)
@given(st.text("ab \n", max_size=30), st.text("ab \n", max_size=30))
def test_diff_spans_give_back_the_lines(a, b):
    lines = diff.diff_lines(a, b)
    old = [x for x in lines if x["old_line"]]
    new = [x for x in lines if x["new_line"]]
    assert "\n".join("".join(s["text"] for s in x["spans"]) for x in old) == a
    assert "\n".join("".join(s["text"] for s in x["spans"]) for x in new) == b
    assert [x["old_line"] for x in old] == list(range(1, len(old) + 1))


def test_word_refinement():
    lines = diff.diff_lines("the old word\nsame", "the new word\nsame\nmore")
    assert [(x["tag"], x["old_line"], x["new_line"]) for x in lines] == [("delete", 1, None), ("insert", None, 1), ("equal", 2, 2), ("insert", None, 3)]
    assert [s["tag"] for s in lines[0]["spans"]] == ["equal", "delete", "equal"] and lines[1]["spans"][1] == {"tag": "insert", "text": "new"}


WIKI = """<!-- not shown
at all -->
== Tea ==
'''Tea''' is a [[hot drink]] &amp; a habit.
It {{small|really}} is {{Odd box
| a = [[b|c]]
}}.

=== Kinds ===
* Green
** [[Oolong (tea)|Oolong]]
# Boil
; Cup
: Said ''softly''.<ref name="x">See [https://a.test/b the book].</ref><ref name="x"/>

{| class="wikitable"
|+ Harvest
! Month !! Kind
|-
| align="left" | May || Green
|-
| June || [[Oolong (tea)|oolong]]
|}

 kept  as it is

[[File:Cup.jpg|thumb|120px|A ''cup'']]
[[Category:Drinks]]
----
More: [https://a.test Tea site], <code>a  b</code>, <nowiki>[[raw]]</nowiki>, {{frac|1|2|3}}, {{convert|5|km|mi|2}}, {{lang|fr|thé}}.<br>__NOTOC__
"""
PLAIN = """Tea

Tea is a hot drink & a habit. It really is [Template: Odd box].

Kinds

- Green
  - Oolong
1. Boil
- Cup
Said softly. [ref: See the book (https://a.test/b).]

Table: Harvest
Month | Kind
May | Green
June | oolong

    kept  as it is

[Image: A cup]
────────
More: Tea site (https://a.test), a b, [[raw]], 1 2/3, 5 km mi, thé.
"""
MARKDOWN = """## Tea

**Tea** is a [hot drink](hot_drink) & a habit. It really is `[Template: Odd box]`.

### Kinds

- Green
  - [Oolong](Oolong_%28tea%29)
1. Boil
- **Cup**
> Said *softly*. [ref: See [the book](https://a.test/b).]

*Table: Harvest*
| Month | Kind |
| --- | --- |
| May | Green |
| June | [oolong](Oolong_%28tea%29) |

    kept  as it is

*Image: A *cup**
---
More: [Tea site](https://a.test), `a b`, \\[\\[raw\\]\\], 1 2/3, 5 km mi, thé.
"""


def test_wikitext():
    render = wikitext.render_wikitext
    assert render(WIKI) == render(WIKI.replace("\n", "\r\n")) == PLAIN and render(WIKI, True) == MARKDOWN
    assert render(None) is None and render("") == render(" \r\n\t") == render("<!-- only -->", True) == render("<!-- open") == ""
    odd = "one [[two {{three|four <ref>five"
    assert render(odd) == "one [[two {{three|four five\n" and render(odd, True) == "one \\[\\[two {{three|four five\n"
    assert wikitext.search_headings("== [[A|B]] ==\nx\n=== C ===\n= D =\n==E=") == "B\nC\n"
    assert render("one\r\ntwo\r\n\r\nthree") == "one two\n\nthree\n" and render("[[A|b {{small|c}} d]]") == "b c d\n"
    assert "x" in render("{{small|" * 40 + "x" + "}}" * 40) and render("{{!}} {{=}} {{ }} &#65;&#x42;&zz; &nbsp;") == "| = [Template: unnamed] AB&zz;\n"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab[]{}|'<>/&;=*#:-_! \nhtp", max_size=80))
def test_wikitext_never_fails(source):
    for markdown in (False, True):
        out = wikitext.render_wikitext(source, markdown)
        assert out == "" or (out.endswith("\n") and not out.endswith("\n\n"))


def test_traversal_bounds(spark):
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(20)] + [("n3", "n0")], "parent string, child string")
    roots = spark.createDataFrame([("n0",)], "node string")
    assert {tuple(r) for r in graph.category_bfs(chain, roots, 16).collect()} == {(f"n{k}", k) for k in range(17)}
    with pytest.raises(graph.TraversalLimit):
        graph.category_bfs(chain, roots, 16, max_nodes=5)


def test_budget_cut_in_slices(spark):
    rows = [(s, k, (k * 7) % 13) for s in "abc" for k in range(0, 400, 1 + "abc".index(s))]
    frame = spark.createDataFrame(rows, "s string, k long, n long")
    want = set()
    for s in "abc":
        total = 0
        for x, k, n in rows:
            if x == s:
                total += n
                if total <= 500:
                    want.add((s, k, n, total))
    for slices in (1, 7, 256):
        assert {tuple(r) for r in history.budget_cut(frame, "s", "k", "n", 500, slices).select("s", "k", "n", "running").collect()} == want
    assert history.budget_cut(frame.limit(0), "s", "k", "n", 5).count() == 0


def test_text_functions(spark):
    row = spark.createDataFrame([("== A ==\nx\n=== B c ===\n",)], "s string").select(text.headings(F.col("s")), text.base36_sha1(F.lit("")), text.slug(F.lit("--Ab c!")), text.percent_encode(F.lit("a b/é")), text.excerpt(F.lit("\n  a \t b\nc"))).first()
    assert row[0] == ["A", "B c"] and row[1] == "phoiac9h4m842xq45sp7s6u21eteeq1" and row[2:] == ("ab-c", "a%20b%2F%C3%A9", "a b c")


def test_as_of_ties_and_bounds(spark):
    pages = spark.createDataFrame([(1,), (2,), (3,)], "p long")
    revs = spark.createDataFrame([(1, 5, "2020-01-01"), (1, 7, "2020-01-01"), (1, 6, "2020-01-02"), (2, 1, "2021-01-01")], "p long, r long, t string").withColumn("t", F.to_timestamp("t"))
    assert {tuple(r) for r in history.as_of(pages, revs, "p", "t", "r", "2020-01-01", ["r"]).collect()} == {(1, 7), (2, None), (3, None)}


def test_category_cycle_and_bounds(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "e")], "parent string, child string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in graph.category_bfs(edges, roots, 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    with pytest.raises(ValueError):
        graph.category_bfs(edges, roots, 17)


def test_membership_and_queue(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(2,), (3,), (3,)], "k long")
    assert {tuple(r) for r in sets.merge_membership(a, b, "k").collect()} == {(1, "removed", "removed"), (2, "active", "kept"), (3, "active", "added")}
    assert sets.merge_membership(a, b, "k", keep_removed=False).count() == 2
    queue = sync.enqueue(a, b, ["k"])
    assert sorted(r[0] for r in queue.collect()) == [1, 2, 3] and sync.enqueue(queue, b, ["k"]).count() == 3


def test_reference_findings_of_whole_tables(spark, tmp_path):
    spark.createDataFrame([(1,), (5,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, 1), (2, 14), (3, None), (11, 5)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1,), (11,), (77,), (77,)], "l_orderkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = catalog.queries()["reference_findings"](spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in found) == Counter([("order-customer", 2), ("line-order", 77), ("line-order", 77)])


def test_removable_sources_of_whole_tables(spark, tmp_path):
    spark.createDataFrame([(k, f"N{k}") for k in range(5)], "n_nationkey long, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(1, 0), (20, 1), (21, None)], "c_custkey long, c_nationkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, 0), (8, 2)], "s_suppkey long, s_nationkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    assert {tuple(r) for r in catalog.queries()["removable_sources"](spark, str(tmp_path)).collect()} == {(3, "N3"), (4, "N4")}


def test_search_needs_every_term(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta", "x"), (2, "alpha gamma", "beta"), (3, "alpha", "alpha"), (4, None, None)], "id long, body string, title string")
    hits = [r[0] for r in search.bm25(docs, "id", {"body": "body", "title": "title"}, "alpha AND beta").collect()]
    assert sorted(hits) == [1, 2] and search.bm25(docs, "id", {"body": "body"}, "absent").count() == 0


def test_schedule(spark):
    from palimpsest.functions.schedule import Cadence

    def at(cadence, *times):
        return [spark.range(1).select(schedule.next_nominal(cadence, F.lit(t))).first()[0] for t in times]

    assert at(Cadence.interval(60), 0, 59, 60) == [60, 60, 120] and at(Cadence.daily(3600), 0, 3600, 86_399) == [3600, 90_000, 90_000] and at(Cadence.manual(), 0) == [None]
    for wrong in (lambda: Cadence.interval(59), lambda: Cadence.daily(86_400)):
        with pytest.raises(ValueError):
            wrong()


def test_jitter_and_recovery(spark):
    from palimpsest.functions.schedule import Cadence

    word = (1 << 64) - 1

    def mix(v):
        v = (v + schedule.STEP) & word
        v = ((v ^ (v >> 30)) * schedule.FIRST) & word
        v = ((v ^ (v >> 27)) * schedule.SECOND) & word
        return v ^ (v >> 31)

    def plain(i, t, most):
        return mix(schedule.JITTER_DOMAIN ^ mix(i) ^ mix(((t << 29) | (t >> 35)) & word)) % (most + 1)

    def first_after(i, most, after):
        return min(x for n in range(0, after + 180, 60) if (x := n + plain(i, n, most)) > after)

    rows = [(i, t) for i in (0, 7, 2**40) for t in (0, 59, 60, 119, 1000)]
    df = spark.createDataFrame([*rows, (None, 5)], "i long, t long")
    every = Cadence.interval(60)
    got = {(r[0], r[1]): r[2:] for r in df.select("i", "t", schedule.jitter(F.col("i"), F.col("t"), 30), schedule.next_occurrence(every, F.col("i"), 500, F.col("t"))).collect()}
    assert all(got[i, t] == (plain(i, t, 30), first_after(i, 59, t)) for i, t in rows) and got[None, 5][0] is None
    due, following = schedule.recover(every, F.lit(3), 0, F.col("p"), F.lit(130))
    plans = spark.createDataFrame([(60,), (180,), (None,)], "p long").select("p", due, following).collect()
    assert [tuple(r) for r in plans] == [(60, 60, 180), (180, None, 180), (None, None, 180)]


def test_titles_and_timestamps(spark):
    cases = [(" A\u00a0", "A", False), ("\t", None, False), ("a\x01b", None, False), ("2024-02-29T23:59:59Z", "2024-02-29T23:59:59Z", True), ("2023-02-29T00:00:00Z", "2023-02-29T00:00:00Z", False), ("0000-01-01T00:00:00Z", "0000-01-01T00:00:00Z", False)]
    df = spark.createDataFrame([(c[0],) for c in cases], "s string")
    assert [tuple(r) for r in df.select("s", text.valid_title(F.col("s")), text.strict_timestamp(F.col("s"))).collect()] == cases
    row = spark.range(1).select(text.format_bytes(F.lit(1023)), text.format_bytes(F.lit(1280)), text.format_bytes(F.lit(1 << 50)), text.timestamp_name(F.lit(5), F.lit(0)), text.timestamp_name(F.lit(5), F.lit(7)), text.escape_markdown(F.lit("a[b]\\"))).first()
    assert tuple(row) == ("1023 B", "1.2 KiB", "1024.0 TiB", "at-time-unix-5", "at-time-unix-5-000000007", "a\\[b\\]\\\\")
    slugs = spark.createDataFrame([("",), ("\u212a!",), ("a" * 63 + " b",), ("a" * 70,)], "s string").select(text.slug(F.col("s"))).collect()
    assert [r[0] for r in slugs] == ["article", "article", "a" * 63 + "-", "a" * 64]


def test_ledger_conflicts(spark):
    state = spark.createDataFrame([(1, 5), (2, None)], "k long, v long")
    offered = spark.createDataFrame([(1, 5), (1, 6), (2, None), (3, 1)], "k long, v long")
    assert {(r.k, r.v, r.outcome) for r in ledger.insert_or_conflict(state, offered, "k", ["v"]).collect()} == {(1, 5, "existing"), (1, 6, "conflict"), (2, None, "existing"), (3, 1, "inserted")}
    assert {(r.k, r.outcome, r.actual) for r in ledger.compare_and_swap(state, offered, "k", "v").collect()} == {(1, "applied", 5), (1, "stale", 5), (2, "applied", None), (3, "missing", None)}
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k long, t string")
    assert ledger.cutoff_of(twice, "k", "t", 1).count() == 0 and ledger.library_state(twice.where("k > 1"), F.col("k") > 0, F.col("k") > 0).collect() == [("idle",)]


def test_conflicts_with_whole_state(spark, tmp_path):
    spark.createDataFrame([(1, 5), (3, 5), (6, 5)], "c_custkey long, c_nationkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, 5), (3, 5), (6, 7), (9, 5)], "s_suppkey long, s_nationkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    outcomes = lambda name: {r.c_custkey: r.outcome for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
    assert outcomes("compare_and_swap") == {1: "applied", 3: "applied", 6: "stale", 9: "missing"}
    assert outcomes("insert_or_conflict") == {1: "existing", 3: "existing", 6: "conflict", 9: "inserted"}


def test_payloads(spark, tmp_path):
    page = {"pageid": 7, "ns": 0, "title": "T", "revisions": [{"revid": 2, "parentid": 1, "timestamp": "2020-01-01T00:00:00Z", "comment": "c", "size": 3, "slots": {"main": {"content": "abc"}}}]}
    (tmp_path / "a.json").write_text(json.dumps({"query": {"pages": [page, {"title": "U", "missing": True}]}}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"error": {"code": "maxlag", "info": "wait"}}))
    payloads = records.read_payloads(spark, str(tmp_path))
    assert records.revisions_of(payloads).select("page_id", "revision_id", "content").collect() == [(7, 2, "abc")]
    assert {tuple(r) for r in records.resolutions(payloads).collect()} == {("T", 7, True), ("U", None, False)} and records.rejects(payloads).collect() == [("maxlag", "wait")]


def test_title_list(spark, tmp_path):
    (tmp_path / "t.txt").write_text("﻿B\n\n A \nB\n")
    assert [r[0] for r in records.title_list(spark, str(tmp_path)).collect()] == ["A", "B"]
    with pytest.raises(ValueError):
        records.title_list(spark, str(tmp_path), limit=1)


def test_manifest_chain(spark):
    ident = lambda s: spark.range(1).select(text.content_id(F.lit(s))).first()[0]
    rows = [(1, None, "a"), (2, ident("a"), "b"), (3, ident("x"), "c"), (5, ident("d"), "e")]
    found = records.chain_manifests(spark.createDataFrame(rows, "sequence long, previous_id string, body string"))
    assert {tuple(r) for r in found.collect()} == {(3, "broken link"), (5, "gap")}


def test_file_stream_is_idempotent(spark, tmp_path):
    rows = spark.range(20).selectExpr("id % 10 as revision_id", "timestamp_seconds(1700000000 + id % 10) as t", "id % 2 as page_id")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = sync.stream_revisions(spark, str(tmp_path / "in"), "revision_id long, t timestamp, page_id long", "t", ["revision_id"])
        sync.run_available(stream, str(tmp_path / "checkpoint"), sync.parquet_commit(str(tmp_path / "out")))
    assert sorted(r.revision_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(10))
