"""Objects and packs, exports, collections and the sync loop against small cases."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import collections, exports, objects
from palimpsest.plans import store
from palimpsest.streaming import reconcile


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_object_id(spark):
    texts = ["", "a", "é" * 300, None]
    want = [None if t is None else "o256:" + hashlib.sha256(b"palimpsest-object\x01" + len(t.encode()).to_bytes(8, "big") + t.encode()).hexdigest() for t in texts]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows(frame, objects.object_id(F.col("t")))] == want
    assert rows(frame.limit(1), objects.object_id(F.col("t"), 2))[0][0] != want[0]


def test_put(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "i string, k string, n long")
    new = spark.createDataFrame([("a", "x", 1), ("a", "x", 1), ("b", "y", 2), ("c", None, 3)], "i string, k string, n long")
    assert set(rows(objects.put(old, new, "i", "k", "n"), "i", "outcome")) == {("a", "existing"), ("b", "conflict"), ("c", "stored")}


def test_locations_and_packs(spark):
    copies = spark.createDataFrame([(1, None, 5, True), (1, 10, 6, True), (1, 11, 3, True), (2, None, 7, True), (2, None, 8, False), (3, 12, 9, True), (4, None, 1, True), (5, None, 2, True), (6, 11, 4, True)], "object long, pack long, location long, verified boolean")
    packs = spark.createDataFrame([(10, 1, True), (11, 2, True), (12, 3, False)], "pack long, generation int, verified boolean")
    usable = objects.usable_locations(copies, packs)
    assert set(rows(objects.best_location(usable), "object", "pack", "location", "copies")) == {(1, 11, 3, 3), (2, None, 7, 1), (4, None, 1, 1), (5, None, 2, 1), (6, 11, 4, 1)}
    sizes = spark.createDataFrame([(i, 10) for i in range(1, 7)], "object long, bytes long")
    assert rows(objects.next_pack(usable, sizes), "object") == [(4,), (5,), (2,)]
    assert rows(objects.next_pack(usable, sizes, most=2), "object") == [(4,), (5,)]
    assert rows(objects.next_pack(usable, sizes, budget=10), "object") == [(4,)]
    assert rows(objects.next_pack(usable, sizes, budget=9), "object") == []
    assert set(rows(objects.prunable(usable), "object", "state")) == {(1, "obsolete"), (2, "verified"), (4, "verified"), (5, "verified")}
    assert set(rows(objects.retirement(usable), "pack", "objects", "may_go")) == {(10, 1, True), (11, 2, False)}


def test_delta_round_trip():
    rng = random.Random(3)
    for _ in range(500):
        a, b = (bytes(rng.choices(b"ab", k=rng.randrange(12))) for _ in "ab")
        delta = objects.make_delta(a, b)
        assert objects.restore(a, delta, len(b)) == b
        start, end = objects.shared_ends(a, b)
        assert a[:start] == b[:start] and (start == min(len(a), len(b)) or a[start] != b[start])
        assert start + end <= min(len(a), len(b)) and a[len(a) - end :] == b[len(b) - end :]
    with pytest.raises(ValueError, match="short"):
        objects.restore(b"", b"123", 0)
    with pytest.raises(ValueError, match="exceeds"):
        objects.restore(b"ab", objects.make_delta(b"abcd", b"abcde"), 5)
    with pytest.raises(ValueError, match="expected"):
        objects.restore(b"abcd", objects.make_delta(b"abcd", b"abcde"), 4)


def test_packs(spark):
    rng = random.Random(5)
    base = rng.randbytes(4000).hex()
    texts = [base[: 100 * k] + "edit" + base[100 * k :] for k in range(30)] + ["", None, rng.randbytes(500).hex()]
    frame = spark.createDataFrame([(k % 2, k, t) for k, t in enumerate(texts)], "pack long, ident long, content string")
    entries = objects.pack_entries(frame).cache()
    got = entries.collect()
    assert len(got) == len(texts) and max(e.depth for e in got) <= objects.MOST_DEPTH and sum(e.encoding == "delta" for e in got) > 20
    assert set(rows(objects.pack_report(entries), "objects", "restored", "sound")) == {(17, 17, True), (16, 16, True)}
    first = min((e for e in got if e.encoding == "delta"), key=lambda e: (e.pack, e.position))
    broken = entries.where((F.col("pack") != first.pack) | (F.col("ident") != first.base_ident))  # a base is lost: what hangs on it is not restored
    report = {r.pack: r for r in objects.pack_report(broken).collect()}
    assert not report[first.pack].sound and report[1 - first.pack].sound
    placed = objects.laid_out(entries)
    assert objects.layout_problems(placed).count() == 0
    assert objects.layout_problems(placed.withColumn("offset", F.col("offset") + (F.col("position") == 3).cast("int"))).count() == 4  # the moved entry and the one behind it, in each pack
    assert objects.pack_report(objects.pack_entries(frame.limit(0))).count() == 0
    entries.unpersist()


def test_verified_reads(spark):
    digest = hashlib.sha256(b"x").hexdigest()
    copies = spark.createDataFrame([(1, "y", 0, digest), (1, "x", 1, digest), (1, "x", 2, digest), (2, "y", 0, digest)], "i long, c string, n int, d string")
    assert set(rows(objects.read_verified(copies, "i", "d", "c", ["n"]), "i", "n", "bad_copies", "outcome")) == {(1, 1, 1, "read"), (2, None, 1, "corrupt")}


def test_export(spark, tmp_path):
    pages = spark.createDataFrame([(2, 7, "A b"), (1, 7, "a  B"), (3, 7, "a-b"), (1, 8, "é")], "w long, p long, t string")
    assert set(rows(exports.with_paths(pages, "w", "p", "t", "md"), "w", "relative_path")) == {(1, "articles/7-a-b.md"), (2, "articles/7-a-b-wiki-2.md"), (3, "articles/7-a-b-wiki-3.md"), (1, "articles/8-article.md")}
    article = ("en", 1, "https://e.org/api.php?x", "T [1] \"q\"", 5, "2024-01-01T00:00:00Z", 9, 99, None, "s256:0", "articles/5-t.md", "body")
    frame = spark.createDataFrame([article], "wiki string, wiki_id int, endpoint string, title string, page_id long, revision_time string, revision_id long, captured_at long, author string, content_hash string, relative_path string, body string")
    frame = frame.withColumn("record", exports.metadata("markdown", "m/1"))
    line, md, plain = rows(frame, exports.index_line(F.col("record")), exports.markdown_file(F.col("record"), F.col("body")), exports.text_file(F.col("record"), F.col("body")))[0]
    record = json.loads(line)
    assert list(record) == sorted(record) and len(record) == 15 and record["author"] is None and record["source_url"] == "https://e.org/index.php?title=T%20%5B1%5D%20%22q%22&oldid=9"
    head, _, rest = md[4:].partition("---\n\n")
    front = dict(x.split(": ", 1) for x in head.splitlines())
    assert tuple(front) == exports.FRONT and json.loads(front["title"]) == article[3] and front["page_id"] == "5"
    assert rest.startswith("body\n\n## Source and attribution\n\nSource: [T \\[1\\] ") and "Revision author: not available.\n\n" in rest
    assert plain.startswith('Title: T [1] "q"\nWiki: en (local ID 1)\nPage ID: 5\n') and "\n\nbody\n\nSOURCE AND ATTRIBUTION\n" in plain and plain.endswith(exports.NOTICE)
    made = exports.summary(spark.createDataFrame([(1, 5, 9), (None, 7, None)], "r long, n long, c long"), "r", "n", "c")
    assert tuple(made.first()) == (1, 1, 5, 9, None)
    out = str(tmp_path / "export")
    files = frame.select("relative_path", F.lit(md).alias("content"), F.lit(line).alias("line"))
    exports.write_export(files, out, made)
    assert spark.read.text(f"{out}/index").first()[0] == line and spark.read.json(f"{out}/manifest").first()["article_count"] == 1 and spark.read.parquet(f"{out}/articles").count() == 1
    with pytest.raises(ValueError, match="too many bytes"):
        exports.write_export(files, out, exports.summary(spark.createDataFrame([(1, 1 << 40, 9)], "r long, n long, c long"), "r", "n", "c"))


def test_members(spark):
    current = spark.createDataFrame([("a", 1, True, 10), ("a", 2, False, 11), ("k", 1, True, 10), ("k", 2, True, 12), ("o", 1, True, 10), ("x", 1, True, 1)], "g string, p long, active boolean, first_at long")
    incoming = spark.createDataFrame([("a", 2, 20), ("a", 3, 20), ("k", 3, 20), ("o", 2, 20), ("o", 3, 20), ("n", 9, 20), ("x", 2, 5)], "g string, p long, at long")
    budgets = spark.createDataFrame([("a", 2, False), ("k", 2, True), ("o", 1, False), ("n", None, False)], "g string, most long, keep boolean")
    got = set(rows(collections.commit_members(current, incoming, budgets, "g", "p"), "g", "p", "state", "first_at", "verdict"))
    assert got == {
        ("a", 1, "removed", 10, "committed"), ("a", 2, "active", 11, "committed"), ("a", 3, "active", 20, "committed"),
        ("k", 1, "active", 10, "members over budget"), ("k", 2, "active", 12, "members over budget"),
        ("o", 1, "active", 10, "incoming over budget"), ("n", 9, "active", 20, "committed"), ("x", 1, "active", 1, "not configured"),
    }


def test_collections_and_heads(spark):
    state = spark.createDataFrame([(1, "a", False), (1, "b", True)], "w int, n string, gone boolean")
    wanted = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "w int, n string")
    assert set(rows(collections.create_or_reopen(state, wanted, ["w", "n"], "gone"), "w", "n", "outcome")) == {(1, "a", "existing"), (1, "b", "reopened"), (2, "a", "created")}
    cases = [("titles", None, None, "titles", "X", None, None), ("titles", None, None, "category", "X", 1, "other kind"), ("category", "X", 2, "category", "X", 2, None), ("category", "X", 2, "category", "X", 3, "too deep"), ("category", "X", 2, "category", "Y", 1, "other category"), ("category", "X", 2, "category", "X", None, "too deep"), (None, None, None, "titles", "X", None, "other kind")]
    frame = spark.createDataFrame(cases, "a string, b string, c int, d string, e string, f int, want string")
    assert all(a == b for a, b in rows(frame, collections.reason_problem(*map(F.col, "abcdef")), "want"))
    rules = spark.createDataFrame([("titles", None, None, "titles"), ("titles", "x", None, None), ("category", "x", 0, "category:x/0"), ("category", "x", None, None), ("category", None, 1, None), ("category", "x", -1, None), ("?", None, None, None)], "k string, t string, d int, want string")
    assert all(a == b for a, b in rows(rules, collections.stored_rule(F.col("k"), F.col("t"), F.col("d")), "want"))
    pages = spark.createDataFrame([(1, 5, True, False), (2, 5, False, True), (3, None, False, False)], "p long, head_at long, missing boolean, removed boolean")
    captured = spark.createDataFrame([(1, 5), (1, 4), (2, 9), (3, 1), (4, 1)], "p long, at long")
    assert set(rows(collections.capture_heads(pages, captured, "p"), "p", "at", "outcome", "reactivated")) == {(1, 5, "moved", True), (1, 4, "older", True), (2, 9, "refused", False), (3, 1, "moved", False), (4, 1, "created", False)}
    known = spark.createDataFrame([(1, 10), (2, 20)], "p long, r long")
    asked = spark.createDataFrame([(1, 10), (1, 20), (1, 30)], "p long, r long")
    assert set(rows(collections.set_heads(known, asked, "p", "r"), "r", "outcome")) == {(10, "set"), (20, "other page"), (30, "not captured")}
    seen = collections.title_history(spark.createDataFrame([(1, "old", 1), (1, "new", 2), (1, "old", 0), (2, "new", 5)], "p long, t string, at long"), ["p"], "t", "at")
    assert set(rows(collections.pages_by_any_title(seen, spark.createDataFrame([("old",), ("old",)], "t string"), ["p"], "t"), "p", "t", "current_title")) == {(1, "old", "new")}


def test_runs_and_jobs(spark):
    schema = "w long, c long, run long, running boolean, low long, high long"
    runs = spark.createDataFrame([(1, None, 7, True, 10, 20), (1, None, 5, True, 1, 2), (1, 2, 8, False, 0, 9)], schema)
    marks = spark.createDataFrame([(1, 2, 1000), (1, 3, 100)], "w long, c long, through long")
    offered = spark.createDataFrame([(1, None, 50), (1, 2, 2000), (1, 3, 150), (2, None, 9)], "w long, c long, candidate long")
    got = set(rows(reconcile.start_or_resume(runs, offered, marks, ["w", "c"], 300), "w", "c", "outcome", "run", "low", "high"))
    assert got == {(1, None, "resumed", 5, 1, 2), (1, 2, "started", None, 700, 2000), (1, 3, "started", None, 0, 150), (2, None, "started", None, 0, 9)}
    queue = spark.createDataFrame([(1, "a"), (2, "a"), (5, None)], "k long, v string")
    offered = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (4, "c"), (4, "d"), (5, None)], "k long, v string")
    assert set(rows(reconcile.enqueue_checked(queue, offered, ["k"], "v"), "k", "outcome")) == {(1, "existing"), (2, "conflict"), (3, "queued"), (4, "conflict"), (5, "existing")}
    steps = [("running", "complete", "succeeded"), ("queued", "complete", None), ("running", "retry", "retryable"), ("retryable", "cancel", "cancelled"), ("succeeded", "cancel", None), ("failed", "fail", None)]
    frame = spark.createDataFrame(steps, "s string, e string, want string")
    assert all(a == b for a, b in rows(frame, reconcile.job_outcome(F.col("s"), F.col("e")), "want"))
    collection = spark.createDataFrame([(1,), (2,), (3,), (4,)], "c long")
    log = spark.createDataFrame([(1, "succeeded"), (1, "running"), (2, "succeeded"), (3, "failed")], "c long, state string")
    assert set(rows(reconcile.next_steps(collection, log, "c"), "c", "step")) == {(1, "resume"), (2, "reconcile"), (3, "bootstrap"), (4, "bootstrap")}


def test_forward_gaps(spark):
    tips = spark.createDataFrame([(1, 1, 4), (2, 5, 5), (3, 10, 12), (4, 20, 22), (5, 30, 33), (6, 40, 41), (7, 50, 54)], "p long, tip long, head long")
    listed = [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (3, 11, 10), (3, 12, 11), (4, 20, 19), (4, 21, 19), (4, 22, 21), (5, 30, 29), (5, 31, 30), (7, 50, 49), (7, 51, 50), (7, 52, 51), (7, 53, 52), (7, 54, 53)]
    frame = spark.createDataFrame(listed, "p long, revision long, parent long")
    known = spark.createDataFrame([(1,), (3,), (3,), (51,)], "revision long")
    got = {p: (v, n, r) for p, v, n, r in rows(reconcile.forward_gaps(tips, frame, "p", known, 3), "p", "verdict", "enumerated", "reused")}
    assert got == {1: ("connected", 3, 1), 2: ("same head", 0, 0), 3: ("identity changed", 2, 0), 4: ("disconnected", 2, 0), 5: ("head not reached", 1, 0), 6: ("identity changed", 0, 0), 7: ("over the limit", 4, 1)}


def test_rendered_files_hold_the_rendered_body(spark, sf):
    first = store.queries()["export_rendered_files"](spark, sf).first()
    assert first["content"].startswith("---\nwiki: ") and "## Source and attribution" in first["content"] and first["relative_path"].startswith("articles/")


def test_base36(spark):
    texts = [f"t{k}" for k in range(2000)] + ["", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, got in rows(frame, "t", text.base36_sha1(F.col("t"))):
        if t is None:
            assert got is None
        else:
            assert len(got) == 31 and int(got, 36) == int(hashlib.sha1(t.encode()).hexdigest(), 16)
