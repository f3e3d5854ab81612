"""Lookups, budgets, instants, manifests, integrity and search against small cases."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import times
from palimpsest.operators import integrity, ledger, manifests, resolve, search, sets


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_exactly_one(spark):
    pages = spark.createDataFrame([(1, "a", "en"), (2, "b", "en"), (3, "b", "de"), (4, None, "en")], "id long, title string, wiki string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "title string")
    assert set(rows(resolve.exactly_one(asked, pages, "title", "id", "wiki"), "title", "outcome", "id", "wiki")) == {("a", "found", 1, "en"), ("b", "ambiguous", None, None), ("c", "missing", None, None)}
    asked = spark.createDataFrame([("b", "de"), ("b", None), ("a", "de")], "title string, w string")
    assert set(rows(resolve.exactly_one(asked, pages, "title", "id", "wiki", "w"), "title", "w", "outcome", "id")) == {("b", "de", "found", 3), ("b", None, "ambiguous", None), ("a", "de", "missing", None)}


def test_budgets_and_rules(spark):
    cases = [(None, 5, None, "fits"), (None, 9, 8, "exceeded"), (None, 5, 8, "unknown"), (7, 5, 8, "fits"), (9, 5, 8, "exceeded"), (3, 8, 8, "fits")]
    frame = spark.createDataFrame(cases, "p long, c long, b long, want string")
    assert all(a == b for a, b in rows(frame, resolve.budget_verdict(F.col("p"), F.col("c"), F.col("b")), "want"))
    assert rows(spark.range(1), resolve.permits(F.lit(3), F.lit(9), F.lit(3), F.lit(None).cast("int")), resolve.permits(F.lit(4), F.lit(9), F.lit(3), F.lit(9)))[0] == (True, False)
    plans = [("manual", None, 0, None, None), ("manual", None, 0, 5, "manual with jitter or next run"), ("interval", 59, 0, 5, "interval out of range"), ("interval", None, 0, 5, "interval out of range"), ("interval", 60, 61, 5, "jitter above interval"), ("interval", 60, 60, 5, None), ("daily", None, 86_401, 5, "jitter above a day"), ("weekly", None, 0, None, "no next run")]
    frame = spark.createDataFrame(plans, "c string, e long, j long, n long, want string")
    assert all(a == b for a, b in rows(frame, resolve.schedule_problem(*map(F.col, "cejn")), "want"))
    members = spark.createDataFrame([(1, 1, "a", 5), (1, 1, "b", 5), (1, 2, "b", 5), (2, 3, "c", 1)], "g long, p long, t string, b long")
    assert set(rows(resolve.preview_problems(members, "g", "p", "t", "b", 2, 14), "g", "problem")) == {(1, "repeated page"), (1, "repeated title"), (1, "page budget"), (1, "byte budget")}
    assert rows(resolve.broken_rows(members, "p", {"b": F.col("b") > 2, "t": F.col("t") != "z"}), "p", "rule") == [(3, "b")]


def test_instants(spark):
    texts = ["2024-02-29T23:59:59Z", "2023-02-30T00:00:60Z", "1969-12-31T00:00:00Z", "2023-13-01T00:00:00Z", "2023-01-32T00:00:00Z", "x2023-01-01T00:00:00Z", "2023-01-01T24:00:00Z", None, "0001-01-01T00:00:00Z"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    base = dt.datetime(1970, 1, 1)
    day = lambda *a: int((dt.datetime(*a) - base).total_seconds())
    assert [r[0] for r in rows(frame, times.lenient_epoch(F.col("t")))] == [day(2024, 2, 29, 23, 59, 59), day(2023, 3, 2) + 60, -86_400, None, None, None, None, None, day(1, 1, 1)]
    cases = {"2024-01-02T03:04:05.5+05:30": (day(2024, 1, 1, 21, 34, 5), 500_000_000), "2023-02-29T00:00:00Z": None, "2024-02-29T00:00:00.123456789-00:01": (day(2024, 2, 29, 0, 1), 123_456_789), "2024-01-01t00:00:00z": (day(2024, 1, 1), 0), "2024-01-01T00:00:60Z": None, "2024-01-01T00:00:00": None, "2024-01-01T00:00:00.Z": None, "2024-01-01T00:00:00+24:00": None}
    frame = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {t: None if x is None else tuple(x) for t, x in rows(frame, "t", times.rfc3339(F.col("t")))}
    assert got == cases
    frame = spark.createDataFrame([("123",), ("0",), ("2024-01-01T00:00:00Z",), ("12a",), ("99999999999999999999",)], "t string")
    assert [None if r[0] is None else tuple(r[0]) for r in rows(frame, times.cutoff(F.col("t")))] == [(123, None, None), None, (None, day(2024, 1, 1), 0), None, None]
    numbers = spark.createDataFrame([(0,), (253_402_300_799,), (253_402_300_800,), (-62_135_596_800,)], "s long")
    assert [r[0] for r in rows(numbers, times.canonical(F.col("s")))] == ["1970-01-01T00:00:00Z", "9999-12-31T23:59:59Z", None, "0001-01-01T00:00:00Z"]


def test_manifest_log(spark):
    rng = random.Random(1)
    captured = [(r, "s", dt.datetime(2024, 1, 1 + r % 28), rng.randrange(9), k, f"o{k}") for k, r in enumerate([5, 9, 5, 40, 9, 7])]
    frame = spark.createDataFrame(captured, "run long, scope string, t timestamp, page long, rev long, obj string")
    made = manifests.run_manifests(frame, "run", "scope", "t", "page", "rev", "obj")
    bodies = dict(rows(made, "run", "body"))
    for r, body in bodies.items():
        one = json.loads(body)
        assert list(one) == ["version", "run", "scope", "completed", "revisions"] and one["run"] == r and json.dumps(one, separators=(",", ":")) == body
        assert one["revisions"] == sorted(one["revisions"], key=lambda x: (x["page"], x["revision"]))
    odd = spark.createDataFrame([(b, ok) for body in bodies.values() for b, ok in ((body, True), (body + " ", False), (body.replace('"version":1', '"version":2'), False), (body.replace('{"page"', '{"x":1,"page"'), False))] + [("nonsense", False), (None, False)], "b string, ok boolean")
    assert all(a == b for a, b in rows(odd, manifests.is_canonical(F.col("b")), "ok"))
    log = spark.createDataFrame([], "sequence long, run long, manifest_id string, previous_id string")
    first = manifests.append(log, made.where("run < 9"), "run").cache()
    again = manifests.append(first, made, "run")
    got = sorted(rows(again, "sequence", "run", "manifest_id", "previous_id"))
    assert [g[:2] for g in got] == [(1, 5), (2, 7), (3, 9), (4, 40)] and [g[3] for g in got] == [None, *[g[2] for g in got[:-1]]]
    assert manifests.append(again, made, "run").count() == 4
    names = spark.createDataFrame([("000000000012.json",), ("12.json",), ("000000000000.json",), ("000000000012.jsonx",)], "n string")
    assert [r[0] for r in rows(names, manifests.sequence_of(F.col("n")))] == [12, None, None, None]


def test_dangling_references(spark):
    orders = spark.createDataFrame([(1, 7), (2, 8), (3, None), (4, 14)], "o long, c long")
    pages = spark.createDataFrame([(7,), (5,)], "c long")
    assert set(rows(sets.missing_references(orders, "c", pages, "c", "k", "o"), "kind", "ident")) == {("k", 2), ("k", 4)}
    refs = [integrity.Reference("a", "orders", ("c",), "pages", ("c",), "o"), integrity.Reference("b", "pages", ("c",), "orders", ("c",), "c"), integrity.Reference("n", "orders", ("c",), "pages", ("c",), "o", "o > 2")]
    found = integrity.reference_findings({"orders": orders, "pages": pages}, refs)
    assert set(rows(found, "problem", "ident")) == {("a", 2), ("a", 4), ("b", 5), ("n", 4)}
    many = spark.range(50).select(F.lit("p").alias("problem"), F.col("id").alias("ident"))
    report = rows(integrity.report(many, 10, 50, 3), "problem", "findings", "first", "coverage")
    assert report == [("p", 50, [0, 1, 2], "partial")]
    stored = spark.createDataFrame([(1, "ab", 2, "fb8e20fc2e4c3f248c60c39bd652f3c1347298bb977b8b4d5903b85055620603"), (2, None, 2, "x"), (3, "ab", 3, "x"), (4, "ab", 2, "x")], "i long, t string, n long, d string")
    assert set(rows(integrity.object_findings(stored, "i", "t", "d", "n"), "ident", "problem")) == {(2, "object missing"), (3, "object size"), (4, "object digest")}
    assert integrity.self_references(spark.createDataFrame([(1, 1), (2, 1)], "i long, p long"), "i", "p", "x").count() == 1
    nations = spark.createDataFrame([(k,) for k in range(4)], "n int")
    assert sorted(rows(ledger.removable(nations, "n", [nations.where("n = 1"), nations.where("n = 3")]), "n")) == [(0,), (2,)]


DOCS = [(1, "Rust is a memory-safe systems language", "Rust"), (2, "A memory unsafe language; systems", "C language"), (3, "Safe memory handling", "Rust guide"), (4, "nothing here", "Ruby")]


def plain_matches(test):
    return {i for i, body, title in DOCS if test([w for w in re.split(r"[\W_]+", body.lower()) if w], [w for w in re.split(r"[\W_]+", title.lower()) if w])}


@pytest.mark.parametrize(
    "query,test",
    [
        ("memory language", lambda b, t: {"memory", "language"} <= {*b, *t}),
        ("memory AND NOT_", lambda b, t: False),
        ("rust OR nothing", lambda b, t: "rust" in b + t or "nothing" in b + t),
        ("memory NOT systems", lambda b, t: "memory" in b + t and "systems" not in b + t),
        ('"memory safe"', lambda b, t: any(b[k : k + 2] == ["memory", "safe"] for k in range(len(b)))),
        ("memory-safe", lambda b, t: any(b[k : k + 2] == ["memory", "safe"] for k in range(len(b)))),
        ("ru*", lambda b, t: any(w.startswith("ru") for w in b + t)),
        ("title:language", lambda b, t: "language" in t),
        ("{title body}:(guide OR unsafe)", lambda b, t: "guide" in b + t or "unsafe" in b + t),
        ('body:"systems lang"*', lambda b, t: any(b[k] == "systems" and b[k + 1].startswith("lang") for k in range(len(b) - 1))),
        ("(rust OR ruby) NOT (guide OR memory)", lambda b, t: ("rust" in b + t or "ruby" in b + t) and not ("guide" in b + t or "memory" in b + t)),
    ],
)
def test_search_grammar(spark, query, test):
    docs = spark.createDataFrame(DOCS, "id long, body string, title string")
    index = search.build_index(docs, "id", {"body": "body", "title": "title"})
    assert {r[0] for r in rows(search.search(index, query), "ident")} == plain_matches(test)


def test_index_is_kept_current(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "id long, body string, title string")
    fields = {"body": "body", "title": "title"}
    search.write_index(search.build_index(docs, "id", fields, docs.where("id < 4")), str(tmp_path / "a"))
    index = search.read_index(spark, str(tmp_path / "a"))
    assert search.search(index, "nothing").count() == 0 and rows(search.search(index, "guide"), "ident") == [(3,)]
    index = search.replace_documents(index, spark.createDataFrame([(3, "other text", "Rust page")], docs.schema), "id", fields)
    assert search.search(index, "guide").count() == 0 and rows(search.search(index, "other"), "ident") == [(3,)]
    title_first = [r[0] for r in rows(search.search(index, "rust"), "ident")]
    assert set(title_first) == {1, 3}
    for bad in ("", "AND", "a AND", "(a", "a)", "x:y", '"', "!!!"):
        with pytest.raises(search.QueryError):
            search.parse(bad)
    with pytest.raises(ValueError):
        search.build_index(docs, "id", {"body": "nowhere"})
