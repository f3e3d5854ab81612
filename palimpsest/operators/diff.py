"""Line and word differences of revisions."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

_SPAN = StructType([StructField("tag", StringType()), StructField("text", StringType())])
LINE_SCHEMA = ArrayType(StructType([StructField("tag", StringType()), StructField("old_line", IntegerType()), StructField("new_line", IntegerType()), StructField("spans", ArrayType(_SPAN))]))


def _common(x: Sequence, y: Sequence) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, by greedy search over furthest-reaching paths."""
    reach, trace = {1: 0}, []
    n, m = len(x), len(y)
    for d in range(n + m + 1):
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            i = reach[k + 1] if k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)) else reach[k - 1] + 1
            while i < n and i - k < m and x[i] == y[i - k]:
                i += 1
            reach[k] = i
            if i >= n and i - k >= m:
                break
        else:
            continue
        break
    pairs, i, j = [], n, m
    for d in range(len(trace) - 1, 0, -1):
        old, k = trace[d], i - j
        down = k == -d or (k != d and old.get(k - 1, -1) < old.get(k + 1, -1))
        pi = old[k + 1] if down else old[k - 1]
        pj = pi - (k + 1 if down else k - 1)
        while i > (pi if down else pi + 1):
            i, j = i - 1, j - 1
            pairs.append((i, j))
        i, j = pi, pj
    while i > 0:
        i, j = i - 1, j - 1
        pairs.append((i, j))
    return pairs[::-1]


def edit_script(a: Sequence, b: Sequence) -> list[tuple[str, int, int]]:
    """A shortest script as (tag, index in a, index in b): equal, delete, insert.

    Only what both sides hold takes part in the search: the rest is deleted or
    inserted in any shortest script.
    """
    n, m = len(a), len(b)
    lead = 0
    while lead < min(n, m) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(n, m) - lead and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    in_a, in_b = set(a[lead : n - tail]), set(b[lead : m - tail])
    x, y = [k for k in range(lead, n - tail) if a[k] in in_b], [k for k in range(lead, m - tail) if b[k] in in_a]
    number = {t: k for k, t in enumerate(in_a & in_b)}
    pairs = [(x[i], y[j]) for i, j in _common([number[a[k]] for k in x], [number[b[k]] for k in y])] if x and y else []
    out: list[tuple[str, int, int]] = [("equal", k, k) for k in range(lead)]
    i, j = lead, lead
    for p, q in [*pairs, (n - tail, m - tail)]:
        out += [("delete", k, j) for k in range(i, p)]
        out += [("insert", p, k) for k in range(j, q)]
        if p < n - tail:
            out.append(("equal", p, q))
        i, j = p + 1, q + 1
    return [*out, *(("equal", n - tail + k, m - tail + k) for k in range(tail))]


def _words(line: str) -> list[str]:
    return re.findall(r"\s+|[^\s]+", line)


def _spans(a: str, b: str) -> tuple[list[dict], list[dict]]:
    """Spans of the old and the new line; each side's spans concatenate to its line."""
    x, y = _words(a), _words(b)
    old: list[dict] = []
    new: list[dict] = []

    def put(side: list[dict], tag: str, text: str) -> None:
        if side and side[-1]["tag"] == tag:
            side[-1]["text"] += text
        else:
            side.append({"tag": tag, "text": text})

    for tag, i, j in edit_script(x, y):
        if tag != "insert":
            put(old, tag, x[i])
        if tag != "delete":
            put(new, tag, y[j])
    return old, new


def diff_lines(older: str | None, newer: str | None) -> list[dict]:
    """Lines of both texts in order, with 1-based numbers; the i-th deleted line of a block is refined against its i-th inserted one."""
    a, b = (older or "").split("\n"), (newer or "").split("\n")
    out: list[dict] = []
    block: list[tuple[str, int, int]] = []

    def flush() -> None:
        gone = [i for t, i, _ in block if t == "delete"]
        came = [j for t, _, j in block if t == "insert"]
        refined = [_spans(a[i], b[j]) for i, j in zip(gone, came, strict=False)]
        for k, i in enumerate(gone):
            out.append({"tag": "delete", "old_line": i + 1, "new_line": None, "spans": refined[k][0] if k < len(refined) else [{"tag": "delete", "text": a[i]}]})
        for k, j in enumerate(came):
            out.append({"tag": "insert", "old_line": None, "new_line": j + 1, "spans": refined[k][1] if k < len(refined) else [{"tag": "insert", "text": b[j]}]})
        block.clear()

    for step in edit_script(a, b):
        if step[0] == "equal":
            flush()
            out.append({"tag": "equal", "old_line": step[1] + 1, "new_line": step[2] + 1, "spans": [{"tag": "equal", "text": a[step[1]]}]})
        else:
            block.append(step)
    flush()
    return out


@F.pandas_udf(LINE_SCHEMA)
def diff_udf(older: pd.Series, newer: pd.Series) -> pd.Series:
    return pd.Series([diff_lines(a, b) for a, b in zip(older, newer, strict=True)])


def has_changes(lines: Column) -> Column:
    """Whether any line of a difference is not equal."""
    return F.exists(lines, lambda x: x["tag"] != "equal")
