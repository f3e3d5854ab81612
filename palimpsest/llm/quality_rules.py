"""Operator 10, quality rules: gradient-boosted trees over document statistics.

Statistics are taken from whole texts in one Arrow pass. A small boosted-tree
model, trained on a bounded sample of labelled documents, is flattened into
numpy node arrays and scores whole batches at once. Monotonic constraints make
the score fall, never rise, as symbols, repetition, repeated lines or capitals
grow.

Edge cases: a null or empty text has no words, all-zero statistics and fails
the base rule; documents whose id is null or repeated are judged row by row;
with no usable labels (none, or one class) the method rejects nothing; extra
input columns are ignored by :func:`score_documents` (it returns its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import per_row, slices, table, words

#: Bound on the labelled rows used for training (documented sample).
TRAIN_ROWS = 20_000
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Features, with the sign of their monotonic constraint on quality (0: free).
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbol_ratio": -1,
    "dup_line_ratio": -1,
    "repeat_ratio": -1,
    "upper_ratio": -1,
    "bang_ratio": -1,
    "digit_ratio": 0,
    "distinct_ratio": 0,
    "words_per_line": 0,
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(offsets: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Words of each row inside a 5-word window that its text has at least twice (exact comparison)."""
    n = len(codes)
    rows = len(offsets) - 1
    doc = np.repeat(np.arange(rows), np.diff(offsets))
    if n < WINDOW:
        return np.zeros(rows, np.int64)
    start = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    covered = np.zeros(n + 1, np.int64)
    if len(start):
        c = codes.astype(np.int64)
        if c.max() < 1 << 21 and rows < 1 << 21:
            keys = [c[start] << 42 | c[start + 1] << 21 | c[start + 2], c[start + 3] << 42 | c[start + 4] << 21 | doc[start]]
        else:
            keys = [c[start + k] for k in range(WINDOW)] + [doc[start]]
        order = np.lexsort(keys)
        same = np.ones(len(start) - 1, bool)
        for k in keys:
            k = k[order]
            same &= k[1:] == k[:-1]
        twice = np.zeros(len(start), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = start[order[twice]]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW, -1)
    return per_row(np.cumsum(covered[:-1]) > 0, offsets)


def _dup_lines(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier one, and lines with a word, of each text."""
    dup, n = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if text:
            lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
            n[k], dup[k] = len(lines), len(lines) - len(set(lines))
    return dup, n


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Base counts and model features of each text of a batch."""
    offsets, codes, vocabulary = words(texts)
    n_words = np.diff(offsets)

    def by_word(values: pa.Array) -> np.ndarray:
        v = values.to_numpy(zero_copy_only=False).astype(np.int64)
        return per_row(v[codes] if len(v) else np.zeros(0, np.int64), offsets)

    def matches(pattern: str) -> np.ndarray:
        return by_word(pc.count_substring_regex(vocabulary, pattern))

    chars = by_word(pc.utf8_length(vocabulary))
    symbols, upper = matches(r"[#*$%&|<>]"), matches(r"\p{Lu}")
    dup, lines = _dup_lines(texts.to_pylist())
    repeat = _repeat_words(offsets, codes)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    pair = np.unique(doc.astype(np.int64) << 32 | codes) if len(codes) else np.zeros(0, np.int64)
    distinct = np.bincount(pair >> 32, minlength=len(n_words))
    w, c = np.maximum(n_words, 1), np.maximum(chars, 1)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat,
        "log_words": np.log1p(n_words), "mean_word_chars": chars / w, "symbol_ratio": symbols / w, "dup_line_ratio": dup / np.maximum(lines, 1),
        "repeat_ratio": repeat / w, "upper_ratio": upper / c, "bang_ratio": matches("!") / w, "digit_ratio": matches(r"\p{Nd}") / c,
        "distinct_ratio": distinct / w, "words_per_line": n_words / np.maximum(lines, 1),
    }


@dataclass
class FlatForest:
    """Boosted trees as node arrays: ``feature`` < 0 marks a leaf; all trees share the arrays."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality for each row of ``x``, by level-wise steps through the arrays."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            down = np.where(x[row, np.maximum(f, 0)] <= self.threshold[node], self.left[node], self.right[node])
            node = np.where(f < 0, node, down)
        return self.base + self.value[node].sum(axis=1)


def train(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 1.0) -> FlatForest:
    """Second-order boosting on log loss with quantile bins and monotonic bounds.

    A split on a constrained feature is refused when its child values would be
    in the wrong order; the midpoint then bounds all values below each child.
    """
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    nodes: list[list[float]] = []
    roots, margin = [], np.full(len(y), base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        me = len(nodes)
        nodes.append([-1, 0.0, me, me, float(np.clip(-gs / (hs + l2), low, high)) * rate])
        if level == 0 or len(rows) < 2:
            return me
        best = (1e-6, 0, 0, 0.0, 0.0)
        for j, c in enumerate(cuts):
            b = binned[rows, j]
            gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
            gr, hr = gs - gl, hs - hl
            vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            score = lambda v, gg, hh: -(gg * v + 0.5 * (hh + l2) * v * v)
            v0 = nodes[me][4] / rate
            gain = score(vl, gl, hl) + score(vr, gr, hr) - score(v0, gs, hs)
            ok = (hl >= least) & (hr >= least) & (signs[j] * (vr - vl) >= 0)
            if ok.any():
                k = int(np.argmax(np.where(ok, gain, -np.inf)))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        gain, j, k, vl, vr = best
        if gain <= 1e-6:
            return me
        mid = (vl + vr) / 2
        bounds = {-1: ((mid, high), (low, mid)), 1: ((low, mid), (mid, high)), 0: ((low, high), (low, high))}[int(signs[j])]
        go = binned[rows, j] <= k
        kids = [grow(rows[m], g, h, level - 1, *b) for m, b in zip((go, ~go), bounds, strict=True)]
        nodes[me][:4] = [j, float(cuts[j][k]), *kids]
        return me

    forest = None
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth, -np.inf, np.inf))
        a = np.array(nodes[first:])
        one = FlatForest(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int) - first, a[:, 3].astype(int) - first, a[:, 4], np.array([0]), depth, 0.0)
        margin = margin + one.margin(x)
    a = np.array(nodes)
    forest = FlatForest(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots), depth, base)
    return forest


def _features(stats: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([np.asarray(stats[f], np.float64) for f in FEATURES], axis=1)


def one_row_per_id(docs: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of ``keys``, where ids are repeated always the same: that of the smallest hash."""
    rest = [c for c in docs.columns if c not in keys]
    first = docs.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows of ``docs`` with one label and one row per document, chosen by a hash of the id.

    Conflicting repeated labels count as the smallest. The id list has at most
    ``limit`` rows, so broadcasting it is safe.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    return one_row_per_id(docs.join(F.broadcast(chosen), "doc_id"), "doc_id", "_label")


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> FlatForest | None:
    """The model, trained on the driver from at most ``limit`` rows of statistics; None without two classes."""
    names = list(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = statistics(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("_label"), *(pa.array(np.asarray(s[f], np.float64)) for f in names)], ["_label", *names])

    sample = labelled_sample(docs.select("doc_id", "text"), labels, "quality", limit).select("_label", "text")
    rows = sample.mapInArrow(run, "_label int, " + ", ".join(f"{f} double" for f in names)).toPandas()
    rows = rows.sort_values(["_label", *names])
    y = rows["_label"].to_numpy(float)
    if len(np.unique(y)) < 2:
        return None
    return train(rows[names].to_numpy(float), y, np.array(list(FEATURES.values())))


def score_documents(docs: DataFrame, forest: FlatForest | None, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, score (probability of good quality) and kept."""
    cut = float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = statistics(b.column("text"))
            m = forest.margin(_features(s)) if forest else np.full(b.num_rows, 50.0)
            failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(s[k].astype(np.int64)) for k in BASE), pa.array(failed), pa.array(1 / (1 + np.exp(-m))), pa.array(~failed & (m >= cut))],
                ["doc_id", *BASE, "base_failed", "score", "kept"],
            )

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by the base rules and the boosted trees."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
