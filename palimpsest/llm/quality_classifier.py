"""Operator 4, quality classifier: co-training of a text view and a page-metadata view.

The text view reads the content: hashed byte trigrams of the whole text. The
metadata view never reads the text: language, source and declared length,
each by itself. Both are logistic regressions. In each round both
views score all unlabelled documents. Those that a view is sure of are
labelled for the other view, which is fitted on its labelled rows and a bounded
sample of these. On held-out labelled rows each view is then calibrated and a
combiner is fitted; it scores all documents.

Fitting uses bounded samples of labelled and pseudo-labelled rows (parameters):
features are computed on the executors and only fixed-size vectors of the
samples reach the driver. Which documents are sure is decided over all of them.

Edge cases: null or empty texts have zero trigrams and are judged by the
metadata and the intercept; null metadata is a value of its own; repeated rows
are judged alike; without two classes among the labels nothing is rejected;
extra columns are kept (names used here begin with ``_q_``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from palimpsest.llm._common import discard, materialise, release_memory, slices, table
from palimpsest.llm.quality_rules import labelled_sample, one_row_per_id

#: Bounds of the samples fitted on: labelled rows, and pseudo-labelled rows of one view, class and round.
LABELLED_ROWS, TOLD_ROWS = 4_000, 400
ROUNDS, CONFIDENT = 3, 0.97
DIM_BITS = 11
#: Measures of spread, and grams added to each text's total.
SPREAD, PRIOR = 3, 60
#: Languages, sources and steps of declared length (a step is a quarter of an octave).
LANGS, SOURCES, STEPS = 16, 64, 80
META = LANGS + SOURCES + STEPS + 3


def text_features(texts: pa.Array) -> np.ndarray:
    """Square roots of the relative frequencies of hashed byte trigrams, a row for each text, then three measures of their spread.

    ``PRIOR`` grams are added to the total, so that short texts, whose
    frequencies say little, stay near the intercept.
    """
    texts = pa.concat_arrays([texts.cast(pa.large_binary()).fill_null(b"")])
    dim, n = 1 << DIM_BITS, len(texts)
    if not n:
        return np.zeros((0, dim + SPREAD), np.float32)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint32) if texts.buffers()[2] else np.zeros(0, np.uint32)
    ends = ends - ends[0]
    if len(raw) < 3:
        return np.zeros((n, dim + SPREAD), np.float32)
    gram = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    bucket = ((gram * np.uint32(2654435769)) >> np.uint32(32 - DIM_BITS)).astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(ends))
    inside = row[:-2] == row[2:]
    out = np.bincount(row[:-2][inside] * dim + bucket[inside], minlength=n * dim).reshape(n, dim).astype(np.float32)
    total = out.sum(axis=1, keepdims=True)
    share = out / (total + PRIOR)
    distinct = (out > 0).sum(axis=1)
    spread = np.stack([np.sqrt((share * share).sum(axis=1)), np.sqrt(share.max(axis=1)), np.log1p(distinct) / np.log(total[:, 0] + PRIOR)], axis=1)
    return np.concatenate([np.sqrt(share), spread.astype(np.float32)], axis=1)


def meta_features(batch: pa.RecordBatch) -> np.ndarray:
    """Language, source and step of declared length as (hashed) indicators, then the length itself."""
    n = batch.num_rows
    out = np.zeros((n, META), np.float32)
    columns = (batch.column(f"_q_{c}").to_pylist() for c in ("lang", "source", "chars"))
    for k, (lang, source, declared) in enumerate(zip(*columns, strict=True)):
        out[k, zlib.crc32(repr(lang).encode()) % LANGS] = 1
        out[k, LANGS + zlib.crc32(repr(source).encode()) % SOURCES] = 1
        small = np.log1p(max(declared or 0, 0))
        out[k, LANGS + SOURCES + (0 if declared is None else min(1 + int(4 * small / np.log(2)), STEPS - 1))] = 1
        out[k, -3:] = small / 10, (small / 10) ** 2, declared is None
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-4, steps: int = 300, scale: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept, by accelerated gradient steps; ``scale`` multiplies the features."""
    weight = np.ones(len(y)) if weight is None else weight
    weight = weight / weight.sum()
    rate = 4 / (scale * scale * np.max(np.einsum("ij,ij->i", x, x)) + 1 + 4 * l2)
    w, b = np.zeros(x.shape[1]), 0.0
    v, c = w.copy(), b
    for t in range(steps):
        e = weight * (1 / (1 + np.exp(-np.clip(x @ (scale * v).astype(x.dtype) + c, -50, 50))) - y)
        w2, b2 = v - rate * (scale * (x.T @ e.astype(x.dtype)) + l2 * v), c - rate * e.sum()
        m = t / (t + 3)
        v, c = w2 + m * (w2 - w), b2 + m * (b2 - b)
        w, b = w2, b2
    return w * scale, float(b)


@dataclass
class CoTrained:
    """Two linear views, each with a calibration (slope, shift), and a combiner over the calibrated log-odds."""

    text: tuple[np.ndarray, float]
    meta: tuple[np.ndarray, float]
    calibration: tuple[tuple[float, float], tuple[float, float]]
    combiner: tuple[np.ndarray, float]
    added: tuple[int, ...] = ()

    def scores(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality by text, by metadata, and combined."""
        z = [s * (x @ w.astype(x.dtype) + b) + o for x, (w, b), (s, o) in ((xt, self.text, self.calibration[0]), (xm, self.meta, self.calibration[1]))]
        both = np.clip(np.stack(z, axis=1), -20, 20) @ self.combiner[0] + self.combiner[1]
        return tuple(1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (*z, both))  # type: ignore[return-value]


TEXT_SCALE, META_SCALE = 10.0, 2.0


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(y: np.ndarray) -> np.ndarray:
    """Every third labelled row is held out for calibration, where both parts have two classes."""
    held = np.arange(len(y)) % 3 == 0
    if len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
        held = np.zeros(len(y), bool)
    return held


#: What a view has been told: features and labels of pseudo-labelled rows.
Told = list[tuple[np.ndarray, np.ndarray]]


def fit_views(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, told: tuple[Told, Told]) -> list[tuple[np.ndarray, float]]:
    """Both views on their labelled rows and what they have been told."""
    held, out = held_out(y), []
    for x, extra, scale in ((xt, told[0], TEXT_SCALE), (xm, told[1], META_SCALE)):
        n = sum(len(t) for _, t in extra)
        weight = np.concatenate([np.ones((~held).sum()), np.full(n, 0.3)])
        out.append(logistic(np.concatenate([x[~held], *(u for u, _ in extra)]), np.concatenate([y[~held], *(t for _, t in extra)]), weight, scale=scale))
    return out


def combine(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, models: list[tuple[np.ndarray, float]], added: tuple[int, ...]) -> CoTrained:
    """Calibration of the views and the combiner, on held-out rows."""
    held = held_out(y)
    if not held.any():
        held[:] = True
    cal, zs = [], []
    for x, (w, b) in ((xt, models[0]), (xm, models[1])):
        z = x[held] @ w.astype(x.dtype) + b
        ws, o = logistic(z[:, None].astype(np.float64) / 4, y[held], steps=400)
        cal.append((float(ws[0]) / 4, o))
        zs.append(np.clip(z * ws[0] / 4 + o, -20, 20))
    combiner = logistic(np.stack(zs, axis=1) / 4, y[held], steps=400)
    return CoTrained(models[0], models[1], tuple(cal), (combiner[0] / 4, combiner[1]), added)  # type: ignore[arg-type]


def _inputs(docs: DataFrame, *more: str) -> DataFrame:
    """The columns that the views read, whatever the table lacks being null."""
    have = set(docs.columns)
    pick = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t).alias(f"_q_{'chars' if c == 'n_chars' else c}")
    return docs.select(*more, "text", pick("lang", "string"), pick("source", "string"), pick("n_chars", "long"))


def _vectors(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample, as half-precision bytes from the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            t, m = text_features(b.column("text")).astype(np.float16), meta_features(b).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column("_label"), pa.array([r.tobytes() for r in t], pa.binary()), pa.array([r.tobytes() for r in m], pa.binary())], ["_label", "t", "m"])

    rows = df.mapInArrow(run, "_label int, t binary, m binary").toArrow()
    rows = sorted(zip(*(rows[c].to_pylist() for c in ("t", "m", "_label")), strict=True))
    t = np.array([np.frombuffer(r[0], np.float16) for r in rows], np.float32).reshape(len(rows), (1 << DIM_BITS) + SPREAD)
    m = np.array([np.frombuffer(r[1], np.float16) for r in rows], np.float32).reshape(len(rows), META)
    order = np.random.default_rng(7).permutation(len(rows))
    return t[order], m[order], np.array([r[2] for r in rows], float)[order]


def _view_scores(docs: DataFrame, models: list[tuple[np.ndarray, float]]) -> DataFrame:
    """doc_id, pt, pm: each document's probability by both views."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            p = [_sigmoid(x @ w.astype(x.dtype) + c) for x, (w, c) in zip((text_features(b.column("text")), meta_features(b)), models, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v.astype(np.float64)) for v in p)], ["doc_id", "pt", "pm"])

    return _inputs(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, pt double, pm double")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED_ROWS, told_rows: int = TOLD_ROWS, rounds: int = ROUNDS) -> CoTrained | None:
    """Co-trained views; None without two classes. At most ``labelled`` rows, and ``told_rows`` for each round, view and class, are fitted on."""
    have = set(docs.columns)
    slim = docs.select("doc_id", *[c for c in ("text", "lang", "source", "n_chars") if c in have])
    sample = labelled_sample(slim, labels, label, labelled)
    xt, xm, y = _vectors(_inputs(sample, "_label"))
    if len(np.unique(y)) < 2:
        return None
    told: tuple[Told, Told] = ([], [])
    models, added = fit_views(xt, xm, y, told), []
    known = labels.select("doc_id").where("doc_id IS NOT NULL").distinct()
    for r in range(rounds):
        # every unlabelled document is scored; of those a view is sure of, the first by a hash of the id are taken
        scored = materialise(_view_scores(slim, models).where("doc_id IS NOT NULL").join(known, "doc_id", "left_anti"), "views")
        order = F.xxhash64("doc_id", F.lit(r))
        count, parts = 0, []
        for view, p in enumerate(("pt", "pm")):
            for value, sure in ((1, F.col(p) >= CONFIDENT), (0, F.col(p) <= 1 - CONFIDENT)):
                parts.append(scored.where(sure).select("doc_id").orderBy(order, "doc_id").limit(told_rows).select("doc_id", F.lit(2 * view + value).alias("_label")))
        chosen = reduce(DataFrame.unionByName, parts).dropDuplicates(["doc_id", "_label"])
        ut, um, what = _vectors(_inputs(one_row_per_id(slim.join(F.broadcast(chosen), "doc_id"), "doc_id", "_label"), "_label"))
        for view in (0, 1):
            mine = what // 2 == view
            count += int(mine.sum())
            told[1 - view].append(((um if view == 0 else ut)[mine], (what % 2)[mine]))
        discard(scored)
        added.append(count)
        models = fit_views(xt, xm, y, told)
        if not count:
            break
    model = combine(xt, xm, y, models, tuple(added))
    del xt, xm, told
    release_memory()
    return model


def score_quality(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (else all) of ``docs`` with q_text, q_meta, q_score (probabilities of good quality) and q_keep."""
    names = ["q_text", "q_meta", "q_score"]
    kept = [c for c in (columns or docs.columns) if c not in (*names, "q_keep")]
    wide = _inputs(docs, *[F.col(c).alias(f"_k{n}") for n, c in enumerate(kept) if c != "text"])
    source = {c: "text" if c == "text" else f"_k{n}" for n, c in enumerate(kept)}
    schema = StructType([*docs.select(*kept).schema.fields, *(StructField(n, DoubleType()) for n in names), StructField("q_keep", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = model.scores(text_features(b.column("text")), meta_features(b)) if model else (np.ones(b.num_rows),) * 3
            yield pa.RecordBatch.from_arrays([*(b.column(source[c]) for c in kept), *(pa.array(v.astype(np.float64)) for v in s), pa.array(s[2] >= threshold)], [*kept, *names, "q_keep"])

    return wide.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    return score_quality(docs, fit_quality(docs, labels)).where("q_keep").select(*docs.columns)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored: doc_id, q_text, q_meta, q_score, kept."""
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, columns=["doc_id"]).select("doc_id", "q_text", "q_meta", "q_score", F.col("q_keep").alias("kept"))
