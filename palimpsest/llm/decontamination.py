"""Operator 3, benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and benchmark items are sequences of words (lower case, letters and
digits only; in scripts without spaces each character is a word). An item leaks
into a document if some stretch of the document is within ``MAX_EDITS`` of the
item's word count in word edit distance: items of up to four words match exactly.

1. Windows. At most k edits leave one of k + 1 equal segments of an item whole,
   so only item-sized windows around an exact segment hit can match: no
   window that could match is skipped.
2. Each window is embedded by the CGK random walk, which maps edit distance to
   Hamming distance: the walk emits the current word at every step and moves on
   when a random bit of (step, word) says so.
3. Repeated bit-sampling LSH over the embeddings (several walks, several
   tables each, several sampled symbols in a table's key) proposes (window,
   item) pairs.
4. Every proposal is verified by the exact edit distance of the item to the
   best stretch around the window; where windows run together, the words before
   and after a stretch found are searched again until none is left.

Items of fewer than ``SHORT`` words skip steps 2 and 3: all their windows are
compared. Items without a letter or digit match nothing. The benchmark is taken in blocks of
bounded size, each against all documents.

Edge cases: null or empty texts match nothing; long texts are searched whole;
repeated rows are judged one by one; an empty benchmark or table gives no
matches; extra columns are kept by :func:`drop_contaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import slices, table, words

MAX_EDITS = 0.2
#: Items of fewer words are compared with every window around a segment hit, without walk and sampling.
SHORT = 8
#: Walks, tables of each walk, and symbols in a table's key. :func:`recall` gives what they reach for a share of unchanged symbols.
WALKS, SAMPLES, SAMPLED = 6, 16, 2
STEPS_PER_WORD = 3
#: Bytes of benchmark text that one block holds.
BLOCK_BYTES = 4_000_000
#: Windows embedded or compared at a time.
WINDOW_CHUNK = 8192
#: Scripts written without spaces between words.
UNSPACED = "".join(rf"\p{{{s}}}" for s in "Han Hiragana Katakana Bopomofo Yi Thai Lao Khmer Myanmar Tibetan Javanese Balinese Tai_Le New_Tai_Lue Tai_Tham Tai_Viet".split())


def _normal(values: pa.Array) -> pa.Array:
    plain = pc.replace_substring_regex(pc.utf8_lower(values.cast(pa.large_string())), pattern=r"[^\p{L}\p{N}]+", replacement="")
    return pc.replace_substring_regex(plain, pattern=f"([{UNSPACED}])", replacement=r" \1 ")


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row offsets, codes and dictionary of the normal words; words without a letter or digit are dropped, unspaced ones split."""
    offsets, codes, vocabulary = words(texts)
    starts, parts, dictionary = words(_normal(vocabulary))
    codes = codes.astype(np.int64)
    n = starts[codes + 1] - starts[codes]
    total = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(n, out=total[1:])
    at = np.repeat(starts[codes] - total[:-1], n) + np.arange(total[-1])
    return total[offsets], parts.astype(np.int64)[at], dictionary


@dataclass
class Items:
    """One block of the benchmark, ready for searching."""

    ids: list[int]
    codes: list[np.ndarray]
    vocabulary: pa.Array
    #: by segment length: sorted keys, and the item and offset of each
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    #: by item length: per (walk, sample) the sampled steps, the sorted keys and the items
    tables: dict[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=dict)

    @property
    def base(self) -> int:
        return len(self.vocabulary) + 3


def edits_allowed(n: int) -> int:
    """Edits within which an item of ``n`` words counts as found."""
    return int(MAX_EDITS * n + 1e-9)


@lru_cache(maxsize=100_000)
def _walk_hash(walk: int, step: int) -> tuple[np.uint64, np.uint64]:
    a, b = np.random.default_rng((walk, step, 11)).integers(1, 1 << 62, 2).astype(np.uint64)
    return a | np.uint64(1), b


def _walk_bits(walk: int, step: int, symbol: np.ndarray) -> np.ndarray:
    """The random bit of each symbol at a step of a walk."""
    a, b = _walk_hash(walk, step)
    return ((symbol.astype(np.uint64) * a + b) >> np.uint64(45)) & np.uint64(1)


def cgk(codes: np.ndarray, start: np.ndarray, end: np.ndarray, steps: int, walk: int, base: int) -> np.ndarray:
    """The first ``steps`` symbols (3n make a whole one) of the embeddings of the windows codes[start:end]; base - 1 pads."""
    at, out = start.copy(), np.empty((len(start), steps), np.int32)
    last = max(len(codes) - 1, 0)
    for j in range(steps):
        symbol = np.where(at < end, codes[np.minimum(at, last)] + 1, base - 1)  # 0: a word that no item has
        out[:, j] = symbol
        at += _walk_bits(walk, j, symbol).astype(np.int64)
    return out


def _sampled(n: int, walk: int) -> np.ndarray:
    """Steps sampled for items of n words, a row for each table of a walk; late steps, often padding, are left out."""
    return np.random.default_rng((n, walk, 5)).integers(0, _steps(n), (SAMPLES, SAMPLED))


def _steps(n: int) -> int:
    """Steps of a walk that are ever sampled."""
    return min(STEPS_PER_WORD * n, int(1.6 * n) + 1)


def recall(same: float, walks: int = WALKS, samples: int = SAMPLES, sampled: int = SAMPLED) -> float:
    """Chance that a window meets its item in some table, if each walk leaves a share ``same`` of the symbols unchanged."""
    return 1 - (1 - same**sampled) ** (walks * samples)


def proposed(items: Items, n: int, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(window, item) pairs that the tables for items of ``n`` words propose for windows codes[start:end], table by table."""
    walk_now, embedded, out = -1, None, []
    for walk, steps, keys, who in items.tables[n]:
        if walk != walk_now:
            walk_now, embedded = walk, cgk(codes, start, end, _steps(n), walk, items.base)
        a, b = _matches(_key(embedded, steps, items.base), keys)
        out.append((a, who[b]))
    return out


def _key(embedded: np.ndarray, steps: np.ndarray, base: int) -> np.ndarray:
    key = np.zeros(len(embedded), np.int64)
    for s in steps:
        key = key * base + embedded[:, s]
    return key


def build_items(rows: list[tuple[int, str | None]]) -> Items:
    """Segments and LSH tables of one block of (item_id, text)."""
    offsets, codes, vocabulary = normal_words(pa.array([t for _, t in rows], pa.large_string()))
    keep = [k for k in range(len(rows)) if offsets[k + 1] - offsets[k] > 0]
    out = Items([rows[k][0] for k in keep], [codes[offsets[k] : offsets[k + 1]] for k in keep], vocabulary)
    seeds: dict[int, list[tuple[int, int, int]]] = {}
    for k, c in enumerate(out.codes):
        parts = edits_allowed(len(c)) + 1
        # 3 words at most go into a key, so that it stays exact in 63 bits for a vocabulary of 2 million
        q = min(len(c) // parts, 3 if out.base > 50_000 else 4)
        for p in range(parts):
            o = p * (len(c) // parts)
            key = 0
            for w in c[o : o + q]:
                key = key * out.base + int(w) + 1
            seeds.setdefault(q, []).append((key, k, o))
    for q, found in seeds.items():
        a = np.array(sorted(found), np.int64)
        out.seeds[q] = (a[:, 0], a[:, 1], a[:, 2])
    lengths = np.array([len(c) for c in out.codes])
    for n in np.unique(lengths[lengths >= SHORT]).tolist():
        who = np.flatnonzero(lengths == n)
        flat = np.concatenate([out.codes[k] for k in who])
        start = np.arange(len(who)) * n
        tables = []
        for walk in range(WALKS):
            e = cgk(flat, start, start + n, _steps(n), walk, out.base)
            for steps in _sampled(n, walk):
                key = _key(e, steps, out.base)
                order = np.argsort(key, kind="stable")
                tables.append((walk, steps, key[order], who[order]))
        out.tables[n] = tables
    return out


def _matches(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index in keys, index in sorted_keys) of all equal pairs."""
    lo, hi = np.searchsorted(sorted_keys, keys, "left"), np.searchsorted(sorted_keys, keys, "right")
    n = hi - lo
    who = np.repeat(np.arange(len(keys)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def nearest_stretches(item: np.ndarray, words_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end in ``words_`` the least edit distance of ``item`` to a stretch up to there, and where that begins."""
    n = len(words_)
    row, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    for w in item:
        diag = row[:-1] + (words_ != w)
        up = row + 1
        nxt, src = up.copy(), origin.copy()
        better = diag <= nxt[1:]
        nxt[1:] = np.where(better, diag, nxt[1:])
        src[1:] = np.where(better, origin[:-1], src[1:])
        # a gap in the item: running minimum of (value - position), carried with where it came from
        level = nxt - steps
        low = np.minimum.accumulate(level)
        first = np.maximum.accumulate(np.where(level == low, steps, 0))
        row, origin = low + steps, src[first]
    return row, origin


def all_stretches(item: np.ndarray, codes: np.ndarray, a: int, b: int, most: int) -> list[tuple[int, int, int]]:
    """(distance, begin, end) of stretches of codes[a:b] that do not overlap and are within ``most`` edits of ``item``, nearest first; what lies between them is searched again."""
    todo, out = [(a, b)], []
    while todo:
        a, b = todo.pop()
        if b - a < len(item) - most:
            continue
        row, origin = nearest_stretches(item, codes[a:b])
        ends = np.flatnonzero(row <= most)
        free = np.ones(b - a, bool)
        for end in ends[np.argsort(row[ends], kind="stable")].tolist():
            begin = int(origin[end])
            if free[begin:end].all():
                free[begin:end] = False
                out.append((int(row[end]), a + begin, a + end))
        if len(ends):
            edge = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
            todo += [(a + x, a + y) for x, y in edge.reshape(-1, 2).tolist()]
    return out


def short_hits(offsets: np.ndarray, codes: np.ndarray, items: Items, n: int, first: np.ndarray, row: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which of the windows of ``n`` words at ``first`` are within the allowed edits of their item, up to as many words shifted."""
    k, out = edits_allowed(n), np.zeros(len(first), bool)
    for lo in range(0, len(first), WINDOW_CHUNK):
        f, r = first[lo : lo + WINDOW_CHUNK], row[lo : lo + WINDOW_CHUNK]
        mine = np.stack([items.codes[x] for x in item[lo : lo + WINDOW_CHUNK]])
        at = f[:, None] + np.arange(-k, n + k)
        inside = (at >= offsets[r][:, None]) & (at < offsets[r + 1][:, None])
        seen = np.where(inside, codes[np.clip(at, 0, len(codes) - 1)], -2)
        last = [np.zeros(len(f), np.int64)] * (n + 2 * k + 1)
        for i in range(n):
            new = [last[0] + 1]
            for j in range(n + 2 * k):
                new.append(np.minimum(last[j] + (seen[:, j] != mine[:, i]), np.minimum(last[j + 1], new[-1]) + 1))
            last = new
        out[lo : lo + WINDOW_CHUNK] = np.min(last, axis=0) <= k
    return out


def find_leaks(offsets: np.ndarray, codes: np.ndarray, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(row, item number, distance, first word, end word) of the leaks in a batch of coded texts.

    ``codes`` hold numbers of the items' vocabulary, -1 for other words.
    """
    if not len(codes) or not items.ids:
        return []
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    windows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    proposals = set()
    lengths = np.array([len(c) for c in items.codes])
    slack = np.array([edits_allowed(int(n)) for n in lengths])
    for q, (keys, who, at) in items.seeds.items():
        if len(codes) < q:
            continue
        known = codes >= 0
        ok = row_of[: len(codes) - q + 1] == row_of[q - 1 :]
        for j in range(q):
            ok &= known[j : len(codes) - q + 1 + j]
        pos = np.flatnonzero(ok)
        key = np.zeros(len(pos), np.int64)
        for j in range(q):
            key = key * items.base + codes[pos + j] + 1
        a, b = _matches(key, keys)
        item, first = who[b], pos[a] - at[b]
        for n in np.unique(lengths[item]).tolist():
            mine = lengths[item] == n
            k = edits_allowed(n)
            if n < SHORT:
                f, r, who_ = first[mine], row_of[pos[a][mine]], item[mine]
                hit = short_hits(offsets, codes, items, n, f, r, who_)
                f = np.clip(f, offsets[r], offsets[r + 1] - 1)
                proposals.update(zip(r[hit].tolist(), who_[hit].tolist(), f[hit].tolist(), strict=True))
                continue
            start = (first[mine][:, None] + np.arange(-k, k + 1)).ravel()
            row = np.repeat(row_of[pos[a][mine]], 2 * k + 1)
            windows.setdefault(n, []).append((start, row))
    for n, found in windows.items():
        start, row = np.concatenate([s for s, _ in found]), np.concatenate([r for _, r in found])
        start = np.clip(start, offsets[row], np.maximum(offsets[row], offsets[row + 1] - 1))
        start, first = np.unique(start, return_index=True)
        row = row[first]
        for lo in range(0, len(start), WINDOW_CHUNK):
            s, r = start[lo : lo + WINDOW_CHUNK], row[lo : lo + WINDOW_CHUNK]
            end = np.minimum(s + n, offsets[r + 1])
            for a, b in proposed(items, n, codes, s, end):
                proposals.update(zip(r[a].tolist(), b.tolist(), s[a].tolist(), strict=True))
    out, span = [], None
    runs: list[list[int]] = []
    for r, k, s in sorted(proposals):  # neighbouring windows of one item are verified as one stretch
        if span == (r, k) and s - runs[-1][3] <= lengths[k] + 2 * slack[k]:
            runs[-1][3] = s
        else:
            runs.append([r, k, s, s])
        span = (r, k)
    for r, k, first, last in runs:
        a = max(int(offsets[r]), first - int(slack[k]))
        b = min(int(offsets[r + 1]), last + int(lengths[k]) + int(slack[k]))
        out += [(r, k, d, begin - int(offsets[r]), end - int(offsets[r])) for d, begin, end in all_stretches(items.codes[k], codes, a, b, int(slack[k]))]
    return out


def _coded(texts: pa.Array, items: Items) -> tuple[np.ndarray, np.ndarray]:
    offsets, codes, vocabulary = normal_words(texts)
    of = pc.fill_null(pc.index_in(vocabulary, items.vocabulary.cast(vocabulary.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return offsets, of[codes] if len(codes) else codes


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The benchmark in blocks of about ``block_bytes`` of text each."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        rows = benchmark.where((F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").collect()
        if rows:
            yield build_items(sorted((tuple(r) for r in rows), key=repr))


def leak_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leaking stretch, those of one item not overlapping: doc_id, item_id, distance, item_words, begin_word, end_word (normal words from 0)."""
    schema = "doc_id long, item_id long, distance int, item_words int, begin_word long, end_word long"
    slim, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                found = find_leaks(*_coded(b.column("text"), items), items)
                ids = b.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                cols = [pa.array([items.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32()), pa.array([len(items.codes[f[1]]) for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", "item_id", "distance", "item_words", "begin_word", "end_word"])

        part = slim.mapInArrow(_one_argument(run), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _one_argument(run):  # noqa: ANN001, ANN202
    return lambda batches: run(batches)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents into which an item has leaked; no shuffle, a pass for each block."""
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                keep = np.ones(b.num_rows, bool)
                keep[[f[0] for f in find_leaks(*_coded(b.column("text"), items), items)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(_one_argument(run), docs.schema)
    return docs


def op3_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item into a document."""
    return leak_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
