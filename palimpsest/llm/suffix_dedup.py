"""Operator 8, suffix-array dedup with a logarithmic index family.

Two rules of what a repeat is, by one engine:

- ``bytes``: each byte covered by a string of ``LENGTH`` bytes that also starts
  anywhere else in the table, the same document included, is removed.
- ``words``: words covered by a passage of over ``PASSAGE - 1`` words that
  another document holds too are counted (white space apart; a word is compared
  by a 64-bit hash). Nothing is removed for these; the count also shows
  passages that are shorter than ``LENGTH`` bytes.

1. Anchors. In each window (of ``LENGTH`` bytes or ``PASSAGE`` words) the
   smallest hashed gram is its anchor, so equal windows have equal anchors at
   equal places. Consecutive windows of one anchor form a stretch. Only
   stretches whose gram occurs elsewhere can hold repeated windows; stretches
   that are equal as a whole (128-bit digest) are repeated as a whole.
2. The rest, mostly edges of repeated passages, are sent with their bytes by
   gram to tasks. There every batch of stretches gets a suffix array: its window
   starts in the byte order of the suffixes' first ``LENGTH`` bytes. The array
   is merge-scanned against the levels of the index family, becomes a level,
   and levels of about equal size merge, so a window is merged a logarithmic number of
   times. Windows are compared byte by byte; no hash decides. As the stretches
   come sorted by gram, a family is closed when its grams have passed, so it
   never holds more than a batch and one gram.
3. Covered ranges are joined to the texts and cut out.

Skew. A gram with more than ``HOT_SHARE`` of all stretches is hot; there are at
most ``1 / HOT_SHARE`` such grams, so these are broadcast instead of shuffled.
The edges of a hot gram are cut into slivers of ``SLIVER`` windows, dealt by
the bytes that all windows of a sliver have in common. Texts are written
once, bucketed by row number, and both joins with them use the buckets.

Edge cases: null texts count as empty; texts shorter than a window are never
touched; repeated rows are whole repeats of each other; repeated and null ids
are separate rows; long texts are read whole; an empty table gives an empty
result; other columns than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import HOT_SHARE, discard, join_by_weight, materialise, slices, table, work_root, words

LENGTH, GRAM = 400, 64
PASSAGE, PASSAGE_GRAM = 51, 16
#: Windows that one suffix array holds, about.
BATCH_WINDOWS = 1 << 16
#: Windows of a sliver of a hot gram's stretch.
SLIVER = 16
#: Stretches that a task gets, about.
TASK_STRETCHES = 20_000
_PRIME = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Rule:
    """What a window is: ``length`` units of ``unit`` bytes each; ``across``: repeats within one document do not count."""

    length: int
    gram: int
    unit: int
    across: bool


BYTES, WORDS = Rule(LENGTH, GRAM, 1, False), Rule(PASSAGE, PASSAGE_GRAM, 8, True)
#: The lowest bit of a gram's hash tells the rule.
RULES = (BYTES, WORDS)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(p: int, n: int) -> np.ndarray:
    out = np.full(n, p, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def rolling(units: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of ``width`` units (hashed already), by prefix sums in arithmetic modulo 2^64."""
    n = len(units)
    if n < width:
        return np.zeros(0, np.uint64)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(units * _powers(_PRIME, n), out=h[1:])
    return _mix((h[width:] - h[:-width]) * _powers(pow(_PRIME, -1, 1 << 64), n - width + 1))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, by running minima of blocks from both sides."""
    n, m = len(v), -(-len(v) // w) * w
    pad = np.full(m, np.iinfo(v.dtype).max, v.dtype)
    pad[:n] = v
    b = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(b, axis=1).ravel()
    behind = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    k = n - w + 1
    return np.minimum(behind[:k], ahead[w - 1 : w - 1 + k])


def stretches(units: np.ndarray, ends: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, gram hash) of each stretch of texts laid end to end; every whole window is in one."""
    none = (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))
    n = len(units)
    if n < rule.length:
        return none
    g = rolling(units, rule.gram)
    # the position in the low bits makes the leftmost of equal grams the anchor
    bits = np.uint64(int(n).bit_length())
    low = sliding_min((g >> bits << bits) | np.arange(len(g), dtype=np.uint64), rule.length - rule.gram + 1)
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.arange(len(at))
    row = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    ok = start + rule.length <= ends[row[: len(start)]]
    start, at = start[ok], at[ok]
    if not len(start):
        return none
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.append(new[1:], len(start)) - 1
    return start[new], start[last], at[new], g[at[new]]


def encode(texts: pa.Array, rule: Rule) -> tuple[np.ndarray, bytes, np.ndarray]:
    """The texts laid end to end: hashed units, the bytes that windows are compared by, and where each text ends (in units)."""
    if rule.unit == 1:
        t = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_binary()), b"")])
        ends = np.cumsum(pc.binary_length(t).to_numpy(zero_copy_only=False).astype(np.int64))
        blob = b"".join(t.to_pylist())
        return _BYTE[np.frombuffer(blob, np.uint8)], blob, ends
    offsets, codes, vocabulary = words(texts)
    of = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in vocabulary.cast(pa.large_binary()).to_pylist()), np.uint64, len(vocabulary))
    units = of[codes] if len(codes) else np.zeros(0, np.uint64)
    return units, units.tobytes(), offsets[1:]


# ---- the index family


class Level:
    """Distinct windows in the byte order of their first ``width`` bytes: where they start in ``raw``, their numbers and owners."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, ids: np.ndarray, owner: np.ndarray, width: int) -> None:
        self.raw, self.at, self.ids, self.owner, self.width = raw, at, ids, owner, width
        self.head = self.word(slice(None), 0)

    def __len__(self) -> int:
        return len(self.at)

    def word(self, pick, d: int) -> np.ndarray:  # noqa: ANN001
        """Bytes 8d to 8d+7 of the picked windows, as numbers in byte order."""
        at = self.at[pick] + 8 * d
        return np.lib.stride_tricks.sliding_window_view(self.raw, 8)[at].view(">u8")[:, 0].astype(np.uint64)

    def rows(self, pick: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.raw, self.width)[self.at[pick]]

    def locate(self, other: Level) -> tuple[np.ndarray, np.ndarray]:
        """For each window of ``other``, how many windows of this level are smaller, and whether the next one is equal."""
        lo = np.searchsorted(self.head, other.head, "left")
        hi = np.searchsorted(self.head, other.head, "right")
        same = np.zeros(len(other), bool)
        open_ = np.flatnonzero(lo < hi)
        for d in range(1, self.width // 8):
            # one window left: the rest is compared at once
            single = open_[hi[open_] - lo[open_] == 1]
            for part in np.array_split(single, max(1, len(single) // 8192)):
                a, b = other.rows(part), self.rows(lo[part])
                differ = a != b
                k = differ.argmax(axis=1)
                where = np.arange(len(part))
                equal = ~differ[where, k]
                same[part] = equal
                lo[part] += ~equal & (b[where, k] < a[where, k])
            open_ = open_[hi[open_] - lo[open_] > 1]
            if not len(open_):
                return lo, same
            q = other.word(open_, d)
            left, right = lo[open_], hi[open_]
            lo[open_] = self._bound(left, right, q, d, False)
            hi[open_] = self._bound(left, right, q, d, True)
            open_ = open_[lo[open_] < hi[open_]]
        same[open_] = True
        return lo, same

    def _bound(self, lo: np.ndarray, hi: np.ndarray, q: np.ndarray, d: int, after: bool) -> np.ndarray:
        """First place in lo..hi whose word ``d`` is not below (``after``: is above) q, by bisection of all at once."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            go = np.flatnonzero(lo < hi)
            if not len(go):
                return lo
            mid = (lo[go] + hi[go]) >> 1
            w = self.word(mid, d)
            up = w <= q[go] if after else w < q[go]
            lo[go[up]] = mid[up] + 1
            hi[go[~up]] = mid[~up]


class IndexFamily:
    """Levels of windows in suffix order; ``repeated()`` tells which windows occur again under another owner.

    ``MANY`` owns windows that are known to be repeated.
    """

    MANY = -1

    def __init__(self, width: int) -> None:
        self.width = width
        self.levels: list[Level] = []
        self.marks: list[np.ndarray] = []
        self.same_as: list[np.ndarray] = []
        self.count = 0

    def add(self, raw: np.ndarray, at: np.ndarray, owner: np.ndarray) -> None:
        """A batch: windows start at ``at`` in ``raw``, numbered on from the last one."""
        if not len(at):
            return
        ids = np.arange(self.count, self.count + len(at))
        self.count += len(at)
        self.marks.append(np.zeros(len(at), bool))
        self.same_as.append(ids.copy())
        self._flatten()
        # the suffix array: window starts in byte order
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, self.width)[at]).view(f"S{self.width}")[:, 0]
        order = np.argsort(suffixes, kind="stable")
        suffixes = suffixes[order]
        first = np.concatenate([[True], suffixes[1:] != suffixes[:-1]])
        del suffixes
        new = self._distinct(raw, at[order], ids[order], owner[order], first)
        for k, level in enumerate(self.levels):
            place, same = level.locate(new)
            x, y = np.flatnonzero(same), place[same]
            differ = (new.owner[x] != level.owner[y]) | (new.owner[x] == self.MANY)
            self.marks_flat[new.ids[x[differ]]] = True
            self.marks_flat[level.ids[y[differ]]] = True
            self.levels[k].owner[y[differ]] = self.MANY
            new.owner[x[differ]] = self.MANY
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self._merge(a, b))
        self.marks, self.same_as = [self.marks_flat], [self.same_flat]

    def _flatten(self) -> None:
        self.marks_flat, self.same_flat = np.concatenate(self.marks), np.concatenate(self.same_as)

    def _distinct(self, raw: np.ndarray, at: np.ndarray, ids: np.ndarray, owner: np.ndarray, first: np.ndarray) -> Level:
        """One of equal windows is kept; those of several owners are marked."""
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(at)))
        low, high = np.minimum.reduceat(owner, begin), np.maximum.reduceat(owner, begin)
        several = (low != high) | ((low == self.MANY) & (size > 1))
        self.marks_flat[ids[np.repeat(several, size)]] = True
        self.same_flat[ids] = np.repeat(ids[begin], size)
        return Level(raw, at[begin], ids[begin], np.where(several, self.MANY, low), self.width)

    def _merge(self, a: Level, b: Level) -> Level:
        """Both levels in one order; of equal windows that of ``a`` stays."""
        place, same = a.locate(b)
        self.same_flat[b.ids[same]] = a.ids[place[same]]
        keep = np.flatnonzero(~same)
        to = np.concatenate([np.arange(len(a)) + np.searchsorted(place[keep], np.arange(len(a)), "right"), place[keep] + np.arange(len(keep))])
        order = np.empty(len(to), np.int64)
        order[to] = np.arange(len(to))
        at, ids, owner = (np.concatenate([x, y[keep]])[order] for x, y in ((a.at, b.at + len(a.raw)), (a.ids, b.ids), (a.owner, b.owner)))
        return Level(np.concatenate([a.raw, b.raw]), at, ids, owner, self.width)

    def repeated(self) -> np.ndarray:
        """A flag for every window, in the order of their numbers."""
        if not self.marks:
            return np.zeros(0, bool)
        marks, same = self.marks[0], self.same_as[0]
        while True:
            up = same[same]
            if (up == same).all():
                break
            same = up
        # a window is as repeated as any that is equal to it
        out = np.zeros(len(marks), bool)
        np.logical_or.at(out, same, marks)
        return out[same]


# ---- stretches of all texts


def row_table(docs: DataFrame) -> DataFrame:
    """doc_id, text and rid, a row number, bucketed by rid, so that joins with it move the other side only."""
    spark = docs.sparkSession
    plain = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("rid")), "rows")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"palimpsest_rows_{uuid.uuid4().hex}"
    plain.repartition(buckets, "rid").sortWithinPartitions("rid").write.bucketBy(buckets, "rid").sortBy("rid").option("path", f"{work_root(spark)}/palimpsest/{name}").saveAsTable(name)
    discard(plain)
    return spark.table(name)


def _packed(first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """One long of a stretch: first window, how many more, and how far the anchor is beyond the last."""
    return (first << 20) | ((last - first) << 10) | (anchor - last)


def _unpack(span: int) -> tuple[int, int, int]:
    first, last = span >> 20, (span >> 20) + ((span >> 10) & 1023)
    return first, last, last + (span & 1023)


def find_stretches(rows: DataFrame) -> DataFrame:
    """kg (gram; its lowest bit tells the rule), c1, c2 (digest of the whole stretch), rid, span for each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rid = b.column("rid").to_numpy()
            for tag, rule in enumerate(RULES):
                units, blob, ends = encode(b.column("text"), rule)
                first, last, at, g = stretches(units, ends, rule)
                row = np.searchsorted(ends, first, "right")
                view, u = memoryview(blob), rule.unit
                ctx = b"".join(xxhash.xxh3_128_digest(view[a * u : (z + rule.length) * u]) for a, z in zip(first.tolist(), last.tolist(), strict=True))
                ctx = np.frombuffer(ctx, np.int64).reshape(-1, 2)
                begin = np.concatenate([[0], ends])[row]
                kg = ((g & ~np.uint64(1)) | np.uint64(tag)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kg, np.ascontiguousarray(ctx[:, 0]), np.ascontiguousarray(ctx[:, 1]), rid[row], _packed(first - begin, last - begin, at - begin))], ["kg", "c1", "c2", "rid", "span"])

    # a passage of the words rule may be shorter than a window of bytes; each of its words but the last has white space after it
    return rows.where(F.octet_length("text") >= min(LENGTH, 2 * PASSAGE - 1)).select("rid", "text").mapInArrow(run, "kg long, c1 long, c2 long, rid long, span long")


def _cut_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted stretches: rows (rid, text, want) to rows (route, kg, rid, first, whole, data); those of hot grams as slivers."""
    names = ["route", "kg", "rid", "first", "whole", "data"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
    for b in slices(batches, "text"):
        out: list[tuple] = []
        blobs = {}
        for tag, rule in enumerate(RULES):
            _, blob, ends = encode(b.column("text"), rule)
            blobs[tag] = memoryview(blob), np.concatenate([[0], ends])
        for k, (rid, want) in enumerate(zip(b.column("rid").to_pylist(), b.column("want").to_pylist(), strict=True)):
            for w in want:
                kg = w["kg"]
                rule, (view, begin) = RULES[kg & 1], blobs[kg & 1]
                u, base = rule.unit, int(begin[k])
                first, last, at = _unpack(w["span"])
                if not w["hot"]:
                    out.append((kg, kg, rid, first, w["whole"], bytes(view[(base + first) * u : (base + last + rule.length) * u])))
                    continue
                # windows that are equal stand equally far before the anchor, so slivers are cut at equal distances
                for c in range((at - last) // SLIVER, (at - first) // SLIVER + 1):
                    a, z = max(first, at - (c + 1) * SLIVER + 1), min(last, at - c * SLIVER)
                    core = view[(base + at - c * SLIVER) * u : (base + at - (c + 1) * SLIVER + 1 + rule.length) * u]
                    route = xxhash.xxh3_64_intdigest(core, seed=(kg + c) & 0xFFFFFFFF) - (1 << 63)
                    out.append((route, kg, rid, a, w["whole"], bytes(view[(base + a) * u : (base + z + rule.length) * u])))
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _runs(flags: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(string, first, last) of each run of set flags within a string; flags of the strings follow one another."""
    who = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(flags)
    if not len(at):
        return
    cut = np.flatnonzero((np.diff(at) > 1) | (who[at[1:]] != who[at[:-1]]))
    begin = np.cumsum(n) - n
    for a, z in zip(np.concatenate([[0], cut + 1]).tolist(), np.append(cut, len(at) - 1).tolist(), strict=True):
        s = int(who[at[a]])
        yield s, int(at[a] - begin[s]), int(at[z] - begin[s])


class _Task:
    """The index family of one rule in one task, and where its windows come from."""

    def __init__(self, rule: Rule) -> None:
        self.rule, self.family = rule, IndexFamily(rule.length * rule.unit)
        self.where: list[tuple[int, int, int]] = []
        self.n: list[int] = []
        self.held: list[tuple[bytes, int]] = []
        self.size = 0
        self.route: int | None = None

    def full(self, route: int) -> bool:
        """Whether ``route`` is a new one after enough windows: nothing to come is equal to any of these."""
        return route != self.route and self.size + self.family.count >= BATCH_WINDOWS

    def take(self, route: int, kg: int, rid: int, first: int, whole: bool, data: bytes) -> None:
        self.route = route
        n = len(data) // self.rule.unit - self.rule.length + 1
        # by the bytes rule every stretch owns its windows, by the words rule every document
        self.held.append((data, IndexFamily.MANY if whole else rid if self.rule.across else len(self.where)))
        self.where.append((kg, rid, first))
        self.n.append(n)
        self.size += n
        if self.size >= BATCH_WINDOWS:
            self.flush()

    def flush(self) -> None:
        if self.held:
            size = np.array([len(d) for d, _ in self.held], np.int64)
            n = np.array(self.n[-len(self.held) :], np.int64)
            begin = np.cumsum(size) - size
            at = np.repeat(begin, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * self.rule.unit
            owner = np.repeat(np.array([o for _, o in self.held], np.int64), n)
            self.family.add(np.frombuffer(b"".join(d for d, _ in self.held), np.uint8), at, owner)
            self.held, self.size = [], 0

    def ranges(self) -> Iterator[tuple[int, int, int, int]]:
        """(kg, rid, first, last) of repeated windows."""
        self.flush()
        for s, a, z in _runs(self.family.repeated(), np.array(self.n, np.int64)):
            kg, rid, first = self.where[s]
            yield kg, rid, first + a, first + z


def _index_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of a partition's stretches, sorted by route, by an index family for each rule and run of routes; equal windows have equal routes."""

    def report(task: _Task) -> pa.RecordBatch:
        cols = list(zip(*task.ranges(), strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["kg", "rid", "first", "last"])

    tasks = [_Task(rule) for rule in RULES]
    for b in batches:
        for route, kg, *rest in zip(*(b.column(c).to_pylist() for c in ("route", "kg", "rid", "first", "whole", "data")), strict=True):
            k = kg & 1
            if tasks[k].full(route):
                yield report(tasks[k])
                tasks[k] = _Task(RULES[k])
            tasks[k].take(route, kg, *rest)
    yield from map(report, tasks)


def repeated_windows(rows: DataFrame) -> DataFrame:
    """tag (rule), rid, first, last: ranges of window starts of a row's text whose windows occur elsewhere too."""
    key = ["kg", "c1", "c2"]
    found = materialise(find_stretches(rows), "stretches")
    # grams first: most occur once, and their stretches go no further
    often = materialise(found.groupBy("kg").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "grams")
    dup = materialise(join_by_weight(found, often, ["kg"], "m"), "repeats")
    discard(found, often)
    alike = dup.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("low"), F.max("rid").alias("high"), F.min(F.struct("rid", "span")).alias("one"))
    across = (F.col("kg").bitwiseAND(F.lit(1))) == 1
    alike = materialise(alike.withColumn("whole", (F.col("n") > 1) & (~across | (F.col("low") < F.col("high")))), "alike")
    first, more = F.shiftright("span", 20), F.shiftright("span", 10).bitwiseAND(F.lit(1023))
    whole = join_by_weight(dup, alike.where("whole").select(*key, "n"), key, "n")
    whole = whole.select("kg", "rid", first.alias("first"), (first + more).alias("last"))
    several = materialise(alike.groupBy("kg").agg(F.count(F.lit(1)).alias("nd")).where("nd > 1"), "several")
    total = several.agg(F.sum("nd")).first()[0] or 0
    hot = F.col("nd") > max(TASK_STRETCHES // 20, int(total * HOT_SHARE))
    edge = join_by_weight(alike, several.select("kg", hot.alias("hot"), "nd"), ["kg"], "nd")
    edge = materialise(edge.select("kg", "one", "whole", "hot"), "edges")
    want = edge.groupBy(F.col("one.rid").alias("rid")).agg(F.collect_list(F.struct("kg", F.col("one.span").alias("span"), "whole", "hot")).alias("want"))
    cut = rows.select("rid", "text").join(want, "rid").mapInArrow(_cut_stretches, "route long, kg long, rid long, first long, whole boolean, data binary")
    tasks = max(1, -(-total // TASK_STRETCHES), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = materialise(cut.repartition(tasks, "route").sortWithinPartitions("route").mapInArrow(_index_tasks, "kg long, rid long, first long, last long"), "indexed")
    # what holds for a stretch that stands for others within its document holds for those too
    lead = F.shiftright("one.span", 20)
    end = lead + F.shiftright("one.span", 10).bitwiseAND(F.lit(1023))
    inner = dup.join(alike.where("n > 1 AND NOT whole").select(*key, "one"), key).where("span <> one.span").select("kg", "rid", lead.alias("lead"), end.alias("end"), (first - lead).alias("shift"))
    moved = out.join(inner, ["kg", "rid"]).where("first <= end AND last >= lead").select("kg", "rid", (F.greatest("first", "lead") + F.col("shift")).alias("first"), (F.least("last", "end") + F.col("shift")).alias("last"))
    ranges = materialise(whole.unionByName(out).unionByName(moved).withColumn("tag", F.col("kg").bitwiseAND(F.lit(1)).cast("int")).drop("kg"), "ranges")
    discard(dup, alike, several, edge, out)
    return ranges


def covered(first: np.ndarray, last: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal ranges covered by the windows."""
    order = np.argsort(first, kind="stable")
    out: list[list[int]] = []
    for a, z in zip(first[order].tolist(), (last[order] + length).tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, spans (byte ranges), kept (remaining bytes), kept_sha256, n_passage_words (by the words rule)."""
    rows = row_table(docs)
    ranges = repeated_windows(rows).groupBy("rid").agg(F.collect_list(F.struct("tag", "first", "last")).alias("ranges"))
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            size, gone, spans, kept, sha, shared = [], [], [], [], [], []
            for text, marks in zip(b.column("text"), b.column("ranges"), strict=True):
                raw = bytes(text.as_buffer()) if text.is_valid else b""
                cuts: list[list[tuple[int, int]]] = [[], []]
                if marks.is_valid:
                    tag, first, last = (f.to_numpy() for f in marks.values.flatten())
                    cuts = [covered(first[tag == k], last[tag == k], rule.length) for k, rule in enumerate(RULES)]
                at, left = 0, []
                for a, z in cuts[0]:
                    left.append(raw[at:a])
                    at = z
                left = b"".join([*left, raw[at:]])
                size.append(len(raw))
                gone.append(len(raw) - len(left))
                spans.append([{"begin": a, "end": z} for a, z in cuts[0]])
                kept.append(left)
                sha.append(hashlib.sha256(left).hexdigest())
                shared.append(sum(z - a for a, z in cuts[1]))
            long_ = pa.int64()
            columns = [b.column("doc_id"), pa.array(size, long_), pa.array(gone, long_), pa.array([len(s) for s in spans], long_), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array(sha), pa.array(shared, long_)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256", "n_passage_words"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<begin:long,end:long>>, kept binary, kept_sha256 string, n_passage_words long"
    return rows.join(ranges, "rid", "left").select("doc_id", "text", "ranges").mapInArrow(run, schema)


#: Every window of every text, hashed and counted; fit for small tables.
OP8_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, p, md5(substr(h, 2 * p - 1, 800)) AS k FROM (SELECT r, h, unnest(range(1, length(h) // 2 - 398)) AS p FROM t)),
rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, p, p - coalesce(lag(p) OVER (PARTITION BY r ORDER BY p), -1000) AS gap FROM win SEMI JOIN rep USING (k)),
run AS (SELECT r, p, sum(CASE WHEN gap > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS s FROM hit),
span AS (SELECT r, s, min(p) AS a, max(p) + 400 AS z FROM run GROUP BY r, s),
cut AS (SELECT r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM span GROUP BY r),
edge AS (SELECT r, s, coalesce(lag(z) OVER (PARTITION BY r ORDER BY s), 1) AS a, a AS z FROM span UNION ALL SELECT r, max(s) + 1, max(z), 1000000000 FROM span GROUP BY r),
kept AS (SELECT e.r, string_agg(substr(h, 2 * e.a - 1, 2 * (e.z - e.a)), '' ORDER BY s) AS h FROM edge e JOIN t USING (r) GROUP BY e.r),
pass AS (SELECT r, p, md5(array_to_string(w[p:p + 50], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 49)) AS p FROM t)),
many AS (SELECT k FROM pass GROUP BY k HAVING min(r) < max(r)),
told AS (SELECT r, sum(least(51, coalesce(nxt - p, 51)))::BIGINT AS n FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS nxt FROM pass SEMI JOIN many USING (k)) GROUP BY r)
SELECT t.doc_id, (length(t.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, t.h))) AS kept_sha256, coalesce(told.n, 0)::BIGINT AS n_passage_words
FROM t LEFT JOIN cut USING (r) LEFT JOIN kept USING (r) LEFT JOIN told USING (r)
"""


def op8_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated 400-byte strings, and the words of passages of over 50 words that other documents share."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words")
