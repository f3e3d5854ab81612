"""Operator 5, MinHash near-dedup: chosen-path set similarity join.

A document's set holds its distinct word shingles. Documents with equal sets
form a class; only classes are joined.

1. Trees. Independent trees branch the classes by selected minwise tokens: a
   node picks coordinates of the MinHash signature by its own path, and its
   children are the classes that agree there. Nodes of at most ``NODE`` classes
   are compared exhaustively by signature; in larger ones all are compared with
   the first, and what is not near it branches again. What is
   still large at the last level agrees on so many tokens that it is taken as
   one candidate family. The number of trees sets the recall (:func:`recall`).
2. Candidate edges are reduced to a spanning forest in each node and joined to
   families by distributed connected components.
3. Full sets are shipped once, to the family's task, and every pair of the
   family is decided by its exact intersection. Families too large for a task
   are laid out as pairs of blocks, so no pair is left out.
4. Links give the components.

Edge cases: without words (null or empty text) the set is empty and linked with
nothing; fewer words than a shingle are one shingle; documents without an id
take part, their component is the smallest id reachable (null if there is
none); repeated rows are one class; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import discard, join_by_weight, materialise, slices, table, words

SHINGLE = 5
#: Signature length, trees, levels, and the size up to which a node is compared exhaustively.
COORDINATES, TREES, LEVELS, NODE = 64, 10, 3, 50
#: Coordinates that a large node picks for its children.
BRANCH = 2
#: Signature agreement under which a pair is no candidate: over four standard deviations below 0.8.
AGREE = 0.6
#: In a large node, agreement with its first class from which on a class joins that one's family, and from which on it branches no more.
#: By the triangle inequality a class within 0.2 of one that stops (0.3 from the first) is within 0.5 of the first: it has joined, with 0.2 to spare for the signatures' error.
JOINS, STOPS = 0.3, 0.7
#: Shingles that one verification task holds, about.
TASK_SHINGLES = 3_000_000
#: Ids that may be broadcast to pick out documents (8 bytes each); beyond, a shuffled join does it.
BROADCAST_IDS = 1_000_000


def recall(similarity: float, trees: int = TREES, levels: int = LEVELS, branch: int = BRANCH) -> float:
    """Chance that a pair meets in a leaf of at least one tree, if all its nodes above the last level are large."""
    q = 1.0
    for _ in range(levels - 1):
        q = 1 - (1 - similarity * q) ** branch
    return 1 - (1 - similarity * q) ** trees


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """The set of each text, as sorted distinct 64-bit hashes of its shingles (A-Z lower-cased)."""
    # only the words of the vocabulary, a fresh array, are lower-cased
    offsets, codes, vocabulary = words(texts)
    vocabulary = pc.ascii_lower(vocabulary)
    if not len(codes):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    w = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in vocabulary.cast(pa.large_binary()).to_pylist()), np.uint64, len(vocabulary))[codes]
    h = np.full(max(len(w) - width + 1, 0), width, np.uint64)
    for k in range(width):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - width + 1 + k])
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1]))
        elif b > a:
            s = np.array([b - a], np.uint64)
            for k in range(a, b):
                s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + w[k : k + 1])
            out.append(s)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _coordinate_hashes(seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 62, COORDINATES).astype(np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1, 1 << 62, COORDINATES).astype(np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures (int32) of the non-empty sets among ``sets``; rows of empty ones are zero."""
    out = np.zeros((len(sets), COORDINATES), np.int32)
    full = [k for k, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[k] for k in full])
    begin = np.concatenate([[0], np.cumsum([len(sets[k]) for k in full])])[:-1]
    a, b = _coordinate_hashes()
    for c in range(COORDINATES):
        out[full, c] = (np.minimum.reduceat(flat * a[c] + b[c], begin) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _child(node: Column, picks: int) -> Column:
    """Array of the children of a row's node: for each pick, the node's own choice of coordinate and the row's token there."""
    def one(k: Column) -> Column:
        c = F.pmod(F.xxhash64(node, k), F.lit(COORDINATES)).cast("int")
        return F.xxhash64(node, c, F.element_at("sig", c + 1))

    return F.transform(F.array(*[F.lit(k) for k in range(picks)]), one)


def _forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Edges (child, root) of the components that ``pairs`` make of n things; roots are the smallest numbers."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in range(n) if find(x) != x]


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of a stream sorted by ``key``, many groups at a time; a group is bounded by the caller's plan."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key)
        change = np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) if b.num_rows > 1 else np.zeros(0, int)
        first_new = 0 if held and held[-1].column(key)[-1] != keys[0] else None
        last = int(change[-1]) + 1 if len(change) else first_new
        if last is None:
            held.append(b)
            continue
        whole = [*held, b.slice(0, last)]
        if sum(x.num_rows for x in whole):
            yield pa.Table.from_batches(whole)
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _bounds(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _compare_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the signature-similar pairs of small nodes (rows sorted by node)."""
    for t in _groups(batches, "node"):
        sids = t["sid"].to_pylist()
        sig = t["sig"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)
        src, dst = [], []
        cut = _bounds(t["node"].to_numpy())
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a > 1:
                s = sig[a:b]
                alike = (s[:, None, :] == s[None, :, :]).mean(axis=2) >= AGREE
                for x, y in _forest(b - a, np.argwhere(np.triu(alike, 1))):
                    src.append(sids[a + x])
                    dst.append(sids[a + y])
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.binary()), pa.array(dst, pa.binary())], ["src", "dst"])


def candidate_edges(classes: DataFrame, trees: int = TREES, levels: int = LEVELS, node_size: int = NODE) -> DataFrame:
    """Candidate edges (src, dst) of classes (sid, sig)."""
    roots = F.transform(F.array(*[F.lit(t) for t in range(trees)]), lambda t: F.element_at(_child(F.xxhash64(F.lit("tree"), t), 1), 1))
    tokens = classes.select("sid", "sig")
    members = tokens.select("sid", F.explode(roots).alias("node"))
    out: DataFrame | None = None
    for level in range(levels):
        # counted before the signatures move: most nodes hold one class and go no further
        sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("sid").alias("first")).where("size > 1")
        # the paths of a class may meet in a node; equal rows are harmless
        # signatures are fetched only for what is left
        placed = materialise(members.join(sizes, "node").join(tokens, "sid"), f"paths{level}")
        small = placed.where(F.col("size") <= node_size).select("node", "sid", "sig").repartition("node").sortWithinPartitions("node")
        edges = small.mapInArrow(_compare_nodes, "src binary, dst binary")
        large = placed.where(F.col("size") > node_size)
        out = edges if out is None else out.unionByName(edges)
        if large.isEmpty():
            break
        # a large node's classes are compared with its first one: near families are settled here and do not multiply further down
        heads = large.where("sid = first").select("node", F.col("sig").alias("head")).dropDuplicates(["node"])
        same = F.size(F.filter(F.zip_with("sig", "head", lambda a, b: a == b), lambda x: x)) / COORDINATES
        large = materialise(large.join(heads, "node").withColumn("same", same).drop("head"), f"large{level}")
        joins = large.where("sid <> first") if level == levels - 1 else large.where((F.col("sid") != F.col("first")) & (F.col("same") >= JOINS))
        out = out.unionByName(joins.select(F.col("sid").alias("src"), F.col("first").alias("dst")))
        members = large.where(F.col("same") < STOPS).select("sid", F.explode(F.array_distinct(_child(F.col("node"), BRANCH))).alias("node"))
    return out.distinct()


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """id, root (smallest id of the component) for every id in ``edges`` (src, dst), by alternating large and small stars.

    Centres of more than ``HOT_SHARE`` of all edges are broadcast instead of shuffled; there are few.
    """
    both = lambda e: e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    sums = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first())
    e = materialise(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    before, now = None, sums(e)
    for _ in range(rounds):
        total = 2 * now[0]
        # large star: neighbours above a node go to the smallest of its neighbourhood
        near = both(e)
        low = near.groupBy("src").agg(F.min("dst").alias("m"), F.count(F.lit(1)).alias("n")).select("src", F.least("src", "m").alias("m"), "n")
        big = join_by_weight(near.where("dst > src"), low, ["src"], "n", total).select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        # small star: a node and its neighbours below go to the smallest of them
        down = materialise(big.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")), "stars")
        low = down.groupBy("src").agg(F.min("dst").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_by_weight(down, low, ["src"], "n", total).select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").unionByName(low.select("src", F.col("m").alias("dst"))).distinct()
        last, e = e, materialise(small, "edges")
        discard(last, down)
        # all stars have one centre each when the edges stop changing: compared by a sum that any change alters
        before, now = now, sums(e)
        if now == before:
            break
    else:
        raise RuntimeError("components did not settle")
    leaves = e.groupBy("src").agg(F.min("dst").alias("root")).select(F.col("src").alias("id"), "root")
    return leaves.unionByName(e.select(F.col("dst").alias("id"), F.col("dst").alias("root")).distinct().join(leaves.select("id"), "id", "left_anti"))


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Index pairs (a from left, b from right, a < b) of sets that are similar enough, by exact intersections.

    Only tokens that at least two sets hold matter. They become columns, and
    intersections are products of 0/1 matrices, block by block.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = count >= 2
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column, width = row[keep], number[column[keep]], int(shared.sum())
    begin = np.searchsorted(row, np.arange(len(sets) + 1))
    out = []
    step = 256
    for i in range(0, len(left), step):
        a = left[i : i + step]
        for j in range(0, len(right), step):
            b = right[j : j + step]
            if a[0] >= b[-1]:
                continue
            common = np.zeros((len(a), len(b)), np.float64)
            for lo in range(0, width, 1 << 16):
                hi = min(width, lo + (1 << 16))
                ma, mb = (_dense(x, begin, row, column, lo, hi) for x in (a, b))
                common += ma @ mb.T
            union = sizes[a][:, None] + sizes[b][None, :] - common
            x, y = np.nonzero((100 * common >= percent * union) & (a[:, None] < b[None, :]))
            out.append(np.stack([a[x], b[y]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _dense(rows: np.ndarray, begin: np.ndarray, row: np.ndarray, column: np.ndarray, lo: int, hi: int) -> np.ndarray:
    m = np.zeros((len(rows), hi - lo), np.float32)  # counts stay far below 2**24
    for k, r in enumerate(rows.tolist()):
        c = column[begin[r] : begin[r + 1]]
        m[k, c[(c >= lo) & (c < hi)] - lo] = 1
    return m


def _verifier(percent: int, width: int):  # noqa: ANN202
    """Links of each family: rows (task, family, side, sid, text) sorted by task and family; side -1: a whole family, else 0 or 1 of a block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "task"):
            keys = t["task"].to_numpy()
            family = t["family"].to_pylist()
            sid, side, texts = t["sid"].to_pylist(), t["side"].to_numpy(), t["text"]
            src, dst = [], []
            cut = _bounds(keys)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                order = sorted(range(a, b), key=lambda k: (family[k], sid[k]))
                at = 0
                while at < len(order):
                    stop = at
                    while stop < len(order) and family[order[stop]] == family[order[at]]:
                        stop += 1
                    mine = order[at:stop]
                    at = stop
                    sets = shingle_sets(texts.take(pa.array(mine)).combine_chunks(), width)
                    s = side[mine]
                    left, right = (np.arange(len(mine)),) * 2 if s.min() == s.max() else (np.flatnonzero(s == 0), np.flatnonzero(s == 1))
                    pairs = _linked(sets, left, right, percent)
                    if s.min() != s.max():
                        pairs = np.concatenate([pairs, _linked(sets, right, left, percent)])
                    for x, y in _forest(len(mine), pairs):
                        src.append(sid[mine[x]])
                        dst.append(sid[mine[y]])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.binary()), pa.array(dst, pa.binary())], ["src", "dst"])

    return run


def verified_links(docs: DataFrame, classes: DataFrame, families: DataFrame, percent: int, width: int, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """Spanning links (src, dst) of the families (id, root), confirmed on full sets taken from the texts."""
    members = families.select(F.col("id").alias("sid"), F.col("root").alias("family")).join(classes.select("sid", "n", "text_key"), "sid")
    members = materialise(members, "members")
    weight = members.groupBy("family").agg(F.sum("n").alias("w"), F.max("n").alias("most"))
    total = members.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-2 * total // task_shingles))
    # families within a task's bound share tasks; larger ones are cut into blocks, and blocks meet in pairs
    blocks = F.greatest(F.lit(1), F.ceil(F.col("w") * 2 / task_shingles)).cast("int")
    placed = members.join(weight.select("family", blocks.alias("g")), "family")
    block = F.pmod(F.xxhash64("sid"), F.col("g")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda o: F.struct(F.xxhash64("family", F.least(block, o), F.greatest(block, o)).alias("task"), F.when(o == block, -1).when(block < o, 0).otherwise(1).alias("side")))
    single = F.array(F.struct(F.pmod(F.xxhash64("family"), F.lit(tasks)).alias("task"), F.lit(-1).alias("side")))
    placed = placed.select("sid", "family", "text_key", F.explode(F.when(F.col("g") == 1, single).otherwise(pair)).alias("p")).select("sid", "family", "text_key", "p.task", "p.side")
    keys = placed.select("text_key").distinct()
    count = members.count()
    texts = docs.select("text").where("text IS NOT NULL").withColumn("text_key", F.xxhash64("text", F.lit(1)))
    texts = texts.join(F.broadcast(keys) if count <= BROADCAST_IDS else keys, "text_key", "left_semi").dropDuplicates(["text_key"])
    ready = texts.join(placed, "text_key").select("task", "family", "side", "sid", "text").repartition("task").sortWithinPartitions("task")
    return ready.mapInArrow(_verifier(percent, width), "src binary, dst binary")


def rooted_classes(docs: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of the documents, and per class (sid) its smallest id (low) and the root of its component."""
    sketched = materialise(sketch_documents(docs, width), "sketches")
    classes = sketched.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("low"), F.first("sig").alias("sig"), F.first("n").alias("n"), F.min("text_key").alias("text_key"))
    classes = materialise(classes, "classes")
    edges = candidate_edges(classes.select("sid", "sig"))
    families = connected_components(edges)
    links = connected_components(verified_links(docs, classes, families, percent, width))
    return sketched, classes.select("sid", "low").join(links.withColumnRenamed("id", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept. Links are pairs with 100 * intersection >= percent * union."""
    sketched, rooted = rooted_classes(docs, percent, width)
    # the smallest id of each component of classes
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    component = rooted.join(lowest, "root").select("sid", "component_id")
    out = sketched.select("doc_id", F.col("n").alias("n_shingles"), "sid").join(component, "sid", "left")
    component_id = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))


def sketch_documents(docs: DataFrame, width: int) -> DataFrame:
    """Sketches with text_key, a hash by which the text of a class is found again."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text", F.lit(1)).alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = shingle_sets(b.column("text"), width)
            sid = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            sig = signatures(sets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, COORDINATES, np.int32)), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sid, pa.binary()), lists], ["doc_id", "text_key", "n", "sid", "sig"])

    return keyed.mapInArrow(run, "doc_id long, text_key long, n long, sid binary, sig array<int>")


def keep_one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id (one without an id only if none has one).

    Rows without words are linked with nothing and stay; rows repeated in id and text count as one document.
    """
    sketched, rooted = rooted_classes(docs, percent, SHINGLE)
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    first = sketched.where("sid IS NOT NULL").groupBy("sid").agg(F.min(row).alias("first"))
    chosen = rooted.select("sid", "root").join(first, "sid").groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_key")
    wordless = sketched.where("sid IS NULL").select("doc_id", "text_key")
    # rows are known by two hashes of id and text, so that the texts move once
    marks = lambda i, t: [F.xxhash64(i, t, F.lit(k)).alias(f"_near{k}") for k in (1, 2)]
    kept = chosen.unionByName(wordless).select(*marks("doc_id", "text_key")).distinct()
    rows = docs.select("*", *marks(F.col("doc_id").cast("long"), F.xxhash64("text", F.lit(1))))
    return rows.join(kept, ["_near1", "_near2"], "left_semi").dropDuplicates(["_near1", "_near2"]).drop("_near1", "_near2")


def op5_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their near-duplicate components at 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
