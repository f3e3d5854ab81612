"""Ranked full-text search over a weighted inverted index.

The index is two tables: postings (term, document, field, positions), stored in
folders by a hash of the term, and document lengths. A query reads only the
folders and row groups that hold its terms.

Queries: words (all must occur), "quoted phrases", pre* fixes, field: filters on a
word, phrase or bracket, AND, OR, NOT and brackets. A word with punctuation inside
(memory-safe) is a phrase of its parts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field weights of the ranking, and its two constants.
WEIGHTS = {"title": 10.0, "aliases": 6.0, "headings": 4.0, "body": 1.0, "categories": 2.0, "captions": 2.0}
K1, B = 1.2, 0.75
MAX_HITS = 100
#: Folders of the stored postings.
BUCKETS = 64


class QueryError(ValueError):
    """A query that does not follow the grammar."""


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


# ---- the index


@dataclass
class Index:
    """postings (term, ident, field, positions, bucket) and lengths (ident, len)."""

    postings: DataFrame
    lengths: DataFrame


def build_index(docs: DataFrame, ident: str, fields: dict[str, str], current: DataFrame | None = None) -> Index:
    """The index of ``docs``; ``fields`` maps columns to weighted fields. ``current`` (ident) leaves only documents that are their page's current revision."""
    if unknown := set(fields.values()) - set(WEIGHTS):
        raise ValueError(f"no weight for {sorted(unknown)}")
    if current is not None:
        docs = docs.join(current.select(ident), ident, "left_semi")
    parts = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(c)).alias("words")) for c, f in fields.items()])
    split = docs.select(F.col(ident).alias("ident"), F.explode(parts).alias("p")).select("ident", "p.field", "p.words")
    lengths = split.groupBy("ident").agg(F.sum(F.size("words")).alias("len"))
    placed = split.select("ident", "field", F.posexplode("words").alias("at", "term"))
    postings = placed.groupBy("term", "ident", "field").agg(F.sort_array(F.collect_list("at")).alias("positions"))
    return Index(postings.withColumn("bucket", _bucket(F.col("term"))), lengths)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_index(index: Index, path: str) -> None:
    """Store an index; a term's postings stand together, sorted, so that row groups can be skipped."""
    index.postings.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "term", "ident").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))


def replace_documents(index: Index, docs: DataFrame, ident: str, fields: dict[str, str]) -> Index:
    """The index after documents are indexed again: their old postings and lengths go."""
    fresh = build_index(docs, ident, fields)
    there = docs.select(F.col(ident).alias("ident")).distinct()
    old = Index(index.postings.join(there, "ident", "left_anti"), index.lengths.join(there, "ident", "left_anti"))
    return Index(old.postings.unionByName(fresh.postings), old.lengths.unionByName(fresh.lengths))


# ---- queries


@dataclass
class Leaf:
    """A phrase of words, the last of which may be a prefix, in some fields (none: all)."""

    words: list[str]
    prefix: bool = False
    fields: frozenset[str] = frozenset()


@dataclass
class Node:
    """all, any or but (the first without the second) of its parts."""

    kind: str
    parts: list = field(default_factory=list)


_LEX = re.compile(r'\s*(?:(?P<phrase>"(?:[^"]|"")*")(?P<pstar>\s*\*)?|(?P<sign>[(){}:])|(?P<word>[^\s"(){}:*]+)(?P<star>\*)?|(?P<bad>\S))')


def parse(query: str) -> Leaf | Node:
    """The tree of a query."""
    marks, at = [], 0
    while at < len(query.rstrip()):
        m = _LEX.match(query, at)
        at = m.end()
        if m["bad"]:
            raise QueryError(f"unexpected {m['bad']!r}")
        if m["sign"]:
            marks.append((m["sign"], None, False))
        elif m["phrase"]:
            marks.append(("leaf", m["phrase"][1:-1], bool(m["pstar"])))
        else:
            marks.append((m["word"] if m["word"] in ("AND", "OR", "NOT") else "leaf", m["word"], bool(m["star"])))
    place = 0

    def peek(k: int = 0) -> str | None:
        return marks[place + k][0] if place + k < len(marks) else None

    def take(kind: str) -> tuple:
        nonlocal place
        if peek() != kind:
            raise QueryError(f"{kind} expected")
        place += 1
        return marks[place - 1]

    def either() -> Leaf | Node:
        parts = [both()]
        while peek() == "OR":
            take("OR")
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("any", parts)

    def both() -> Leaf | Node:
        parts = [without()]
        while peek() not in (None, ")", "OR", "}"):
            if peek() == "AND":
                take("AND")
            parts.append(without())
        return parts[0] if len(parts) == 1 else Node("all", parts)

    def without() -> Leaf | Node:
        left = single(frozenset())
        while peek() == "NOT":
            take("NOT")
            left = Node("but", [left, single(frozenset())])
        return left

    def single(within: frozenset[str]) -> Leaf | Node:
        if peek() == "{" or (peek() == "leaf" and peek(1) == ":"):
            if peek() == "{":
                take("{")
                names = []
                while peek() != "}":
                    names.append(take("leaf")[1])
                take("}")
            else:
                names = [take("leaf")[1]]
            take(":")
            if unknown := set(names) - set(WEIGHTS):
                raise QueryError(f"no field {sorted(unknown)}")
            return single(frozenset(names))
        if peek() == "(":
            take("(")
            inner = either()
            take(")")
            return _in_fields(inner, within)
        _, text, star = take("leaf")
        words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
        if not words:
            raise QueryError(f"nothing to search for in {text!r}")
        return Leaf(words, star, within)

    tree = either()
    if place < len(marks):
        raise QueryError(f"unexpected {marks[place][0]}")
    return tree


def _in_fields(tree: Leaf | Node, names: frozenset[str]) -> Leaf | Node:
    if not names:
        return tree
    if isinstance(tree, Leaf):
        return Leaf(tree.words, tree.prefix, tree.fields & names if tree.fields else names)
    return Node(tree.kind, [_in_fields(p, names) for p in tree.parts])


def _leaves(tree: Leaf | Node) -> list[Leaf]:
    return [tree] if isinstance(tree, Leaf) else [x for p in tree.parts for x in _leaves(p)]


def search(index: Index, query: str, limit: int = 20) -> DataFrame:
    """ident, score of the best documents that match ``query``; the lower the score, the better.

    Postings of the query's words are gathered by document, phrases are found in
    their positions, and the score sums over all phrases of the query.
    """
    tree = parse(query)
    leaves = _leaves(tree)
    # a slot for each distinct word or prefix
    slots = sorted({(w, leaf.prefix and k == len(leaf.words) - 1) for leaf in leaves for k, w in enumerate(leaf.words)})
    term = F.col("term")
    hit = lambda w, prefix: term.startswith(w) if prefix else term == w
    wanted = index.postings.where(_any(hit(*s) for s in slots))
    if not any(prefix for _, prefix in slots):
        # folders of other terms are not read
        spark = index.postings.sparkSession
        numbers = sorted({r[0] for r in spark.createDataFrame([(w,) for w, _ in slots], "term string").select(_bucket(F.col("term"))).collect()})
        wanted = wanted.where(F.col("bucket").isin(numbers))
    names = sorted(WEIGHTS)
    cells = [F.flatten(F.collect_list(F.when(hit(*s) & (F.col("field") == f), F.col("positions")))).alias(f"s{k}_{f}") for k, s in enumerate(slots) for f in names]
    docs = wanted.groupBy("ident").agg(*cells)
    number = {s: k for k, s in enumerate(slots)}

    def occurrences(leaf: Leaf, f: str) -> Column:
        use = [number[w, leaf.prefix and k == len(leaf.words) - 1] for k, w in enumerate(leaf.words)]
        first, *rest = [F.col(f"s{k}_{f}") for k in use]
        return F.size(F.filter(first, lambda p: _all([F.array_contains(r, p + k) for k, r in enumerate(rest, 1)]))) if rest else F.size(first)

    freq = [sum((occurrences(leaf, f) * F.lit(WEIGHTS[f]) for f in names if not leaf.fields or f in leaf.fields), F.lit(0.0)).alias(f"f{k}") for k, leaf in enumerate(leaves)]
    counted = docs.select("ident", *freq)
    order = iter(range(len(leaves)))

    def holds(node: Leaf | Node) -> Column:
        if isinstance(node, Leaf):
            return F.col(f"f{next(order)}") > 0
        parts = [holds(p) for p in node.parts]
        return _all(parts) if node.kind == "all" else _any(parts) if node.kind == "any" else parts[0] & ~parts[1]

    matched = holds(tree)
    stats = index.lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("av"))
    having = counted.agg(*[F.count_if(F.col(f"f{k}") > 0).alias(f"d{k}") for k in range(len(leaves))])
    few = F.broadcast(stats.crossJoin(having))  # one row each
    rows = counted.where(matched).join(index.lengths, "ident").crossJoin(few)
    score = F.lit(0.0)
    for k in range(len(leaves)):
        f, d = F.col(f"f{k}"), F.col(f"d{k}")
        idf = F.greatest(F.log((F.col("n") - d + 0.5) / (d + 0.5)), F.lit(1e-6))
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("av")))
    return rows.select("ident", F.round(score, 6).alias("score")).orderBy("score", "ident").limit(min(limit, MAX_HITS))


def _any(conditions) -> Column:  # noqa: ANN001
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _all(conditions) -> Column:  # noqa: ANN001
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def bm25(docs: DataFrame, ident: str, fields: dict[str, str], query: str, limit: int = 20) -> DataFrame:
    """:func:`search` without a stored index, for small tables."""
    return search(build_index(docs, ident, fields), query, limit).withColumnRenamed("ident", ident)
