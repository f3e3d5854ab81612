"""Operator 7, sharding by histogram sort (native DataFrame operations only).

Rows are ordered by (hash of the text, hash of the id). A tree of key ranges
is refined in rounds: each round counts the exact bytes and rows of every range
over all partitions, and ranges heavier than the tolerance are divided by the
next bits of the key. When none is left, the cumulative counts below the range
boundaries give the splitters of the shards, and one exchange by range puts the
rows in place. The law is ``bytes``: sizes near equal.

Equal texts have equal leading keys, so a group of them stays in one shard
unless it is heavier than the tolerance; then it is divided by id.

Edge cases: a null text has size 1 and no checksum bytes; null ids are keyed
as such; rows equal in text and id cannot be told apart by the key, stay in one
range, and are numbered in any order; an empty table gives an empty result;
the input's columns are kept, names used here are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm._common import materialise, table

SHARDS = 16
#: Ranges end up with at most 1 / (shards x FINE) of all bytes each, if keys allow.
FINE = 128
ROOT_BITS, STEP_BITS = 12, 6
#: Key bits: 64 of the text, then 64 of the id.
KEY_BITS = 128


def _ints(values: list[int]) -> Column:
    """An array literal that the optimizer folds to a constant."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def _bits(start: Column, width: int) -> Column:
    """``width`` bits of the 128-bit key (h, d) from bit ``start`` (0: the highest), never across the middle."""
    word, at = F.when(start < 64, F.col("_h")).otherwise(F.col("_d")), F.pmod(start, F.lit(64))
    take = F.least(F.lit(width), F.lit(64) - at)
    right = F.call_function("shiftrightunsigned", word, (F.lit(64) - at - take).cast("int"))
    return F.pmod(right, F.call_function("shiftleft", F.lit(1).cast("long"), take.cast("int")))


class RangeTree:
    """Key ranges as arrays over nodes: first child (or -1) and the bit where the children's bits start."""

    def __init__(self) -> None:
        n = 1 << ROOT_BITS
        self.child = [-1] * n
        self.bit = [0] * n
        self.depth = 0

    def node(self) -> Column:
        """The leaf of a row."""
        root = F.call_function("shiftrightunsigned", F.col("_h"), F.lit(64 - ROOT_BITS))
        if not self.depth:
            return root
        children, bits = _ints(self.child), _ints(self.bit)

        def down(node: Column, _: Column) -> Column:
            at = (node + 1).cast("int")
            child = F.element_at(children, at)
            return F.when(child < 0, node).otherwise(child + _bits(F.element_at(bits, at), STEP_BITS))

        return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), root, down)

    def divide(self, node: int, bit: int) -> None:
        self.child[node], self.bit[node] = len(self.child), bit
        self.child += [-1] * (1 << STEP_BITS)
        self.bit += [0] * (1 << STEP_BITS)

    def leaves(self) -> list[int]:
        """Leaves in key order."""
        out, todo = [], list(range((1 << ROOT_BITS) - 1, -1, -1))
        while todo:
            k = todo.pop()
            if self.child[k] < 0:
                out.append(k)
            else:
                todo.extend(range(self.child[k] + (1 << STEP_BITS) - 1, self.child[k] - 1, -1))
        return out


def histogram_shards(df: DataFrame, size: Column, text: Column, ident: Column, shards: int = SHARDS, fine: int = FINE) -> DataFrame:
    """``df`` with shard and slot (gapless from 0 in each shard, in key order)."""
    spark = df.sparkSession
    keyed = df.withColumn("_h", F.xxhash64(text)).withColumn("_d", F.xxhash64(ident)).withColumn("_s", size.cast("long"))
    keys = materialise(keyed.select("_h", "_d", "_s"), "shardkeys")
    tree, tolerance, done = RangeTree(), None, {}
    start_bit = dict.fromkeys(range(1 << ROOT_BITS), ROOT_BITS)
    pending: DataFrame = keys
    while True:
        # a sum per range; at most 4096 + 64 x (heavy ranges) rows come back, and heavy ranges are bounded by the tolerance
        counted = pending.groupBy(tree.node().alias("node")).agg(F.sum("_s").alias("b"), F.count(F.lit(1)).alias("n"), F.min("_h").alias("h0"), F.max("_h").alias("h1"), F.min("_d").alias("d0"), F.max("_d").alias("d1"))
        rows = {r["node"]: r for r in counted.collect()}
        done.update({k: (r["b"], r["n"]) for k, r in rows.items()})
        if tolerance is None:
            total = sum(b for b, _ in done.values())
            tolerance = max(1, total // (shards * fine))
        heavy = []
        for k, r in rows.items():
            if r["b"] <= tolerance or (r["h0"], r["d0"]) == (r["h1"], r["d1"]):
                continue
            bit = start_bit[k] if r["h0"] != r["h1"] else max(start_bit[k], 64)
            base, lo, hi = (0, r["h0"], r["h1"]) if bit < 64 else (64, r["d0"], r["d1"])
            # skip the bits on which all keys of the range agree
            differ = (lo ^ hi) & ((1 << 64) - 1)
            bit = max(bit, base + 64 - differ.bit_length())
            if bit < KEY_BITS:
                heavy.append((k, bit))
        if not heavy:
            break
        for k, bit in heavy:
            done.pop(k)
            first = len(tree.child)
            tree.divide(k, bit)
            nxt = bit + STEP_BITS if bit % 64 + STEP_BITS <= 64 else (bit // 64 + 1) * 64
            start_bit.update(dict.fromkeys(range(first, first + (1 << STEP_BITS)), nxt))
        tree.depth += 1
        before = len(tree.child) - (len(heavy) << STEP_BITS)
        pending = keys.where(tree.node() >= before)  # new ranges have the highest numbers
    # shards from the cumulative bytes at each range's middle; slots from the exact rows before the range in its shard
    shard_of, offset_of, below, rows_in = [0] * len(tree.child), [0] * len(tree.child), 0, [0] * shards
    for k in tree.leaves():
        b, n = done.get(k, (0, 0))
        s = min(shards - 1, (2 * below + b) * shards // (2 * max(total, 1)))
        shard_of[k], offset_of[k] = s, rows_in[s]
        below += b
        rows_in[s] += n
    at = (F.col("_node") + 1).cast("int")
    # one exchange: ranges are dealt out and each is numbered on its own
    place = F.row_number().over(Window.partitionBy("_node").orderBy("_h", "_d", ident))
    out = keyed.withColumn("_node", tree.node()).withColumn("_place", place)
    out = out.withColumn("shard", F.element_at(_ints(shard_of), at).cast("int")).withColumn("slot", F.element_at(_ints(offset_of), at) + F.col("_place") - 1)
    return out.drop("_h", "_d", "_s", "_node", "_place")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.encode("text", "UTF-8")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.crc32(F.encode(F.lit(""), "UTF-8"))).alias("text_crc32"),
        F.xxhash64("text").alias("text_key"),
    )
    out = histogram_shards(slim, F.col("size"), F.col("text_key"), F.col("doc_id"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes."""
    return shard_documents(table(spark, sf_dir, "documents"))
