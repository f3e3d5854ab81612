"""Content objects: identities, stored copies, packs with deltas, and what may be given up.

An archive's objects are rows; a pack is a bounded group of them whose entries
are whole or a delta against one of the entries before it.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

#: Bounds of a pack and of the choice of deltas.
MOST_OBJECTS, MOST_BYTES = 256, 512 << 20
LOOK_BACK, MOST_DEPTH, LEAST_SAVING = 16, 8, 16
#: Bytes of an entry's header and of a delta's.
ENTRY_HEADER, DELTA_HEADER = 84, 16
DOMAIN = "palimpsest-object"

ENTRIES = "pack long, position int, ident long, digest string, whole_bytes long, encoding string, base_ident long, depth int, payload binary"
DELTA = StructType().add("start", LongType()).add("end", LongType()).add("delta_bytes", LongType()).add("digest", StringType())
CHECKED = "pack long, position int, ident long, restored boolean"


def _length_bytes(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def object_id(content: Column, kind: int = 1) -> Column:
    """Identity of content of one kind: SHA-256 over domain, kind and length before the content, so that no content passes for another kind's."""
    raw = content.cast("binary")
    head = F.concat(F.lit(DOMAIN.encode()), F.lit(bytes([kind])), _length_bytes(F.octet_length(raw)))
    return F.concat(F.lit("o256:"), F.sha2(F.concat(head, raw), 256))


def put(store: DataFrame, offered: DataFrame, ident: str, kind: str, size: str) -> DataFrame:
    """What becomes of each distinct offered object: stored, existing, or conflict (the id is there with another kind or size)."""
    old = store.groupBy(ident).agg(F.first(F.struct(kind, size)).alias("_old"))
    fresh = offered.select(ident, kind, size).distinct().join(old, ident, "left")
    outcome = F.when(F.col("_old").isNull(), "stored").when(F.struct(kind, size).eqNullSafe(F.col("_old")), "existing").otherwise("conflict")
    return fresh.select(ident, kind, size, outcome.alias("outcome"))


def usable_locations(locations: DataFrame, packs: DataFrame) -> DataFrame:
    """Verified copies (object, pack, location, verified); a pack's only if the pack (pack, generation, verified) is verified too; loose ones have a null pack."""
    good = packs.where("verified").select("pack", "generation")
    return locations.where("verified").drop("verified").join(good, "pack", "left").where("pack IS NULL OR generation IS NOT NULL")


def best_location(usable: DataFrame) -> DataFrame:
    """For each object the copy to read first: a packed one, of the newest generation, the newest location; and how many there are."""
    order = F.struct(F.col("pack").isNotNull(), F.coalesce("generation", F.lit(-1)), F.col("location"))
    return usable.groupBy("object").agg(F.max_by(F.struct("pack", "location"), order).alias("_b"), F.count(F.lit(1)).alias("copies")).select("object", F.col("_b.pack").alias("pack"), F.col("_b.location").alias("location"), "copies")


def read_verified(copies: DataFrame, ident: str, digest: str, content: str, order: list[str]) -> DataFrame:
    """For each object the first copy, in ``order``, whose content has the object's digest; outcome ``corrupt`` where none has."""
    good = F.sha2(F.col(content).cast("binary"), 256) == F.col(digest)
    best = F.min_by(F.when(good, F.struct(*order)), F.when(good, F.struct(*order)))
    read = copies.groupBy(ident).agg(best.alias("_b"), F.count_if(~good).alias("bad_copies"))
    return read.select(ident, *[F.col(f"_b.{c}").alias(c) for c in order], "bad_copies", F.when(F.col("_b").isNull(), "corrupt").otherwise("read").alias("outcome"))


def next_pack(usable: DataFrame, sizes: DataFrame, most: int = MOST_OBJECTS, budget: int = MOST_BYTES) -> DataFrame:
    """Objects of the next pack: loose ones without a packed copy, the oldest location first, up to ``most`` and, added up, ``budget`` bytes.

    The count bounds the rows before the running sum, which one task then forms.
    """
    loose = usable.where("pack IS NULL").groupBy("object").agg(F.min("location").alias("oldest"))
    waiting = loose.join(usable.where("pack IS NOT NULL").select("object"), "object", "left_anti")
    first = waiting.join(sizes.select("object", "bytes"), "object").orderBy("oldest", "object").limit(most)
    running = F.sum("bytes").over(Window.orderBy("oldest", "object"))
    return first.withColumn("running", running).where(F.col("running") <= budget)


def prunable(usable: DataFrame) -> DataFrame:
    """Loose copies that a packed one makes needless: their state becomes obsolete, others stay as they are."""
    packed = usable.where("pack IS NOT NULL").select("object", F.lit(True).alias("_packed")).distinct()
    rows = usable.where("pack IS NULL").join(packed, "object", "left")
    return rows.select("object", "location", F.when(F.col("_packed"), "obsolete").otherwise("verified").alias("state"))


def retirement(usable: DataFrame) -> DataFrame:
    """Each pack with its objects and whether it may go: all of them have a verified copy elsewhere."""
    packed = usable.where("pack IS NOT NULL").select("object", "pack").distinct()
    homes = packed.groupBy("object").agg(F.count(F.lit(1)).alias("_packs")).join(usable.where("pack IS NULL").select("object", F.lit(True).alias("_loose")).distinct(), "object", "left")
    rows = packed.join(homes, "object")
    return rows.groupBy("pack").agg(F.count(F.lit(1)).alias("objects"), F.bool_and((F.col("_packs") > 1) | F.coalesce("_loose", F.lit(False))).alias("may_go"))


def shared_ends(base: bytes, target: bytes) -> tuple[int, int]:
    """Lengths of the common start and, behind it, of the common end."""
    m = min(len(base), len(target))
    a, b = np.frombuffer(base, "u1"), np.frombuffer(target, "u1")
    differ = a[:m] != b[:m]
    start = int(differ.argmax()) if differ.any() else m
    rest = m - start
    differ = a[len(a) - rest :][::-1] != b[len(b) - rest :][::-1]
    return start, int(differ.argmax()) if differ.any() else rest


def make_delta(base: bytes, target: bytes) -> bytes:
    """The target's middle behind two big-endian lengths: those of its start and its end in the base."""
    start, end = shared_ends(base, target)
    return struct.pack(">QQ", start, end) + target[start : len(target) - end]


def restore(base: bytes, delta: bytes, size: int) -> bytes:
    """The target of a delta; an error where it does not fit its base or the expected size."""
    if len(delta) < DELTA_HEADER:
        raise ValueError("delta is cut short")
    start, end = struct.unpack(">QQ", delta[:DELTA_HEADER])
    if start + end > len(base):
        raise ValueError("delta exceeds its base")
    out = base[:start] + delta[DELTA_HEADER:] + base[len(base) - end :]
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes, {size} expected")
    return out


@F.pandas_udf(DELTA)
def delta_of(base: pd.Series, target: pd.Series) -> pd.DataFrame:
    """Shared start and end, the delta's size, and the SHA-256 of what it restores; nulls give nulls."""
    out = []
    for b, t in zip(base, target, strict=True):
        if b is None or t is None:
            out.append((None, None, None, None))
            continue
        b, t = b.encode(), t.encode()
        delta = make_delta(b, t)
        out.append((*struct.unpack(">QQ", delta[:DELTA_HEADER]), len(delta), hashlib.sha256(restore(b, delta, len(t))).hexdigest()))
    frame = pd.DataFrame(out, columns=["start", "end", "delta_bytes", "digest"])
    return frame.astype({"start": "Int64", "end": "Int64", "delta_bytes": "Int64"})


def _encode_pack(rows: pd.DataFrame) -> pd.DataFrame:
    press = zstandard.ZstdCompressor(level=3).compress
    rows = rows.sort_values("ident", kind="stable")
    done: list[tuple] = []
    contents: list[bytes] = []
    for k, (pack, ident, digest, content) in enumerate(zip(rows["pack"], rows["ident"], rows["digest"], rows["content"], strict=True)):
        best = ("whole", None, 0, press(content))
        for j in range(max(0, k - LOOK_BACK), k):
            depth = done[j][7]
            if depth < MOST_DEPTH and len(payload := press(make_delta(contents[j], content))) + LEAST_SAVING < len(best[3]):
                best = ("delta", done[j][2], depth + 1, payload)
        contents.append(content)
        done.append((pack, k, ident, digest, len(content), *best))
    return pd.DataFrame(done, columns=["pack", "position", "ident", "digest", "whole_bytes", "encoding", "base_ident", "depth", "payload"]).astype({"base_ident": "Int64"})


def pack_entries(objects: DataFrame) -> DataFrame:
    """Entries of packs, from rows (pack, ident, content): each whole or a compressed delta against one of the 16 entries
    before it, whichever is smallest by more than 16 bytes, chains at most eight deep.

    A pack's objects meet in one task, so packs must be within the bounds of ``next_pack``; nulls count as empty.
    """
    raw = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    rows = objects.select(F.col("pack").cast("long").alias("pack"), F.col("ident").cast("long").alias("ident"), F.sha2(raw, 256).alias("digest"), raw.alias("content"))
    return rows.groupBy("pack").applyInPandas(_encode_pack, ENTRIES)


def laid_out(entries: DataFrame) -> DataFrame:
    """Entries with their offset and length in the pack's file."""
    size = F.octet_length("payload").cast("long") + ENTRY_HEADER
    before = Window.partitionBy("pack").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("length", size).withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)))


def layout_problems(placed: DataFrame) -> DataFrame:
    """Entries (pack, position, offset, length) that do not begin where the one before them ends."""
    w = Window.partitionBy("pack").orderBy("position")
    expected = F.coalesce(F.lag(F.col("offset") + F.col("length")).over(w), F.lit(0))
    return placed.select("pack", "position", "offset", expected.alias("expected")).where("offset <> expected")


def _decode_pack(rows: pd.DataFrame) -> pd.DataFrame:
    expand = zstandard.ZstdDecompressor().decompress
    rows = rows.sort_values("position", kind="stable")
    known: dict[int, tuple[bytes, int]] = {}
    out = []
    for e in rows.itertuples(index=False):
        good = False
        try:
            content, depth = expand(e.payload), 0
            if e.encoding == "delta":
                base, depth = known[int(e.base_ident)]
                content, depth = restore(base, content, int(e.whole_bytes)), depth + 1
            good = depth == e.depth and depth <= MOST_DEPTH and len(content) == e.whole_bytes and hashlib.sha256(content).hexdigest() == e.digest
        except (KeyError, ValueError, TypeError, zstandard.ZstdError):
            pass
        if good:
            known[int(e.ident)] = content, depth
        out.append((e.pack, e.position, e.ident, good))
    return pd.DataFrame(out, columns=["pack", "position", "ident", "restored"])


def verify_entries(entries: DataFrame) -> DataFrame:
    """Each entry with whether it is restored, from bases before it only, to the content of its digest."""
    return entries.groupBy("pack").applyInPandas(_decode_pack, CHECKED)


def pack_report(entries: DataFrame) -> DataFrame:
    """For each pack its objects, their whole bytes, how many are restored, and whether it is sound (restored whole, laid out without gaps)."""
    gaps = layout_problems(laid_out(entries)).groupBy("pack").agg(F.count(F.lit(1)).alias("_gaps"))
    sums = entries.groupBy("pack").agg(F.count(F.lit(1)).alias("objects"), F.sum("whole_bytes").alias("whole_bytes"))
    good = verify_entries(entries).groupBy("pack").agg(F.count_if("restored").alias("restored"))
    rows = sums.join(good, "pack").join(gaps, "pack", "left")
    return rows.select("pack", "objects", "whole_bytes", "restored", ((F.col("restored") == F.col("objects")) & F.col("_gaps").isNull()).alias("sound"))
