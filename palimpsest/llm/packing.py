"""Operator 9, best-fit packing with bound-certified repacking.

Documents become token pieces once (Arrow, a tokenizer call per text). Pieces are dealt to packing partitions of bounded size and packed by
best-fit decreasing. Dual-feasible functions give a lower bound on each
partition's bins; partitions whose count exceeds it exchange the contents of
their open bins with other such partitions and pack these again, round by
round, until a round saves no bin. Each piece carries the bins and the bound of
the partition that packed it last, so every remaining gap can be seen. Full
pieces are sequences of their own and take no part.

Edge cases: a null or empty text is one piece holding only the end token;
repeated ids are separate documents; empty tables give empty results; long
texts are cut as the rule says and never shortened.
"""

from __future__ import annotations

import contextlib
import json
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import materialise, slices, table

CAPACITY = 1024
END = 2
#: Pieces that one packing partition gets, about.
PARTITION_PIECES = 8_000
#: Fixed value: the splitting pattern of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_WORKER: dict = {}


def default_tokenizer() -> str:
    """Path of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Byte strings and ids of a byte-level vocabulary file whose ids follow its merges; None for any other kind."""
    spec = json.loads(Path(path).read_text())
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(spec.get(k) for k in ("normalizer", "truncation", "padding")) and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    shown = [c for c in range(256) if 0x21 <= c <= 0x7E or (0xA1 <= c and c != 0xAD)]
    hidden = [c for c in range(256) if c not in set(shown)]
    of = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(hidden)}
    vocab = model["vocab"]
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != list(range(256, 256 + len(merged))) or len(vocab) != 256 + len(merged):
        return None
    return {bytes(of[c] for c in token): k for token, k in vocab.items()}


class TextTokenizer:
    """Token ids of whole texts, those that ``tokenizers`` gives for a vocabulary file by default, without template tokens.

    Byte-level files are run by the faster merge loop of tiktoken, which gives
    the same ids (tested over all code points); other files, texts that it refuses,
    and texts with the literal of an added token (a token of its own) by ``tokenizers``.
    """

    def __init__(self, path: str) -> None:
        self.path, self.whole, self.merge = path, None, None
        if ranks := byte_ranks(path):
            import tiktoken

            self.added = tuple(t["content"] for t in json.loads(Path(path).read_text()).get("added_tokens") or ())
            self.merge = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.merge and not any(t in text for t in self.added):
            # its splitter refuses runs of white space of about a million characters
            with contextlib.suppress(ValueError):
                return self.merge.encode_to_numpy(text, disallowed_special=())
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


def _cached_tokenizer(path: str) -> TextTokenizer:
    if path not in _WORKER:
        _WORKER[path] = TextTokenizer(path)
    return _WORKER[path]


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of all documents; only longer ones are cut, the first piece being the shorter."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _cached_tokenizer(path)
        for b in slices(batches, "text"):
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(b.column("text").cast(pa.binary())):
                ids = np.append(tok.encode((text.as_py() or b"").decode("utf-8", "replace")), end).astype("<u4")
                at, first = 0, len(ids) % capacity or capacity
                for n, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    row.append(k)
                    piece.append(n)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(ids[at:stop].tobytes()))
                    at = stop
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(v, t) for v, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64())))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins needed at least, by the two classic families of dual-feasible functions, over every useful parameter.

    The first rounds items above capacity - a up to a whole bin and drops those
    under a; the second divides by 1/k with rounding.
    """
    hist = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((hist * size).sum()) // capacity)
    for a in range(1, capacity // 2 + 1):
        f = np.where(size > capacity - a, capacity, np.where(size < a, 0, size))
        best = max(best, -(-int((hist * f).sum()) // capacity))
    for k in range(1, 33):
        scaled = (k + 1) * size
        f = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((hist * f).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each item; the open bin with the least room that still suffices is found in a bit set of room sizes."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    room_set, count = 0, 0
    for k in order.tolist():
        s = int(lengths[k])
        fit = room_set >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                room_set &= ~(1 << room)
        else:
            room, b = capacity, count
            count += 1
        bins[k] = b
        left = room - s
        if left:
            open_bins[left].append(b)
            room_set |= 1 << left
    return bins


def _packer(r: int, capacity: int) -> Callable[[pa.Table], pa.Table]:
    """Packs one partition in round ``r``; ``_done`` marks the pieces of final bins."""

    def run(frame: pa.Table) -> pa.Table:
        frame = frame.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = frame["length"].to_numpy()
        bins = best_fit_decreasing(lengths, capacity)
        used, bound = int(bins.max()) + 1, lower_bound(lengths, capacity)
        load = np.bincount(bins, lengths, used).astype(np.int64)
        order = np.argsort(bins, kind="stable")
        begin = np.concatenate([[0], np.cumsum(load)])[:-1]
        offset = np.empty(len(bins), np.int64)
        offset[order] = np.cumsum(lengths[order]) - lengths[order] - begin[bins[order]]
        number = (r << 54) + (frame["_part"][0].as_py() << 30) + bins
        out = frame.drop_columns("_part")
        for name, values in (("sequence_id", number), ("offset", offset), ("bins", np.full(len(bins), used)), ("bound", np.full(len(bins), bound)), ("_done", (used == bound) | (load[bins] == capacity))):
            out = out.append_column(name, pa.array(values))
        return out

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """Add sequence_id, offset, bins and bound to ``pieces`` (doc_id, piece, start, length, ids_crc32).

    Each round packs partitions of about ``partition_pieces`` items. A partition
    that meets its lower bound is certified and done. Any other one keeps its
    full bins and gives the contents of the rest to the next round, where
    partitions with gaps meet in new partitions, fewer of them. A round that needs as many
    bins as held its items before is the last. ``bins`` and ``bound`` are those of
    the partition that packed the piece (both 1 for full pieces): equal where certified.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    one = F.lit(1).cast("long")
    full = pieces.where(F.col("length") == capacity).select(*columns, (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), one.alias("bins"), one.alias("bound"))
    rest = pieces.where(F.col("length") < capacity).select(*columns)
    n, before, out, r = rest.count(), None, full, 0
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, bins long, bound long, _done boolean"
    while n:
        parts = max(1, -(-n // partition_pieces))
        deal = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(r)), F.lit(parts)).cast("long")
        packed = materialise(rest.withColumn("_part", deal).groupBy("_part").applyInArrow(_packer(r, capacity), schema), f"pack{r}")
        # a bin's first piece stands for it
        open_ = ~F.col("_done")
        n, used, left = packed.agg(F.count_if(open_), F.count_if(F.col("offset") == 0), F.count_if(open_ & (F.col("offset") == 0))).first()
        if before is not None and used >= before:
            return out.unionByName(packed.drop("_done"))
        out = out.unionByName(packed.where("_done").drop("_done"))
        rest, before, r = packed.where(open_).select(*columns), left, r + 1
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack all documents: one row per piece."""
    pieces = materialise(token_pieces(docs, tokenizer, capacity), "pieces")
    return pack(pieces, capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
