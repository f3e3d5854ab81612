"""Shared pieces: durable intermediate tables, word splitting, byte-bounded batches."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes and rows that one numpy step takes at a time; a longer single text is taken alone.
BATCH_BYTES, BATCH_ROWS = 4_000_000, 1_000
#: Rows and bytes of an Arrow batch on its way to and from Python; Spark's own bounds are for short rows.
ARROW_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8_000_000}


def bound_arrow(spark: SparkSession) -> None:
    """Lower the session's Arrow batch bounds to ``ARROW_BOUNDS``, so that long texts do not pile up in memory; smaller bounds stay."""
    for key, most in ARROW_BOUNDS.items():
        number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]?)[a-z]*", spark.conf.get(key).lower()).groups()
        now = int(number) << {"k": 10, "m": 20, "g": 30}.get(unit, 0)
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def release_memory() -> None:
    """Give what Arrow and numpy have freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def work_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (as in tests) a temporary
    folder is made and set; on a cluster every machine would have its own, so
    there the setting is demanded.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_root(spark)}/palimpsest/{label}-{uuid.uuid4().hex}"
    bound_arrow(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._palimpsest_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of tables that :func:`materialise` wrote and nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._palimpsest_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot if it has more than this share of all rows, so at most ``1 / HOT_SHARE`` keys are hot.
HOT_SHARE = 1 / 1000


def join_by_weight(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int | None = None, outer: bool = False) -> DataFrame:
    """Join of ``left`` with ``right`` (inner, or left outer), whose keys are unique and whose column ``weight`` counts the rows of ``left`` with that key.

    Hot keys, at most ``1 / HOT_SHARE`` of them as the weights add up to no
    more than ``total`` rows, are broadcast, so that their rows stay where they are;
    the others are shuffled. Where no total is given it is counted, and both must be tables that can be read again.
    """
    if total is None:
        total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > max(1, int(total * HOT_SHARE))
    few = F.broadcast(right.where(hot))
    cold = left.join(few.select(*on), on, "left_anti").join(right.where(~hot).drop(weight), on, "left" if outer else "inner")
    return left.join(few.drop(weight), on).unionByName(cold)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``limit`` bytes at most in each; what a batch has freed goes back to the system."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + BATCH_ROWS, int(np.searchsorted(ends, before + limit, "right"))))
            # a copy: some string kernels (ascii_lower) misread arrays whose values do not begin at the buffer's start
            yield batch.take(pa.array(np.arange(start, stop))) if start else batch.slice(0, stop)
            start = stop
        release_memory()


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: row offsets, dictionary codes, dictionary.

    A null text has no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    row = np.repeat(np.arange(len(counts)), counts)[full]
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=len(counts)), out=offsets[1:])
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``offsets``."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the given folder."""
    bound_arrow(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
