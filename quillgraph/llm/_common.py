"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none and the master is local (tests on one machine) a temporary folder is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quillgraph-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Spark's setting by which a query's shuffle files go when the query ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")  # once the table is written, nothing reads the shuffles that made it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


#: Most bytes of a batch between Spark and Python.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes, not only the rows, of each batch that goes to Python, unless the session bounds them further down.

    A batch of 10,000 long texts would be gigabytes.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = spark.conf.get(key, None)
    if said is None or not said.isdigit() or int(said) > BATCH_BYTES or int(said) < 1:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Return to the system what a task's end has freed: the worker process lives on for other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores in front until no column of ``df`` has that name (compared without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def arrow_type(ddl: str) -> pa.DataType:
    """The Arrow type of a struct in Spark's DDL; for the driver."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(T.StructType.fromDDL(ddl))


def append_column(df: DataFrame, inputs: list[str], name: str, dtype: T.DataType | str, make: Callable[[], Callable[..., pa.Array]]) -> DataFrame:
    """Pass all columns through and append ``name``, which replaces a column of that name (compared without case); one Arrow pass, no shuffle.

    ``dtype`` is a type, or the DDL of a struct. ``make()`` runs once in each task and returns a function from the input arrays of a batch to the new array.
    """
    dtype = T.StructType.fromDDL(dtype) if isinstance(dtype, str) else dtype
    kept = [i for i, c in enumerate(df.columns) if c.lower() != name.lower()]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(name, dtype)])
    at = [df.columns.index(c) for c in inputs]
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            if b.num_rows:
                new = fn(*(b.column(i) for i in at))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), new], names=[*(b.schema.names[i] for i in kept), name])
        del fn
        give_back()

    return df.mapInArrow(run, schema)


def residue(column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as residue 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(c.cast("string")) % modulus, F.lit(0))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, keep: Column, cap: int) -> tuple[DataFrame, tuple[float, float]]:
    """(id, label, part) of at most ``cap`` distinct labelled ids a class, the ones with the smallest hash; and what a row of either class weighs.

    Of contradictory rows for an id, label 1 counts. Rows without id or label don't count. ``part`` (0 to 5) deals the ids by
    hash: models fit parts 1 to 5 and are calibrated on part 0. The weights bring the classes back to their shares among
    all labelled ids, so a calibration means the same whether the sample is full or not.
    """
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & keep)
    one = one.groupBy(F.col(id_col).alias("_label_id")).agg(F.max(label_col).cast("int").alias("_label"))
    sizes = {r[0]: r[1] for r in one.groupBy("_label").count().collect()}
    part = F.pmod(F.xxhash64("_label_id", F.lit(12)), F.lit(6)).cast("int")
    parts = [one.where(F.col("_label") == k).orderBy(F.xxhash64("_label_id", F.lit(11)), "_label_id").limit(cap) for k in (0, 1)]
    return parts[0].unionByName(parts[1]).withColumn("_part", part), tuple(max(1.0, sizes.get(k, 0) / cap) for k in (0, 1))


#: A-Z to a-z; ASCII that is neither letter nor digit to a blank; all bytes above 0x7F stay, as parts of words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_RANDOM = np.random.default_rng(47)
_BYTE_CODES = _RANDOM.integers(1, 1 << 63, 256).astype(np.uint64)
_PLACE_CODES = _RANDOM.integers(1, 1 << 63, 256).astype(np.uint64) | np.uint64(1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text: ASCII letters in lower case, digits, and all that isn't ASCII."""
    return (text or b"").translate(WORD_BYTES).split()


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of each of ``words(text)``, without making them: sums of byte codes times place codes between blanks."""
    raw = (text or b"").translate(WORD_BYTES)
    b = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], b != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    place = np.arange(len(b)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(b)]])))
    codes = _BYTE_CODES[b] * _PLACE_CODES[place & 255]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes, dtype=np.uint64)])
    return mix(total[ends] - total[starts] + sizes.astype(np.uint64))
