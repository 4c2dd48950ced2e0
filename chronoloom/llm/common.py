"""Helpers that several text operators share: folders, Arrow buffers, hashing, components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text that one vectorised step handles at once; bounds the memory of a Python worker.
CHUNK_BYTES = 1 << 18
# memory that a step has freed goes back to the system, as workers live on with the next steps
pa.set_memory_pool(pa.system_memory_pool())
BATCH_ROWS, BATCH_BYTES = 300, 2 << 20
#: Rows of one key that a task may get, and keys of more at most.
HEAVY, HEAVIEST = 1000, 5000
#: Paths that written() made.
SCRATCH: list[str] = []
#: What a Python worker remembers from task to task: the module that it serves, and what frees it.
REMEMBERED: list[tuple[str, Callable[[], None]]] = []
U64 = np.uint64
_BASE, _SEED = 0x9E3779B97F4A7C15 | 1, 20240229
_BYTE_VALUES = np.random.Generator(np.random.PCG64(_SEED)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}

#: Bytes that separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lean(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold BATCH_ROWS rows and BATCH_BYTES at most: texts are long, and a batch is held by the JVM and by Python at once.

    Smaller settings of the session stay.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.sub(r"\D", "", conf.get(name, None) or "0")
        if not 0 < int(now or 0) <= most:
            conf.set(name, str(most))
    return df


def turn_to(module: str) -> None:
    """Frees what a worker remembers for other modules than this one."""
    for owner, free in REMEMBERED:
        if owner != module:
            free()


def give_back() -> None:
    """Returns freed memory to the system where the C library can; workers live on and share an executor's memory with the JVM."""
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def step(make: Callable) -> Callable:
    """For functions that make what mapInArrow() runs: a task first frees what other modules' tasks left in its worker, and gives memory back at its end."""
    module = make.__module__

    @wraps(make)
    def made(*args, **kwargs):
        run = make(*args, **kwargs)

        def task(batches):
            turn_to(module)
            try:
                yield from run(batches)
            finally:
                give_back()

        return task

    return made


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where the session names none and runs on this machine alone, a temporary one of our own."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='chronoloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: later steps survive the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    SCRATCH.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """df, dealt evenly to other tasks. For what comes from a step and goes to another one: each step of a task has a Python worker of its own, and executors keep as many workers as their tasks ever had."""
    return df.hint("rebalance")


def forget(spark: SparkSession, since: int = 0) -> None:
    """Removes the tables that written() made, from the one numbered since on; what reads them can't be computed any more."""
    paths, SCRATCH[since:] = SCRATCH[since:], []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like name that df lacks."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fields(df: DataFrame, *columns: str) -> StructType:
    """The schema of some columns of df, whatever characters their names have."""
    return StructType([df.schema[c] for c in columns])


def packed(df: DataFrame) -> DataFrame:
    """df as (row, text): row has all columns but text, which unpacked() takes apart again, so their names can't clash with others."""
    others = [F.col(f"`{c}`") for c in df.columns if c != "text"]
    return df.select(F.struct(*others).alias("row"), "text")


def unpacked(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The columns of what was packed(), and some more of df."""
    return df.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns), *more)


def heavy(groups: DataFrame, *keys: str) -> DataFrame | None:
    """The keys of groups(keys, n) whose n rows are too many for one task: over HEAVY and over a HEAVIEST-th of all. There are HEAVIEST of them at most, so they may be broadcast; None if there are none."""
    total = groups.agg(F.sum("n")).first()[0] or 0
    found = written(groups.where(F.col("n") > max(HEAVY, total // HEAVIEST)).select(*keys), "heavy")
    return found if found.head(1) else None


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, many: DataFrame | None) -> DataFrame:
    """left.join(right, keys, how), for inner, left, left_semi and left_anti joins with a right side of one row a key.

    Rows of left under the keys in many, of heavy(), are dealt over as many tasks as a shuffle has, which all get the right side's row for them.
    """
    if many is None:
        return left.join(right, keys, how)
    many = F.broadcast(many)
    tasks = max(32, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = fresh(left, fresh(right, "salt"))
    rare = left.join(many, keys, "left_anti").join(right.join(many, keys, "left_anti"), keys, how)
    dealt = left.join(many, keys, "left_semi").withColumn(salt, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in left.columns)), F.lit(tasks)).cast("int"))
    copies = right.join(many, keys, "left_semi").withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    return rare.unionByName(dealt.join(copies, [*keys, salt], how).drop(salt))


def small(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows; reads no more than are needed to tell."""
    return df.limit(limit + 1).count() <= limit


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        size = max(n, 2 * CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, U64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i] the polynomial hash of data[:i]; span_hash() takes differences of it."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_VALUES[data] * powers(len(data) + 1)[0][:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they lie."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(U64))


def texts(column: pa.ChunkedArray | pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about limit bytes; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the index of its first word (one more entry at the end)."""
    full = ~SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = full[:-1], full[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(full & ~before), np.flatnonzero(full & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list column: row i takes the next counts[i] values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of the edges, the smallest node reachable from it.

    Large-star and small-star steps in turn; each writes its edges to the shared folder, so no lineage grows and nothing
    is collected. Ends when a round leaves the edges as they were (count and checksum).
    """
    now = written(edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x <> y").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        now = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        now = written(now, "large-star")
        low = now.groupBy("x").agg(F.min("y").alias("m"))
        pairs = F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))
        now = now.join(low, "x").select(F.explode(pairs).alias("e")).select("e.*").where("x <> y").distinct()
        now = written(now, "small-star")
        got = now.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if got == mark:
            return now.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(now.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())
        mark = got
