"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR_ENV = "TOKENIZER_DIR"
#: Bytes in memory up to which a written table is broadcast.
BROADCAST = 64 << 20
#: Rows of texts that go to Python at once.
ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Batches of ``ROWS`` rows go to Python where the session has Spark's default of 10,000: whole texts are in them, and JVM and worker each hold one a task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ROWS))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies: in $TOKENIZER_DIR if that is set, else in the installed package of such files."""
    if os.environ.get(TOKENIZER_DIR_ENV):
        return os.path.join(os.environ[TOKENIZER_DIR_ENV], name)
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share; a local folder only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "docquarry-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` from a table written in the shared folder: lineage is cut, and a lost executor costs only the tasks that ran on it."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    for mine in _scratch.get()[-1:]:
        mine.append(out)
    return out


#: Tables written within the scopes that are open here, a list for each; every thread has scopes of its own.
_scratch: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written within are deleted at the end, but for those that the function it gives is called with."""
    outer, mine, kept = _scratch.get(), [], []
    token = _scratch.set((*outer, mine))
    try:
        yield lambda x: kept.append(x) or x
    finally:
        _scratch.reset(token)
        discard(*[x for x in mine if not any(x is k for k in kept)])
        for around in outer[-1:]:
            around += kept


def again(table: DataFrame) -> DataFrame:
    """A written table read anew, with columns of its own, to be joined with itself."""
    return table.sparkSession.read.schema(table.schema).parquet(table._folder)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for x in tables:
        remove(x.sparkSession, x._folder)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def collected(spark: SparkSession) -> None:
    """Has the executors collect their garbage and give the heap back to the system, as ``_give_back`` does for workers. A JVM that goes on to a next job
    otherwise keeps the largest heap that it ever had, however little of it is in use, beside that job's Python workers. A task a core, so that idle executors get one each."""
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def free(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column is called so."""
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def own(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra ones can't clash with those an operator adds."""
    return df.select(*[F.col(f"`{x}`") for x in names])


def _give_back() -> None:
    """Returns freed memory to the system: workers outlive their tasks, and what a large one has freed would stay theirs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def task(run: Callable) -> Callable:
    """A function of a task's batches that gives its memory back at the end."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches: Python objects of one slice are alive at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    """Lists of n numbers as rows of doubles, from the column's buffer."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, n)


def by_length(lists: pa.Array) -> dict[int, np.ndarray]:
    """Places of a column's lists by their length."""
    size = np.asarray(lists.value_lengths())
    return {int(n): np.flatnonzero(size == n) for n in np.unique(size)}


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], list[tuple]]], schema: str, key: str = "doc_id", text: str = "text", rows: int = 256) -> DataFrame:
    """One output row for each input row, in Arrow batches.

    ``make()`` runs once a task and returns the function from a list of texts to a list of tuples for the columns after ``key``.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    full = f"`{key}` {kind}, {schema}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(full))

    def run(batches):
        f = make()
        for b in slices(batches, rows):
            out = f(b.column(1).to_pylist())
            cols = list(zip(*out)) if out else [[] for _ in range(len(arrow) - 1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), *[pa.array(c, type=arrow.field(i + 1).type) for i, c in enumerate(cols)]], schema=arrow)

    return own(df, key, text).mapInArrow(task(run), full)


def small(df: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """A written table, to be broadcast if its rows take at most ``limit`` bytes in memory; a larger one is joined by a shuffle."""
    size = F.lit(16 + 16 * len(df.columns))
    for f in df.schema:
        if f.dataType.typeName() == "array":
            size = size + 16 * F.greatest(F.size(f.name), F.lit(0))
        elif f.dataType.typeName() == "struct":
            size = size + 16 * len(f.dataType)
        elif f.dataType.typeName() in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit else df


def join_unique(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, total: int, how: str = "left", parts: int = 1024, limit: int = BROADCAST) -> DataFrame:
    """``left`` joined with the one row that ``right``, a written table, has for each ``key``, however unevenly ``left`` is spread over keys.

    ``right`` is broadcast if it takes at most ``limit`` bytes. Else: ``sizes`` has ``key`` and ``n``, the rows of ``left`` with it. Fewer than
    ``parts`` keys can hold over 1/``parts`` of all rows each; only the hashes of these come to the driver and only their rows of ``right`` are
    broadcast, so both have a proven bound, and what is left for the shuffle has no key of more than 1/``parts`` of the rows.
    """
    if limit > 0 and (whole := small(right, limit)) is not right:
        return left.join(whole, key, how)
    edge = max(1, total // parts)
    hot = [r[0] for r in sizes.where(F.col("n") > edge).select(F.xxhash64(key)).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.xxhash64(key).isin(hot)
    return left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how).unionByName(left.where(~is_hot).join(right.where(~is_hot), key, how))
