"""Shared helpers: written tables that cut lineage, word counts, and memory of Python workers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract here: runs of characters other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, conf[len("file://"):], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/") if "://" in conf else "file://" + conf.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    Cuts the lineage: a lost executor costs a reread, never a recomputation, and every later use sees
    the same rows.
    """
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text):
    """Number of words of a text column (null: 0), JVM-side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unused(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, changed where columns of the caller have them (in any case of letters)."""
    taken, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(df: DataFrame):
    """A hash of all columns of a row: rows of one hash are taken to be the same in every column."""
    cols = [F.to_json(f"`{f.name}`") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.xxhash64(F.array(*[c.isNull() for c in cols]), *cols)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20):
    """Arrow batches of so many rows and bytes at the most (one row more, for the bytes) for what runs inside:
    texts are long, and a batch is in memory on both sides."""
    names = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], str(min(int(before[names[0]]), rows) if int(before[names[0]]) > 0 else rows))
    spark.conf.set(names[1], str(size))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        pass


def task(run):
    """Wrap a function over Arrow batches so that its worker is small again after the task."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def group_task(run):
    """The same for a function over the rows of a group."""

    def wrapped(key: tuple, pdf: "pd.DataFrame") -> "pd.DataFrame":  # noqa: F821
        try:
            return run(key, pdf)
        finally:
            _release()

    return wrapped
