"""What the operators of this folder share: tables, the shared folder, UDF helpers."""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches: setting, Spark's usual value, ours.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}
#: Bytes of a worker's remembered results, about.
MEMO_BYTES = 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; where it is unset, a folder in the warehouse."""
    sc = spark.sparkContext
    set_to = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if set_to or not current.isDefined():
        set_to = set_to or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_siftwood"
        if not current.isDefined():
            sc.setCheckpointDir(set_to)
        return set_to
    return current.get()


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session's Arrow batches get bounds that suit long texts, where Spark's usual ones stand."""
    conf = df.sparkSession.conf
    for name, (usual, bound) in BATCHES.items():
        if conf.get(name) == usual:
            conf.set(name, bound)
    return df


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/siftwood-{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """What is executed meanwhile leaves no shuffle files behind: its result stands in the shared folder."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: lost executors don't bring it back to work."""
    path = scratch_path(df.sparkSession, name)
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path  # for drop_stored
    return out


def drop_stored(df: DataFrame) -> None:
    """Deletes a table made by stored(); only for one that no DataFrame given out still reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fixed(df: DataFrame) -> DataFrame:
    """df, computed once and kept by checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    with _shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that df doesn't have yet (case doesn't count)."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to write: results replace input columns of their name."""
    drop = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in drop])


def sizes(texts) -> list[str]:
    """An Arrow string array as Python strings; nulls become empty."""
    return [t or "" for t in texts.to_pylist()]


class Memo(dict):
    """Remembered results of two generations: when the younger takes half of most bytes, about, the elder goes. get() looks at both."""

    def __init__(self, most: int = MEMO_BYTES):
        super().__init__()
        self.half = self.left = most // 2
        self.elder: dict = {}

    def __missing__(self, key):
        """What the elder knows is known to the younger from then on; else None."""
        value = self.elder.get(key)
        if value is not None:
            self.keep(key, value, len(key))
        return value

    def keep(self, key, value, size: int) -> None:
        """size: bytes of key and value beyond the entry's own."""
        self.left -= size + 200
        if self.left < 0:
            self.elder = dict(self)
            self.clear()
            self.left = self.half - size - 200
        self[key] = value


_HELD: dict = {}


def worker_state(key, make: Callable[[], object]):
    """What this Python worker holds for steps of that key: a model with its memos. A worker is used again by later steps; when one with another key begins, the old state goes and its memory is given back."""
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Returns freed memory to the system, as far as the C library can."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
