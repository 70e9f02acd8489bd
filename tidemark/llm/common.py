"""Helpers that the operators of this package share: the cluster's shared folder, files in it, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters that separate words in every operator here: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACE.encode()
#: A word, as a Java or Python pattern.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Where it is unset, a local master gets a new
    one, and a cluster an error: its executors would write to disks that others do not see."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tidemark-')}")
    return sc.getCheckpointDir().rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


#: Folders made by this driver and not yet removed.
_MADE: list[str] = []


def staged(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """What ``make`` returns, written and read back, and where it is; all folders that were made on the way are removed."""
    since = len(_MADE)
    df, path = make(), work_dir(spark, name)
    df.write.parquet(path)
    remove(spark, [p for p in _MADE[since:] if p != path])
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of ``work_dir``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        if p in _MADE:
            _MADE.remove(p)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and lost executors cost only their own tasks."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write under another name first, then move: a task that is run again replaces the file, a lost one leaves none."""
    with FileWriter(uri) as out:
        out.write(data)


class FileWriter:
    """A stream to a file that appears under its name only when it is complete."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = file_system(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def __enter__(self) -> FileWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        self.out.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)


def read_file(uri: str) -> bytes:
    fs, path = file_system(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


_KEPT: OrderedDict = OrderedDict()


def per_worker(key, make):
    """What ``make`` returns, kept in this Python worker for later tasks with the same key: a tokenizer, a cache of words. The
    last one is kept, so workers that serve one stage after another don't gather them."""
    if key not in _KEPT:
        _KEPT[key] = make()
        while len(_KEPT) > 1:
            _KEPT.popitem(last=False)
    _KEPT.move_to_end(key)
    return _KEPT[key]


def words(text: bytes | None) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` over UTF-8; bytes.split() separates at just these six characters."""
    return text.split() if text else []


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows and about so many bytes of text, so that few texts are Python objects at
    once. One text may be longer than that."""
    for batch in batches:
        text = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
        sizes = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in text), np.zeros(batch.num_rows, np.int64))
        part = np.cumsum(sizes) // most
        edges = np.flatnonzero((part[1:] != part[:-1]) | (np.arange(1, batch.num_rows) % rows == 0)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)
        del batch, text
    give_back()


def give_back() -> None:
    """Return freed memory to the system at the end of a task, for Python workers live on and hold what they once needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def filter_rows(docs: DataFrame, make: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """The rows of ``docs`` whose texts pass: rows go through Python as they are, and nothing is shuffled. ``make`` gives the
    function that tells which texts of a list stay; it is called in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in pieces(batches):
            texts = [t.decode("utf-8", "replace") if isinstance(t, bytes) else t for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).to_pylist()


def batches_of(schema: pa.Schema, columns: list) -> Iterator[pa.RecordBatch]:
    """One record batch of the columns, unless they are empty."""
    if len(columns[0]):
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, schema.types)], schema=schema)


def running_total(df: DataFrame, keys: list[str], order: str, value: str, name: str, fan: int = 1024) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same keys with a smaller ``order`` (distinct whole numbers).

    In two levels of ``fan``: no window holds all rows of a key, so a key with very many rows is no bottleneck."""
    part = df.withColumn("__part", F.floor(F.col(order) / fan))
    names = [f"__key{i}" for i in range(len(keys))]
    totals = part.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("__part").alias("__at")).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*names).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*names, "__at", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)], F.col("__part") == F.col("__at"))
    inner = Window.partitionBy(*keys, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = (F.col("__base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).cast("long")
    return part.join(totals, same).withColumn(name, total).select(*df.columns, name)
