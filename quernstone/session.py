"""Session helpers shared by every query."""

from __future__ import annotations

import atexit
import ctypes
import functools
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "quernstone.shipped"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it anywhere."""
    context = spark.sparkContext
    if context.getLocalProperty(_SHIPPED):
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(path.relative_to(root.parent)))
    folder = tempfile.mkdtemp(prefix="quernstone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = os.path.join(folder, "quernstone_pkg.zip")
    Path(name).write_bytes(held.getvalue())
    context.addPyFile(name)  # the driver's file server hands it out; executors don't need this path
    context.setLocalProperty(_SHIPPED, "yes")


def give_back() -> None:
    """Return freed memory to the system: Arrow's, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *forget: Callable[[], None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, whose task calls forget and gives freed memory back when it ends: Python workers are used again, and
    what each holds adds up with the executor's own memory."""

    def leaving_nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            give_back()

    return leaving_nothing


#: Bytes of text that Python reads at once.
PART = 1 << 20


def parts(batch: pa.RecordBatch | pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch | pa.Array]:
    """batch in order, in parts of PART bytes of texts at most; a longer text is a part of its own. What Python makes of a part
    is then bounded by its bytes, not by the rows that Spark puts into a batch."""
    begin, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if i > begin and held + n > PART:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    yield batch.slice(begin)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting gets a folder of its own; a cluster without one is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_dir()


@functools.cache
def _own_dir() -> str:
    """A local session's folder, removed when the process ends."""
    path = f"/tmp/checkpoints/quernstone-{os.getpid()}"
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbered folders under path that were written in full, in order."""
    if not exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = (x.getPath().getName() for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p))
    return sorted(int(n) for n in names if n.isdigit() and exists(spark, f"{path}/{n}/_SUCCESS"))


#: What cut() wrote inside each open results_only(), the innermost last.
_WRITTEN: list[list[str]] = []


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame that cut() returned, once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        _delete(df.sparkSession, files[0].rsplit("/", 1)[0])


def results_only(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """cut() of what make() returns; whatever else cut() wrote on the way is deleted then."""
    _WRITTEN.append([])
    try:
        out = make()
        before = list(_WRITTEN[-1])
        stored = cut(out, label)
        for path in before:
            _delete(out.sparkSession, path)
    finally:
        _WRITTEN.pop()
    return stored
