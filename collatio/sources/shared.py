"""The folder that driver and executors share, and small files in any file system that Spark reads."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

_OWN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where it is unset and everything is one process, an own temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="collatio-"))
            atexit.register(shutil.rmtree, _OWN[0][7:], True)
        root = _OWN[0]
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/collatio/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Makes a folder that is deleted when the driver ends."""
    fs, p = _path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file of the driver's, as it is, in the place of an older one."""
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


@contextlib.contextmanager
def create(spark: SparkSession, path: str) -> Iterator[tuple[Callable[[str], None], Callable[[str, int], None]]]:
    """A file in the place of an older one: functions that append a text, and another file's bytes from a position on, through a buffer of the JVM's."""
    fs, p = _path(spark, path)
    out = fs.create(p, True)

    def append(other: str, start: int) -> None:
        file_system, q = _path(spark, other)
        file = file_system.open(q)
        try:
            file.seek(start)
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(file, out, 1 << 20, False)
        finally:
            file.close()

    try:
        yield lambda text: out.write(bytearray(text.encode())), append
    finally:
        out.close()


def parts(spark: SparkSession, folder: str) -> list[str]:
    """Files that Spark wrote, in order, those without rows left out."""
    fs, p = _path(spark, folder)
    return sorted(x.getPath().toString() for x in fs.listStatus(p) if x.getPath().getName().startswith("part-") and x.getLen())


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    file = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(file)).decode("utf-8")
    finally:
        file.close()
