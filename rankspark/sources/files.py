"""Small files and folders on whatever file system a path names (local, HDFS, object stores), through Spark."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession


def _at(path: str):
    spark = SparkSession.active()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(path: str) -> bool:
    files, at = _at(path)
    return files.exists(at)


def names(path: str, folders: bool = False) -> list[str]:
    """Names in a folder, in order; of folders only, if asked for.  A missing folder has none."""
    files, at = _at(path)
    if not files.exists(at):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(at) if s.isDirectory() or not folders)


def age(path: str) -> float:
    """Seconds since a file or folder changed."""
    files, at = _at(path)
    return time.time() - files.getFileStatus(at).getModificationTime() / 1000


def delete(path: str) -> None:
    files, at = _at(path)
    files.delete(at, True)


def rename(path: str, new: str) -> None:
    files, at = _at(path)
    if not files.rename(at, _at(new)[1]):
        raise OSError(f"cannot rename {path} to {new}")


def make_folder(path: str) -> None:
    files, at = _at(path)
    files.mkdirs(at)


def read_text(path: str) -> str:
    files, at = _at(path)
    stream = files.open(at)
    try:
        return bytes(SparkSession.active()._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """The file with this text, by way of a second file: a failed write leaves the old one."""
    new = f"{path}.new-{uuid.uuid4().hex}"
    files, at = _at(new)
    stream = files.create(at, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if exists(path):
        delete(path)
    rename(new, path)
