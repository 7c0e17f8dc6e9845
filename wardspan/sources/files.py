"""Small files beside the tables, through Hadoop's file systems: claims, markers and manifests."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _write(fs, place, text: str, overwrite: bool) -> None:
    stream = fs.create(place, overwrite)
    stream.write(bytearray(text.encode()))
    stream.close()


def claim_file(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create a file that must not exist yet; False if somebody else has it."""
    fs, place = _place(spark, path)
    if fs.exists(place):
        return False
    try:
        _write(fs, place, text, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
            return False
        raise
    return True


def put_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a whole file under another name and rename it, so that no reader meets half of it. The path must be free."""
    fs, place = _place(spark, path)
    _, draft = _place(spark, f"{path}.draft")
    _write(fs, draft, text, True)
    if not fs.rename(draft, place):
        raise FileExistsError(path)


def read_file(spark: SparkSession, path: str) -> str | None:
    """The text of a file, None if there is none."""
    fs, place = _place(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder, none if it does not exist."""
    fs, place = _place(spark, path)
    if not fs.exists(place):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(place))


def file_states(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """Path, size and time of last change of every file, by path; one listing per folder."""
    wanted, found = {}, []
    for path in paths:
        folder, _, name = path.rpartition("/")
        wanted.setdefault(folder, set()).add(name)
    for folder, names in wanted.items():
        fs, place = _place(spark, folder)
        for status in fs.listStatus(place):
            if status.getPath().toUri().getRawPath().rpartition("/")[2] in names or status.getPath().getName() in names:
                found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(found)
