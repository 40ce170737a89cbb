"""Source files as a DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.functions.names import resolve
from rulespan.operators.skips import skipped

FILES = "file string, content binary, hash string"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """A file in any store, from the driver."""
    where, files = _file_system(spark, path)
    out = files.create(where, True)
    out.write(bytearray(content))
    out.close()


def _matches(spark: SparkSession, pattern: str):
    where, files = _file_system(spark, pattern)
    return files.globStatus(where) or ()


def hidden(spark: SparkSession, folder: str, suffix: str) -> tuple[list[str], list[str]]:
    """Files with the suffix, and folders, below ``folder`` whose names start with ``_`` or ``.``, which Spark's readers
    leave out. One listing for each depth."""
    files, folders, depth = [], [], folder.rstrip("/")
    while True:
        for status in _matches(spark, f"{depth}/[_.]*"):
            path = status.getPath().toString()
            if status.isDirectory():
                folders.append(path)
            elif path.endswith(f".{suffix}"):
                files.append(path)
        depth += "/*"
        if not len(_matches(spark, depth)):
            return files, folders


def scan(spark: SparkSession, paths: Sequence[str], *, base_path: str = "", skip: Iterable[str] = (), suffix: str = "php") -> DataFrame:
    """(file, content, hash) of all files with the suffix below the paths that aren't skipped; paths that
    aren't there are ignored, overlapping ones give each file once. The skip is applied to file names, before
    contents are used. Folders whose names start with ``_`` or ``.`` are read as paths of their own, and single
    files of such names, of which projects have few, by the driver."""
    there, alone = [], []
    for p in dict.fromkeys(resolve(p, base_path) for p in paths):
        where, system = _file_system(spark, p)
        if system.exists(where):
            more, folders = hidden(spark, p, suffix) if system.getFileStatus(where).isDirectory() else ([], [])
            single = p.rsplit("/", 1)[-1]
            if single[:1] in "_." and not system.getFileStatus(where).isDirectory():
                alone += [p] if single.endswith(f".{suffix}") else []
                continue
            there += [p, *folders]
            alone += more
    if not there and not alone:
        return spark.createDataFrame([], FILES)
    there = list(dict.fromkeys(there))
    skips = list(skip)
    files = spark.createDataFrame([], "path string, content binary")
    if there:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(there).select("path", "content")
    if alone:
        names = spark.createDataFrame([(p,) for p in dict.fromkeys(alone)], "path string").withColumn("file", F.regexp_replace("path", r"^file:/+", "/"))
        wanted = [r.path for r in (names.where(~skipped("file", skips, base_path)) if skips else names).collect()]
        files = files.unionByName(spark.createDataFrame([(p, bytearray(_content(spark, p))) for p in wanted], "path string, content binary"))
    files = files.withColumn("file", F.regexp_replace("path", r"^file:/+", "/"))
    files = files.where(~skipped("file", skips, base_path)) if skips else files
    # paths that lie in one another give a file twice
    nested = any(a != b and f"{b}/".startswith(f"{a}/") for a in there for b in there)
    files = files.dropDuplicates(["file"]) if nested or alone else files
    return files.select("file", "content", F.sha2("content", 256).alias("hash"))


def _content(spark: SparkSession, path: str) -> bytes:
    where, system = _file_system(spark, path)
    stream = system.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def in_scope(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files of the first that the second has too."""
    return files.join(wanted.select("file").distinct(), "file", "left_semi")
