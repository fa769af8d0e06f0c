"""Results on disk: keys of parameters, written tables, saved interpolations, cache upkeep."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cache_key(**parameters) -> str:
    """16 hexadecimal digits of the parameters; the order of names and of listed values does not count, nor the case of parties."""

    def canonical(name, value):
        if isinstance(value, (list, tuple, set)):
            return sorted(str(v).upper() if name == "parties" else str(v) for v in value)
        return value

    text = json.dumps({k: canonical(k, v) for k, v in parameters.items() if v is not None}, sort_keys=True, ensure_ascii=False)
    return hashlib.md5(text.encode()).hexdigest()[:16]


def key_column(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 16)


class Files:
    """The file system of a path, as Spark's own readers and writers see it: local, distributed or an object store."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.root = self._path(root)
        self.fs = self.root.getFileSystem(self.conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def folders(self, path: str) -> list[str]:
        """Names of the folders in a folder, in order; none if it is not there."""
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(path)) if s.isDirectory())

    def delete(self, path: str) -> bool:
        return self.fs.delete(self._path(path), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self._path(old), self._path(new)):
            raise OSError(f"cannot rename {old} to {new}")

    def write_text(self, path: str, text: str) -> None:
        out = self.fs.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def read_text(self, path: str) -> str:
        source = self.fs.open(self._path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode("utf-8")
        finally:
            source.close()


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _under(*parts: str) -> str:
    return "/".join([parts[0].rstrip("/"), *parts[1:]])


def write_cached(df: DataFrame, root: str, kind: str, key: str) -> DataFrame:
    """Write under a temporary name, then rename, so that a reader finds all of a table or none; returns what was written."""
    spark = df.sparkSession
    files, path, temporary = Files(spark, root), _under(root, kind, key), _under(root, kind, f".{key}-{uuid.uuid4().hex}")
    df.write.parquet(temporary)
    files.delete(path)
    files.rename(temporary, path)
    return spark.read.parquet(path)


def read_cached(spark: SparkSession, root: str, kind: str, key: str) -> DataFrame | None:
    path = _under(root, kind, key)
    return spark.read.parquet(path) if Files(spark, root).exists(_under(path, "_SUCCESS")) else None


def list_cached(root: str) -> dict[str, list[str]]:
    files = Files(_spark(), root)
    return {k: [x for x in files.folders(_under(root, k)) if not x.startswith(".")] for k in files.folders(root)}


def clean_cached(root: str, kinds: list[str] | None = None, containing: str = "") -> int:
    """Delete tables of the kinds (all by default) whose key contains a text; the number deleted."""
    files, n = Files(_spark(), root), 0
    for kind, keys in list_cached(root).items():
        for key in keys if kinds is None or kind in kinds else ():
            if containing in key:
                files.delete(_under(root, kind, key))
                n += 1
    return n


def save_result(result, path: str) -> None:
    """One table for each DataFrame of a result, and its other fields as meta.json."""
    meta = {}
    for name, value in vars(result).items():
        if isinstance(value, DataFrame):
            value.write.mode("overwrite").parquet(_under(path, name))
        else:
            meta[name] = value
    Files(_spark(), path).write_text(_under(path, "meta.json"), json.dumps({"class": type(result).__name__, "meta": meta}, default=str))


def load_result(spark: SparkSession, path: str, kind: type):
    files = Files(spark, path)
    found = json.loads(files.read_text(_under(path, "meta.json")))
    if found["class"] != kind.__name__:
        raise ValueError(f"{path} holds a {found['class']}, not a {kind.__name__}")
    tables = {n: spark.read.parquet(_under(path, n)) for n in files.folders(path)}
    return kind(**tables, **found["meta"])


def write_history(history: DataFrame, path: str) -> None:
    """The course of a fit, one row per epoch in order, as one CSV file with a header: as long as one fit."""
    history.orderBy("epoch").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
