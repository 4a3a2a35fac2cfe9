"""Stage tables keyed by what they were made from: a result is computed once for a set of parameters."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def key_of(parameters: Any) -> str:
    """Twelve hex digits of the parameters' canonical JSON."""
    return hashlib.blake2b(json.dumps(parameters, sort_keys=True, default=str).encode(), digest_size=16).hexdigest()[:12]


def fingerprint_file(path: str, sample_bytes: int = 1 << 20) -> str:
    """A digest of a media file's name, size, time of change and of its first and last bytes: what a re-encoded, cut or exchanged file changes, without reading all of it."""
    facts = os.stat(path)
    digest = hashlib.blake2b(json.dumps([os.path.basename(path), facts.st_size, int(facts.st_mtime)]).encode(), digest_size=16)
    with open(path, "rb") as file:
        digest.update(file.read(sample_bytes))
        if facts.st_size > sample_bytes:
            file.seek(-sample_bytes, os.SEEK_END)
            digest.update(file.read(sample_bytes))
    return digest.hexdigest()


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, fingerprint) of all files under a path of the cluster's file system, by name, size and time of change; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.substring(F.sha2(F.concat_ws("|", name, "length", F.unix_micros("modificationTime")), 256), 1, 32).alias("fingerprint"))


class Workspace:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def path(self, name: str, parameters: Any) -> str:
        return f"{self.root}/stage/{name}/key={key_of(parameters)}"

    def table(self, name: str, parameters: Any, build: Callable[[], DataFrame]) -> DataFrame:
        """The stored stage, or ``build()`` stored; an incomplete one is made again and other keys of the stage are removed."""
        path = self.path(name, parameters)
        fs, at = self._fs(f"{path}/_SUCCESS")
        if not fs.exists(at):
            folder = self._fs(f"{self.root}/stage/{name}")[1]
            build().write.mode("overwrite").parquet(path)
            for other in fs.listStatus(folder):
                if other.getPath().getName() != path.rsplit("/", 1)[1]:
                    fs.delete(other.getPath(), True)
        return self.spark.read.parquet(path)

    def write_manifest(self, payload: dict[str, Any]) -> str:
        """Writes the run's record as JSON beside the stages and returns its path."""
        path = f"{self.root}/manifest.json"
        fs, at = self._fs(path)
        out = fs.create(at, True)
        try:
            out.write(bytearray(json.dumps(payload, indent=2, default=str).encode()))
        finally:
            out.close()
        return path

    def clear(self) -> None:
        fs, at = self._fs(f"{self.root}/stage")
        fs.delete(at, True)
