"""Versioned manifests: small JSON files that publish what a table consists of.

A writer first writes its files, then publishes the next version of the
manifest, which names them.  Publishing renames a finished file to the
version's name (on a local disk: links it to that name), which fails if another
writer has taken the version, so a reader sees a whole version or the one
before, and no two writers publish the same.
Files that no version names are nobody's data.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Taken(Exception):
    """Another writer has published this version."""


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path object) of a path on any supported store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


class Manifest:
    """The versions of one table's manifest in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _name(self, version: int) -> str:
        return f"{self.folder}/v{version:012d}.json"

    def read(self) -> tuple[int, dict]:
        """The last version and its content; (0, {}) before the first."""
        fs, at = file_system(self.spark, self.folder)
        if not fs.exists(at):
            return 0, {}
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        versions = [int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")]
        if not versions:
            return 0, {}
        last = max(versions)
        _, path = file_system(self.spark, self._name(last))
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return last, json.loads(text)

    def publish(self, version: int, content: dict) -> None:
        """Make ``content`` the given version; ``Taken`` if there is one."""
        jvm = self.spark.sparkContext._jvm
        fs, folder = file_system(self.spark, self.folder)
        fs.mkdirs(folder)
        _, part = file_system(self.spark, f"{self.folder}/.{uuid.uuid4().hex}.part")
        out = fs.create(part, False)
        try:
            out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            out.close()
        _, target = file_system(self.spark, self._name(version))
        try:
            if fs.getUri().getScheme() == "file":
                # renaming goes over an existing file on a local disk; a link never does
                local = [jvm.java.nio.file.Paths.get(fs.makeQualified(x).toUri()) for x in (target, part)]
                jvm.java.nio.file.Files.createLink(*local)
                fs.delete(part, False)
            else:
                never_over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                never_over[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                    fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(
                    fs.makeQualified(part), fs.makeQualified(target), never_over)
        except Exception as e:  # the store's own error class names differ
            fs.delete(part, False)
            if fs.exists(target):
                raise Taken(self._name(version)) from e
            raise

    def change(self, step: Callable[[dict], dict], tries: int = 20) -> dict:
        """Publish ``step(content)`` as the next version, and again from the
        newer content if another writer was first."""
        for _ in range(tries):
            version, content = self.read()
            new = step(content)
            try:
                self.publish(version + 1, new)
                return new
            except Taken:
                continue
        raise Taken(f"{self.folder}: lost {tries} races")
