"""Tables that change by whole commits: rows lie in buckets of a key, and a commit names the folder of each bucket.

A writer reads the commit that stands, writes the buckets it touches aside, and commits by renaming a small file to the next
number, which fails where another writer was faster. A crash before that leaves the old table as it was; readers see one
commit or the next, never parts of both. Only the buckets of the updates' keys are read and written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed first: read again and repeat."""


class VersionedTable:
    """A keyed table in a folder. The schema must not have a column `_bucket`; keys may not be null."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, *parts: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _fs(self):  # noqa: ANN202
        return self._at().getFileSystem(self._conf)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def commits(self) -> list[int]:
        if not self._fs().exists(self._at("commits")):
            return []
        return sorted(int(x.getPath().getName()) for x in self._fs().listStatus(self._at("commits")) if x.getPath().getName().isdigit())

    def current(self) -> tuple[int, dict[str, str]]:
        """The number of the last commit, 0 before any, and the folder of each bucket that has rows."""
        numbers = self.commits()
        if not numbers:
            return 0, {}
        stream = self._fs().open(self._at("commits", str(numbers[-1])))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return numbers[-1], json.loads(text)

    def read(self, only: list[int] | None = None, manifest: dict[str, str] | None = None) -> DataFrame:
        """The rows of the last commit, or of some of its buckets."""
        folders = self.current()[1] if manifest is None else manifest
        paths = [f"{self.path}/{f}" for b, f in sorted(folders.items()) if only is None or int(b) in only]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def prepare(self, updates: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> tuple[int, dict[str, str]]:
        """Writes aside what the buckets of the updates become: merge(stored rows, updates), or else updates in place of the
        stored rows of their keys. Gives the number to commit and the folders. Updates are read twice: keep them first."""
        number, folders = self.current()
        touched = sorted(r[0] for r in updates.select(self.bucket().alias("b")).distinct().collect())
        stored = self.read(touched, folders)
        if merge is None:
            new = stored.join(updates.select(self.key).distinct(), self.key, "left_anti").select(*stored.columns).unionByName(updates.select(*stored.columns))
        else:
            new = merge(stored, updates).select(*stored.columns)
        name = f"data/{uuid.uuid4().hex}"
        # a task writes few files, and none holds more than a bucket
        new.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        written = {b: f"{name}/_bucket={b}" for b in touched if self._fs().exists(self._at(name, f"_bucket={b}"))}
        kept = {b: f for b, f in folders.items() if int(b) not in touched}
        return number + 1, kept | {str(b): f for b, f in written.items()}

    def commit(self, number: int, folders: dict[str, str]) -> int:
        """Makes the folders the table; Conflict where the number has been taken meanwhile."""
        aside, goal = self._at("aside", uuid.uuid4().hex), self._at("commits", str(number))
        fs = self._fs()
        fs.mkdirs(self._at("commits"))
        out = fs.create(aside, True)
        out.write(json.dumps(folders).encode())
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(goal.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(fs.makeQualified(aside), fs.makeQualified(goal), none)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or fs.exists(goal):
                raise Conflict(f"commit {number} of {self.path} is taken") from e
            raise
        return number

    def upsert(self, updates: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> int:
        return self.commit(*self.prepare(updates, merge))

    def vacuum(self, keep: int = 2) -> int:
        """Deletes data folders that none of the last commits names; gives their number. Not while others write."""
        fs, used = self._fs(), set()
        for n in self.commits()[-keep:]:
            stream = fs.open(self._at("commits", str(n)))
            used |= {f.split("/")[1] for f in json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).values()}
            stream.close()
        old = [x.getPath() for x in fs.listStatus(self._at("data")) if x.getPath().getName() not in used] if fs.exists(self._at("data")) else []
        for p in old:
            fs.delete(p, True)
        return len(old)
