"""Small files through Spark's file systems, so any store that Spark reads will do."""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import EngineError


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def read_json(self, path: str) -> dict | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write_json(self, path: str, value: dict) -> None:
        """Written beside its place, then moved there in one step."""
        self._moved(path, value, "OVERWRITE")

    def create_json(self, path: str, value: dict) -> bool:
        """As write_json, but False where the name is taken: of several writers one gets it, on file systems whose rename
        refuses an existing name in one step (HDFS does)."""
        try:
            self._moved(path, value, "NONE")
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def _moved(self, path: str, value: dict, how: str) -> None:
        fs, p = self._at(path)
        _, tmp = self._at(f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}")
        stream = fs.create(tmp, True)
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self._conf)
        option = getattr(self._jvm.org.apache.hadoop.fs.Options.Rename, how)
        options = self._jvm.java.lang.reflect.Array.newInstance(option.getClass(), 1)
        options[0] = option
        try:
            context.rename(tmp, p, options)
        except Py4JJavaError:
            fs.delete(tmp, False)
            raise

    def old_names(self, path: str, grace_ms: int) -> list[str]:
        """Names whose last change is at least grace_ms ago."""
        fs, p = self._at(path)
        now = self._jvm.System.currentTimeMillis()
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if now - s.getModificationTime() >= grace_ms) if fs.exists(p) else []

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def copy(self, source: str, to: str) -> None:
        fs, p = self._at(source)
        fs2, q = self._at(to)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, fs2, q, False, True, self._conf)


class Commits:
    """Numbered manifests in path/commits: the last one holds, and each number is taken by one writer only."""

    def __init__(self, files: Files, path: str):
        self.files, self.at = files, f"{path}/commits"

    def latest(self) -> dict | None:
        names = [n for n in self.files.names(self.at) if not n.startswith(("_", "."))]
        return self.files.read_json(f"{self.at}/{names[-1]}") if names else None

    def follow(self, manifest: dict) -> dict:
        """Commits a manifest that was made from the last one, under the next number."""
        m = manifest | {"commit": manifest["commit"] + 1}
        if not self.files.create_json(f"{self.at}/{m['commit']:012d}.json", m):
            raise EngineError("StoreBusy", "another writer has committed")
        return m
