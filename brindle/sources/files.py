"""Files of a table through Hadoop's FileSystem, so that a table may lie on any storage the cluster reads."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        # every step of a dotted class name is a round trip to the JVM: look classes up once
        self._path, self._utils, self._file = self.jvm.org.apache.hadoop.fs.Path, self.jvm.org.apache.commons.io.IOUtils, self.jvm.java.io.File

    def _at(self, path: str):
        p = self._path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def list(self, path: str) -> list[tuple[str, bool, int, int]]:
        """(name, is directory, bytes, modified ms) of what is in path; nothing if there is no such path."""
        p, fs = self._at(path)
        if not fs.exists(p):
            return []
        return sorted((s.getPath().getName(), s.isDirectory(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p))

    def size(self, path: str) -> int:
        p, fs = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return self._utils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Write to a temporary name of its own, then rename to a path that isn't there yet: a reader sees nothing or the whole content."""
        p, fs = self._at(path)
        tmp = self._path(f"{path}.{uuid.uuid4().hex}.partial")
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        if fs.exists(p) or not fs.rename(tmp, p):
            fs.delete(tmp, False)
            raise FileExistsError(path)

    def create(self, path: str, text: str = "") -> bool:
        """Create a file that no one else has created: of several callers exactly one gets True."""
        p, fs = self._at(path)
        fs.mkdirs(p.getParent())
        uri = fs.makeQualified(p).toUri()
        try:
            if uri.getScheme() == "file":  # Hadoop's local file system looks first and creates then
                if not self._file(uri.getPath()).createNewFile():
                    return False
                if text:
                    self.touch(path, text)
                return True
            out = fs.create(p, False)
            out.write(bytearray(text.encode("utf-8")))
            out.close()
            return True
        except Exception as e:  # noqa: BLE001
            if fs.exists(p):
                return False
            raise e

    def spool(self, path: str, chunks: Iterable[bytes]) -> None:
        """Write a stream of bytes to a new file, a chunk at a time."""
        p, fs = self._at(path)
        out = fs.create(p, False)
        for chunk in chunks:
            out.write(bytearray(chunk))
        out.close()

    def touch(self, path: str, text: str = "") -> None:
        """Overwrite a small file of one's own, which also renews its time."""
        p, fs = self._at(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()

    def age(self, path: str) -> float:
        """Seconds since a file was written, by the storage's clock as far as this machine knows it; a missing file is ageless."""
        p, fs = self._at(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000 if fs.exists(p) else float("inf")

    def tree(self, path: str) -> list[tuple[str, int]]:
        """(path below, bytes) of all files at any depth, in order."""
        p, fs = self._at(path)
        if not fs.exists(p):
            return []
        root = fs.makeQualified(p).toString().rstrip("/") + "/"
        found, out = fs.listFiles(p, True), []
        while found.hasNext():
            s = found.next()
            out.append((s.getPath().toString()[len(root) :], s.getLen()))
        return sorted(out)

    def rename(self, a: str, b: str) -> bool:
        p, fs = self._at(a)
        return fs.rename(p, self._at(b)[0])

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def mkdirs(self, path: str) -> None:
        p, fs = self._at(path)
        fs.mkdirs(p)
