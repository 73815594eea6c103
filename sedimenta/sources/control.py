"""Small control files through Spark's own file systems: JSON documents, exclusive
creation, pointers that advance by compare-and-swap."""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import Refused, StaleBase


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _at(self, name: str):
        p = self._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self._conf), p

    def exists(self, name: str) -> bool:
        fs, p = self._at(name)
        return fs.exists(p)

    def read(self, name: str) -> Any:
        fs, p = self._at(name)
        stream = fs.open(p)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def create(self, name: str, value: Any) -> bool:
        """Writes a new file; False if the name is taken.  Of several writers one wins: on a
        local file system by a hard link to a file written whole, elsewhere by a creation
        that may not overwrite, which HDFS and object stores with conditional puts decide."""
        data = bytearray(json.dumps(value, sort_keys=True, ensure_ascii=False).encode())
        fs, p = self._at(name)
        if fs.exists(p):
            return False
        if fs.getScheme() == "file":
            return self._link(fs, p, data)
        try:
            out = fs.create(p, False)
        except Py4JJavaError as error:
            if fs.exists(p):
                return False
            raise error
        out.write(data)
        out.close()
        return True

    def _link(self, fs, p, data: bytearray) -> bool:
        part = self._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}.part")
        out = fs.create(part, False)
        out.write(data)
        out.close()
        local = lambda x: self._jvm.java.nio.file.Path.of(x.toUri().getPath(), self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("java.lang.String"), 0))
        try:
            self._jvm.java.nio.file.Files.createLink(local(p), local(part))
            return True
        except Py4JJavaError as error:
            if fs.exists(p):
                return False
            raise error
        finally:
            fs.delete(part, False)

    def names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().endswith(".part")) if fs.exists(p) else []

    def delete(self, name: str) -> None:
        fs, p = self._at(name)
        fs.delete(p, True)

    # --- pointers -----------------------------------------------------------------

    def current(self, pointer: str) -> str | None:
        versions = self.names(f"pointers/{pointer}")
        return self.read(f"pointers/{pointer}/{versions[-1]}")["target"] if versions else None

    def advance(self, pointer: str, target: str, expected: str | None) -> None:
        """Moves a pointer that still names ``expected``.  Each version is a file of its own,
        created exclusively, so of two writers one fails."""
        versions = self.names(f"pointers/{pointer}")
        now = self.read(f"pointers/{pointer}/{versions[-1]}")["target"] if versions else None
        if now != expected or not self.create(f"pointers/{pointer}/{len(versions):08d}.json", {"target": target, "after": now}):
            raise StaleBase(f"{pointer} no longer names {expected}")


def digest(value: Any) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def require(condition: bool, what: str) -> None:
    if not condition:
        raise Refused(what)
