"""Files of a database through Hadoop's FileSystem, so that any store Spark reads will do.

Hadoop's local file system starts processes (chmod, stat, readlink) for files that it
creates and renames, tens of milliseconds each; files of the driver's machine are handled here
in the same form, checksum files included.
"""

from __future__ import annotations

import os
import shutil
import struct
import zlib

from pyspark.sql import SparkSession

from ..errors import Corruption, Io, Unsupported

#: Bytes that a number of Hadoop's checksum files stands for.
CHUNK = 512


def _beside(path: str) -> str:
    """Where Hadoop keeps a local file's checksums."""
    return os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")


def _sums(data: bytes) -> bytes:
    return b"crc\0" + struct.pack(">i", CHUNK) + b"".join(struct.pack(">I", zlib.crc32(data[i : i + CHUNK])) for i in range(0, len(data), CHUNK))


def _is_sums(name: str) -> bool:
    return name.startswith(".") and name.endswith(".crc")


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)
        self.gateway = spark.sparkContext._gateway
        uri = self.fs.makeQualified(self.path("")).toUri()
        self.local = uri.getPath() if uri.getScheme() == "file" else None
        try:
            self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(self.path("")).toUri(), self.conf)
        except Exception as e:
            raise Unsupported("this file system", "files cannot be renamed over others there") from e

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _at(self, name: str) -> str:
        return os.path.join(self.local, name) if name else self.local

    def full(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        if self.local:
            return os.path.exists(self._at(name))
        return self.fs.exists(self.path(name))

    def list(self, name: str = "") -> list[str]:
        if self.local:
            return sorted(n for n in os.listdir(self._at(name)) if not _is_sums(n)) if os.path.isdir(self._at(name)) else []
        p = self.path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def size(self, name: str) -> int:
        if self.local:
            path = self._at(name)
            if not os.path.isdir(path):
                return os.path.getsize(path) if os.path.exists(path) else 0
            return sum(os.path.getsize(os.path.join(at, n)) for at, _, names in os.walk(path) for n in names if not _is_sums(n))
        p = self.path(name)
        return self.fs.getContentSummary(p).getLength() if self.fs.exists(p) else 0

    def mkdirs(self, name: str = "") -> None:
        if self.local:
            return os.makedirs(self._at(name), exist_ok=True)
        self.fs.mkdirs(self.path(name))

    def read(self, name: str) -> bytes:
        if self.local:
            with open(self._at(name), "rb") as f:
                data = f.read()
            try:
                with open(_beside(self._at(name)), "rb") as f:
                    told = f.read()
            except FileNotFoundError:
                return data
            if told[:4] == b"crc\0" and told[4:8] == struct.pack(">i", CHUNK) and told != _sums(data):
                raise Corruption(name, "checksum error")
            return data
        p = self.path(name)
        stream = self.fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """Writes a file that must not exist yet; False if it does."""
        if self.local:
            return self._create(self._at(name), data)
        try:
            out = self.fs.create(self.path(name), False)
        except Exception as e:
            if self.exists(name):
                return False
            raise Io(str(e)) from e
        try:
            out.write(bytearray(data))
            out.hsync() if hasattr(out, "hsync") else None
        finally:
            out.close()
        return True

    def _create(self, path: str, data: bytes) -> bool:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        try:
            file = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o644)
        except FileExistsError:
            return False
        except OSError as e:
            raise Io(str(e)) from e
        with os.fdopen(file, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        with open(_beside(path), "wb") as f:
            f.write(_sums(data))
        return True

    def publish(self, name: str, data: bytes) -> None:
        """Writes beside and renames over: readers and crashes see the old file or the new one, never none and never a part."""
        aside = f"{name}.new"
        self.delete(aside)
        self.create(aside, data)
        self.rename(aside, name, True)

    def rename(self, source: str, target: str, over: bool = False) -> None:
        """Renames; what exists under the target's name is replaced with ``over``, and an error without."""
        if self.local:
            return self._rename(self._at(source), self._at(target), over)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE if over else rename.NONE
        try:
            self.context.rename(self.path(source), self.path(target), how)
        except Exception as e:
            raise Io(f"cannot rename {source} to {target}: {e}") from e

    def _rename(self, source: str, target: str, over: bool) -> None:
        try:
            if not over and os.path.exists(target):
                raise FileExistsError(target)
            os.replace(source, target)
            if os.path.exists(_beside(source)):
                os.replace(_beside(source), _beside(target))
            elif os.path.exists(_beside(target)):
                os.unlink(_beside(target))
        except OSError as e:
            raise Io(f"cannot rename {source} to {target}: {e}") from e

    def delete(self, name: str) -> None:
        if self.local:
            path = self._at(name)
            if os.path.isdir(path):
                return shutil.rmtree(path)
            for p in (path, _beside(path)):
                if os.path.exists(p):
                    os.unlink(p)
            return
        self.fs.delete(self.path(name), True)

    def copy(self, name: str, to: Files, target: str | None = None) -> None:
        to.mkdirs("/".join((target or name).split("/")[:-1]))
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path(name), to.fs, to.path(target or name), False, self.conf)
