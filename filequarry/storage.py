"""Files on any storage that Spark reads, by Hadoop's file systems; for what the driver does itself."""

from __future__ import annotations

import contextlib
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


class Storage:
    """Paths of one file system, that of ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        fs = self._path(path).getFileSystem(conf)
        # without checksum files, which would forbid other programs to change a table
        self._fs = self._jvm.org.apache.hadoop.fs.FileSystem.getLocal(conf).getRaw() if fs.getUri().getScheme() == "file" else fs

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def is_dir(self, path: str) -> bool:
        p = self._path(path)
        return self._fs.exists(p) and self._fs.getFileStatus(p).isDirectory()

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def rename(self, old: str, new: str) -> None:
        """Fails if there is something at the new path."""
        if self.exists(new) or not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"cannot rename {old} to {new}")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def matching(self, pattern: str) -> list[str]:
        return sorted(str(s.getPath()) for s in self._fs.globStatus(self._path(pattern)) or ())

    def write(self, path: str, raw: bytes) -> None:
        out = self._fs.create(self._path(path), True)
        try:
            out.write(bytearray(raw))
        finally:
            out.close()

    def join(self, parts: list[str], path: str, head: str, tail: str, cut: int = 0, packed: bool = False, of: Storage | None = None) -> None:
        """Files one after the other, with a head and a tail, by streams; ``cut`` bytes at the end of the last one go. ``of`` has the parts."""
        of = of or self
        sizes = [of.size(p) for p in parts]
        out = self._fs.create(self._path(path), True)
        out = self._jvm.java.util.zip.GZIPOutputStream(out) if packed else out
        try:
            out.write(bytearray(head.encode()))
            for i, (part, size) in enumerate(zip(parts, sizes, strict=True)):
                inp = of._fs.open(of._path(part))
                try:
                    self._jvm.org.apache.commons.io.IOUtils.copyLarge(inp, out, 0, size - (cut if i == len(parts) - 1 else 0))
                finally:
                    inp.close()
            out.write(bytearray(tail.encode()))
        finally:
            out.close()

    def size(self, path: str) -> int:
        return self._fs.getFileStatus(self._path(path)).getLen()

    @contextlib.contextmanager
    def on_disk(self, path: str) -> Iterator[str]:
        """A plain path of the file: its own, or that of a copy."""
        if self._fs.getUri().getScheme() == "file":
            yield self._path(path).toUri().getPath()
            return
        with tempfile.TemporaryDirectory() as d:
            self._fs.copyToLocalFile(False, self._path(path), self._path(f"file://{d}/part"), True)
            yield f"{d}/part"

    def put_in_place(self, new: str, path: str, old: str) -> None:
        """Move ``new`` to ``path``. What was there waits at ``old`` until that is done, and comes back if it fails."""
        there = self.exists(path)
        if there:
            self.rename(path, old)
        try:
            self.rename(new, path)
        except BaseException:
            if there:
                self.rename(old, path)
            raise
        if there:
            self.delete(old)

    @contextlib.contextmanager
    def locked(self, path: str, patience: float = 60.0) -> Iterator[None]:
        """Hold a lock file that only one process can create; TimeoutError if another holds it for longer than that."""
        until = time.monotonic() + patience
        while True:
            with contextlib.suppress(Exception):  # file systems differ in how they tell that the file is there
                if self._fs.createNewFile(self._path(path)):
                    break
            if time.monotonic() > until:
                raise TimeoutError(f"{path} is held; remove it if no other process changes the table")
            time.sleep(0.1)
        try:
            yield
        finally:
            self.delete(path)


def beside(path: str, mark: str, ending: str = "") -> str:
    """A hidden path in the same folder, which no reader of the folder sees."""
    head, slash, name = path.rstrip("/").rpartition("/")
    return f"{head}{slash}.{name}.{mark}{ending}"


def shared_beside(spark: SparkSession, path: str) -> str | None:
    """A new path that all machines share: beside ``path`` if that is on a shared storage, else in ``spark.checkpoint.dir``; None if there is none."""
    mark = uuid.uuid4().hex
    if "://" in path and not path.startswith("file:"):
        return beside(path, mark, ".parts")
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return f"{shared.rstrip('/')}/parts-{mark}"
    return beside(path, mark, ".parts") if spark.sparkContext.master.startswith("local") else None
