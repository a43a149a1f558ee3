"""One writer at a time per store: a lock file that is created atomically.

On HDFS (and stores with conditional creation) ``create`` without overwrite is atomic; on a local
file system the file is made with the exclusive flag. The holder renews the file's time while it works; a
lock that has not been renewed for ``stale_after`` seconds belongs to a driver that died and is taken
over: it is renamed first, which only one of several waiting writers can do.
"""

from __future__ import annotations

import os
import threading
import time
import uuid
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

WAIT_SECONDS = 3600.0
STALE_AFTER = 300.0
POLL_SECONDS = 0.1


class _Lock:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark.sparkContext._jvm  # noqa: SLF001
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
        uri = str(self.fs.makeQualified(self.path).toUri().toString())
        self.local = unquote(urlparse(uri).path) if uri.startswith("file:") else None

    def create(self) -> bool:
        self.fs.mkdirs(self.path.getParent())
        if self.local is not None:
            try:
                os.close(os.open(self.local, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                return True
            except FileExistsError:
                return False
        try:
            self.fs.create(self.path, False).close()
            return True
        except Exception:  # noqa: BLE001 - it exists already, or the store cannot be written: the next line tells
            if self.fs.exists(self.path):
                return False
            raise

    def age(self) -> float:
        try:
            return time.time() - self.fs.getFileStatus(self.path).getModificationTime() / 1000.0
        except Exception:  # noqa: BLE001 - released meanwhile
            return 0.0

    def renew(self) -> None:
        self.fs.setTimes(self.path, int(time.time() * 1000), -1)

    def take_over(self) -> None:
        away = self.jvm.org.apache.hadoop.fs.Path(f"{self.path.toString()}.{uuid.uuid4().hex[:12]}.dead")
        if self.fs.rename(self.path, away):
            self.fs.delete(away, False)

    def release(self) -> None:
        self.fs.delete(self.path, False)


@contextmanager
def writing(spark: SparkSession, root: str, wait: float = WAIT_SECONDS, stale_after: float = STALE_AFTER):
    """Hold the store's write lock; waits for another writer, takes over from a dead one."""
    lock = _Lock(spark, f"{root.rstrip('/')}/_writer.lock")
    until = time.monotonic() + wait
    while not lock.create():
        if lock.age() > stale_after:
            lock.take_over()
        elif time.monotonic() > until:
            raise TimeoutError(f"another writer holds {root} since more than {wait:.0f} s")
        else:
            time.sleep(POLL_SECONDS)
    done = threading.Event()

    def renew() -> None:
        while not done.wait(stale_after / 5):
            lock.renew()

    keeper = threading.Thread(target=renew, daemon=True)
    keeper.start()
    try:
        yield
    finally:
        done.set()
        keeper.join()
        lock.release()
