"""One writer at a time: a lease beside the store, a machine-wide slot for embedding, and a log of events."""

from __future__ import annotations

import contextlib
import json
import os
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession

from lodestone.sources.embedding import BudgetExhausted

LEASE_S = 360
POLL_S = 0.1


class LockedError(Exception):
    """Another owner holds the lease."""


class Lease:
    """A file in the store's folder, through the file system that Spark uses for it: owner and expiry.

    Creating a file that exists fails, so of two that try at once one wins.  An expired lease is stolen by the next that asks.
    """

    def __init__(self, spark: SparkSession, store: str, owner: str, seconds: float = LEASE_S):
        self.owner, self.seconds = owner, seconds
        self._path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/lease")
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = spark._jvm

    def _read(self) -> dict | None:
        from py4j.protocol import Py4JJavaError

        try:
            stream = self._fs.open(self._path)
        except Py4JJavaError:
            return None
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return {"owner": None, "expires": 0}
        finally:
            stream.close()

    def _write(self) -> bool:
        from py4j.protocol import Py4JJavaError

        try:
            stream = self._fs.create(self._path, False)
        except Py4JJavaError:
            return False
        stream.write(json.dumps({"owner": self.owner, "expires": time.time() + self.seconds}).encode())
        stream.close()
        return True

    def acquire(self) -> bool:
        held = self._read()
        if held is not None and held["owner"] != self.owner and held["expires"] > time.time():
            return False
        if held is not None:
            self._fs.delete(self._path, False)
        return self._write()

    def renew(self) -> bool:
        """Whether the lease is still ours, for another term."""
        held = self._read()
        return held is not None and held["owner"] == self.owner and self.acquire()

    def release(self) -> None:
        held = self._read()
        if held is not None and held["owner"] == self.owner:
            self._fs.delete(self._path, False)


@contextlib.contextmanager
def machine_slot(folder: str, deadline: float | None = None) -> Iterator[None]:
    """The one slot of this machine's drivers for embedding; waits until ``deadline`` (epoch seconds) at most."""
    import fcntl

    Path(folder).mkdir(parents=True, exist_ok=True)
    with open(Path(folder, "embedding.lock"), "a") as f:
        began = time.time()
        while True:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if deadline is not None and time.time() >= deadline:
                    raise BudgetExhausted from None
                time.sleep(POLL_S)
        if (waited := time.time() - began) >= 0.001:
            log_event(folder, "lock-wait", wait_ms=int(waited * 1000))
        yield


def log_event(folder: str, event: str, **fields) -> None:
    """Appends one JSON line; a log that cannot be written never fails a run."""
    with contextlib.suppress(OSError):
        Path(folder).mkdir(parents=True, exist_ok=True)
        with open(Path(folder, "events.jsonl"), "a") as f:
            f.write(json.dumps({"ts": int(time.time()), "event": event, "pid": os.getpid()} | fields) + "\n")
