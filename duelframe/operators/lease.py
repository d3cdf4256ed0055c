"""One writer at a time on a shared file system: leases with growing fencing numbers, numbered pointers, attempts and a queue that is drained.

Everything rests on one step that only one caller can win: creating a file that must not exist. A lease's number is the number of its
file, and the pointer that its holder sets carries this number. Readers follow the highest pointer, so a writer that was overtaken
meanwhile can't name its work any more, however late it wakes up.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import SparkSession


class StoreBusy(RuntimeError):
    """Another writer holds the lease."""


class StaleWriter(RuntimeError):
    """A later lease has been given since."""


def file_system(spark: SparkSession, path: str):
    """(file system, Hadoop path) of ``path``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = file_system(spark, path)
    return fs.exists(hadoop)


def create_once(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file with its content if there is none; of several callers one gets True.

    The content is written aside first, so that whoever sees the file sees all of it. On a local disk a hard link is the exclusive step, elsewhere the
    file system's rename, which HDFS refuses onto an existing file.
    """
    fs, target = file_system(spark, path)
    if fs.exists(target):
        return False
    fs.mkdirs(target.getParent())
    aside = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{spark._jvm.java.util.UUID.randomUUID()}")
    out = fs.create(aside, False)
    out.write(bytearray(content.encode()))
    out.close()
    try:
        if fs.getScheme() != "file":
            return bool(fs.rename(aside, target))
        nio, paths = spark._jvm.java.nio.file.Files, spark._jvm.java.nio.file.Paths
        nio.createLink(paths.get(fs.makeQualified(target).toUri()), paths.get(fs.makeQualified(aside).toUri()))
        return True
    except Exception as e:
        if fs.exists(target) and "AlreadyExists" in str(e):
            return False
        raise
    finally:
        fs.delete(aside, False)


def read_text(spark: SparkSession, path: str) -> str:
    fs, hadoop = file_system(spark, path)
    stream = fs.open(hadoop)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, path = file_system(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n) for n in names if n.isdigit())


class Lease:
    """The right to publish under ``root`` until ``until``, with its fencing number; a context manager that gives it back."""

    def __init__(self, spark: SparkSession, root: str, owner: str, number: int, until: float):
        self.spark, self.root, self.owner, self.number, self.until = spark, root, owner, number, until

    def __enter__(self) -> Lease:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()

    def release(self) -> None:
        create_once(self.spark, f"{self.root}/leases/{self.number:012d}.released", "")

    def check(self) -> None:
        """Raise if a later lease has been given."""
        newest = _numbers(self.spark, f"{self.root}/leases")[-1]
        if newest != self.number:
            raise StaleWriter(f"lease {self.number} of {self.root} was followed by {newest}")

    def point(self, content: dict) -> None:
        """Make ``content`` what readers find; refused to a writer that was overtaken.

        Should a later lease be given between the check and the pointer, the pointer still has the lower number, so the later writer's wins.
        """
        self.check()
        if not create_once(self.spark, f"{self.root}/pointers/{self.number:012d}", json.dumps(content)):
            raise StaleWriter(f"lease {self.number} of {self.root} has set its pointer before")


def acquire(spark: SparkSession, root: str, owner: str, seconds: float = 3600.0, now: float | None = None) -> Lease:
    """The next lease; ``StoreBusy`` while the last one is neither given back nor over, or if another caller was faster."""
    now = time.time() if now is None else now
    numbers = _numbers(spark, f"{root}/leases")
    if numbers:
        last = f"{root}/leases/{numbers[-1]:012d}"
        held = json.loads(read_text(spark, last))
        if held["until"] > now and not exists(spark, f"{last}.released"):
            raise StoreBusy(f"{held['owner']} writes to {root}")
    lease = Lease(spark, root, owner, (numbers[-1] if numbers else 0) + 1, now + seconds)
    if not create_once(spark, f"{root}/leases/{lease.number:012d}", json.dumps({"owner": owner, "until": lease.until})):
        raise StoreBusy(f"another writer took lease {lease.number} of {root}")
    return lease


def all_pointed(spark: SparkSession, root: str) -> list[dict]:
    """What all pointers say, the highest first."""
    return [json.loads(read_text(spark, f"{root}/pointers/{n:012d}")) for n in reversed(_numbers(spark, f"{root}/pointers"))]


def pointed(spark: SparkSession, root: str) -> dict | None:
    """What the highest pointer says, None before the first."""
    numbers = _numbers(spark, f"{root}/pointers")
    return json.loads(read_text(spark, f"{root}/pointers/{numbers[-1]:012d}")) if numbers else None


def attempt_id(spark: SparkSession, root: str, batch_id: str) -> str:
    """Reserve an id for a batch: its own, or with the first free suffix ``-attempt-N`` from 2; of several callers each gets another."""
    wanted = batch_id.strip()
    if not wanted:
        raise ValueError("batch_id is required")
    name, attempt = wanted, 1
    while not create_once(spark, f"{root}/batches/{name}", ""):
        attempt += 1
        name = f"{wanted}-attempt-{attempt}"
    return name


def drain(spark: SparkSession, root: str, entries: list[str], work: Callable[[str], object], attempts: int = 3) -> dict[str, str]:
    """Work through a queue in order: entry -> done, failed or skipped (done in an earlier call).

    An entry is marked when its work has returned, so a call after a crash goes on with the first that is not. One that fails is tried again up to
    ``attempts`` times over all calls, and later ones wait for no failure of it.
    """
    out: dict[str, str] = {}
    for entry in entries:
        tries = sum(exists(spark, f"{root}/queue/{entry}.try-{n}") for n in range(1, attempts + 1))
        if exists(spark, f"{root}/queue/{entry}.done"):
            out[entry] = "skipped"
            continue
        out[entry] = "failed"
        while tries < attempts and out[entry] == "failed":
            tries += 1
            create_once(spark, f"{root}/queue/{entry}.try-{tries}", "")
            try:
                work(entry)
            except (StaleWriter, StoreBusy):
                raise
            except Exception:
                continue
            create_once(spark, f"{root}/queue/{entry}.done", "")
            out[entry] = "done"
    return out
