"""Results of a stream as a few stored tables that are swapped in one step.

Every batch is reduced and written to a folder of its own. When FAN folders of a level have come together they are
folded into one of the next level, so after n batches a reader opens about FAN * log(n) folders. Which folders count is said by a
manifest: each change writes the next numbered one under another name and renames it into place. A job that dies
before the rename has changed nothing; one that runs again with a batch that is already in does nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

FAN = 4
BATCH = "_batch"


@dataclass(frozen=True)
class Part:
    """A stored folder: its name, its level and the last batch that is in it."""

    name: str
    level: int
    batch: int


class Levels:
    """One stored result; ``fold`` reduces rows, with their batch number in ``_batch``, to what a reader needs of them."""

    def __init__(self, spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.fold = spark, path.rstrip("/"), fold
        self._files = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._files.listStatus(self._at(folder))] if self._files.exists(self._at(folder)) else []

    def manifest(self) -> tuple[int, list[Part]]:
        """Number of the newest manifest (-1 if there is none) and its parts."""
        versions = [int(n[1:]) for n in self._names("manifest") if n[:1] == "v" and n[1:].isdigit()]
        if not versions:
            return -1, []
        text = "".join(r.value for r in self.spark.read.text(f"{self.path}/manifest/v{max(versions):012d}").collect())
        return max(versions), [Part(**p) for p in json.loads(text)]

    def _commit(self, version: int, parts: list[Part]) -> None:
        draft, final = self._at("manifest", f"draft-{uuid.uuid4().hex}"), self._at("manifest", f"v{version:012d}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps([p.__dict__ for p in parts]).encode()))
        out.close()
        if not self._files.rename(draft, final):
            raise RuntimeError(f"another writer has changed {self.path}")

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Add a batch; false if it is in already. Batches come in ascending order, as a stream sends them."""
        version, parts = self.manifest()
        if any(p.batch >= batch for p in parts):
            return False
        new = self._store(self.fold(rows.withColumn(BATCH, F.lit(batch).cast("long"))), 0, batch)
        parts = [*parts, new]
        while sum(p.level == parts[-1].level for p in parts) >= FAN:
            level = parts[-1].level
            same = [p for p in parts if p.level == level]
            merged = self._store(self.fold(self._read(same)), level + 1, max(p.batch for p in same))
            parts = [*[p for p in parts if p.level != level], merged]
        self._commit(version + 1, parts)
        self._clean(version, parts)
        return True

    def _store(self, rows: DataFrame, level: int, batch: int) -> Part:
        part = Part(f"L{level}-{batch:012d}-{uuid.uuid4().hex}", level, batch)
        rows.write.parquet(f"{self.path}/data/{part.name}")
        return part

    def _clean(self, before: int, now: list[Part]) -> None:
        """Drop folders in neither the new manifest nor the one before it, which a reader may still hold."""
        kept = {p.name for p in now}
        if before >= 0:
            text = "".join(r.value for r in self.spark.read.text(f"{self.path}/manifest/v{before:012d}").collect())
            kept |= {p["name"] for p in json.loads(text)}
        for name in self._names("data"):
            if name not in kept:
                self._files.delete(self._at("data", name), True)
        for name in self._names("manifest"):
            if name[:1] != "v" or int(name[1:]) < before:
                self._files.delete(self._at("manifest", name), False)

    def _read(self, parts: list[Part]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/data/{p.name}" for p in parts])

    def read(self) -> DataFrame | None:
        """All that has come in, folded; None before the first batch."""
        _, parts = self.manifest()
        return self.fold(self._read(parts)) if parts else None
