"""Additive sums that are fed batch by batch, kept in few files and safe against crashes and repeats.

Each batch stores its sums in a folder of its own, which never changes. A small manifest, replaced as a whole,
names the folders that count and the batches they hold; a folder without a mention does not count. Folders of one
size class are merged into one of the next class when there are FAN_IN of them, so after n batches a reader opens at
most (FAN_IN - 1) * log(n) folders. A batch that is sent again is known by its id, also after its folder
was merged. One writer at a time is assumed; readers may run beside it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN_IN = 8


@dataclass
class Manifest:
    version: int = 0
    #: (folder, size class) of all that counts.
    files: list[tuple[str, int]] = field(default_factory=list)
    #: Ids of the batches in them, as sorted ranges (first, last).
    absorbed: list[tuple[int, int]] = field(default_factory=list)
    #: Folders that the last merge replaced; readers may still hold them.
    replaced: list[str] = field(default_factory=list)

    def holds(self, batch_id: int) -> bool:
        return any(a <= batch_id <= b for a, b in self.absorbed)

    def with_batch(self, batch_id: int, folder: str) -> Manifest:
        ranges: list[tuple[int, int]] = []
        for a, b in sorted([*self.absorbed, (batch_id, batch_id)]):
            if ranges and a <= ranges[-1][1] + 1:
                ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]))
            else:
                ranges.append((a, b))
        return Manifest(self.version + 1, [*self.files, (folder, 0)], ranges, self.replaced)

    def merged(self, old: list[str], folder: str, level: int) -> Manifest:
        return Manifest(self.version + 1, [f for f in self.files if f[0] not in old] + [(folder, level)], self.absorbed, old)


class BatchSums:
    """Sums by ``keys`` in the folder ``path``; all other columns of ``schema`` are added up."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.types = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
        self.schema = schema

    # Files: a manifest is written beside its place and moved there.

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _versions(self) -> list[int]:
        fs, place = self._fs(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self) -> Manifest:
        versions = self._versions()
        if not versions:
            return Manifest()
        fs, place = self._fs(f"{self.path}/manifest/{versions[-1]}")
        stream = fs.open(place)
        try:
            kept = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return Manifest(versions[-1], [(n, k) for n, k in kept["files"]], [(a, b) for a, b in kept["absorbed"]], kept["replaced"])

    def _publish(self, new: Manifest) -> None:
        """Make ``new`` the manifest in one step; of the older ones the last stays."""
        fs, place = self._fs(f"{self.path}/manifest/{new.version}")
        aside = self._fs(f"{self.path}/manifest/.{new.version}-{uuid4().hex}")[1]
        stream = fs.create(aside, True)
        try:
            stream.write(bytearray(json.dumps({"files": new.files, "absorbed": new.absorbed, "replaced": new.replaced}).encode()))
        finally:
            stream.close()
        if fs.exists(place) or not fs.rename(aside, place):
            raise RuntimeError(f"another writer published version {new.version} of {self.path}")
        for version in self._versions()[:-2]:
            self._delete(f"manifest/{version}")

    def _delete(self, name: str) -> None:
        fs, place = self._fs(f"{self.path}/{name}")
        fs.delete(place, True)

    # Sums

    def _sums(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[F.sum(c).cast(t).alias(c) for c, t in self.types.items() if c not in self.keys]).select(*self.types)

    def _store(self, sums: DataFrame) -> str:
        name = f"data/{uuid4().hex}"
        sums.select(*[F.col(c).cast(t).alias(c) for c, t in self.types.items()]).write.parquet(f"{self.path}/{name}")
        return name

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in names])

    def commit(self, batch_id: int, sums: DataFrame) -> bool:
        """Add a batch once: a batch whose id is known is left out. False if it was."""
        now = self.manifest()
        if now.holds(batch_id):
            return False
        # A crash before the next line leaves a folder that no manifest names.
        self._publish(now.with_batch(int(batch_id), self._store(sums)))
        self.compact()
        return True

    def compact(self, fan_in: int = FAN_IN) -> None:
        """Merge the folders of each size class that has ``fan_in`` of them. Totals stay the same at every step."""
        while True:
            now = self.manifest()
            by_level: dict[int, list[str]] = {}
            for name, level in now.files:
                by_level.setdefault(level, []).append(name)
            full = sorted(level for level, names in by_level.items() if len(names) >= fan_in)
            if not full:
                return
            old = by_level[full[0]]
            merged = self._store(self._sums(self._read(old)))
            self._publish(now.merged(old, merged, full[0] + 1))
            for name in now.replaced:  # what the merge before this one replaced
                self._delete(name)

    def totals(self) -> DataFrame:
        """Sums by key over all batches so far."""
        return self._sums(self._read([name for name, _ in self.manifest().files]))
