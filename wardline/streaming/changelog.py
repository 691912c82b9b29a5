"""A change log that stays small: one folder per micro-batch, merged by level, read through a versioned pointer.

A micro-batch writes the rows it changed to a folder of level 0.  When a level has ``fanout`` folders, they are folded to one
folder of the next level that holds the latest row of every key, so a log of n micro-batches has at most ``fanout`` folders on
each of log(n) levels and a row is rewritten as often as there are levels.  A version file names the folders that belong
together.  It is put in place by a rename after they are written, so a reader sees one whole version and a micro-batch that is
run again changes nothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Version:
    """The folders of the log after a micro-batch, oldest first, as (level, name)."""

    batch: int
    folders: tuple[tuple[int, str], ...]


class ChangeLog:
    """Rows of ``key`` and ``order``; the row with the largest ``order`` counts."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, fanout: int = 8):
        self.spark, self.path, self.key, self.order, self.fanout = spark, path.rstrip("/"), key, order, fanout

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        """Micro-batches whose version is still there, oldest first."""
        fs, where = self._at("_versions")
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self, batch: int | None = None) -> Version | None:
        """The version of a micro-batch, or the last one; None for an empty log."""
        known = self.versions()
        if not known:
            return None
        batch = known[-1] if batch is None else batch
        said = json.loads(self.spark.read.text(f"{self.path}/_versions/{batch}.json").first()[0])
        return Version(batch, tuple((level, name) for level, name in said))

    def _commit(self, version: Version) -> None:
        fs, draft = self._at(f"_drafts/{version.batch}.json")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(version.folders).encode()))
        finally:
            out.close()
        _, final = self._at(f"_versions/{version.batch}.json")
        fs.mkdirs(final.getParent())
        if not fs.rename(draft, final):
            raise RuntimeError(f"version {version.batch} of {self.path} is there already")

    def _latest(self, rows: DataFrame) -> DataFrame:
        others = F.struct(*[F.col(c) for c in rows.columns])
        return rows.groupBy(self.key).agg(F.max_by(others, self.order).alias("row")).select("row.*")

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{name}" for name in names])

    def append(self, changes: DataFrame, batch: int) -> Version:
        """Log the latest row of every key in a micro-batch; one that is logged already is left as it is."""
        last = self.version()
        if last and last.batch >= batch:
            return last
        folders = list(last.folders) if last else []
        folders.append((0, f"level=0/{batch}"))
        self._latest(changes).write.mode("overwrite").parquet(f"{self.path}/{folders[-1][1]}")
        level, written = 0, [folders[-1][1]]
        while len(full := [f for f in folders if f[0] == level]) >= self.fanout:
            merged = (level + 1, f"level={level + 1}/{batch}")
            self._latest(self._read([name for _, name in full])).write.mode("overwrite").parquet(f"{self.path}/{merged[1]}")
            # older, higher levels stand before it
            folders = [f for f in folders if f[0] > level] + [merged] + [f for f in folders if f[0] < level]
            written.append(merged[1])
            level += 1
        version = Version(batch, tuple(folders))
        self._commit(version)
        self._remove(set(written) - {name for _, name in folders})  # merged at once, and named by no version
        return version

    def _remove(self, names) -> None:
        for name in sorted(names):
            fs, where = self._at(name)
            fs.delete(where, True)

    def read(self, batch: int | None = None) -> DataFrame | None:
        """The latest row of every key as of a version, or None for an empty log.  Later micro-batches do not change it."""
        version = self.version(batch)
        return self._latest(self._read([name for _, name in version.folders])) if version else None

    def clean(self, keep: int = 2) -> None:
        """Remove all but the last ``keep`` versions, and the folders that none of those names."""
        known = self.versions()
        kept, gone = known[-keep:], known[:-keep]
        named = {name for batch in kept for _, name in self.version(batch).folders}
        old = {name for batch in gone for _, name in self.version(batch).folders} - named
        self._remove({f"_versions/{batch}.json" for batch in gone} | old)
