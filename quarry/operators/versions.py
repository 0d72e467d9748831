"""Rows under versions: a base table, a delta table for each operation, and manifests that name those in force."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.features import rows_table
from quarry.operators.annotate import UNDO_LEVELS, state
from quarry.plans.lineage import remove

#: Columns of a stored row.
STORED = ("row_id", "raw", "review", "excluded", "deleted", "dirty", "tags")
_DELTA = "seq long, row_id long, field string, value string"
_MANIFEST = "base string, base_version long, deltas array<struct<version:long,folder:string>>, last long"


class RowStore:
    """Versions of a rows table in a folder, for one writer at a time.

    Each operation writes its changes of fields (see annotate.change) as a table of its own: what it costs grows with the rows
    that it changes. Reading joins the base with the deltas of the versions up to the one asked for, so any kept version, text included,
    can be read. Undo takes the last deltas out of force. Past UNDO_LEVELS + `slack` deltas the oldest are folded into a new base, so that UNDO_LEVELS are left.
    A manifest is written last and counts once it is complete: an operation that fails leaves the version before.
    """

    def __init__(self, spark: SparkSession, path: str, slack: int = UNDO_LEVELS):
        self.spark, self.path, self.slack = spark, path.rstrip("/"), slack

    @classmethod
    def create(cls, rows: DataFrame, path: str, slack: int = UNDO_LEVELS) -> RowStore:
        """A store whose version 0 are the given rows (a rows table)."""
        store = cls(rows.sparkSession, path, slack)
        folder = f"base-{uuid.uuid4().hex}"
        rows.select(*STORED).write.parquet(f"{store.path}/{folder}")
        store._commit(folder, 0, [], 0, 0)
        return store

    def _manifests(self) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/*/_SUCCESS")
        found = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(hadoop) or []
        return sorted(int(f.getPath().getParent().getName()) for f in found)

    def _read(self) -> tuple[int, str, int, list[tuple[int, str]], int]:
        number = self._manifests()[-1]
        m = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests/{number:08d}").first()
        return number, m.base, m.base_version, [tuple(d) for d in m.deltas], m.last

    def _commit(self, base: str, base_version: int, deltas: list[tuple[int, str]], last: int, number: int) -> None:
        row = self.spark.createDataFrame([(base, base_version, deltas, last)], _MANIFEST)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{number:08d}")

    @property
    def version(self) -> int:
        """The version in force."""
        _, _, base_version, deltas, _ = self._read()
        return deltas[-1][0] if deltas else base_version

    def versions(self) -> list[int]:
        """Versions that can be read, oldest first."""
        _, _, base_version, deltas, _ = self._read()
        return [base_version, *(v for v, _ in deltas)]

    def _log(self, deltas: list[tuple[int, str]]) -> DataFrame:
        if not deltas:
            return self.spark.createDataFrame([], _DELTA)
        return self.spark.read.schema(_DELTA).parquet(*[f"{self.path}/{folder}" for _, folder in deltas])

    def apply(self, *changes: DataFrame) -> int:
        """Log the changes (row_id, field, value) of one operation; its version is returned."""
        number, base, base_version, deltas, last = self._read()
        version, folder = last + 1, f"delta-{last + 1}-{uuid.uuid4().hex}"
        out = None
        for c in changes:
            part = c.select(F.lit(version).cast("long").alias("seq"), F.col("row_id").cast("long"), "field", "value")
            out = part if out is None else out.unionByName(part)
        out.write.parquet(f"{self.path}/{folder}")
        self._commit(base, base_version, [*deltas, (version, folder)], version, number + 1)
        if len(deltas) + 1 > UNDO_LEVELS + self.slack:
            self.compact()
        return version

    def undo(self, levels: int = 1) -> int:
        """Take the last operations back, UNDO_LEVELS at most; the version then in force is returned."""
        number, base, base_version, deltas, last = self._read()
        self._commit(base, base_version, deltas[: max(len(deltas) - min(levels, UNDO_LEVELS), 0)], last, number + 1)
        return self.version

    def changed(self, since: int) -> DataFrame:
        """(row_id) of the rows that operations after a version, which is still in force, have changed."""
        _, _, _, deltas, _ = self._read()
        return self._log([d for d in deltas if d[0] > since]).select("row_id").distinct()

    def _state(self, base: str, deltas: list[tuple[int, str]]) -> DataFrame:
        return state(self.spark.read.parquet(f"{self.path}/{base}"), self._log(deltas))

    def stored(self, version: int | None = None) -> DataFrame:
        """STORED columns of a kept version (the one in force by default)."""
        _, base, base_version, deltas, _ = self._read()
        known = [base_version, *(v for v, _ in deltas)]
        if version is not None and version not in known:
            raise ValueError(f"version {version} is not kept: {known}")
        return self._state(base, [d for d in deltas if version is None or d[0] <= version])

    def rows(self, version: int | None = None) -> DataFrame:
        """The rows table of a kept version."""
        return rows_table(self.stored(version))

    def compact(self, keep: int = UNDO_LEVELS) -> None:
        """Fold all but the last `keep` deltas into a new base; folders that are no longer in force, and old manifests, are removed after that."""
        number, base, base_version, deltas, last = self._read()
        old, kept = deltas[: len(deltas) - keep], deltas[len(deltas) - keep :]
        if len(deltas) <= keep:
            return
        folder = f"base-{uuid.uuid4().hex}"
        self._state(base, old).select(*STORED).write.parquet(f"{self.path}/{folder}")
        self._commit(folder, old[-1][0], kept, last, number + 1)
        for n in self._manifests()[:-1]:
            remove(self.spark, f"{self.path}/manifests/{n:08d}")
        for f in [base, *(f for _, f in old)]:
            remove(self.spark, f"{self.path}/{f}")
