"""State of the continuous job as tables in a shared folder, one version per micro-batch.

A replayed micro-batch reads the same earlier version and overwrites its own, so results are
the same after a restart. Because the state is a table, the same partitioned operators serve
batch and stream, and no key's history has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.session import delete_folder


class StateTables:
    #: Micro-batches whose additions are merged into one table.
    MERGE = 96

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str, epoch: int) -> str:
        return f"{self.folder}/{name}/epoch={epoch}"

    def latest(self, name: str, epoch: int) -> DataFrame | None:
        """The version the previous micro-batch left."""
        return None if epoch == 0 else self.spark.read.parquet(self._path(name, epoch - 1))

    def replace(self, name: str, epoch: int, table: DataFrame) -> None:
        table.write.mode("overwrite").parquet(self._path(name, epoch))
        if epoch > 1:  # a replay reads one version back at most
            delete_folder(self.spark, self._path(name, epoch - 2))

    # Grow-only tables are what every earlier micro-batch added: one merged table and the additions since, so that
    # neither the folders that are listed nor the small files that are read grow with the job's age.
    def grown(self, name: str, epoch: int) -> DataFrame | None:
        if epoch == 0:
            return None
        merged = (epoch - 1) // self.MERGE * self.MERGE
        paths = [self._path(name, e) for e in range(merged + (merged > 0), epoch)]
        return self.spark.read.parquet(*([self._path(f"{name}-merged", merged)] if merged else []), *paths)

    def add(self, name: str, epoch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self._path(name, epoch))
        if epoch and epoch % self.MERGE == 0:
            earlier = self.grown(name, epoch).unionByName(self.spark.read.parquet(self._path(name, epoch)))
            earlier.write.mode("overwrite").parquet(self._path(f"{name}-merged", epoch))
            # what the merge before last replaced is read by no replay any more
            for old in range(max(0, epoch - 2 * self.MERGE), epoch - self.MERGE):
                delete_folder(self.spark, self._path(name, old))
            delete_folder(self.spark, self._path(f"{name}-merged", epoch - 2 * self.MERGE))
