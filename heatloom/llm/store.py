"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession

from heatloom.session import remove_paths, scratch_path


class Scratch:
    """Tables written during one call; ``drop`` removes them once nothing reads them any more. What a lazy result
    still reads is removed when the program ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}
        atexit.register(self._at_exit)

    def _at_exit(self) -> None:
        if self.paths and self.spark.sparkContext._jsc is not None:
            self.drop()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        keys = [id(t) for t in tables] if tables else list(self.paths)
        remove_paths(self.spark, [self.paths.pop(key) for key in keys])


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed and kept in the shared checkpoint folder, its lineage cut."""
    from heatloom.session import checkpoint_root

    checkpoint_root(df.sparkSession)
    return df.checkpoint()
