"""The last results of a session, kept as written tables, by query, mode, filters and the library's version."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigrove.session import shared_folder


class ResultCache:
    """Holds ``most`` results; the one not asked for the longest goes first. A new version of the library makes old ones void."""

    def __init__(self, spark: SparkSession, most: int = 32):
        self.spark, self.most = spark, most
        self._held: OrderedDict[tuple, tuple[str, object]] = OrderedDict()

    def get(self, query: str, mode: str, filters: object, version: str, run: Callable[[], DataFrame]) -> DataFrame:
        key = query, mode, repr(filters), version
        if key not in self._held:
            for old in [k for k in self._held if k[3] != version]:
                self._drop(old)
            while len(self._held) >= self.most:
                self._drop(next(iter(self._held)))
            found, path = run(), f"{shared_folder(self.spark)}/lexigrove-results/{uuid.uuid4().hex}"
            found.write.parquet(path)
            self._held[key] = path, found.schema
        self._held.move_to_end(key)
        path, schema = self._held[key]
        return self.spark.read.schema(schema).parquet(path)

    def __len__(self) -> int:
        return len(self._held)

    def _drop(self, key: tuple) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._held.pop(key)[0])
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
