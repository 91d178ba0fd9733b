"""A table kept as versions: every version is a list of parts, and a change writes only the parts that it affects.

::

    P/versions/<n>.json    key of a part -> its directory, and facts about the version; the last one is current
    P/data/<id>/...        what one change wrote; parts that it left alone stay where they are
    P/locks/change/        lease of the writer

A reader opens the current version by its path, in this process or another. A change that fails leaves the
version before it. Older versions are kept up to ``keep``; parts that no kept version names are deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from brindle.sources.files import Files
from brindle.sources.lease import Busy, Lease


class Versions:
    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep, self.files = spark, path.rstrip("/"), keep, Files(spark)

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n, _, _, _ in self.files.list(f"{self.path}/versions") if n.endswith(".json"))

    def get(self, number: int | None = None) -> dict:
        """A version (the current one by default): ``number``, ``parts``, ``facts``; number 0, without parts, before the first change."""
        found = self.numbers()
        if number is None:
            if not found:
                return {"number": 0, "parts": {}, "facts": {}}
            number = found[-1]
        return json.loads(self.files.read(f"{self.path}/versions/{number}.json"))

    def write(self, df: DataFrame, key: str) -> dict[str, str]:
        """Write df in parts by the column *key* to a new directory: key -> part. Nothing shows before ``change`` publishes it."""
        at = f"data/{uuid.uuid4().hex}"
        df.write.partitionBy(key).option("compression", "zstd").parquet(f"{self.path}/{at}")
        names = [n for n, is_dir, _, _ in self.files.list(f"{self.path}/{at}") if is_dir and n.startswith(f"{key}=")]
        return {n.split("=", 1)[1]: f"{at}/{n}" for n in names}

    def read(self, parts: Mapping[str, str], schema: T.StructType) -> DataFrame:
        """The rows of parts, without the key's column."""
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in parts.values()])

    def change(self, how: Callable[[dict], tuple[dict[str, str], dict] | None]) -> dict:
        """The next version: how gets the current one and gives its parts and facts; None leaves everything as it is."""
        lease = Lease(self.files, f"{self.path}/locks/change")
        with lease:
            old = self.get()
            made = how(old)
            if made is None:
                return old
            new = {"number": old["number"] + 1, "parts": made[0], "facts": made[1]}
            if not lease.held():
                raise Busy(f"the change of {self.path} was taken over by another one")
            self.files.mkdirs(f"{self.path}/versions")
            self.files.write(f"{self.path}/versions/{new['number']}.json", json.dumps(new))
            self._clean()
        return new

    def _clean(self) -> None:
        found = self.numbers()
        for n in found[: -self.keep]:
            gone = self.get(n)
            left = {p for k in found if k > n for p in self.get(k)["parts"].values()}
            for p in set(gone["parts"].values()) - left:
                self.files.delete(f"{self.path}/{p}")
            self.files.delete(f"{self.path}/versions/{n}.json")
