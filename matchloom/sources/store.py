"""Several tables under one folder that are published together.

``publish`` writes the partitions that changed, each as a new folder, and then one small version file that says which
folder each partition of each table has. Readers take the newest version file, so they see all tables as of one moment and
read each partition from one place, however many batches there were. A writer that fails on the way leaves no version
file, and its second try writes over the same folders; a batch that was published already is not published again.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_PART = "part_of"


class TableStore:
    """Tables of one folder. Every table has its rows dealt to partitions by one expression, whose value is a number or a short text."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(name))] if self._fs.exists(self._at(name)) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json"))

    def snapshot(self) -> dict[str, Any]:
        """The newest version: its number, the last batch of each writer, and per table its schema and the folder of each partition."""
        known = self.versions()
        if not known:
            return {"version": 0, "batches": {}, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{known[-1]}.json", wholetext=True).first()[0])

    def read(self, table: str, schema: StructType | None = None, parts: Iterable[Any] | None = None, snapshot: dict[str, Any] | None = None) -> DataFrame:
        """A table, or some partitions of it; an empty one of the given schema where there is none yet."""
        found = (snapshot or self.snapshot())["tables"].get(table)
        asked = None if parts is None else {str(p) for p in parts}
        folders = [f"{self.path}/{folder}" for part, folder in sorted(found["parts"].items()) if asked is None or part in asked] if found else []
        schema = StructType.fromJson(found["schema"]) if found else schema
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def publish(self, writer: str, batch: int, tables: dict[str, DataFrame], part: Column, touched: Iterable[Any]) -> bool:
        """Replaces the touched partitions of the tables by the given rows. Gives False, and does nothing, if the writer's batch is there already."""
        before = self.snapshot()
        if before["batches"].get(writer, -1) >= batch:
            return False
        asked = {str(p) for p in touched}
        after = {name: {"schema": t["schema"], "parts": dict(t["parts"])} for name, t in before["tables"].items()}
        for name, rows in tables.items():
            folder = f"data/{name}/{writer}-{batch}"
            dealt = rows.withColumn(_PART, part)
            # a partition may be larger than a task should hold: Spark splits such ones, and puts small ones together
            dealt.hint("rebalance", F.col(_PART)).write.mode("overwrite").partitionBy(_PART).parquet(f"{self.path}/{folder}")
            written = {n.removeprefix(f"{_PART}="): f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{_PART}=")}
            if not written.keys() <= asked:
                raise ValueError(f"rows of {name} outside the touched partitions: {sorted(written.keys() - asked)[:5]}")
            kept = {p: f for p, f in after.get(name, {"parts": {}})["parts"].items() if p not in asked}
            after[name] = {"schema": rows.schema.jsonValue(), "parts": kept | written}
        self._put({"version": before["version"] + 1, "batches": before["batches"] | {writer: batch}, "tables": after})
        return True

    def _put(self, version: dict[str, Any]) -> None:
        draft, final = self._at(f"versions/{version['version']}.draft"), self._at(f"versions/{version['version']}.json")
        out = self._fs.create(draft, True)
        out.write(json.dumps(version).encode())
        out.close()
        # a rename does not replace a file, so of two writers only one gets the number
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"another writer has published version {version['version']}")

    def compact(self, keep: int = 1) -> int:
        """Removes all but the last versions, and the folders that none of them has. Gives the number of folders removed. Nobody may publish meanwhile."""
        known = self.versions()
        used = set()
        for n in known[-keep:]:
            version = json.loads(self.spark.read.text(f"{self.path}/versions/{n}.json", wholetext=True).first()[0])
            used |= {folder for t in version["tables"].values() for folder in t["parts"].values()}
        for n in known[:-keep]:
            self._fs.delete(self._at(f"versions/{n}.json"), False)
        gone = 0
        for table in self._names("data"):
            for batch in self._names(f"data/{table}"):
                left = 0
                for part in self._names(f"data/{table}/{batch}"):
                    folder = f"data/{table}/{batch}/{part}"
                    if part.startswith(f"{_PART}=") and folder not in used:
                        self._fs.delete(self._at(folder), True)
                        gone += 1
                    left += folder in used
                if not left:
                    self._fs.delete(self._at(f"data/{table}/{batch}"), True)
        return gone


def values_of(rows: DataFrame, part: Column) -> list[Any]:
    """The partitions that rows belong to; as many as there are partitions at most."""
    return [r[0] for r in rows.select(part.alias(_PART)).distinct().collect()]


def day_of(recorded_at: str = "recorded_at") -> Column:
    return F.substring(recorded_at, 1, 10)
