"""Keyed tables that batches are merged into without being rewritten.

A batch writes only its own keys, as a delta in a folder ``d<level>-<first>-<last>``; a read groups the live
deltas by key and folds each column by its rule, in the order of the batches.  ``FAN`` deltas of a
level become one of the next level, so each row is written about log(batches) times in all, whatever the
size of the table.  Level 0 deltas are named by the number of their batch and overwritten when
a batch runs again after a failure; only batches that are done are ever joined, so a batch has its effect once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: deltas of a level that become one of the next
FAN = 8


def _empty(c: Column) -> Column:
    return c.isNull() | c.cast("string").isin("", "{}", "[]")


def folded(rule: str, name: str) -> Column:
    """A column of a key over its deltas (numbered by ``_n``): what merging them one after the other gives."""
    c, n = F.col(name), F.col("_n")
    latest = lambda keep: F.max_by(F.struct(c.alias("v")), F.when(keep, n))["v"]
    first = lambda keep: F.min_by(F.struct(c.alias("v")), F.when(keep, n))["v"]
    if rule == "new":
        return latest(F.lit(True))
    if rule == "old":
        return first(F.lit(True))
    if rule == "new_or_old":
        return latest(c.isNotNull())
    if rule == "old_or_new":
        return first(c.isNotNull())
    if rule == "new_unless_empty":
        return F.coalesce(latest(~_empty(c)), first(F.lit(True)))
    if rule in ("least", "greatest", "sum"):
        return {"least": F.min, "greatest": F.max, "sum": F.sum}[rule](c)
    if rule == "union":
        return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.coalesce(c, F.array()).alias("v")))), lambda x: x["v"])))
    raise ValueError(f"unknown rule {rule}")


@dataclass
class DeltaTable:
    """A table under ``folder`` keyed by ``keys``; other columns follow ``rules`` (``default`` where none is named)."""

    spark: SparkSession
    folder: str
    keys: list[str]
    rules: dict[str, str] = field(default_factory=dict)
    default: str = "new"

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def deltas(self) -> list[tuple[int, int, int]]:
        """(level, first, last) of the finished deltas."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/d*/_SUCCESS")
        names = [f.getPath().getParent().getName() for f in self._files().globStatus(pattern) or []]
        return sorted(tuple(map(int, m.groups())) for n in names if (m := re.fullmatch(r"d(\d+)-(\d+)-(\d+)", n)))

    def live(self, before: int | None = None) -> list[tuple[int, int, int]]:
        """The deltas that no joined one covers, of batches before a number, in order."""
        found = [d for d in self.deltas() if before is None or d[2] < before]
        covered = lambda d: any(o[0] > d[0] and o[1] <= d[1] and d[2] <= o[2] for o in found)
        return sorted((d for d in found if not covered(d)), key=lambda d: d[1])

    def _path(self, d: tuple[int, int, int]) -> str:
        return f"{self.folder}/d{d[0]}-{d[1]}-{d[2]}"

    def _merged(self, deltas: list[tuple[int, int, int]]) -> DataFrame:
        parts = [self.spark.read.parquet(self._path(d)).withColumn("_n", F.lit(d[1])) for d in deltas]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        if len(parts) == 1:
            return rows.drop("_n")
        others = [c for c in rows.columns if c not in (*self.keys, "_n")]
        return rows.groupBy(*self.keys).agg(*[folded(self.rules.get(c, self.default), c).alias(c) for c in others])

    def read(self) -> DataFrame:
        return self._merged(self.live())

    def write(self, rows: DataFrame, number: int) -> None:
        """Merges a batch: one row for each key.  The same number again replaces what it wrote."""
        self._join(number)
        rows.write.mode("overwrite").parquet(self._path((0, number, number)))

    def _join(self, number: int) -> None:
        """Joins FAN deltas of one level, of batches before ``number``, and removes what an earlier join covers."""
        live = self.live(number)
        for d in self.deltas():
            if d[2] < number and d not in live:
                self._files().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(d)), True)
        for level in sorted({d[0] for d in live}):
            same = [d for d in live if d[0] == level]
            if len(same) >= FAN:
                self._merged(same).write.mode("overwrite").parquet(self._path((level + 1, same[0][1], same[-1][2])))
                return
