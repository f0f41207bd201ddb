"""Tables that runs can stop and resume: measurements by path and time, and writes that pass a gate.

A commit is a folder that counts once Spark has marked it finished, so a lost job leaves nothing half done and nothing is
rewritten in place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from noctua.session import written


class Folder:
    """Numbered commits below a path: commit-N holds new rows, base-N all rows up to N."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def commits(self) -> list[tuple[int, bool]]:
        """(number, whether it is a base) of the finished commits that count: the last base and all after it."""
        root = self._path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        found = sorted((int(n.split("-")[1]), n.startswith("base-")) for n in names if n.startswith(("commit-", "base-")) and self._fs.exists(self._path(f"{self.path}/{n}/_SUCCESS")))
        last = max((i for i, base in found if base), default=-1)
        return [(i, base) for i, base in found if i > last or (base and i == last)]

    def place(self, number: int, base: bool) -> str:
        return f"{self.path}/{'base' if base else 'commit'}-{number}"

    def next(self) -> int:
        return max((i for i, _ in self.commits()), default=-1) + 1

    def write(self, df: DataFrame, base: bool = False) -> int:
        """A commit of df; what an earlier try has left under its number is overwritten."""
        number = self.next()
        df.write.mode("overwrite").parquet(self.place(number, base))
        return number

    def read(self) -> DataFrame | None:
        """All rows that count, with the number of their commit as `commit`; None without any."""
        out = None
        for number, base in self.commits():
            part = self.spark.read.parquet(self.place(number, base))
            part = part if base else part.withColumn("commit", F.lit(number))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def forget(self, before: int) -> None:
        """Delete commits below a base."""
        root = self._path(self.path)
        for s in self._fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith(("commit-", "base-")) and int(name.split("-")[1]) < before:
                self._fs.delete(s.getPath(), True)


class MeasurementCache:
    """Measurements by path and time.  A row counts for a file as long as its time is within `tolerance` seconds of the
    measured one; of several the last commit's counts."""

    def __init__(self, spark: SparkSession, path: str, key: str = "path", mtime: str = "mtime", tolerance: float = 1e-6):
        self.folder, self.key, self.mtime, self.tolerance = Folder(spark, path), key, mtime, tolerance

    def read(self) -> DataFrame | None:
        """The newest measurement of each key."""
        rows = self.folder.read()
        if rows is None:
            return None
        rest = [c for c in rows.columns if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), "commit").alias("m")).select(self.key, *[F.col(f"m.`{c}`").alias(c) for c in rest])

    def missing(self, work: DataFrame, force: bool = False) -> DataFrame:
        """The rows of work (key, mtime, ...) that have no valid measurement."""
        done = None if force else self.read()
        if done is None:
            return work
        known = done.select(F.col(self.key).alias("_k"), F.col(self.mtime).alias("_m"))
        return work.join(known, (F.col(self.key) == F.col("_k")) & (F.abs(F.col(self.mtime) - F.col("_m")) < self.tolerance), "left_anti")

    def fill(self, work: DataFrame, measure: Callable[[DataFrame], DataFrame], batches: int = 1, bucket: Column | None = None, force: bool = False, most: int | None = None) -> int:
        """Measure what is missing, in so many commits (rows dealt by `bucket`, else by a hash of the key), and give the
        number of commits made.  A run that breaks off keeps the commits it made, and the next one measures only the rest; `most` ends
        a run after so many.  measure: rows of work to rows with key, mtime and results."""
        todo = written(self.missing(work, force), "to-measure")
        place = F.pmod(F.xxhash64(self.key) if bucket is None else bucket, F.lit(batches))
        made = 0
        for i in range(batches):
            if most is not None and made >= most:
                break
            part = todo.where(place == i)
            if not part.isEmpty():
                self.folder.write(measure(part))
                made += 1
        return made

    def compact(self) -> None:
        """The newest rows as one base; the commits before it go."""
        rows = self.read()
        if rows is not None:
            self.folder.forget(self.folder.write(rows, base=True))


def write_gated(df: DataFrame, path: str, required: tuple[str, ...] = ("exposure", "mode")) -> None:
    """K9: df as Parquet under `path` if no row lacks a required field; else ValueError, and no table has that name.

    The fields are counted by the write itself, beside the final name, which the table takes only then."""
    spark = df.sparkSession
    seen = Observation()
    counts = [F.count_if(F.col(c).isNull()).alias(f"f{i}") for i, c in enumerate(required)]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.mode("overwrite").parquet(f"{path}.pending")
    got = seen.get
    lacking = {c: got[f"f{i}"] for i, c in enumerate(required) if got[f"f{i}"]}
    jvm = spark._jvm
    pending, final = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.pending", path))
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if lacking:
        fs.delete(pending, True)
        raise ValueError(f"of {got['rows']} rows " + ", ".join(f"{n} lack {c}" for c, n in lacking.items()))
    if fs.exists(final):
        fs.delete(final, True)
    fs.rename(pending, final)
