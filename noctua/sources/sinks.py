"""Sinks: CSV, JSON lines, manifests, calibration documents, layouts and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noctua.functions.scalar import finite, general


def significant(df: DataFrame, digits: int = 8, fixed: int | None = None) -> DataFrame:
    """K1, K4: doubles as text of some significant (or, fixed, decimal) digits; not finite: empty."""
    write = lambda x: general(x, digits) if fixed is None else F.format_string(f"%.{fixed}f", x)
    text = lambda c: F.when(finite(F.col(c)).isNotNull(), write(finite(F.col(c))))
    return df.select(*[text(c).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, digits: int = 8, fixed: int | None = None, one_file: bool = False) -> None:
    """K1, K2, K4: fixed columns with a header; NULL and not finite are empty.  one_file is for small reports only."""
    out = significant(df.select(*(columns or df.columns)), digits, fixed)
    (out.coalesce(1) if one_file else out).write.csv(path, header=True, nullValue="", emptyValue="", mode="overwrite")


def write_jsonl(df: DataFrame, path: str, columns: list[str]) -> None:
    """K2: named columns only."""
    df.select(*columns).write.json(path, mode="overwrite")


def rewrite_table(df: DataFrame, path: str) -> None:
    """K3: the new table is written whole beside the old one, then takes its name by two renames; between them, for the
    time of one rename, no table has the name, and the old one stays as `path`.old until the end."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    here, there, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new", f"{path}.old"))
    fs.delete(old, True)
    if fs.exists(here):
        fs.rename(here, old)
    fs.rename(there, here)
    fs.delete(old, True)


def append_rows(df: DataFrame, path: str) -> None:
    """K3: add rows."""
    df.write.mode("append").parquet(path)


def write_manifests(df: DataFrame, path: str, keys: tuple[str, ...] = ("user", "equipment", "filter")) -> None:
    """K5, K7: one table, a folder for each group; a group's rows are brought together first, hot ones in several files."""
    df.repartition(*keys, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.partitionBy(*keys).mode("overwrite").parquet(path)


def calibration_document(models: DataFrame, reference: str, updated: str) -> DataFrame:
    """K6: one JSON document with the reference filter, the models by filter and the date; models: a row for each filter."""
    entry = F.struct(F.col("filter"), F.struct(*[c for c in models.columns if c != "filter"]))
    return models.agg(F.to_json(F.struct(F.lit(reference).alias("reference_filter"), F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("filters"), F.lit(updated).alias("updated"))).alias("document"))


def masters_index(manifest: DataFrame) -> DataFrame:
    """K8: finished masters by filter, user and equipment, without regard to case."""
    from noctua.functions.scalar import filter_rank

    return manifest.where("state = 'master_written'").orderBy(filter_rank(F.col("filter")), F.lower("user"), F.lower("equipment"))


def collected_frames(status: DataFrame, root: str, source: str = "path", keys: tuple[str, ...] = ("filter", "user", "equipment")) -> DataFrame:
    """K7: where each kept frame is to stand: root/keys/name, made safe; names that meet in one folder get a part of a hash
    of the source.  The layout is a table (source, target) for write_manifests, not links."""
    from noctua.functions.scalar import sanitize
    from noctua.operators.sessions import unique_names

    kept = status.where(F.col("drop_status").isin("reference", "kept"))
    folder = F.concat_ws("/", F.lit(root.rstrip("/")), *[sanitize(F.col(k).cast("string")) for k in keys])
    named = kept.withColumns({"folder": folder, "name": F.element_at(F.split(F.col(source).cast("string"), "/"), -1)})
    return unique_names(named, ["folder"], "name", source).withColumn("target", F.concat_ws("/", "folder", "link_name"))
