"""Exports: CSV tables, search results, JSON pages (SNK1-SNK6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlex.functions import text as T


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """A CSV with a header; ``single`` writes one file, for reports of a bounded size."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def frequency_table(counts: DataFrame, label: str = "Слово") -> DataFrame:
    """SNK1."""
    return counts.select(F.col("label").alias(label), F.col("count").alias("Частота"))


def comparison_table(rows: DataFrame) -> DataFrame:
    """SNK2."""
    return rows.select("label", "left_count", "right_count", "shared", "total")


def search_table(results: DataFrame) -> DataFrame:
    """SNK3: one line a result, contexts without tags joined by ' | '."""
    return results.select("title", "author_line", "year", T.text(F.col("section")).alias("section"), "hit_count", F.array_join(F.transform("contexts", T.strip_tags), " | ").alias("contexts"))


def json_page(ordered: DataFrame, offset: int, limit: int) -> DataFrame:
    """SNK4: one row with the page as JSON: rows, total, offset, limit, has_more.

    The page is found by offset and limit before it is gathered, so only ``limit`` rows meet.
    """
    total = ordered.agg(F.count(F.lit(1)).alias("total"))
    rows = ordered.offset(offset).limit(limit).agg(F.collect_list(F.struct(*ordered.columns)).alias("rows"))
    body = F.struct("rows", "total", F.lit(offset).alias("offset"), F.lit(limit).alias("limit"), (F.col("total") > offset + limit).alias("has_more"))
    return rows.join(F.broadcast(total)).select(F.to_json(body).alias("page"))  # one row each


def bundle(frames: dict[str, DataFrame], most: int = 5_000) -> dict[str, list[dict]]:
    """SNK5: named tables as lists of rows.  A table of more than ``most`` rows is refused, never cut; such
    tables are for :func:`write_bundle`."""
    out = {}
    for name, df in frames.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        out[name] = [r.asDict(recursive=True) for r in rows]
    return out


def write_bundle(frames: dict[str, DataFrame], path: str) -> None:
    """SNK5 for tables of any size: a folder of JSON lines each."""
    for name, df in frames.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def backup(spark: SparkSession, d: str, tables: list[str], target: str) -> DataFrame:
    """SNK7: copies of tables below ``target``, and a manifest (name, rows, signature) of what was copied."""
    rows = []
    for name in tables:
        src = spark.read.parquet(f"{d}/{name}.parquet")
        src.write.mode("overwrite").parquet(f"{target}/{name}.parquet")
        copy = spark.read.parquet(f"{target}/{name}.parquet")
        got = copy.agg(F.count(F.lit(1)).alias("n"), T.signature(F.to_json(F.struct(*copy.columns))).alias("s")).collect()[0]
        rows.append((name, got["n"], got["s"]))
    manifest = spark.createDataFrame(rows, "name string, rows bigint, signature string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{target}/manifest")  # a row a table
    return manifest


def write_partitioned(df: DataFrame, path: str, by: str, buckets: int = 64) -> None:
    """SNK6: Parquet by hash bucket of ``by``; only the buckets at hand are replaced."""
    b = df.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(buckets)))
    b.repartition("bucket").sortWithinPartitions("bucket", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
