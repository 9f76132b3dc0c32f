"""The corpus tables as DataFrames: newest record and text of every article, and link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlex.functions import text as T
from loomlex.session import kept, spread, table


def newest(df: DataFrame, key: str, by: str, tie: str) -> DataFrame:
    """Row of every ``key`` with the greatest (``by``, ``tie``).

    The winners are found on three narrow columns with partial aggregation, so a key that holds a
    third of all rows costs no more than any other; the wide rows are then met by a semi join.
    Rows with a NULL key or NULL ``tie`` are left out; exact copies of a winner are dropped.
    """
    best = df.where(F.col(tie).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max_by(tie, F.struct(F.coalesce(F.col(by).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")), tie)).alias(tie))
    return df.join(best.select(tie), tie, "left_semi").dropDuplicates([tie])


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Newest metadata record of every article (M4/M5: the last import wins)."""
    return newest(table(spark, d, "article_metadata"), "article_id", "ingested_at", "record_id")


def published(spark: SparkSession, d: str) -> DataFrame:
    """SRC2."""
    return articles(spark, d).where("is_published")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Newest text of every article, found once a session: the bodies of copies are dropped on narrow
    columns, those that stay are written once and read by every later query."""
    raw = table(spark, d, "article_text")
    return kept(spark, d, ("article_text",), "texts", lambda: spread(newest(raw, "article_id", "updated_at", "text_id"), raw))


def keyword_links(records: DataFrame) -> DataFrame:
    """(article_id, name, normalized) by keyword, tidied; M7 for lists."""
    k = records.select("article_id", F.explode("keywords").alias("k"))
    return k.select("article_id", F.trim(F.regexp_replace("k", "[ \t ]+", " ")).alias("name")).where("name <> ''").withColumn("normalized", F.lower("name")).dropDuplicates(["article_id", "normalized"])


def author_links(spark: SparkSession, d: str) -> DataFrame:
    """(article_id, author_id, affiliation_id, author_order, name): J2."""
    a = table(spark, d, "author").select("author_id", T.full_name(F.col("last_name"), F.col("first_name"), F.col("middle_name")).alias("full_name"), "last_name")
    link = table(spark, d, "article_author")
    shown = F.when(F.trim(T.text(F.col("display_name"))) != "", F.col("display_name")).otherwise(F.col("full_name"))
    return link.join(a, "author_id").select("article_id", "author_id", "affiliation_id", "author_order", shown.alias("name"), "last_name")


def author_line(links: DataFrame) -> DataFrame:
    """Names of an article joined by ', ' in order."""
    seq = F.array_sort(F.collect_list(F.struct("author_order", "author_id", "name")))
    return links.groupBy("article_id").agg(F.array_join(F.transform(seq, lambda s: s["name"]), ", ").alias("author_line"))


def placed_affiliations(spark: SparkSession, d: str) -> DataFrame:
    """Affiliations with the listed city of the same key (J6): affiliation_id and the city's columns."""
    aff = table(spark, d, "affiliation").select("affiliation_id", T.city_key(F.col("city")).alias("city_key"))
    city = table(spark, d, "city_location").select("city_location_id", "display_name", "region", "country", F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon"), T.city_key(F.col("normalized_name")).alias("city_key"), "normalized_name")
    return aff.where("city_key <> ''").join(city, "city_key")
