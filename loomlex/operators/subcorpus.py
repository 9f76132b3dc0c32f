"""Saved sub-corpora, highlights and logs (SET1-SET4, M13-M16, M21-M25, J9, W9, AGG20, AGG21, FLT10-FLT12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlex.functions import text as T


def refresh(members: DataFrame, selected: DataFrame) -> DataFrame:
    """Membership after a filter ran again: rows from the filter are replaced, manual rows stay (SET3)."""
    manual = members.where("source = 'manual'").select("subcorpus_id", "article_id", "source")
    new = selected.select("subcorpus_id", "article_id").distinct().join(manual, ["subcorpus_id", "article_id"], "left_anti")
    return manual.unionByName(new.withColumn("source", F.lit("filter")))


def add_members(members: DataFrame, extra: DataFrame) -> DataFrame:
    """Manual additions; rows that are there stay as they are."""
    new = extra.select("subcorpus_id", "article_id").distinct().join(members, ["subcorpus_id", "article_id"], "left_anti")
    return members.unionByName(new.withColumn("source", F.lit("manual")))


def remove_members(members: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members left, removed rows to restore later)."""
    key = ["subcorpus_id", "article_id"]
    return members.join(gone, key, "left_anti"), members.join(gone, key, "left_semi")


def candidates(articles: DataFrame, members: DataFrame, subcorpus_id: int) -> DataFrame:
    """Articles not yet in a sub-corpus, newest issue first (FLT11, L11)."""
    own = members.where(F.col("subcorpus_id") == subcorpus_id)
    return articles.join(own, "article_id", "left_anti").orderBy(F.desc("year"), F.desc_nulls_first("volume"), "title", "article_id")


def totals(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """AGG20: articles and tokens of every sub-corpus."""
    m = members.select("subcorpus_id", "article_id").distinct()
    return m.join(sizes, "article_id", "left").groupBy("subcorpus_id").agg(F.count(F.lit(1)).alias("articles"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))


def ordered_members(members: DataFrame, articles: DataFrame) -> DataFrame:
    """L10."""
    return members.join(articles.select("article_id", "year", "title"), "article_id").orderBy("subcorpus_id", "year", "title", "article_id")


def visible(subcorpora: DataFrame, user_id: int | None) -> DataFrame:
    """Own and public ones; only public ones without a user (FLT10)."""
    return subcorpora.where(F.col("is_public") | (F.lit(False) if user_id is None else F.col("user_id") == user_id))


def capable(users: DataFrame, flag: str) -> DataFrame:
    """Staff, superusers, and users whose role has ``flag`` (FLT12)."""
    return users.where(F.coalesce(F.col(flag), F.lit(False)) | F.col("is_staff") | F.col("is_superuser"))


def overlapping(marks: DataFrame, wanted: DataFrame, earlier: bool = False) -> DataFrame:
    """Pairs (mark_id, wanted_id) of one user's marks in one article that overlap (J9); with ``earlier`` those
    with a lesser mark_id only, when both sides are one table.

    Ranges are laid out in cells of 2048 characters, so that the join is on equal keys even when one
    article holds very many marks; a pair counts in the cell where its overlap starts.
    """
    cell = 2048
    cells = lambda d, a, b: d.withColumn("cell", F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1) / cell))))
    m = cells(marks.select("mark_id", "user_id", "article_id", "char_start", "char_end").where("char_end > char_start"), "char_start", "char_end")
    w = cells(wanted.select("wanted_id", "user_id", "article_id", F.col("char_start").alias("a"), F.col("char_end").alias("b")).where("b > a"), "a", "b")
    both = m.join(w, ["user_id", "article_id", "cell"]).where("char_start < b and char_end > a")
    both = both.where("mark_id < wanted_id") if earlier else both
    return both.where(F.floor(F.greatest("char_start", "a") / cell) == F.col("cell")).select("mark_id", "wanted_id")


def new_marks(marks: DataFrame, wanted: DataFrame, texts: DataFrame, most: int = 1600, earlier: bool = False) -> DataFrame:
    """Wanted highlights that can be stored: clamped to the text, without outer white space, not
    empty, not too long, overlapping no stored one (M16)."""
    t = wanted.join(texts.select("article_id", "body_text"), "article_id")
    n = F.length("body_text")
    a, b = F.greatest(F.lit(0), F.least("char_start", n)), F.greatest(F.lit(0), F.least("char_end", n))
    t = t.withColumn("a", a).withColumn("raw", F.substring("body_text", a + 1, F.greatest(F.lit(0), b - a)))
    lead = F.length("raw") - F.length(F.regexp_replace("raw", r"(?U)^\s+", ""))
    t = t.withColumn("selected_text", T.strip(F.col("raw"))).withColumn("char_start", F.col("a") + lead).withColumn("char_end", F.col("a") + lead + F.length("selected_text"))
    good = t.where((F.col("selected_text") != "") & (F.length("selected_text") <= most)).select("wanted_id", "user_id", "article_id", "char_start", "char_end", "selected_text")
    return good.join(overlapping(marks, good, earlier).select("wanted_id"), "wanted_id", "left_anti")


def grouped_marks(marks: DataFrame, active: int | None = None) -> DataFrame:
    """A user's marks, newest first in their article, articles by their newest mark; the article of
    the active mark leads."""
    by = Window.partitionBy("user_id", "article_id")
    lead = F.max(F.when(F.col("mark_id") == (-1 if active is None else active), 1).otherwise(0)).over(by)
    out = marks.withColumn("newest", F.max("updated_at").over(by)).withColumn("lead", lead).withColumn("place", F.row_number().over(by.orderBy(F.desc("updated_at"), F.desc("mark_id"))))
    return out.orderBy("user_id", F.desc("lead"), F.desc("newest"), "article_id", "place")


def mark_counts(marks: DataFrame) -> DataFrame:
    """AGG21: marks and marked articles of every user."""
    return marks.groupBy("user_id").agg(F.count(F.lit(1)).alias("marks"), F.count_distinct("article_id").alias("articles"))


def save_query(saved: DataFrame, row: DataFrame) -> DataFrame:
    """Insert, or replace the same user's query of that id."""
    return saved.join(row, ["user_id", "query_id"], "left_anti").unionByName(row)


def with_result_count(row: DataFrame, ids: DataFrame) -> DataFrame:
    """A saved query with the number of its results counted anew."""
    return row.drop("result_count").join(F.broadcast(ids.agg(F.count(F.lit(1)).alias("result_count"))))  # one row


def rename_query(saved: DataFrame, user_id: int, query_id: int, name: str) -> DataFrame:
    """Its owner renames a saved query."""
    own = (F.col("user_id") == user_id) & (F.col("query_id") == query_id)
    return saved.withColumn("name", F.when(own, F.lit(name)).otherwise(F.col("name")))


def delete_query(saved: DataFrame, user_id: int, query_id: int) -> DataFrame:
    """Its owner deletes a saved query."""
    return saved.where(~F.coalesce((F.col("user_id") == user_id) & (F.col("query_id") == query_id), F.lit(False)))


def restore_members(members: DataFrame, removed: DataFrame) -> DataFrame:
    """The rows removed last come back as they were, unless they are there again."""
    return members.unionByName(removed.join(members, ["subcorpus_id", "article_id"], "left_anti").select(*members.columns))


def log_activity(log: DataFrame, events: DataFrame) -> DataFrame:
    """M23, TS8: only known kinds, only signed-in users."""
    return log.unionByName(events.where(F.col("user_id").isNotNull() & F.col("activity_type").isin("search", "subcorpus", "export", "import", "login")).select(*log.columns))
