"""Frequencies, bigrams, comparison and publication statistics (AGG1-AGG9, W1, W2, L1, L3, SET1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlex.functions import text as T
from loomlex.session import broadcast_if_small

#: L1: orders of a comparison.
SORTS = {
    "shared_desc": (("shared", -1), ("total", -1), ("label", 1)),
    "shared_asc": (("shared", 1), ("total", 1), ("label", 1)),
    "left_desc": (("left_count", -1), ("shared", -1), ("label", 1)),
    "right_desc": (("right_count", -1), ("shared", -1), ("label", 1)),
    "alpha": (("label", 1),),
}
PAGE_LEAST, PAGE_MOST, PAGE = 20, 160, 35


def scope(df: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows of the articles in ``ids``; all of them for None (FLT7)."""
    return df if ids is None else df.join(ids.select("article_id"), "article_id", "left_semi")


def counted(sentences: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(label, count) of normalised words of the articles in ``ids``, outside references: one aggregation."""
    own = scope(sentences.where("section <> 'references'"), ids)
    return own.select(F.explode("norms").alias("label")).where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("count"))


def as_lemmas(counts: DataFrame, lexicon: DataFrame, *columns: str) -> DataFrame:
    """Counts by form added up by lemma; forms without an entry are their own."""
    listed = broadcast_if_small(lexicon.select(F.col("form").alias("label"), "lemma"))
    out = counts.join(listed, "label", "left").groupBy(F.coalesce("lemma", "label").alias("label"))
    return out.agg(*(F.sum(c).alias(c) for c in columns or ("count",)))


def frequency(sentences: DataFrame, ids: DataFrame | None = None, mode: str = "all", scripts: str = "exclude_latin", lexicon: DataFrame | None = None) -> DataFrame:
    """(label, count) of words, or of lemmas when a lexicon is given (AGG1, AGG2).

    Labels are counted first and judged after: the predicate depends only on the label and then
    runs once a label instead of once a token.
    """
    counts = counted(sentences, ids)
    if lexicon is not None:
        counts = as_lemmas(counts, lexicon)
    return counts.where(T.meaningful(F.col("label"), mode, scripts))


def frequencies_of(sentences: DataFrame, left: DataFrame, right: DataFrame, mode: str = "all", scripts: str = "exclude_latin", lexicon: DataFrame | None = None) -> DataFrame:
    """(label, left_count, right_count) of two scopes in one pass over the sentences (AGG5, AGG6)."""
    sides = left.select("article_id", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select("article_id", F.lit(0).alias("l"), F.lit(1).alias("r")))
    sides = sides.groupBy("article_id").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    own = sentences.where("section <> 'references'").join(sides, "article_id").select("l", "r", F.explode("norms").alias("label")).where("label is not null")
    counts = own.groupBy("label").agg(F.sum("l").alias("left_count"), F.sum("r").alias("right_count"))
    if lexicon is not None:
        counts = as_lemmas(counts, lexicon, "left_count", "right_count")
    return counts.where(T.meaningful(F.col("label"), mode, scripts))


def top(counts: DataFrame, n: int | None = None, query: str | None = None) -> DataFrame:
    """Most frequent first, ties in code-point order (AGG3), of the labels that match (FLT6)."""
    out = counts.where(T.label_matches(F.col("label"), query)).orderBy(F.desc("count"), "label")
    return out if n is None else out.limit(n)


def bigrams(sentences: DataFrame, mode: str = "all", scripts: str = "exclude_latin", lexicon: DataFrame | None = None) -> DataFrame:
    """(label, count, first_at) of neighbouring accepted words, or their lemmas, of a sentence (AGG4, W1, W2).

    A token that isn't alphabetic, or that the filter rejects, breaks the chain.  ``first_at`` is the
    place of the first occurrence, the order of ties.  A sentence is one array, so pairs are built
    without a window.  Pairs of forms are counted first; lemmas and the filter follow once a pair.
    """
    s = sentences.where("section <> 'references' and size(norms) > 1")
    pair = F.transform(F.sequence(F.lit(0), F.size("norms") - 2), lambda i: F.struct(i.alias("i"), F.get("norms", i).alias("a"), F.get("norms", i + 1).alias("b")))
    flat = s.select("article_id", "section_no", "sentence", F.explode(F.filter(pair, lambda p: p["a"].isNotNull() & p["b"].isNotNull())).alias("p"))
    pairs = flat.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("article_id", "section_no", "sentence", F.col("p.i").alias("idx"))).alias("first_at"))
    if lexicon is not None:
        listed = broadcast_if_small(lexicon.select("form", "lemma"))
        for c in ("a", "b"):
            pairs = pairs.join(listed, pairs[c] == listed["form"], "left").withColumn(c, F.coalesce("lemma", c)).drop("form", "lemma")
    good = T.meaningful(F.col("a"), mode, scripts) & T.meaningful(F.col("b"), mode, scripts)
    return pairs.where(good).groupBy(F.concat_ws(" ", "a", "b").alias("label")).agg(F.sum("count").alias("count"), F.min("first_at").alias("first_at"))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Labels of both sides: left, right, shared (the less) and total (AGG5, J7, SET2)."""
    return shared_labels(left.select("label", F.col("count").alias("left_count")).join(right.select("label", F.col("count").alias("right_count")), "label"))


def shared_labels(both: DataFrame) -> DataFrame:
    """As :func:`compare` for counts that are side by side already."""
    own = both.where("left_count > 0 and right_count > 0")
    return own.select("label", "left_count", "right_count", F.least("left_count", "right_count").alias("shared"), (F.col("left_count") + F.col("right_count")).alias("total"))


def order_comparison(df: DataFrame, sort: str = "shared_desc") -> DataFrame:
    """L1; the order is total with the label."""
    return df.orderBy(*(F.desc(c) if way < 0 else F.asc(c) for c, way in SORTS.get(sort, SORTS["shared_desc"])))


def page_bounds(offset: object, limit: object, least: int = PAGE_LEAST, most: int = PAGE_MOST, default: int = PAGE) -> tuple[int, int]:
    """L3, L4: offset at least 0, limit within bounds, defaults for what isn't a number."""
    def number(x, default):
        try:
            return int(x)
        except (TypeError, ValueError):
            return default

    return max(0, number(offset, 0)), min(max(number(limit, default), least), most)


def page(ordered: DataFrame, offset: object = 0, limit: object = PAGE) -> DataFrame:
    """One page of a totally ordered table (L2-L4)."""
    o, n = page_bounds(offset, limit)
    return ordered.offset(o).limit(n)


def union_scope(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids of either scope, once (SET1)."""
    return a.select("article_id").unionByName(b.select("article_id")).distinct()


def per_year(articles: DataFrame) -> DataFrame:
    """AGG7."""
    return articles.groupBy("year").agg(F.count(F.lit(1)).alias("articles")).orderBy("year")


def top_authors(links: DataFrame, articles: DataFrame, names: DataFrame, n: int = 10) -> DataFrame:
    """AGG8: authors by distinct published articles."""
    pub = articles.where("is_published").select("article_id")
    counts = links.select("author_id", "article_id").distinct().join(pub, "article_id", "left_semi").groupBy("author_id").agg(F.count(F.lit(1)).alias("articles"))
    return counts.join(names, "author_id").orderBy(F.desc("articles"), "last_name", "first_name", "middle_name", "author_id").limit(n)


def corpus_stats(articles: DataFrame, links: DataFrame, sizes: DataFrame) -> DataFrame:
    """AGG9: issues, articles, authors and tokens of what is published, one row."""
    pub = articles.where("is_published")
    ids = pub.select("article_id")
    a = pub.agg(F.count_distinct(F.struct("year", F.coalesce("volume", F.lit("")), F.coalesce("number", F.lit("")))).alias("issues"), F.count(F.lit(1)).alias("articles"))
    b = links.join(ids, "article_id", "left_semi").agg(F.count_distinct("author_id").alias("authors"))
    c = sizes.join(ids, "article_id", "left_semi").agg(F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each


def issue_counts(articles: DataFrame, links: DataFrame) -> DataFrame:
    """AGG10, AGG11: articles (all, FLT15) and distinct authors of every issue, with its label."""
    key = ["year", "volume", "number"]
    names = articles.select("article_id", *(T.text(F.col(c)).alias(c) if c != "year" else F.col(c) for c in key))
    n = names.groupBy(*key).agg(F.count(F.lit(1)).alias("articles"))
    authors = names.join(links.select("article_id", "author_id").distinct(), "article_id").select(*key, "author_id").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("authors"))
    return n.join(authors, key, "left").select(*key, "articles", F.coalesce("authors", F.lit(0)).cast("bigint").alias("authors"), T.issue_label(F.col("year"), F.col("volume"), F.col("number")).alias("label"))
