"""Quality audits, upserts and clean-ups (AGG23-AGG25, M4-M11, M18-M22, W10-W12, J11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from loomlex.functions import text as T
from loomlex.functions.udf import article_slug_udf, clean_body_udf
from loomlex.session import stage_table


def quality_report(texts: DataFrame, column: str = "body_text") -> DataFrame:
    """AGG24: counts, shares and flags of every text."""
    return texts.select("article_id", T.quality(F.col(column)).alias("q")).select("article_id", "q.*")


def audit(articles: DataFrame, texts: DataFrame, most: int | None = 80, pages: DataFrame | None = None) -> DataFrame:
    """Published articles whose body has a flag, first ``most`` by id.

    ``pages`` (article_id, empty_pages, image_pages, failed) of their files adds flags for these.
    """
    body = articles.where("is_published").select("article_id", "title").join(texts.select("article_id", "body_text"), "article_id", "left")
    flags = T.quality(F.col("body_text"))["flags"]
    if pages is not None:
        body = body.join(pages, "article_id", "left")
        count = lambda name, c: F.when(F.col(c) > 0, F.concat(F.lit(f"{name}:"), F.col(c).cast("string")))
        flags = F.concat(flags, F.array_compact(F.array(count("pdf_empty_pages", "empty_pages"), count("pdf_image_only_pages", "image_pages"), F.when(F.col("failed"), "pdf_read_failed"))))
    out = body.select("article_id", "title", flags.alias("flags")).where(F.size("flags") > 0).orderBy("article_id")
    return out if most is None else out.limit(most)


def audit_counters(articles: DataFrame, texts: DataFrame) -> DataFrame:
    """AGG23: one row of counters in one pass."""
    body = articles.where("is_published").join(texts.select("article_id", "body_text"), "article_id", "left").select("text_file", "source_file", "original_url", T.quality(F.col("body_text")).alias("q"))
    none = (T.text(F.col("source_file")) == "") & (T.text(F.col("original_url")) == "")
    return body.agg(F.count(F.lit(1)).alias("articles"), F.count_if(F.size("q.flags") > 0).alias("flagged"), F.count_if(F.col("q.private_use_count") > 0).alias("private_use"), F.count_if(F.col("q.char_count") == 0).alias("empty"), F.count_if(none).alias("without_source"))


def repair_candidates(articles: DataFrame, texts: DataFrame, mode: str = "missing") -> DataFrame:
    """Articles without a body, with a flagged one ('quality'), or all ('force')."""
    pub = articles.where("is_published")
    if mode == "force":
        return pub
    if mode == "quality":
        return pub.join(quality_report(texts).where(F.size("flags") > 0), "article_id", "left_semi")
    return pub.join(texts.where("body_text > ''"), "article_id", "left_anti")


def repaired_bodies(raw: DataFrame) -> DataFrame:
    """Cleaned body, or the sanitised one when nothing is left; raw has body, title and abstract."""
    clean = clean_body_udf("body_text", "title", "abstract")
    return raw.select("article_id", F.coalesce(F.nullif(clean, F.lit("")), T.sanitize(F.col("body_text"))).alias("body_text"))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those with equal keys (M4, M5); NULL keys equal each other."""
    cond = reduce(lambda a, b: a & b, (existing[k].eqNullSafe(new[k]) for k in keys))
    return existing.join(new, cond, "left_anti").unionByName(new)


def match_uploads(uploads: DataFrame, articles: DataFrame) -> DataFrame:
    """(upload_id, article_id): by DOI first, else by title and issue (M6)."""
    doi = uploads.where(T.text(F.col("doi")) != "").join(articles.where(T.text(F.col("doi")) != "").select("doi", F.col("article_id").alias("d")), "doi").groupBy("upload_id").agg(F.min("d").alias("by_doi"))
    key = ["title", "year", "volume", "number"]
    name = uploads.join(articles.select(*key, F.col("article_id").alias("t")), key).groupBy("upload_id").agg(F.min("t").alias("by_title"))
    return uploads.select("upload_id").join(doi, "upload_id", "left").join(name, "upload_id", "left").select("upload_id", F.coalesce("by_doi", "by_title").alias("article_id"))


def split_keywords(df: DataFrame, key: str, column: str) -> DataFrame:
    """M7: (key, name, normalized) of comma-separated keywords, first spelling kept."""
    k = df.select(key, F.posexplode(F.split(T.text(F.col(column)), ",")).alias("no", "name")).withColumn("name", T.strip(F.col("name"))).where("name <> ''")
    return k.groupBy(key, F.lower("name").alias("normalized")).agg(F.min_by("name", "no").alias("name"))


def orphans(authors: DataFrame, affiliations: DataFrame, links: DataFrame, keywords: DataFrame | None = None, keyword_links: DataFrame | None = None, files: DataFrame | None = None, used: DataFrame | None = None, lemmas: DataFrame | None = None, forms: DataFrame | None = None) -> DataFrame:
    """(kind, id) of rows that nothing refers to (M8, M26, J11): authors and affiliations without links, keywords
    without articles, files that no article names, lemmas without words."""
    kinds = [("author", authors.join(links, "author_id", "left_anti"), "author_id"), ("affiliation", affiliations.join(links.where("affiliation_id is not null"), "affiliation_id", "left_anti"), "affiliation_id")]
    if keywords is not None and keyword_links is not None:
        kinds.append(("keyword", keywords.join(keyword_links, "normalized", "left_anti"), "normalized"))
    if files is not None and used is not None:
        kinds.append(("file", files.join(used, "file", "left_anti"), "file"))
    if lemmas is not None and forms is not None:
        kinds.append(("lemma", lemmas.join(forms, "lemma", "left_anti"), "lemma"))
    return reduce(DataFrame.unionByName, (df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id")) for kind, df, c in kinds))


def purge(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """M9: without the rows of the named imports."""
    return df.where(~F.coalesce(F.col(column).isin(*values), F.lit(False)))


def unseen(crawled: DataFrame, known: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Crawled rows whose key isn't stored; the first ``most`` by key when a crawl is bounded."""
    out = crawled.join(known.select(key), key, "left_anti")
    return out if most is None else out.orderBy(key).limit(most)


def body_with_fallback(new: DataFrame, files: DataFrame, existing: DataFrame) -> DataFrame:
    """M4: (slug, body_text, origin): the body of an import, else the text of its saved file, else the one at hand."""
    filled = lambda c: F.when(T.strip(F.col(c)) != "", F.col(c))
    both = new.select("slug", "body_text").join(files.select("slug", F.col("text").alias("file_text")), "slug", "left").join(existing.select("slug", F.col("body_text").alias("old_text")), "slug", "left")
    origin = F.when(filled("body_text").isNotNull(), "import").when(filled("file_text").isNotNull(), "file").when(filled("old_text").isNotNull(), "existing").otherwise("none")
    return both.select("slug", F.coalesce(filled("body_text"), filled("file_text"), filled("old_text"), F.lit("")).alias("body_text"), origin.alias("origin"))


def import_counters(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """AGG25: rows seen, created, updated, with and without a file of an import, in one row."""
    old = existing.select(key).distinct().withColumn("old", F.lit(True))
    own = new.dropDuplicates([key]).join(old, key, "left")
    has = T.text(F.col("source_file")) != ""
    return own.agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("old").isNull()).alias("created"), F.count_if(F.col("old")).alias("updated"), F.count_if(has).alias("with_file"), F.count_if(~has).alias("without_file"))


def active_journal(journals: DataFrame) -> DataFrame:
    """The first active journal by id."""
    return journals.where("is_active").orderBy("journal_id").limit(1)


def listed(df: DataFrame, query: str = "", fields: tuple[str, ...] = (), equal: dict | None = None) -> DataFrame:
    """FLT16: rows of a management list: every word of the query in some field, and equal values."""
    out = df
    for c, v in (equal or {}).items():
        out = out.where(F.col(c) == v)
    for word in query.split():
        out = out.where(reduce(lambda a, b: a | b, (T.has(F.col(c).cast("string"), F.lit(word)) for c in fields)))
    return out


def locked_out(failures: DataFrame, user: str, ts: str, limit: int = 8, width: str = "900 seconds") -> DataFrame:
    """AGG26: (user, window, failures) of those with ``limit`` failures or more within a window."""
    n = failures.groupBy(F.col(user).alias("user"), F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("failures"))
    return n.where(F.col("failures") >= limit).select("user", F.unix_timestamp("w.start").alias("start_s"), "failures")


def first_seen(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """First row of every key, by partial aggregation."""
    rest = F.struct(*df.columns)
    return df.groupBy(*key).agg(F.min_by(rest, order).alias("r")).select("r.*")


def unique_slugs(df: DataFrame, column: str, order: str) -> DataFrame:
    """The first row of a slug keeps it; later ones, in ``order``, get -2, -3 … and skip every number that
    makes the slug of another title.

    Rows are ranked by ranges of (slug, order), so that rows of one slug ('article' of empty titles, say)
    lie in many tasks: places within a range, and the numbers of rows in the ranges before it.
    """
    keyed = df.withColumn("base", article_slug_udf(column))
    width = keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = stage_table(keyed.repartitionByRange(int(width), "base", order).withColumn("range", F.spark_partition_id()), "slugs")
    sizes = ranged.groupBy("base", "range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("base").orderBy("range")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("base", "range").orderBy(order))
    ranked = ranged.withColumn("place", place).join(before, ["base", "range"]).withColumn("n", F.col("place") + F.col("before"))
    natural = sizes.select(F.regexp_extract("base", r"^(.+)-(\d{1,9})$", 1).alias("of"), F.regexp_extract("base", r"^(.+)-(\d{1,9})$", 2).alias("k"), "base").distinct()
    taken = natural.where((F.col("of") != "") & (F.concat_ws("-", "of", F.col("k").cast("int").cast("string")) == F.col("base"))).groupBy(F.col("of").alias("base")).agg(F.sort_array(F.collect_set(F.col("k").cast("int"))).alias("taken"))
    number = F.aggregate(F.coalesce("taken", F.array().cast("array<int>")), F.col("n").cast("int"), lambda n, t: n + F.when((t >= 2) & (t <= n), 1).otherwise(0))
    suffix = F.concat(F.lit("-"), number.cast("string"))
    slug = F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat(F.substring(F.col("base"), F.lit(1), F.lit(255) - F.length(suffix)), suffix))
    return ranked.join(taken, "base", "left").withColumn("slug", slug).select(*df.columns, "slug")


def numbered_authors(records: DataFrame) -> DataFrame:
    """Authors of a record with their order from 1."""
    return records.select("article_id", F.posexplode("authors").alias("pos", "a")).select("article_id", (F.col("pos") + 1).alias("author_order"), "a.*")


def distinct_lemmas(tokens: DataFrame) -> DataFrame:
    """M22."""
    return tokens.where("lemma is not null").select("lemma", T.token_language(F.col("normalized"), F.lit("ru")).alias("language")).distinct()


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """AGG25: the import with counters that fill when it runs."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("seen"), F.count_if(F.col("is_published")).alias("published")), o


def missing_vectors(articles: DataFrame, postings: DataFrame) -> DataFrame:
    """AGG23: published articles that the index has no word of."""
    return articles.where("is_published").join(postings.select("article_id").distinct(), "article_id", "left_anti")


def synced_roles(users: DataFrame, roles: DataFrame, default: str) -> DataFrame:
    """Users with the flags of their role; users without a known role get the default one."""
    known = users.join(F.broadcast(roles.select("role", F.lit(True).alias("known"))), "role", "left")  # one row a role
    assigned = known.withColumn("role", F.when(F.col("known"), F.col("role")).otherwise(F.lit(default))).drop("known")
    return assigned.join(F.broadcast(roles), "role")
