"""Sources: import packages, uploaded files, HTML archives (SRC3-SRC13)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from loomlex.functions import text as T
from loomlex.functions.udf import decode_upload_udf
from loomlex.sources.html_page import HEADING_CLASSES, read_issue, read_page

AUTHOR = S.StructType([S.StructField(n, S.StringType()) for n in ("first_name", "last_name", "middle_name", "affiliation", "display_name", "slug")])
ARTICLE = S.StructType([
    *(S.StructField(n, S.IntegerType() if n == "year" else S.StringType()) for n in ("slug", "title", "year", "volume", "number", "issue_title", "issue_url", "section", "language", "pages", "doi", "abstract", "text_file", "source_file", "original_url", "references")),
    S.StructField("keywords", S.ArrayType(S.StringType())), S.StructField("is_published", S.BooleanType()), S.StructField("authors", S.ArrayType(AUTHOR)),
])
JOURNAL = S.StructType([S.StructField(n, S.StringType()) for n in ("title", "short_title", "publisher", "description", "site_url")])
PACKAGE = S.StructType([S.StructField("journal", JOURNAL), S.StructField("articles", S.ArrayType(ARTICLE))])


def read_package(spark: SparkSession, path: str) -> DataFrame:
    """Articles of an import package with their texts (SRC3): metadata.json and the files it names.

    A text file that is named but missing fails the job when the row is used.
    """
    meta = spark.read.schema(PACKAGE).option("multiLine", True).json(f"{path}/metadata.json")
    a = meta.select("journal.title", F.explode("articles").alias("a")).select(F.col("title").alias("journal"), "a.*")
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path)
    files = files.select(F.col("value").alias("body_text"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    name = F.element_at(F.split("text_file", "/"), -1)
    both = a.join(files, name == files["file"], "left").drop("file")
    missing = (T.text(F.col("text_file")) != "") & F.col("body_text").isNull()
    return both.withColumn("body_text", F.when(missing, F.raise_error(F.concat(F.lit("missing text file: "), "text_file"))).otherwise(F.col("body_text")))


def package_authors(articles: DataFrame) -> DataFrame:
    """Authors of an import in order; articles without any stay out."""
    return articles.select("slug", F.posexplode("authors").alias("pos", "a")).select("slug", (F.col("pos") + 1).alias("author_order"), "a.*")


#: Kinds of uploaded files with their first bytes and media types.
KINDS = {"pdf": ("25504446", "application/pdf"), "docx": ("504B0304", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), "txt": ("", "text/plain")}


def read_uploads(spark: SparkSession, path: str, most: int = 25 * 1024 * 1024) -> DataFrame:
    """Uploaded files: kind, media type, size, checksum, text and ``problem`` (SRC11, SRC12, M27).

    Every file has a row.  ``problem`` says what keeps it out: 'too large', 'unknown kind' or 'other
    first bytes'; it is '' for files that are taken.  The bytes of files that are too large aren't read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = T.file_kind(F.col("path"))
    small = raw.where(F.col("length") <= most)
    head = F.hex(F.substring("content", 1, 4))
    known = F.create_map(*(F.lit(x) for k, (h, _) in KINDS.items() for x in (k, h)))
    media = F.create_map(*(F.lit(x) for k, (_, m) in KINDS.items() for x in (k, m)))
    first = F.coalesce(F.try_element_at(known, kind), F.lit("-"))
    problem = F.when(first == "-", "unknown kind").when((first != "") & (head != first), "other first bytes").otherwise("")
    taken = small.select(
        "path", kind.alias("kind"), F.try_element_at(media, kind).alias("media_type"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("checksum"),
        F.when((kind == "txt") & (problem == ""), decode_upload_udf("content")).otherwise("").alias("text"), problem.alias("problem"))
    large = raw.where(F.col("length") > most).select("path", kind.alias("kind"), F.try_element_at(media, kind).alias("media_type"), F.col("length").alias("bytes"), F.lit(None).cast("string").alias("checksum"), F.lit("").alias("text"), F.lit("too large").alias("problem"))
    return taken.unionByName(large)


def best_extraction(pages: DataFrame, primary: str = "primary") -> DataFrame:
    """Of several engines' texts of a file the one that is taken (SRC9): ``pages`` has file, engine, page, plain,
    layout and images.

    The primary engine's text is taken at once when it has no flag and no page without text; else the
    text with the best score, the primary engine's among equals.  A page of images only counts as an
    empty page as well.
    """
    p = pages.withColumn("t", T.pick_page_text(F.col("plain"), F.col("layout")))
    empty = T.strip(F.col("t")) == ""
    seq = F.array_sort(F.collect_list(F.struct("page", "t")))  # the pages of one file
    per = p.groupBy("file", "engine").agg(F.array_join(F.transform(seq, lambda s: T.text(s["t"])), "\n\n").alias("raw"), F.count_if(empty).alias("empty_pages"), F.count_if(empty & (F.col("images") > 0)).alias("image_pages"))
    q = per.withColumn("q", T.quality(F.col("raw"))).withColumn("text", T.sanitize(F.col("raw")))
    score = T.extraction_score(F.col("q.word_count"), F.col("q.char_count"), F.col("q.private_use_count"), F.col("empty_pages"), F.col("image_pages"))
    first = F.col("engine") == primary
    healthy = first & (F.size(F.filter("q.flags", lambda f: f != "private_use_symbols")) == 0) & (F.col("empty_pages") == 0)
    ranked = q.withColumn("score", score).groupBy("file").agg(F.max_by(F.struct("engine", "text", "score", "empty_pages", "image_pages"), F.struct(healthy, "score", first, "engine")).alias("b"))
    return ranked.select("file", "b.*")


def editor_authors(df: DataFrame, key: str, column: str) -> DataFrame:
    """'name | affiliation' lines of an editor's form (SRC13)."""
    lines = df.select(key, F.posexplode(F.split(F.regexp_replace(T.text(F.col(column)), "\r\n?", "\n"), "\n")).alias("pos", "line")).where(T.strip(F.col("line")) != "")
    part = F.split("line", "\\|", 2)
    return lines.select(key, "pos", T.squeeze(F.get(part, 0)).alias("name"), T.squeeze(F.get(part, 1)).alias("affiliation")).where("name <> ''")


# ------------------------------------------------------------ HTML


PAGE = "struct<meta:map<string,array<string>>,links:array<string>,headings:array<string>,abstract:string,references:array<string>>"
ISSUE = "struct<heading:string,published:string,articles:array<struct<url:string,pdf_url:string,section:string>>>"


def page_udf():
    """UDF (html, url) -> meta, links, headings and fallback blocks (SRC4-SRC6, W10)."""

    @F.pandas_udf(PAGE)
    def parse(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        rows = [read_page(h, u or "") for h, u in zip(html, url)]
        return pd.DataFrame({k: [r[k] for r in rows] for k in ("meta", "links", "headings", "abstract", "references")})

    return parse


def issue_udf(headings: tuple[str, ...] = HEADING_CLASSES):
    """UDF (html, url) -> heading, day and articles of an issue page (SRC4)."""

    @F.pandas_udf(ISSUE)
    def parse(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        rows = [read_issue(h, u or "", headings) for h, u in zip(html, url)]
        return pd.DataFrame({k: [r[k] for r in rows] for k in ("heading", "published", "articles")})

    return parse


def article_metadata(pages: DataFrame) -> DataFrame:
    """Bibliographic fields of article pages from (url, html) with their fallbacks (SRC6, SRC8)."""
    m = pages.select("url", page_udf()("html", "url").alias("p")).select("url", F.col("p.meta").alias("m"), "p.abstract", F.col("p.references").alias("listed"))
    values = lambda *keys: F.coalesce(*(F.try_element_at("m", F.lit(k)) for k in keys), F.array().cast("array<string>"))
    first = lambda *keys: F.coalesce(*(F.get(F.try_element_at("m", F.lit(k)), 0) for k in keys), F.lit(""))
    last = lambda *keys: F.coalesce(*(F.element_at(F.try_element_at("m", F.lit(k)), -1) for k in keys), F.lit(""))
    names, places = values("citation_author", "DC.Creator.PersonalName"), values("citation_author_institution")
    authors = F.transform(names, lambda n, i: F.struct(n.alias("name"), F.coalesce(F.get(places, i), F.lit("")).alias("affiliation")))
    lang = first("citation_language", "DC.Language")
    summary, cited = last("DC.Description", "citation_abstract", "description"), values("citation_reference")
    return m.select(
        "url", F.regexp_extract("url", r"/article/view/(\d+)", 1).alias("number"), first("citation_title", "DC.Title").alias("title"), F.when(summary != "", summary).otherwise(F.col("abstract")).alias("abstract"),
        values("citation_keywords", "DC.Subject").alias("keywords"), F.when(F.size(cited) > 0, cited).otherwise(F.col("listed")).alias("references"), authors.alias("authors"), F.when(lang == "", "ru").otherwise(lang).alias("language"),
        T.parse_date(first("citation_date", "DC.Date.issued")).alias("date"), first("citation_volume", "DC.Source.Volume").alias("volume"), first("citation_issue", "DC.Source.Issue").alias("number_of_issue"),
        first("citation_doi", "DC.Identifier.DOI").alias("doi"), T.joined("-", first("citation_firstpage"), first("citation_lastpage")).alias("pages"), first("citation_pdf_url").alias("pdf_url"), first("DC.Type.articleType").alias("section"))


def issue_heading(c) -> F.Column:
    """'Том 3 № 2 (2024)': struct volume, number, year; fails on anything else (SRC7)."""
    pattern = r"(?iU)(?:Том|Т\.)\s*([\w.-]+)\s*(?:№|N)\s*([\w.-]+)\s*\((\d{4})\)"
    x = T.squeeze(c)
    part = lambda i: F.regexp_extract(x, pattern, i)
    good = F.struct(part(1).alias("volume"), part(2).alias("number"), part(3).cast("int").alias("year"))
    return F.when(x.rlike(pattern), good).otherwise(F.raise_error(F.concat(F.lit("no issue heading: "), x)).cast("struct<volume:string,number:string,year:int>"))


def issue_links(pages: DataFrame) -> DataFrame:
    """Absolute links of archive pages to issues, in order, each once (SRC4)."""
    links = pages.select("url", F.posexplode(page_udf()("html", "url")["links"]).alias("pos", "link"))
    return links.where(F.contains("link", F.lit("/issue/view/")))


def issue_articles(pages: DataFrame, headings: tuple[str, ...] = HEADING_CLASSES) -> DataFrame:
    """Articles of issue pages from (url, html) with volume, number, year, day and section (SRC4, SRC7);
    ``headings`` are the classes of headings of issues, in order of preference.

    A page without a heading of an issue fails the job when its rows are used.
    """
    p = pages.select("url", issue_udf(headings)("html", "url").alias("p"))
    p = p.select("url", issue_heading(F.col("p.heading")).alias("h"), T.parse_date(F.col("p.published")).alias("day"), F.posexplode("p.articles").alias("pos", "a"))
    return p.select(F.col("url").alias("issue_url"), "h.volume", "h.number", "h.year", "day", "pos", F.col("a.url").alias("url"), "a.pdf_url", "a.section")
