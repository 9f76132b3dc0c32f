"""Queries over the relational tables: filters, joins, roll-ups, set operations, logs, the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlex.functions import text as T
from loomlex.functions.udf import article_slug_udf
from loomlex.operators import analytics, catalog, geo, index, maintenance, search, subcorpus
from loomlex.sources import batch_import
from loomlex.plans.corpus_queries import ARTICLE, BASE, TEXT, _context_sql, curated_sql
from loomlex.session import table
from loomlex.sinks import exports


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "article_author")


def _names(spark, d):
    return table(spark, d, "author").select("author_id", "last_name", "first_name", "middle_name")


# ---- filters and joins


def flt1_composite_filter(spark, d):
    a = catalog.published(spark, d)
    f = search.ArticleFilter(year_from=2005, year_to=2023, language="ru", keyword="рынок")
    return search.apply_filter(a, f, _links(spark, d), catalog.keyword_links(a)).select("article_id", "year", "title")


def flt1_by_author(spark, d):
    return search.apply_filter(catalog.published(spark, d), search.ArticleFilter(author_id=4), _links(spark, d)).select("article_id")


def src2_published(spark, d):
    return catalog.published(spark, d).select("article_id", "slug", "year")


def flt15_issue_visibility(spark, d):
    a = catalog.articles(spark, d)
    return a.groupBy("year").agg(F.count(F.lit(1)).alias("all_articles"), F.count_if("is_published").alias("published_articles"))


def ts6_metadata_results(spark, d):
    return search.metadata_results(catalog.published(spark, d))


def l2_catalogue_page(spark, d):
    return analytics.page(search.metadata_results(catalog.published(spark, d)), 40, 20)


def j1_issue_join(spark, d):
    a = catalog.articles(spark, d)
    issues = a.where("issue_title is not null").groupBy("year", "volume", "number").agg(F.min("issue_title").alias("issue"))
    return a.join(issues, ["year", "volume", "number"], "left").select("article_id", T.text(F.col("issue")).alias("issue"), T.text(F.col("section")).alias("section"))


def j2_author_lines(spark, d):
    return catalog.author_line(catalog.author_links(spark, d))


def j12_related(spark, d):
    return search.related(catalog.published(spark, d))


def flt17_suggest_titles(spark, d):
    return search.suggestions(catalog.published(spark, d), "title", "region", 20)


def flt17_suggest_volumes(spark, d):
    return search.suggestions(catalog.articles(spark, d), "volume", "1", 400)


def flt13_city_filter(spark, d):
    return search.resolve_city(table(spark, d, "city_location"), "г. Пижев").select("city_location_id", "display_name")


def ts9_recent_searches(spark, d):
    log = table(spark, d, "user_activity").dropDuplicates(["activity_id"]).where("activity_type = 'search'")
    return search.recent(log, 128, 6).select("activity_id", "title")


def l11_choices(spark, d):
    return catalog.published(spark, d).orderBy(F.desc("year"), F.desc_nulls_first("volume"), "title", "article_id").limit(50).select("article_id", "year", "volume", "title")


def l6_title_order(spark, d):
    a = catalog.published(spark, d).select("article_id", "title")
    return a.select("article_id", T.title_rank(F.col("title")).alias("rank"), F.lower(T.text(F.col("title"))).alias("low")).orderBy("rank", "low", "article_id")


# ---- aggregation


def agg7_per_year(spark, d):
    return analytics.per_year(catalog.published(spark, d))


def agg8_top_authors(spark, d):
    return analytics.top_authors(_links(spark, d), catalog.articles(spark, d), _names(spark, d)).select("author_id", "last_name", "articles")


def agg9_corpus_tokens(spark, d):
    return analytics.corpus_stats(catalog.articles(spark, d), _links(spark, d), index.text_sizes(index.sentence_table(spark, d)))


def agg10_issue_counts(spark, d):
    return analytics.issue_counts(catalog.articles(spark, d), _links(spark, d))


def _geo(spark, d):
    return geo.base(_links(spark, d), catalog.articles(spark, d), catalog.placed_affiliations(spark, d))


def agg12_city_rollup(spark, d):
    return geo.cities(_geo(spark, d)).select("city_location_id", "display_name", "articles", "authors", "affiliations")


def agg13_country_rollup(spark, d):
    return geo.countries(_geo(spark, d))


def agg14_activity_histogram(spark, d):
    return geo.activity_histogram(geo.cities(_geo(spark, d))).select("label", "cities", "articles")


def agg15_geo_articles(spark, d):
    return geo.article_list(_geo(spark, d)).select("article_id", "year", "authors")


def agg16_city_timeline(spark, d):
    return geo.timeline(geo.of_city(_geo(spark, d), 101))


def agg17_city_totals(spark, d):
    return geo.totals(geo.of_city(_geo(spark, d), 101))


def agg18_geo_totals(spark, d):
    return geo.totals(_geo(spark, d))


def agg18_top_city(spark, d):
    return geo.top_city(geo.cities(_geo(spark, d))).select("city_location_id", "articles")


def agg19_empty_cities(spark, d):
    rows = geo.cities(_geo(spark, d)).select("city_location_id", "display_name", "country", "articles", "authors")
    return geo.with_empty_city(rows, table(spark, d, "city_location").select("city_location_id", "display_name", "country"))


def j8_resolved_affiliations(spark, d):
    seeds = geo.from_cities(table(spark, d, "city_location"))
    return geo.resolve(table(spark, d, "affiliation"), seeds, "affiliation_id", "city").select("affiliation_id", "seed", "display_name")


def m12_refresh_geography(spark, d):
    return geo.refresh_geography(table(spark, d, "affiliation"), geo.from_cities(table(spark, d, "city_location"))).select("affiliation_id", "city_name", "geography_source", "geography_confidence")


def src15_gazetteer(spark, d):
    """Affiliations against the built-in cities."""
    return geo.refresh_geography(table(spark, d, "affiliation"), geo.gazetteer(spark)).groupBy("city_name", "geography_source", "geography_confidence").agg(F.count(F.lit(1)).alias("affiliations"))


def m19_city_upsert(spark, d):
    return geo.upsert_cities(table(spark, d, "city_location"), geo.gazetteer(spark)).groupBy("country", "geocode_source").agg(F.count(F.lit(1)).alias("cities"))


def flt14_city_year(spark, d):
    """A year that the data lack is no condition."""
    b = _geo(spark, d)
    known, unknown = geo.of_city(b, 101, 2019), geo.of_city(b, 101, 1800)
    return geo.totals(known).withColumn("asked", F.lit(2019)).unionByName(geo.totals(unknown).withColumn("asked", F.lit(1800)))


def agg17_years(spark, d):
    return geo.years(_geo(spark, d)).select(F.array_join("years", ",").alias("years"))


def scl33_markers(spark, d):
    c = geo.cities(_geo(spark, d))
    return c.select("city_location_id", geo.level(F.col("articles")).alias("level"), geo.marker(F.col("country")).alias("marker"))


def agg26_logins_by_quarter_hour(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "15 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events")).select(F.unix_timestamp("w.start").alias("start_s"), "user_id", "events")


def agg26_locked_out(spark, d):
    """Users with repeated errors within a window; the limit is two, the events are thin."""
    return maintenance.locked_out(table(spark, d, "events").where("event_type = 'error'"), "user_id", "ts", 2)


# ---- set operations, sub-corpora, marks


def set1_scope_union(spark, d):
    a = catalog.published(spark, d)
    return analytics.union_scope(a.where("year = 2020"), a.where("language = 'en'"))


def _members(spark, d):
    a = catalog.articles(spark, d)
    sub = F.pmod(F.col("article_id"), F.lit(7)).alias("subcorpus_id")
    return a.where("year >= 2018").select(sub, "article_id", F.when(F.col("is_published"), "filter").otherwise("manual").alias("source"))


def set3_membership_refresh(spark, d):
    chosen = catalog.articles(spark, d).where("year >= 2020").select(F.pmod(F.col("article_id"), F.lit(7)).alias("subcorpus_id"), "article_id")
    return subcorpus.refresh(_members(spark, d), chosen)


def agg20_subcorpus_tokens(spark, d):
    return subcorpus.totals(_members(spark, d), index.text_sizes(index.sentence_table(spark, d)))


def flt11_candidates(spark, d):
    return subcorpus.candidates(catalog.published(spark, d), _members(spark, d), 3).select("article_id", "year")


def l10_members(spark, d):
    return subcorpus.ordered_members(_members(spark, d), catalog.articles(spark, d)).select("subcorpus_id", "article_id", "source")


def m13_add_remove(spark, d):
    extra = catalog.articles(spark, d).where("year = 2005").select(F.lit(1).cast("bigint").alias("subcorpus_id"), "article_id")
    left, _ = subcorpus.remove_members(subcorpus.add_members(_members(spark, d), extra), catalog.articles(spark, d).where("year = 2021").select(F.pmod(F.col("article_id"), F.lit(7)).alias("subcorpus_id"), "article_id"))
    return left


def _marks(spark, d):
    """Marks made from the activity log, one a row: spread over all articles and the whole of their bodies."""
    e = table(spark, d, "user_activity").dropDuplicates(["activity_id"])
    t = catalog.texts(spark, d).select("article_id", F.length("body_text").alias("n")).where("n > 0")
    last = t.agg(F.max("article_id").alias("last"))
    e = e.join(F.broadcast(last)).withColumn("article_id", F.pmod(F.col("activity_id") * 7919, F.col("last")) + 1)  # one row
    e = e.join(t, "article_id")
    start = F.pmod(F.col("activity_id") * 104729, F.col("n")).cast("int")
    return e.select(F.col("activity_id").alias("mark_id"), "user_id", "article_id", start.alias("char_start"), (start + 10 + F.pmod("activity_id", F.lit(600)).cast("int")).alias("char_end"), "updated_at")


def _wanted(m):
    return m.select(F.col("mark_id").alias("wanted_id"), "user_id", "article_id", "char_start", "char_end")


def j9_overlapping_marks(spark, d):
    m = _marks(spark, d)
    return subcorpus.overlapping(m, _wanted(m), earlier=True)


def m16_new_marks(spark, d):
    m = _marks(spark, d)
    return subcorpus.new_marks(m, _wanted(m), catalog.texts(spark, d), earlier=True).select("wanted_id", "char_start", "char_end", F.md5("selected_text").alias("hash"))


def w9_grouped_marks(spark, d):
    return subcorpus.grouped_marks(_marks(spark, d)).select("mark_id", "user_id", "article_id", "place")


def agg21_mark_counts(spark, d):
    return subcorpus.mark_counts(_marks(spark, d))


# ---- maintenance


def m5_newest_records(spark, d):
    return catalog.articles(spark, d).select("article_id", "record_id")


def m4_upsert(spark, d):
    r = table(spark, d, "article_metadata").select("article_id", "record_id", "title")
    late = catalog.newest(table(spark, d, "article_metadata"), "article_id", "ingested_at", "record_id").where("year >= 2015").select("article_id", "record_id", "title")
    first = maintenance.first_seen(r, ["article_id"], "record_id")
    return maintenance.upsert(first, late, ["article_id"]).select("article_id", "record_id")


def m6_match_uploads(spark, d):
    up = table(spark, d, "article_metadata").select(F.col("record_id").alias("upload_id"), "doi", "title", "year", "volume", "number")
    return maintenance.match_uploads(up, catalog.articles(spark, d))


def m7_keywords(spark, d):
    return maintenance.split_keywords(catalog.texts(spark, d), "article_id", "keywords_text").select("article_id", "normalized")


def m8_orphans(spark, d):
    a = catalog.articles(spark, d)
    words = catalog.keyword_links(table(spark, d, "article_metadata")).select("normalized").distinct()
    files = table(spark, d, "article_metadata").select(F.col("source_file").alias("file")).where("file <> ''").distinct()
    used = a.select(F.col("source_file").alias("file"))
    return maintenance.orphans(table(spark, d, "author"), table(spark, d, "affiliation"), _links(spark, d), words, catalog.keyword_links(a).select("normalized"), files, used)


def m9_purge(spark, d):
    return maintenance.purge(table(spark, d, "user_activity").dropDuplicates(["activity_id"]), "activity_type", ["login", "import"]).select("activity_id", "activity_type")


def m4_body_fallback(spark, d):
    """Bodies of the newest texts, else the abstracts as if they were files, else older bodies."""
    a = catalog.articles(spark, d)
    slug = a.select("article_id", "slug")
    new = slug.join(catalog.texts(spark, d).select("article_id", "body_text"), "article_id", "left").select("slug", "body_text")
    files = a.select("slug", F.col("abstract").alias("text"))
    old = slug.join(maintenance.first_seen(table(spark, d, "article_text").select("article_id", "text_id", "body_text"), ["article_id"], "text_id"), "article_id").select("slug", "body_text")
    return maintenance.body_with_fallback(new, files, old).select("slug", "origin", F.md5("body_text").alias("hash"))


def agg25_import_counters(spark, d):
    r = table(spark, d, "article_metadata")
    return maintenance.import_counters(r.where("year < 2015"), r.where("year >= 2010"), "slug")


def flt16_listed(spark, d):
    return maintenance.listed(catalog.articles(spark, d), "рынок 20", ("title", "slug", "year"), {"is_published": True}).select("article_id")


def m10_unseen(spark, d):
    r = table(spark, d, "article_metadata")
    return maintenance.unseen(r.select("slug", "record_id"), r.where("year < 2020"), "slug")


def m10_bounded_crawl(spark, d):
    r = table(spark, d, "article_metadata")
    return maintenance.unseen(r.select("slug", "record_id"), r.where("year < 2010"), "slug", 25).select("slug")


def w11_author_order(spark, d):
    return maintenance.numbered_authors(catalog.articles(spark, d)).select("article_id", "author_order", T.text(F.col("last_name")).alias("last_name"))


def w12_unique_slugs(spark, d):
    return maintenance.unique_slugs(catalog.articles(spark, d).select("article_id", "title"), "title", "article_id").select("article_id", "slug")


def w10_first_seen(spark, d):
    return maintenance.first_seen(table(spark, d, "user_activity").select("user_id", "activity_type", "activity_id").distinct(), ["user_id", "activity_type"], "activity_id")


def m23_activity(spark, d):
    e = table(spark, d, "user_activity").dropDuplicates(["activity_id"])
    return e.groupBy("activity_type").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("users"))


# ---- scalar functions


def scl25_labels(spark, d):
    c = table(spark, d, "city_location").select(F.lit("city").alias("kind"), F.col("city_location_id").alias("id"), T.city_label(F.col("display_name"), F.col("region"), F.col("country")).alias("label"))
    a = table(spark, d, "author").select(F.lit("author"), "author_id", T.full_name(F.col("last_name"), F.col("first_name"), F.col("middle_name")))
    i = catalog.articles(spark, d).select(F.lit("issue"), "article_id", T.issue_label(F.col("year"), F.col("volume"), F.col("number")))
    return c.union(a).union(i)


def scl21_city_keys(spark, d):
    return table(spark, d, "affiliation").select("affiliation_id", T.city_key(F.col("city")).alias("city_key"))


def scl36_payloads(spark, d):
    e = table(spark, d, "user_activity").dropDuplicates(["activity_id"])
    p = F.from_json("payload", "map<string,string>")
    return e.select("activity_id", F.coalesce(F.size(T.clean_payload(p)), F.lit(-1)).alias("keys"), F.try_element_at(p, F.lit("search_mode")).alias("mode"), F.coalesce(T.has_filters(p), F.lit(False)).alias("has_filters"))


def scl27_query_strings(spark, d):
    """Payloads with a list of two values put in, as a form with several choices gives."""
    e = table(spark, d, "user_activity").dropDuplicates(["activity_id"]).where("payload is not null")
    p = F.map_concat(F.from_json("payload", "map<string,string>"), F.create_map(F.lit("volumes"), F.concat(F.lit('["'), F.col("activity_type"), F.lit('","б 2"]'))))
    return e.select("activity_id", T.query_string(p).alias("query")).where("query is not null")


def scl20_file_kinds(spark, d):
    return catalog.articles(spark, d).groupBy(T.file_kind(F.col("source_file")).alias("kind")).agg(F.count(F.lit(1)).alias("files"))


def scl30_dates(spark, d):
    e = table(spark, d, "article_metadata").select("record_id", F.concat_ws(".", F.lit("3"), F.lit("11"), F.col("year").cast("string")).alias("raw"))
    return e.select("record_id", F.date_format(T.parse_date(F.col("raw")), "yyyy-MM-dd").alias("day"))


def _shown_names(spark, d):
    return catalog.author_links(spark, d).select("article_id", "author_order", T.squeeze(F.col("name")).alias("name"))


def scl17_split_names(spark, d):
    return _shown_names(spark, d).select("article_id", "author_order", T.split_name(F.col("name")).alias("n")).select("article_id", "author_order", "n.*")


def scl18_crawled_names(spark, d):
    return _shown_names(spark, d).select("article_id", "author_order", T.split_crawled_name(F.col("name")).alias("n")).select("article_id", "author_order", "n.*")


def src13_editor_authors(spark, d):
    """Authors of a record as an editor types them, read back."""
    typed = F.array_join(F.transform("authors", lambda a: F.concat(T.joined(" ", a["last_name"], a["first_name"]), F.when(T.text(a["affiliation"]) != "", F.concat(F.lit(" | "), a["affiliation"])).otherwise(""))), "\n")
    a = catalog.articles(spark, d).select("article_id", typed.alias("typed"))
    return batch_import.editor_authors(a, "article_id", "typed").select("article_id", F.col("pos").alias("line"), "name", "affiliation")


def scl8_lines(spark, d):
    return catalog.texts(spark, d).select("article_id", F.md5(T.squeeze_lines(F.col("body_text"))).alias("hash"))


def scl23_marked(spark, d):
    a = catalog.published(spark, d).select("article_id", F.replace(T.text(F.col("title")), F.lit("рын"), F.lit(T.MARK_START + "рын" + T.MARK_END)).alias("t"))
    return a.select("article_id", T.render_marks(F.col("t")).alias("html"))


def scl24_short_titles(spark, d):
    return catalog.articles(spark, d).select("article_id", T.truncate(T.text(F.col("abstract"))).alias("short"))


def scl26_described(spark, d):
    a = catalog.articles(spark, d)
    p = F.create_map(F.lit("title"), T.text(F.col("title")), F.lit("year_from"), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("year_to"), F.when(F.col("is_published"), "2024").otherwise(""), F.lit("volume"), T.text(F.col("volume")), F.lit("language"), T.text(F.col("language")))
    return a.select("article_id", F.array_join(T.describe_payload(p), "; ").alias("lines"))


def flt10_visible(spark, d):
    """Searches as saved sub-corpora, those of two users public."""
    e = table(spark, d, "user_activity").dropDuplicates(["activity_id"]).where("activity_type = 'subcorpus'")
    subs = e.select("activity_id", "user_id", F.coalesce(F.col("user_id").isin(128, 129), F.lit(False)).alias("is_public"))
    return subcorpus.visible(subs, 130).select("activity_id")


def flt12_capable(spark, d):
    u = table(spark, d, "user_activity").where("user_id is not null").groupBy("user_id").agg(F.bool_or(F.col("activity_type") == "export").alias("can_export"), (F.pmod("user_id", F.lit(10)) == 0).alias("is_staff"), (F.col("user_id") == 1).alias("is_superuser"))
    return subcorpus.capable(u, "can_export").select("user_id")


def set5_export_scope(spark, d):
    pair = search.comparison_pair(left_subcorpus=2, right_subcorpus=5)
    return search.analytics_scope(catalog.published(spark, d), _members(spark, d), pair)


def m15_counted_query(spark, d):
    row = spark.createDataFrame([(1, 7, "рынок", 0)], "user_id bigint, query_id bigint, name string, result_count bigint")
    f = search.ArticleFilter(keyword="рынок")
    a = catalog.published(spark, d)
    return subcorpus.with_result_count(row, search.apply_filter(a, f, _links(spark, d), catalog.keyword_links(a)))


def m21_restored(spark, d):
    gone = catalog.articles(spark, d).where("year = 2021").select(F.pmod(F.col("article_id"), F.lit(7)).alias("subcorpus_id"), "article_id")
    left, removed = subcorpus.remove_members(_members(spark, d), gone)
    return subcorpus.restore_members(left, removed)


def scl22_mojibake(spark, d):
    e = table(spark, d, "user_activity").dropDuplicates(["activity_id"])
    return e.select("activity_id", T.repair_cp1251(F.col("title")).alias("title"), F.col("title").alias("raw")).where("title <> raw").select("activity_id", "title")


def scl19_slugs(spark, d):
    return catalog.articles(spark, d).select("article_id", article_slug_udf("title").alias("slug"))


def scl34_signature(spark, d):
    a = catalog.published(spark, d)
    return a.groupBy("year").agg(T.signature(F.concat_ws(":", "article_id", "slug")).alias("signature"))


def src16_files(spark, d):
    a = catalog.articles(spark, d)
    return a.select("article_id", F.coalesce(F.nullif(T.text(F.col("source_file")), F.lit("")), F.nullif(T.text(F.col("text_file")), F.lit("")), F.nullif(T.text(F.col("original_url")), F.lit(""))).alias("place"))


def src8_article_numbers(spark, d):
    return catalog.articles(spark, d).select("article_id", F.regexp_extract(T.text(F.col("original_url")), r"/article/view/(\d+)", 1).alias("number"))


def snk4_json_page(spark, d):
    o, n = analytics.page_bounds(0, 20)
    return exports.json_page(analytics.per_year(catalog.published(spark, d)), o, n)


def snk1_frequency_table(spark, d):
    counts = analytics.frequency(index.sentence_table(spark, d), catalog.published(spark, d).select("article_id"), "curated")
    return exports.frequency_table(analytics.top(counts, 40))


def snk2_comparison_table(spark, d):
    a = catalog.published(spark, d)
    both = analytics.frequencies_of(index.sentence_table(spark, d), a.where("language = 'en'").select("article_id"), a.where("language = 'ru'").select("article_id"), "curated", "any")
    return exports.comparison_table(analytics.order_comparison(analytics.shared_labels(both)))


def snk3_search_table(spark, d):
    forms = search.query_forms(spark, "кластер")
    s = index.sentence_table(spark, d)
    hits = search.word_hits(s, forms)
    seen = search.contexts(s, hits, forms).groupBy("article_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hit_no", "context"))), lambda x: x["context"]).alias("contexts"))  # five a row
    a = catalog.articles(spark, d).select("article_id", "title", "year", "section").join(catalog.author_line(catalog.author_links(spark, d)), "article_id", "left")
    return exports.search_table(hits.join(seen, "article_id").join(a, "article_id"))


# ---- the star schema: the same shapes at the sizes of the bench


def star_year_rollup(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.year("o_orderdate").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def star_supplier_rollup(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"))


def star_order_lines(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    seq = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey")))
    return li.groupBy("l_orderkey").agg(F.array_join(F.transform(seq, lambda s: s["l_suppkey"].cast("string")), ", ").alias("suppliers"))


QUERIES = {f.__name__: f for f in (
    flt1_composite_filter, flt1_by_author, src2_published, flt15_issue_visibility, ts6_metadata_results, l2_catalogue_page, j1_issue_join, j2_author_lines, j12_related, flt17_suggest_titles, flt17_suggest_volumes,
    flt13_city_filter, ts9_recent_searches, l11_choices, l6_title_order, agg7_per_year, agg8_top_authors, agg9_corpus_tokens, agg10_issue_counts, agg12_city_rollup, agg13_country_rollup, agg14_activity_histogram,
    agg15_geo_articles, agg16_city_timeline, agg17_city_totals, agg17_years, agg18_geo_totals, agg18_top_city, agg19_empty_cities, flt14_city_year, j8_resolved_affiliations, m12_refresh_geography, src15_gazetteer, m19_city_upsert, scl33_markers,
    agg26_logins_by_quarter_hour, agg26_locked_out, set1_scope_union, set3_membership_refresh, set5_export_scope, agg20_subcorpus_tokens, flt10_visible, flt11_candidates, flt12_capable, l10_members, m13_add_remove, m15_counted_query, m21_restored,
    j9_overlapping_marks, m16_new_marks, w9_grouped_marks, agg21_mark_counts, m5_newest_records, m4_upsert, m4_body_fallback, m6_match_uploads, m7_keywords, m8_orphans, m9_purge, m10_unseen, m10_bounded_crawl, agg25_import_counters, flt16_listed,
    w11_author_order, w12_unique_slugs, w10_first_seen, m23_activity, scl25_labels, scl21_city_keys, scl36_payloads, scl27_query_strings, scl20_file_kinds, scl30_dates, scl17_split_names, scl18_crawled_names, src13_editor_authors, scl8_lines, scl23_marked,
    scl24_short_titles, scl26_described, scl22_mojibake, scl19_slugs, scl34_signature, src16_files, src8_article_numbers, snk1_frequency_table, snk2_comparison_table, snk3_search_table, snk4_json_page, star_year_rollup, star_supplier_rollup, star_order_lines,
)}

A = f"WITH {ARTICLE}, pub AS (SELECT * FROM article WHERE is_published)"
_KW = r"kw AS (SELECT DISTINCT article_id, lower(trim(regexp_replace(u.k, '[ \t\x{00a0}]+', ' ', 'g'), ' ')) AS k FROM article, unnest(keywords) AS u(k))"
_KEY = "trim(regexp_replace(regexp_replace(replace(replace(replace(lower(trim(regexp_replace(coalesce({c}, ''), '[\\s\\x{{a0}}]+', ' ', 'g'))), 'ё', 'е'), 'г.', ''), 'город ', ''), '[^a-zа-я0-9 -]+', ' ', 'g'), ' +', ' ', 'g'))"
_CITY, _NORM = _KEY.format(c="city"), _KEY.format(c="normalized_name")
GEO = A + f""", placed AS (SELECT affiliation_id, c.* EXCLUDE (latitude, longitude) FROM (SELECT affiliation_id, {_CITY} AS key FROM affiliation) a JOIN (SELECT *, {_NORM} AS ckey FROM city_location) c ON a.key = c.ckey WHERE a.key <> ''),
  base AS (SELECT l.article_id, l.author_id, l.affiliation_id, p.city_location_id, p.display_name, p.country, u.year, u.title FROM article_author l JOIN placed p USING (affiliation_id) JOIN pub u USING (article_id)),
  cit AS (SELECT city_location_id, display_name, country, count(DISTINCT article_id)::BIGINT AS articles, count(DISTINCT author_id)::BIGINT AS authors, count(DISTINCT affiliation_id)::BIGINT AS affiliations FROM base GROUP BY ALL)"""
_TOTAL = "SELECT count(DISTINCT article_id)::BIGINT AS articles, count(DISTINCT author_id)::BIGINT AS authors, count(DISTINCT affiliation_id)::BIGINT AS affiliations, count(DISTINCT city_location_id)::BIGINT AS cities, count(DISTINCT country)::BIGINT AS countries FROM base"
_SUB = A + ", mem AS (SELECT article_id % 7 AS subcorpus_id, article_id, CASE WHEN is_published THEN 'filter' ELSE 'manual' END AS source FROM article WHERE year >= 2018)"
_SIZE = "n AS (SELECT article_id, count(*)::BIGINT AS n FROM tok GROUP BY 1)"
_LOG = "log AS (SELECT DISTINCT ON (activity_id) * FROM user_activity)"
_MARK = f"WITH {_LOG}, {TEXT}, bodies AS (SELECT article_id, body_text, length(body_text) AS n FROM txt WHERE length(body_text) > 0), mark AS (SELECT activity_id AS mark_id, user_id, b.article_id, ((activity_id * 104729) % n)::INT AS char_start, ((activity_id * 104729) % n + 10 + activity_id % 600)::INT AS char_end, updated_at FROM log JOIN bodies b ON b.article_id = (activity_id * 7919) % (SELECT max(article_id) FROM bodies) + 1)"
_OVER = "SELECT m.mark_id, w.mark_id AS wanted_id FROM mark m JOIN mark w ON m.user_id = w.user_id AND m.article_id = w.article_id AND m.char_start < w.char_end AND m.char_end > w.char_start WHERE m.mark_id < w.mark_id"
_NAMES = "nm AS (SELECT l.article_id, author_order, trim(regexp_replace({name}, '[\\s\\x{{a0}}]+', ' ', 'g')) AS name FROM article_author l JOIN author a USING (author_id)), nw AS (SELECT *, string_split(trim(regexp_replace(replace(name, '.', ' '), '[\\s\\x{{a0}}]+', ' ', 'g')), ' ') AS w FROM nm)"
_LINES = "regexp_replace(regexp_replace(regexp_replace(replace(coalesce(body_text, ''), chr(13), chr(10)), '[ \\t\\x0b\\f]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
_ENDS = "'^[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\p{Z}]+|[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\p{Z}]+$'"
_SLUG = "regexp_replace(regexp_replace(regexp_replace(lower(replace(coalesce(title, ''), chr(160), ' ')), '[^\\p{L}\\p{N}\\p{M}_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g')"
_ALL_AFF = f"a AS (SELECT affiliation_id, {_KEY.format(c=chr(99) + 'oncat_ws(' + chr(39) + ' ' + chr(39) + ', coalesce(city, ' + chr(39) * 2 + '), coalesce(country, ' + chr(39) * 2 + '), coalesce(name, ' + chr(39) * 2 + '))')} AS k FROM affiliation)"
_RESOLVED = "SELECT a.affiliation_id, m.display_name AS city_name, CASE WHEN m.display_name IS NULL THEN 'unresolved' ELSE 'gazetteer' END AS geography_source, (CASE WHEN m.display_name IS NULL THEN 0.0 WHEN own THEN 0.95 ELSE 0.82 END)::DOUBLE AS geography_confidence FROM a LEFT JOIN m ON a.affiliation_id = m.affiliation_id AND m.o = 1"
_SEEDS = f"g(seed, display_name, country, aliases) AS (VALUES {', '.join(str((i, r[0], r[1])).rstrip(')') + ', ' + str([r[0], *r[5]]) + ')' for i, r in enumerate(geo.GAZETTEER))})"
_URL = "replace(replace(replace(url_encode({x}), '%20', '+'), '%2A', '*'), '~', '%7E')"
_PUBTOK = ", pub AS (SELECT * FROM article WHERE is_published), ptok AS (SELECT * FROM tok WHERE article_id IN (SELECT article_id FROM pub))"
_BASE_SLUG = f"slug0 AS (SELECT article_id, CASE WHEN {_SLUG} = '' THEN 'article' ELSE left({_SLUG}, 220) END AS base FROM article)"
_HIST = "CASE WHEN articles >= 100 THEN '100+' WHEN articles >= 25 THEN '25–99' WHEN articles >= 10 THEN '10–24' WHEN articles >= 5 THEN '5–9' WHEN articles >= 2 THEN '2–4' ELSE '1' END"
_NAME = "CASE WHEN trim(coalesce(l.display_name, '')) <> '' THEN l.display_name ELSE concat_ws(' ', nullif(last_name, ''), nullif(first_name, ''), nullif(middle_name, '')) END"

SQL = {
    "flt1_composite_filter": A + f", {_KW} SELECT article_id, year, title FROM pub WHERE year BETWEEN 2005 AND 2023 AND language = 'ru' AND article_id IN (SELECT article_id FROM kw WHERE contains(k, 'рынок'))",
    "flt1_by_author": A + " SELECT article_id FROM pub WHERE article_id IN (SELECT article_id FROM article_author WHERE author_id = 4)",
    "src2_published": A + " SELECT article_id, slug, year FROM pub",
    "flt15_issue_visibility": A + " SELECT year, count(*)::BIGINT AS all_articles, count_if(is_published)::BIGINT AS published_articles FROM article GROUP BY 1",
    "ts6_metadata_results": A + " SELECT article_id, year, title, 0 AS hit_count FROM pub",
    "l2_catalogue_page": A + " SELECT article_id, year, title, 0 AS hit_count FROM pub ORDER BY year DESC, title, article_id LIMIT 20 OFFSET 40",
    "j1_issue_join": A + ", i AS (SELECT year, volume, number, min(issue_title) AS issue FROM article WHERE issue_title IS NOT NULL GROUP BY ALL) SELECT article_id, coalesce(issue, '') AS issue, coalesce(section, '') AS section FROM article LEFT JOIN i USING (year, volume, number)",
    "j2_author_lines": f"SELECT l.article_id, string_agg({_NAME}, ', ' ORDER BY author_order, author_id) AS author_line FROM article_author l JOIN author a USING (author_id) GROUP BY 1",
    "j12_related": A + ", r AS (SELECT a.article_id, b.article_id AS related_id, row_number() OVER (PARTITION BY a.article_id ORDER BY b.year DESC, b.title, b.article_id)::INT AS place FROM pub a JOIN pub b ON a.section IS NOT DISTINCT FROM b.section AND a.article_id <> b.article_id) SELECT * FROM r WHERE place <= 4",
    "flt17_suggest_titles": A + ", v AS (SELECT DISTINCT title AS value FROM pub WHERE contains(lower(title), 'region')) SELECT value FROM v ORDER BY CASE WHEN regexp_matches(value, '^[\\s]*[\\x{0400}-\\x{052f}]') THEN 0 WHEN regexp_matches(value, '^[\\s]*[A-Za-z]') THEN 1 ELSE 2 END, lower(value), value LIMIT 20",
    "flt17_suggest_volumes": A + " SELECT DISTINCT volume AS value FROM article WHERE contains(volume, '1')",
    "flt13_city_filter": "SELECT city_location_id, display_name FROM city_location WHERE contains(normalized_name, 'пижев') ORDER BY CASE WHEN normalized_name = 'пижев' THEN 0 WHEN lower(display_name) = 'г. пижев' THEN 1 ELSE 2 END, display_name, city_location_id LIMIT 1",
    "ts9_recent_searches": f"WITH {_LOG} SELECT activity_id, title FROM log WHERE user_id = 128 AND activity_type = 'search' ORDER BY created_at DESC, activity_id DESC LIMIT 6",
    "l11_choices": A + " SELECT article_id, year, volume, title FROM pub ORDER BY year DESC, volume DESC NULLS FIRST, title, article_id LIMIT 50",
    "l6_title_order": A + " SELECT article_id, CASE WHEN regexp_matches(coalesce(title, ''), '^[\\s]*[\\x{0400}-\\x{052f}]') THEN 0 WHEN regexp_matches(coalesce(title, ''), '^[\\s]*[A-Za-z]') THEN 1 ELSE 2 END AS rank, lower(coalesce(title, '')) AS low FROM pub",
    "agg7_per_year": A + " SELECT year, count(*)::BIGINT AS articles FROM pub GROUP BY 1",
    "agg8_top_authors": A + " SELECT author_id, last_name, articles FROM (SELECT author_id, count(DISTINCT article_id)::BIGINT AS articles FROM article_author WHERE article_id IN (SELECT article_id FROM pub) GROUP BY 1) JOIN author USING (author_id) ORDER BY articles DESC, last_name, first_name NULLS FIRST, middle_name NULLS FIRST, author_id LIMIT 10",
    "agg9_corpus_tokens": BASE + A.removeprefix(f"WITH {ARTICLE}") + f", {_SIZE} SELECT (SELECT count(DISTINCT (year, coalesce(volume, ''), coalesce(number, '')))::BIGINT FROM pub) AS issues, (SELECT count(*)::BIGINT FROM pub) AS articles, (SELECT count(DISTINCT author_id)::BIGINT FROM article_author WHERE article_id IN (SELECT article_id FROM pub)) AS authors, (SELECT coalesce(sum(n), 0)::BIGINT FROM n WHERE article_id IN (SELECT article_id FROM pub)) AS tokens",
    "agg10_issue_counts": A + ", n AS (SELECT year, coalesce(volume, '') AS volume, coalesce(number, '') AS number, article_id FROM article) SELECT year, volume, number, count(DISTINCT n.article_id)::BIGINT AS articles, count(DISTINCT author_id)::BIGINT AS authors, concat_ws(' ', year::VARCHAR, CASE WHEN volume <> '' THEN 'Т. ' || volume END, CASE WHEN number <> '' THEN '№ ' || number END) AS label FROM n LEFT JOIN article_author l ON n.article_id = l.article_id GROUP BY ALL",
    "agg12_city_rollup": GEO + " SELECT city_location_id, display_name, articles, authors, affiliations FROM cit",
    "agg13_country_rollup": GEO + " SELECT country, count(DISTINCT city_location_id)::BIGINT AS cities, count(DISTINCT author_id)::BIGINT AS authors, count(DISTINCT article_id)::BIGINT AS articles FROM base GROUP BY 1",
    "agg14_activity_histogram": GEO + f", b(label) AS (VALUES ('1'), ('2–4'), ('5–9'), ('10–24'), ('25–99'), ('100+')), h AS (SELECT {_HIST} AS label, count(*)::BIGINT AS cities, sum(articles)::BIGINT AS articles FROM cit GROUP BY 1) SELECT label, coalesce(cities, 0)::BIGINT AS cities, coalesce(articles, 0)::BIGINT AS articles FROM b LEFT JOIN h USING (label)",
    "agg15_geo_articles": GEO + " SELECT article_id, year, count(DISTINCT author_id)::BIGINT AS authors FROM base GROUP BY ALL",
    "agg16_city_timeline": GEO + " SELECT year, count(DISTINCT article_id)::BIGINT AS articles, count(DISTINCT author_id)::BIGINT AS authors FROM base WHERE city_location_id = 101 GROUP BY 1",
    "agg17_city_totals": GEO + f" {_TOTAL} WHERE city_location_id = 101",
    "agg17_years": GEO + " SELECT string_agg(year::VARCHAR, ',' ORDER BY year DESC) AS years FROM (SELECT DISTINCT year FROM base WHERE year IS NOT NULL)",
    "flt14_city_year": GEO + f" SELECT *, 2019 AS asked FROM ({_TOTAL} WHERE city_location_id = 101 AND (year = 2019 OR NOT EXISTS (FROM base WHERE city_location_id = 101 AND year = 2019))) UNION ALL SELECT *, 1800 FROM ({_TOTAL} WHERE city_location_id = 101)",
    "agg18_geo_totals": GEO + f" {_TOTAL}",
    "agg18_top_city": GEO + " SELECT city_location_id, articles FROM cit ORDER BY articles DESC, authors DESC, display_name, city_location_id LIMIT 1",
    "agg19_empty_cities": GEO + " SELECT c.city_location_id, c.display_name, c.country, coalesce(articles, 0)::BIGINT AS articles, coalesce(authors, 0)::BIGINT AS authors FROM city_location c LEFT JOIN cit USING (city_location_id)",
    "j8_resolved_affiliations": f"WITH a AS (SELECT affiliation_id, {_CITY} AS key FROM affiliation), m AS (SELECT affiliation_id, c.city_location_id, c.display_name, row_number() OVER (PARTITION BY affiliation_id ORDER BY length(ckey) DESC, city_location_id) AS o FROM a JOIN (SELECT *, {_NORM} AS ckey FROM city_location) c ON contains(' ' || key || ' ', ' ' || ckey || ' ')) SELECT a.affiliation_id, m.city_location_id::INT AS seed, m.display_name FROM a LEFT JOIN m ON a.affiliation_id = m.affiliation_id AND o = 1",
    "m12_refresh_geography": f"WITH c AS (SELECT *, {_NORM} AS ckey, {_KEY.format(c='display_name')} AS dkey FROM city_location), al AS (SELECT city_location_id, display_name, dkey, dkey AS key, 0 AS no FROM c UNION ALL SELECT city_location_id, display_name, dkey, ckey, 1 FROM c), {_ALL_AFF}, m AS (SELECT affiliation_id, display_name, dkey = key AS own, row_number() OVER (PARTITION BY affiliation_id ORDER BY length(key) DESC, city_location_id, no) AS o FROM a JOIN al ON key <> '' AND contains(' ' || k || ' ', ' ' || key || ' ')) {_RESOLVED}",
    "src15_gazetteer": f"WITH {_SEEDS}, al AS (SELECT seed, display_name, {_KEY.format(c='display_name')} AS dkey, {_KEY.format(c='u.alias')} AS key, u.no FROM g, LATERAL (SELECT unnest(aliases) AS alias, generate_subscripts(aliases, 1) AS no) AS u), {_ALL_AFF}, m AS (SELECT affiliation_id, display_name, dkey = key AS own, row_number() OVER (PARTITION BY affiliation_id ORDER BY length(key) DESC, seed, no) AS o FROM a JOIN al ON key <> '' AND contains(' ' || k || ' ', ' ' || key || ' ')), r AS ({_RESOLVED}) SELECT city_name, geography_source, geography_confidence, count(*)::BIGINT AS affiliations FROM r GROUP BY ALL",
    "m19_city_upsert": f"WITH {_SEEDS}, n AS (SELECT DISTINCT {_KEY.format(c='display_name')} AS normalized_name, country FROM g), u AS (SELECT country, 'gazetteer' AS geocode_source FROM n UNION ALL SELECT country, geocode_source FROM city_location WHERE (normalized_name, country) NOT IN (SELECT (normalized_name, country) FROM n)) SELECT country, geocode_source, count(*)::BIGINT AS cities FROM u GROUP BY ALL",
    "scl33_markers": GEO + " SELECT city_location_id, CASE WHEN articles >= 100 THEN 5 WHEN articles >= 25 THEN 4 WHEN articles >= 10 THEN 3 WHEN articles >= 5 THEN 2 WHEN articles >= 2 THEN 1 ELSE 0 END AS level, CASE WHEN lower(country) = 'россия' THEN 'circle' ELSE 'diamond' END AS marker FROM cit",
    "agg26_logins_by_quarter_hour": "SELECT (floor(epoch(ts) / 900) * 900)::BIGINT AS start_s, user_id, count(*)::BIGINT AS events FROM events GROUP BY 1, 2",
    "agg26_locked_out": "SELECT user_id AS user, (floor(epoch(ts) / 900) * 900)::BIGINT AS start_s, count(*)::BIGINT AS failures FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 2",
    "set1_scope_union": A + " SELECT article_id FROM pub WHERE year = 2020 UNION SELECT article_id FROM pub WHERE language = 'en'",
    "set3_membership_refresh": _SUB + " SELECT * FROM mem WHERE source = 'manual' UNION ALL SELECT article_id % 7, article_id, 'filter' FROM article WHERE year >= 2020 AND article_id NOT IN (SELECT article_id FROM mem WHERE source = 'manual')",
    "agg20_subcorpus_tokens": BASE + _SUB.removeprefix(f"WITH {ARTICLE}") + f", {_SIZE} SELECT subcorpus_id, count(*)::BIGINT AS articles, coalesce(sum(n), 0)::BIGINT AS tokens FROM mem LEFT JOIN n USING (article_id) GROUP BY 1",
    "flt11_candidates": _SUB + " SELECT article_id, year FROM pub WHERE article_id NOT IN (SELECT article_id FROM mem WHERE subcorpus_id = 3)",
    "l10_members": _SUB + " SELECT subcorpus_id, article_id, source FROM mem",
    "m13_add_remove": _SUB + ", ext AS (SELECT 1::BIGINT AS subcorpus_id, article_id FROM article WHERE year = 2005), al AS (SELECT * FROM mem UNION ALL SELECT subcorpus_id, article_id, 'manual' FROM ext WHERE (subcorpus_id, article_id) NOT IN (SELECT (subcorpus_id, article_id) FROM mem)) SELECT * FROM al WHERE (subcorpus_id, article_id) NOT IN (SELECT (article_id % 7, article_id) FROM article WHERE year = 2021)",
    "j9_overlapping_marks": f"{_MARK} {_OVER}",
    "m16_new_marks": _MARK + f""", c AS (SELECT m.*, substr(body_text, char_start + 1, least(char_end, n) - char_start) AS raw FROM mark m JOIN bodies USING (article_id)),
      q AS (SELECT mark_id AS wanted_id, user_id, article_id, regexp_replace(raw, {_ENDS}, '', 'g') AS selected_text, char_start + length(raw) - length(regexp_replace(raw, {_ENDS.split('|')[0]}', '')) AS a FROM c),
      k AS (SELECT *, a + length(selected_text) AS b FROM q WHERE selected_text <> '' AND length(selected_text) <= 1600)
      SELECT wanted_id, a::INT AS char_start, b::INT AS char_end, md5(selected_text) AS hash FROM k WHERE NOT EXISTS (SELECT 1 FROM mark m WHERE m.user_id = k.user_id AND m.article_id = k.article_id AND m.mark_id < k.wanted_id AND m.char_start < k.b AND m.char_end > k.a)""",
    "w9_grouped_marks": _MARK + " SELECT mark_id, user_id, article_id, (row_number() OVER (PARTITION BY user_id, article_id ORDER BY updated_at DESC, mark_id DESC))::INT AS place FROM mark",
    "agg21_mark_counts": _MARK + " SELECT user_id, count(*)::BIGINT AS marks, count(DISTINCT article_id)::BIGINT AS articles FROM mark GROUP BY 1",
    "m5_newest_records": A + " SELECT article_id, record_id FROM article",
    "m4_upsert": A + " SELECT r.article_id, CASE WHEN a.year >= 2015 THEN a.record_id ELSE r.record_id END AS record_id FROM (SELECT article_id, min(record_id) AS record_id FROM article_metadata GROUP BY 1) r JOIN article a USING (article_id)",
    "m6_match_uploads": A + ", d AS (SELECT doi, min(article_id) AS d FROM article WHERE coalesce(doi, '') <> '' GROUP BY 1), t AS (SELECT title, year, volume, number, min(article_id) AS t FROM article GROUP BY ALL) SELECT record_id AS upload_id, coalesce(d, t) AS article_id FROM article_metadata m LEFT JOIN d USING (doi) LEFT JOIN t USING (title, year, volume, number)",
    "m7_keywords": f"WITH {TEXT} SELECT DISTINCT article_id, lower(regexp_replace(u.k, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')) AS normalized FROM txt, unnest(string_split(coalesce(keywords_text, ''), ',')) AS u(k) WHERE regexp_replace(u.k, '[\\s\\x{{a0}}]+', '', 'g') <> ''",
    "m8_orphans": A + f""", kwl AS (SELECT DISTINCT lower(trim(regexp_replace(u.k, '[ \\t\\x{{a0}}]+', ' ', 'g'), ' ')) AS k FROM article_metadata, unnest(keywords) AS u(k)), {_KW}
      SELECT 'author' AS kind, author_id::VARCHAR AS id FROM author WHERE author_id NOT IN (SELECT author_id FROM article_author) UNION ALL SELECT 'affiliation', affiliation_id::VARCHAR FROM affiliation WHERE affiliation_id NOT IN (SELECT affiliation_id FROM article_author WHERE affiliation_id IS NOT NULL)
      UNION ALL SELECT 'keyword', k FROM kwl WHERE k <> '' AND k NOT IN (SELECT k FROM kw WHERE k IS NOT NULL) UNION ALL SELECT DISTINCT 'file', source_file FROM article_metadata WHERE source_file <> '' AND source_file NOT IN (SELECT source_file FROM article WHERE source_file IS NOT NULL)""",
    "m9_purge": f"WITH {_LOG} SELECT activity_id, activity_type FROM log WHERE activity_type NOT IN ('login', 'import') OR activity_type IS NULL",
    "m4_body_fallback": A + f", {TEXT}, o AS (SELECT article_id, min_by(body_text, text_id) AS old FROM (SELECT article_id, text_id, coalesce(body_text, '') AS body_text FROM article_text) GROUP BY 1), f AS (SELECT slug, nullif(coalesce(body_text, ''), '') AS b, abstract AS t, old, regexp_replace(coalesce(body_text, ''), {_ENDS}, '', 'g') <> '' AS hb, regexp_replace(coalesce(abstract, ''), {_ENDS}, '', 'g') <> '' AS ht, regexp_replace(coalesce(old, ''), {_ENDS}, '', 'g') <> '' AS ho FROM article LEFT JOIN txt USING (article_id) LEFT JOIN o USING (article_id)) SELECT slug, CASE WHEN hb THEN 'import' WHEN ht THEN 'file' WHEN ho THEN 'existing' ELSE 'none' END AS origin, md5(CASE WHEN hb THEN b WHEN ht THEN t WHEN ho THEN old ELSE '' END) AS hash FROM f",
    "agg25_import_counters": "WITH o AS (SELECT DISTINCT slug FROM article_metadata WHERE year < 2015), n AS (SELECT DISTINCT ON (slug) slug, source_file FROM article_metadata WHERE year >= 2010) SELECT count(*)::BIGINT AS seen, count_if(slug NOT IN (SELECT slug FROM o))::BIGINT AS created, count_if(slug IN (SELECT slug FROM o))::BIGINT AS updated, count_if(coalesce(source_file, '') <> '')::BIGINT AS with_file, count_if(coalesce(source_file, '') = '')::BIGINT AS without_file FROM n",
    "flt16_listed": A + " SELECT article_id FROM pub WHERE (contains(lower(coalesce(title, '')), 'рынок') OR contains(lower(coalesce(slug, '')), 'рынок') OR contains(coalesce(year::VARCHAR, ''), 'рынок')) AND (contains(lower(coalesce(title, '')), '20') OR contains(lower(coalesce(slug, '')), '20') OR contains(coalesce(year::VARCHAR, ''), '20'))",
    "m10_unseen": "SELECT slug, record_id FROM article_metadata WHERE slug NOT IN (SELECT slug FROM article_metadata WHERE year < 2020)",
    "m10_bounded_crawl": "SELECT slug FROM article_metadata WHERE slug NOT IN (SELECT slug FROM article_metadata WHERE year < 2010) ORDER BY slug LIMIT 25",
    "w11_author_order": A + " SELECT article_id, i::INT AS author_order, coalesce(authors[i].last_name, '') AS last_name FROM (SELECT article_id, authors, unnest(generate_series(1, len(authors))) AS i FROM article)",
    "w10_first_seen": "SELECT user_id, activity_type, min(activity_id) AS activity_id FROM user_activity GROUP BY ALL",
    "m23_activity": f"WITH {_LOG} SELECT activity_type, count(*)::BIGINT AS rows, count(DISTINCT user_id)::BIGINT AS users FROM log GROUP BY 1",
    "scl25_labels": A + " SELECT 'city' AS kind, city_location_id AS id, concat_ws(', ', nullif(display_name, ''), CASE WHEN coalesce(region, '') NOT IN ('', display_name) THEN region END, nullif(country, '')) AS label FROM city_location UNION ALL SELECT 'author', author_id, concat_ws(' ', nullif(last_name, ''), nullif(first_name, ''), nullif(middle_name, '')) FROM author UNION ALL SELECT 'issue', article_id, concat_ws(' ', year::VARCHAR, CASE WHEN coalesce(volume, '') <> '' THEN 'Т. ' || volume END, CASE WHEN coalesce(number, '') <> '' THEN '№ ' || number END) FROM article",
    "scl21_city_keys": f"SELECT affiliation_id, {_CITY} AS city_key FROM affiliation",
    "scl20_file_kinds": A + " SELECT CASE lower(regexp_extract(coalesce(source_file, ''), '\\.([A-Za-z0-9]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'doc' THEN 'docx' WHEN 'docx' THEN 'docx' WHEN 'txt' THEN 'txt' WHEN 'md' THEN 'txt' ELSE 'other' END AS kind, count(*)::BIGINT AS files FROM article GROUP BY 1",
    "scl30_dates": "SELECT record_id, year::VARCHAR || '-11-03' AS day FROM article_metadata",
    "set5_export_scope": _SUB + " SELECT DISTINCT m.article_id FROM mem m JOIN pub USING (article_id) WHERE subcorpus_id IN (2, 5)",
    "flt10_visible": f"WITH {_LOG} SELECT activity_id FROM log WHERE activity_type = 'subcorpus' AND (user_id IN (128, 129) OR user_id = 130)",
    "flt12_capable": "SELECT user_id FROM user_activity WHERE user_id IS NOT NULL GROUP BY 1 HAVING coalesce(bool_or(activity_type = 'export'), false) OR user_id % 10 = 0 OR user_id = 1",
    "m15_counted_query": A + f", {_KW} SELECT 1::BIGINT AS user_id, 7::BIGINT AS query_id, 'рынок' AS name, (SELECT count(*)::BIGINT FROM pub WHERE article_id IN (SELECT article_id FROM kw WHERE contains(k, 'рынок'))) AS result_count",
    "m21_restored": _SUB + " SELECT subcorpus_id, article_id, source FROM mem",
    "scl17_split_names": f"WITH {_NAMES.format(name=_NAME)} SELECT article_id, author_order, w[1] AS last_name, coalesce(w[2], '') AS first_name, array_to_string(w[3:], ' ') AS middle_name FROM nw",
    "scl18_crawled_names": f"WITH {_NAMES.format(name=_NAME)} SELECT article_id, author_order, w[-1] AS last_name, CASE WHEN len(w) > 1 THEN w[1] ELSE '' END AS first_name, CASE WHEN len(w) > 2 THEN array_to_string(w[2:-2], ' ') ELSE '' END AS middle_name FROM nw",
    "src13_editor_authors": A + r""", e AS (SELECT article_id, i, authors[i] AS a FROM (SELECT article_id, authors, unnest(generate_series(1, len(authors))) AS i FROM article)),
      t AS (SELECT article_id, i, concat_ws(' ', nullif(a.last_name, ''), nullif(a.first_name, '')) AS n, coalesce(a.affiliation, '') AS f FROM e)
      SELECT article_id, (i - 1)::INT AS line, trim(regexp_replace(n, '[\s\x{a0}]+', ' ', 'g')) AS name, trim(regexp_replace(f, '[\s\x{a0}]+', ' ', 'g')) AS affiliation FROM t WHERE trim(n) <> ''""",
    "scl8_lines": f"WITH {TEXT} SELECT article_id, md5(regexp_replace({_LINES}, {_ENDS}, '', 'g')) AS hash FROM txt",
    "scl23_marked": A + " SELECT article_id, replace(replace(replace(replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;'), 'рын', '<mark>рын</mark>') AS html FROM pub",
    "scl24_short_titles": A + " SELECT article_id, CASE WHEN length(coalesce(abstract, '')) > 220 THEN rtrim(left(abstract, 219)) || '…' ELSE coalesce(abstract, '') END AS short FROM article",
    "scl26_described": A + " SELECT article_id, concat_ws('; ', CASE WHEN coalesce(title, '') <> '' THEN 'Название: ' || title END, CASE WHEN year IS NOT NULL AND is_published THEN 'Годы: ' || year || '–2024' WHEN year IS NOT NULL THEN 'Год от: ' || year WHEN is_published THEN 'Год до: 2024' END, CASE WHEN coalesce(volume, '') <> '' THEN 'Том: ' || volume END, CASE WHEN coalesce(language, '') <> '' THEN 'Язык: ' || language END) AS lines FROM article",
    "scl22_mojibake": f"WITH {_LOG}, r AS (SELECT activity_id, title, coalesce(TRY(decode(unhex(list_aggregate(list_transform(string_split(title, ''), lambda c: printf('%02x', CASE WHEN unicode(c) < 128 THEN unicode(c) WHEN instr('{T.CP1251}', c) > 0 THEN instr('{T.CP1251}', c) + 127 END)), 'string_agg', '')))), title) AS fixed FROM log WHERE title <> '' AND regexp_matches(title, '^[\\x00-\\x7f{T.CP1251}]*$')) SELECT activity_id, fixed AS title FROM r WHERE fixed <> title",
    "scl19_slugs": A + f", {_BASE_SLUG} SELECT article_id, base AS slug FROM slug0",
    "w12_unique_slugs": A + f""", {_BASE_SLUG}, n0 AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY article_id) AS n FROM slug0),
      tk AS (SELECT regexp_extract(base, '^(.+)-([0-9]{{1,9}})$', 1) AS base, list(DISTINCT regexp_extract(base, '^(.+)-([0-9]{{1,9}})$', 2)::INT ORDER BY regexp_extract(base, '^(.+)-([0-9]{{1,9}})$', 2)::INT) AS t FROM (SELECT DISTINCT base FROM slug0) WHERE regexp_matches(base, '^.+-[1-9][0-9]{{0,8}}$') GROUP BY 1),
      k AS (SELECT article_id, n0.base, n, list_reduce(list_prepend(n::INT, coalesce(t, []::INT[])), lambda a, b: CASE WHEN b >= 2 AND b <= a THEN a + 1 ELSE a END) AS k FROM n0 LEFT JOIN tk ON n0.base = tk.base)
      SELECT article_id, CASE WHEN n = 1 THEN base ELSE left(base, 254 - length(k::VARCHAR)) || '-' || k END AS slug FROM k""",
    "scl34_signature": A + ", h AS (SELECT year, ('0x' || left(md5(concat_ws(':', article_id, slug)), 15))::BIGINT AS h FROM pub) SELECT year, sha1(concat_ws(':', count(h), bit_xor(h), sum(h % 1000003))) AS signature FROM h GROUP BY 1",
    "scl36_payloads": f"WITH {_LOG}, p AS (SELECT activity_id, CASE WHEN json_valid(payload) THEN payload END AS p FROM log), k AS (SELECT activity_id, p, list_filter(json_keys(p), lambda k: k NOT IN ('saved_query', 'subcorpus', 'page') AND coalesce(json_extract_string(p, '$.\"' || k || '\"'), '') NOT IN ('', '[]', 'None')) AS ks FROM p) SELECT activity_id, coalesce(len(ks), -1)::INT AS keys, json_extract_string(p, '$.search_mode') AS mode, coalesce(len(list_filter(ks, lambda k: k <> 'search_mode')) > 0, false) AS has_filters FROM k",
    "scl27_query_strings": f"WITH {_LOG}, p AS (SELECT activity_id, activity_type, payload AS p FROM log WHERE json_valid(payload)), e AS (SELECT activity_id, activity_type, unnest(json_keys(p)) AS k, p FROM p), q AS (SELECT activity_id, k, 0 AS i, json_extract_string(p, '$.\"' || k || '\"') AS v FROM e UNION ALL SELECT activity_id, 'volumes', 0, activity_type FROM p UNION ALL SELECT activity_id, 'volumes', 1, 'б 2' FROM p) SELECT activity_id, string_agg({_URL.format(x='k')} || '=' || {_URL.format(x='v')}, '&' ORDER BY k, i) AS query FROM q GROUP BY 1",
    "snk1_frequency_table": BASE + _PUBTOK + f" SELECT normalized AS \"Слово\", count(*)::BIGINT AS \"Частота\" FROM ptok WHERE is_alpha AND {curated_sql('normalized')} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40",
    "snk2_comparison_table": BASE + _PUBTOK + f", side AS (SELECT normalized AS label, count(*) FILTER (p.language = 'en')::BIGINT AS left_count, count(*) FILTER (p.language = 'ru')::BIGINT AS right_count FROM ptok JOIN pub p USING (article_id) WHERE is_alpha GROUP BY 1) SELECT label, left_count, right_count, least(left_count, right_count) AS shared, left_count + right_count AS total FROM side WHERE left_count > 0 AND right_count > 0 AND {curated_sql('label', 'any')}",
    "snk3_search_table": BASE + _context_sql("'кластер'").replace("SELECT h.article_id, h.hit_no", ", ctx AS (SELECT h.article_id, h.hit_no", 1) + f"), lines AS (SELECT l.article_id, string_agg({_NAME}, ', ' ORDER BY author_order, author_id) AS author_line FROM article_author l JOIN author a USING (author_id) GROUP BY 1) SELECT title, author_line, year, coalesce(section, '') AS section, n::BIGINT AS hit_count, (SELECT string_agg(regexp_replace(context, '<[^>]*>', '', 'g'), ' | ' ORDER BY hit_no) FROM ctx WHERE ctx.article_id = top.article_id) AS contexts FROM top JOIN article USING (article_id) LEFT JOIN lines USING (article_id)",
    "snk4_json_page": A + ", y AS (SELECT year, count(*)::BIGINT AS articles FROM pub GROUP BY 1), w AS (SELECT * FROM y ORDER BY year NULLS FIRST LIMIT 20) SELECT to_json({'rows': (SELECT list({'year': year, 'articles': articles} ORDER BY year) FROM w), 'total': (SELECT count(*) FROM y), 'offset': 0, 'limit': 20, 'has_more': (SELECT count(*) FROM y) > 20})::VARCHAR AS page",
    "src16_files": A + " SELECT article_id, coalesce(nullif(source_file, ''), nullif(text_file, ''), nullif(original_url, '')) AS place FROM article",
    "src8_article_numbers": A + " SELECT article_id, regexp_extract(coalesce(original_url, ''), '/article/view/(\\d+)', 1) AS number FROM article",
    "star_year_rollup": "SELECT year(o_orderdate)::BIGINT AS year, count(*)::BIGINT AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "star_supplier_rollup": "SELECT n_name, count(DISTINCT l_orderkey)::BIGINT AS orders, count(DISTINCT l_suppkey)::BIGINT AS suppliers, count(DISTINCT l_partkey)::BIGINT AS parts FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    "star_order_lines": "SELECT l_orderkey, string_agg(l_suppkey::VARCHAR, ', ' ORDER BY l_linenumber, l_suppkey) AS suppliers FROM lineitem GROUP BY 1",
}
