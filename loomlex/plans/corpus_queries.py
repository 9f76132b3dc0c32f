"""Queries over texts: frequencies, bigrams, comparison, search, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlex.functions import text as T
from loomlex.functions.stemming import stem_sql
from loomlex.functions.udf import chunks_udf, clean_body_udf
from loomlex.operators import analytics, catalog, index, maintenance, search
from loomlex.session import table

# ---------------------------------------------------------------- shared SQL

#: Newest record and text of every article.
ARTICLE = """article AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY ingested_at DESC NULLS LAST, record_id DESC) AS rn FROM article_metadata) WHERE rn = 1)"""
TEXT = """txt AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY updated_at DESC NULLS LAST, text_id DESC) AS rn FROM article_text) WHERE rn = 1)"""

L = "A-Za-z\\x{0400}-\\x{052f}"


def clean_sql(c: str) -> str:
    """DuckDB counterpart of ``functions.text.sanitize``."""
    x = f"coalesce({c}, '')"
    for a, b in (
        ("\\r\\n?", "\\n"), ("[\\x{feff}\\x{00ad}]", ""), ("[\\x{2028}\\x{2029}]", "\\n"), ("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{e000}-\\x{f8ff}]", " "),
        (f"([{L}])-[\\s\\x{{a0}}\\x{{85}}]*\\n[\\s\\x{{a0}}\\x{{85}}]*([{L}])", "\\1\\2"), ("[ \\t\\f\\x0b]+", " "), (" *\\n *", "\\n"),
    ):
        x = f"regexp_replace({x}, '{a}', {'chr(10)' if b == chr(92) + 'n' else repr(b).replace(chr(92) * 2, chr(92))}, 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({x}, '^[\\s\\x{{a0}}\\x{{85}}\\x{{2000}}-\\x{{200a}}]+|[\\s\\x{{a0}}\\x{{85}}\\x{{2000}}-\\x{{200a}}]+$', '', 'g')"


def modern_sql(c: str) -> str:
    """DuckDB counterpart of ``functions.text.modern_cyrillic``."""
    x = f"translate({c}, '{T.HISTORICAL}', '{T.MODERN}')"
    for a, b in T.HISTORICAL_PAIRS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


SECTION = f"""sec AS (
  SELECT article_id, 0 AS section_no, 'title' AS section, {clean_sql('title_text')} AS t FROM txt
  UNION ALL SELECT article_id, 1, 'abstract', {clean_sql('abstract_text')} FROM txt
  UNION ALL SELECT article_id, 2, 'keywords', {clean_sql('keywords_text')} FROM txt
  UNION ALL SELECT article_id, 3, 'body', {clean_sql('body_text')} FROM txt)"""
TOKEN = SECTION + r""", sent AS (
  SELECT article_id, section_no, section, s.i - 1 AS sentence, s.s FROM sec,
  LATERAL (SELECT unnest(regexp_extract_all(t, '[^.!?…]+[.!?…]?|[.!?…]')) AS s, generate_subscripts(regexp_extract_all(t, '[^.!?…]+[.!?…]?|[.!?…]'), 1) AS i) AS s WHERE t <> ''),
tok AS (
  SELECT *, CASE WHEN is_alpha THEN MODERN ELSE low END AS normalized FROM (SELECT article_id, section_no, section, sentence, k.i - 1 AS idx, k.tok AS token, lower(k.tok) AS low, regexp_matches(k.tok, '^\p{L}+$') AS is_alpha FROM (
    SELECT *, list_filter(regexp_extract_all(s, '\p{L}+|\p{N}+|[^\p{L}\p{N}\p{Z}\s]'), lambda x: length(x) <= 120) AS l FROM sent),
  LATERAL (SELECT unnest(l) AS tok, generate_subscripts(l, 1) AS i) AS k))""".replace("MODERN", modern_sql("low"))
#: Lemmas and lexemes of the words of all texts.
LEMMA = f""", forms AS (SELECT DISTINCT normalized AS form FROM tok WHERE is_alpha),
ana AS (SELECT form, CASE WHEN regexp_matches(form, '^[a-z][a-z-]*$') THEN 'en' ELSE 'ru' END AS language, {stem_sql("form", "russian", "duckdb", stops=False)} AS stem FROM forms),
lem AS (SELECT form, language, stem, first_value(form) OVER (PARTITION BY language, stem ORDER BY length(form), form) AS lemma FROM ana)"""
LEXEME = f""", lexm AS (SELECT * FROM (
  SELECT form, 'russian' AS config, {stem_sql("form", "russian", "duckdb")} AS lexeme FROM (SELECT DISTINCT normalized AS form FROM tok WHERE is_alpha)
  UNION ALL SELECT form, 'english', {stem_sql("form", "english", "duckdb")} FROM (SELECT DISTINCT normalized AS form FROM tok WHERE is_alpha)) WHERE lexeme <> '')"""
BASE = f"WITH {ARTICLE}, {TEXT}, {TOKEN}"

#: Tokens and the white space between them, for places in a text; and white space alone.
_PIECE, _SPACE = r"'\p{L}+|\p{N}+|[\p{Z}\s\x0b]+|[^\p{L}\p{N}\p{Z}\s\x0b]'", r"'^[\p{Z}\s\x0b]'"
_FLAT = f"concat_ws(chr(10) || chr(10), {', '.join(f'nullif({clean_sql(c)}, {chr(39) * 2})' for c in ('title_text', 'abstract_text', 'keywords_text', 'body_text'))})"
_STOPS = ", ".join(f"'{w}'" for w in T.STOP_LABELS)


def curated_sql(c: str, scripts: str = "exclude_latin") -> str:
    latin = f" AND NOT regexp_matches({c}, '^[a-z][a-z-]*$')" if scripts != "any" else ""
    return rf"length({c}) >= 3 AND {c} NOT IN ({_STOPS}) AND NOT regexp_matches({c}, '^(10\.|doi|edn|issn|http|www|fig|table)') AND NOT regexp_matches({c}, '\p{{Nd}}') AND regexp_matches(replace({c}, '-', ''), '^\p{{L}}+$'){latin}"


# ---------------------------------------------------------------- helpers


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.texts(spark, d)


def _published_ids(spark: SparkSession, d: str, cond: str = "true") -> DataFrame:
    return catalog.published(spark, d).where(cond).select("article_id")


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return index.sentence_table(spark, d)


# ---------------------------------------------------------------- queries


def agg1_word_freq_all(spark, d):
    return analytics.frequency(_sentences(spark, d), _published_ids(spark, d), "all")


def agg1_word_freq_curated(spark, d):
    return analytics.frequency(_sentences(spark, d), _published_ids(spark, d), "curated")


def agg2_lemma_freq(spark, d):
    return analytics.frequency(_sentences(spark, d), _published_ids(spark, d), "curated", lexicon=index.lemma_table(spark, d))


def agg3_top_words(spark, d):
    return analytics.top(analytics.frequency(_sentences(spark, d), _published_ids(spark, d), "all"), 25)


def flt6_label_search(spark, d):
    return analytics.page(analytics.top(analytics.frequency(_sentences(spark, d), _published_ids(spark, d), "curated"), None, "Регион"), 0, 160)


def w1_bigrams(spark, d):
    return analytics.bigrams(analytics.scope(_sentences(spark, d), _published_ids(spark, d)), "curated").select("label", "count")


def agg4_lemma_bigrams(spark, d):
    own = analytics.scope(_sentences(spark, d), _published_ids(spark, d))
    return analytics.bigrams(own, "curated", lexicon=index.lemma_table(spark, d)).select("label", "count")


def w2_top_bigrams(spark, d):
    b = analytics.bigrams(analytics.scope(_sentences(spark, d), _published_ids(spark, d)), "all")
    return b.orderBy(F.desc("count"), "first_at").limit(50).select("label", "count", F.col("first_at.article_id").alias("first_article"))


def _sides(spark, d, lexicon=None):
    early, late = _published_ids(spark, d, "year < 2015"), _published_ids(spark, d, "year >= 2015")
    return analytics.shared_labels(analytics.frequencies_of(_sentences(spark, d), early, late, "curated", lexicon=lexicon))


def agg5_compare_periods(spark, d):
    return _sides(spark, d)


def agg6_compare_subcorpora(spark, d):
    a = catalog.published(spark, d)
    left, right = a.where("language = 'ru'").select("article_id"), a.where("year >= 2010").select("article_id")  # the two may share articles
    return analytics.shared_labels(analytics.frequencies_of(_sentences(spark, d), left, right, "curated", lexicon=index.lemma_table(spark, d)))


def l1_compare_left_desc(spark, d):
    return analytics.page(analytics.order_comparison(_sides(spark, d), "left_desc"), 20, 40)


def agg22_text_sizes(spark, d):
    return index.text_sizes(_sentences(spark, d), index.lemma_table(spark, d))


def scl13_tokens(spark, d):
    t = index.tokens(_sentences(spark, d))
    return t.groupBy("section", "is_alpha").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("normalized").alias("forms"), F.sum("sentence").alias("sentence_sum"), F.sum(F.col("idx").cast("bigint")).alias("idx_sum"))


def j4_token_lemmas(spark, d):
    t = index.tokens(_sentences(spark, d), index.lemma_table(spark, d))
    return t.groupBy("section", "lemma").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("normalized").alias("forms"))


def m22_lemmas(spark, d):
    return index.lemma_table(spark, d).select("form", "language", "stem", "lemma")


def scl3_token_languages(spark, d):
    words = F.transform(F.filter("tokens", lambda t: t.rlike("^\\p{L}+$")), F.lower)
    t = _sentences(spark, d).select(F.explode(words).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return t.groupBy(T.token_language(F.col("label"), F.lit("other")).alias("language")).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("forms"))


def scl13_token_spans(spark, d):
    s = index.token_spans(_texts(spark, d))
    return s.groupBy("article_id").agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.col("char_start").cast("bigint")).alias("start_sum"), F.max("char_end").alias("last_end"))


def w7_section_offsets(spark, d):
    return index.section_offsets(_texts(spark, d)).select("article_id", "section", "start", "stop")


def scl14_sections(spark, d):
    return index.flat_tokens(_texts(spark, d)).groupBy("article_id", "section").agg(F.count(F.lit(1)).alias("tokens"), F.min("char_start").alias("first_at"))


def ts3_word_hits(spark, d):
    return search.word_hits(_sentences(spark, d), search.query_forms(spark, " Рынок "))


def ts3_lemma_hits(spark, d):
    return search.word_hits(_sentences(spark, d), search.query_forms(spark, "markets", index.lemma_table(spark, d)))


def ts5_contexts(spark, d):
    forms = search.query_forms(spark, "рынок")
    return search.contexts(_sentences(spark, d), search.word_hits(_sentences(spark, d), forms), forms)


def ts5_lemma_contexts(spark, d):
    forms = search.query_forms(spark, "рынка", index.lemma_table(spark, d))
    return search.contexts(_sentences(spark, d), search.word_hits(_sentences(spark, d), forms), forms)


def fts1_postings(spark, d):
    p = index.posting_table(spark, d)
    return p.groupBy("config", "lexeme").agg(F.count(F.lit(1)).alias("places"), F.count_distinct("article_id").alias("articles"), F.sum(F.col("position").cast("bigint")).alias("position_sum"))


def fts1_lexemes(spark, d):
    return index.lexeme_table(spark, d).select("form", "config", "lexeme")


def fts2_query_configs(spark, d):
    q = table(spark, d, "article_metadata").select("record_id", F.coalesce("title", F.lit("")).alias("query"))
    return q.select("record_id", T.search_config(F.col("query")).alias("config"))


def _search(spark, d, text, mode="fulltext"):
    return search.search(index.posting_table(spark, d), catalog.published(spark, d), text, mode)


def fts3_and_not(spark, d):
    return search.match(index.posting_table(spark, d), search.parse_query(spark, "market policies -consumption"))


def fts3_or(spark, d):
    return search.match(index.posting_table(spark, d), search.parse_query(spark, "кластеры or cluster"))


def fts4_phrase(spark, d):
    return search.match(index.posting_table(spark, d), search.parse_query(spark, "при прочих равных условиях", phrase=True))


def fts6_rank_term(spark, d):
    return _search(spark, d, "кластеров")


def fts6_rank_terms(spark, d):
    return _search(spark, d, "market policy")


def fts7_headlines(spark, d):
    q = search.parse_query(spark, "рынок")
    return search.headlines(_sentences(spark, d), _search(spark, d, "рынок"), search.forms_of_lexemes(index.lexeme_table(spark, d), q.terms))


def m14_payload_articles(spark, d):
    a = catalog.published(spark, d)
    payload = {"text_query": "рынок", "search_mode": "fulltext", "year_from": 2010, "language": "ru", "page": "3"}
    return search.payload_articles(payload, a, table(spark, d, "article_author"), catalog.keyword_links(a), lambda q, m: _search(spark, d, q, m))


def set4_mode_alone(spark, d):
    a = catalog.published(spark, d)
    return search.payload_articles({"search_mode": "phrase", "title": ""}, a, table(spark, d, "article_author"), catalog.keyword_links(a), lambda q, m: _search(spark, d, q, m))


def flt2_catalogue_search(spark, d):
    a = catalog.published(spark, d)
    return search.catalogue_filter(a, _texts(spark, d), catalog.author_links(spark, d), catalog.keyword_links(a), "кластер").select("article_id")


def flt9_missing_body(spark, d):
    return search.missing_body(catalog.published(spark, d), _texts(spark, d)).select("article_id")


def scl9_quality(spark, d):
    q = maintenance.quality_report(_texts(spark, d))
    return q.select("article_id", "char_count", "word_count", "private_use_count", F.round("alpha_density", 6).alias("alpha_density"), F.array_join("flags", ",").alias("flags"))


def m18_audit(spark, d):
    return maintenance.audit(catalog.articles(spark, d), _texts(spark, d)).select("article_id", F.array_join("flags", ",").alias("flags"))


def agg23_audit_counters(spark, d):
    return maintenance.audit_counters(catalog.articles(spark, d), _texts(spark, d))


def agg23_missing_vectors(spark, d):
    return maintenance.missing_vectors(catalog.articles(spark, d), index.posting_table(spark, d)).select("article_id")


def m2_saved_texts(spark, d):
    """Words of the index after the English articles were saved without their bodies."""
    english = catalog.articles(spark, d).where("language = 'en'")
    saved = _texts(spark, d).join(english, "article_id", "left_semi").withColumn("body_text", F.lit(None).cast("string"))
    table_now = index.replace_articles(_sentences(spark, d), index.sentences(saved), saved)
    return table_now.groupBy("section").agg(F.sum(F.size("tokens")).alias("tokens"), F.count_distinct("article_id").alias("articles"))


def m11_repair_candidates(spark, d):
    return maintenance.repair_candidates(catalog.articles(spark, d), _texts(spark, d), "quality").select("article_id")


def scl10_clean_bodies(spark, d):
    return _texts(spark, d).select("article_id", clean_body_udf("body_text", "title_text", "abstract_text").alias("body")).select("article_id", F.length("body").alias("chars"), F.md5("body").alias("hash"))


def scl16_chunks(spark, d):
    return _texts(spark, d).select("article_id", F.explode(chunks_udf("body_text")).alias("c")).select("article_id", "c.start", "c.end", F.length("c.text").alias("chars"))


def l4_chunk_pages(spark, d):
    """Second page of eight chunks of every body, with the number of all."""
    o, n = analytics.page_bounds("8", None, least=4, most=24, default=8)
    c = _texts(spark, d).select("article_id", chunks_udf("body_text").alias("c"))
    return c.select("article_id", F.size("c").alias("total"), F.size(F.slice("c", o + 1, n)).alias("shown"), (F.size("c") > o + n).alias("has_more"))


def scl11_paragraphs(spark, d):
    return _texts(spark, d).select("article_id", F.size(T.paragraphs(F.col("body_text"))).alias("paragraphs"))


def scl6_sanitized(spark, d):
    return _texts(spark, d).select("article_id", F.md5(T.sanitize(F.col("body_text"))).alias("hash"))


def scl12_flattened(spark, d):
    return _texts(spark, d).select("article_id", F.length(T.flatten(F.col("title_text"), F.col("abstract_text"), F.col("keywords_text"), F.col("body_text"))).alias("chars"))


def agg1_documents_freq(spark, d):
    t = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}+"), F.lit(0))).alias("label"))
    return t.groupBy("label").agg(F.count(F.lit(1)).alias("count"))


QUERIES = {f.__name__: f for f in (
    agg1_word_freq_all, agg1_word_freq_curated, agg2_lemma_freq, agg3_top_words, flt6_label_search, w1_bigrams, agg4_lemma_bigrams, w2_top_bigrams, agg5_compare_periods, agg6_compare_subcorpora, l1_compare_left_desc,
    agg22_text_sizes, scl13_tokens, j4_token_lemmas, m22_lemmas, scl3_token_languages, scl13_token_spans, w7_section_offsets, scl14_sections, ts3_word_hits, ts3_lemma_hits, ts5_contexts, ts5_lemma_contexts, fts1_postings, fts1_lexemes,
    fts2_query_configs, fts3_and_not, fts3_or, fts4_phrase, fts6_rank_term, fts6_rank_terms, fts7_headlines, m14_payload_articles, set4_mode_alone, flt2_catalogue_search, flt9_missing_body, scl9_quality, m18_audit, agg23_audit_counters, agg23_missing_vectors, m2_saved_texts,
    m11_repair_candidates, scl10_clean_bodies, scl16_chunks, l4_chunk_pages, scl11_paragraphs, scl6_sanitized, scl12_flattened, agg1_documents_freq,
)}

_PUB = ", pub AS (SELECT * FROM article WHERE is_published), ptok AS (SELECT * FROM tok WHERE article_id IN (SELECT article_id FROM pub))"
_FREQ = "SELECT normalized AS label, count(*)::BIGINT AS count FROM ptok WHERE is_alpha"
_BIGRAM = f""", lab AS (
  SELECT article_id, section_no, sentence, idx, CASE WHEN is_alpha AND (COND) THEN LABEL END AS label FROM ptok),
pair AS (
  SELECT article_id, section_no, sentence, idx, lag(label) OVER (PARTITION BY article_id, section_no, sentence ORDER BY idx) || ' ' || label AS label FROM lab)"""
_POST = LEXEME + """, words AS (SELECT article_id, section_no, normalized AS form, row_number() OVER (PARTITION BY article_id ORDER BY section_no, sentence, idx) - 1 AS i FROM tok WHERE is_alpha),
cnt AS (SELECT article_id, section_no, own, sum(own) OVER (PARTITION BY article_id ORDER BY section_no) - own AS before FROM (SELECT article_id, section_no, count(*) AS own FROM words GROUP BY ALL)),
post AS (SELECT article_id, config, lexeme, i + before + 1 + CASE config WHEN 'english' THEN own ELSE 0 END AS position, CASE section_no WHEN 0 THEN 1.0 WHEN 3 THEN 0.2 ELSE 0.4 END AS w
  FROM words JOIN cnt USING (article_id, section_no) JOIN lexm USING (form))"""
_CMP = _PUB + f""", side AS (
  SELECT t.normalized AS label, count(*) FILTER (p.year < 2015)::BIGINT AS left_count, count(*) FILTER (p.year >= 2015)::BIGINT AS right_count
  FROM ptok t JOIN pub p USING (article_id) WHERE t.is_alpha GROUP BY 1),
cmp AS (SELECT label, left_count, right_count, least(left_count, right_count) AS shared, left_count + right_count AS total FROM side WHERE left_count > 0 AND right_count > 0 AND {curated_sql('label')})"""


def _lexeme(word: str, config: str = "russian") -> str:
    return stem_sql(f"'{word}'", config, "duckdb")


def _context_sql(forms: str) -> str:
    return f""", top AS (SELECT article_id, count(*) AS n FROM tok WHERE is_alpha AND normalized IN ({forms}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100),
      num AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY section_no, sentence, idx) AS p FROM tok WHERE article_id IN (SELECT article_id FROM top)),
      hit AS (SELECT article_id, p, token, row_number() OVER (PARTITION BY article_id ORDER BY p) AS hit_no FROM num WHERE is_alpha AND normalized IN ({forms}))
      SELECT h.article_id, h.hit_no::INT AS hit_no, trim(string_agg(CASE WHEN n.p = h.p THEN '[' || n.token || ']' ELSE n.token END, ' ' ORDER BY n.p)) AS context
      FROM hit h JOIN num n ON h.article_id = n.article_id AND n.p BETWEEN h.p - 7 AND h.p + 7 WHERE hit_no <= 5 GROUP BY h.article_id, h.hit_no, h.p"""


_STEM = "SELECT form FROM lem WHERE language = 'en' AND stem = {stem}"
_SAME = "SELECT form FROM lem WHERE lemma = (SELECT lemma FROM lem WHERE form = '{}')"
_QUAL = f""", q0 AS (SELECT article_id, {clean_sql('body_text')} AS c, coalesce(body_text, '') AS raw FROM txt),
q1 AS (
  SELECT article_id, length(c)::INT AS char_count, len(regexp_extract_all(c, '[{L}]{{2,}}'))::INT AS word_count, len(regexp_extract_all(raw, '[\\x{{e000}}-\\x{{f8ff}}]'))::INT AS private_use_count,
         CASE WHEN length(c) > 0 THEN len(regexp_extract_all(c, '[{L}]')) / length(c) ELSE 0.0 END AS density,
         list_filter(list_transform(string_split_regex(c, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}]'), lambda s: trim(regexp_replace(s, '[\\s\\x{{a0}}\\x{{85}}]+', ' ', 'g'))), lambda s: s <> '') AS lines FROM q0),
q2 AS (SELECT *, len(list_filter(lines, lambda s: regexp_matches(s, '^[^\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}]?.[^\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}]?$'))) AS single FROM q1),
q3 AS (SELECT *, concat_ws(',', CASE WHEN char_count = 0 THEN 'empty_text' END, CASE WHEN private_use_count > 0 THEN 'private_use_symbols' END, CASE WHEN word_count > 0 AND word_count < 120 THEN 'suspiciously_short_text' END,
         CASE WHEN char_count > 0 AND density < 0.35 THEN 'low_alpha_density' END, CASE WHEN len(lines) >= 20 AND single / len(lines) > 0.25 THEN 'fragmented_lines' END) AS flags FROM q2)"""


def _rank_sql(terms: list[str]) -> str:
    """One term, or pairs of two terms."""
    if len(terms) == 1:
        return f""", h AS (SELECT p.article_id, p.w, row_number() OVER (PARTITION BY p.article_id ORDER BY position) - 1 AS j FROM post p JOIN pub USING (article_id) WHERE lexeme = {terms[0]}),
        m AS (SELECT article_id, w, j, row_number() OVER (PARTITION BY article_id ORDER BY w DESC, j) AS o, w / ((j + 1) * (j + 1)) AS part FROM h),
        r AS (SELECT article_id, (sum(part) + sum(CASE WHEN o = 1 THEN w - part ELSE 0 END)) / 1.64493406685 AS rank FROM m GROUP BY 1)
        SELECT article_id, round(rank, 3) AS rank, 1 AS hit_count FROM r ORDER BY r.rank DESC, article_id LIMIT 100"""
    return f""", a AS (SELECT article_id, position AS p, w AS u FROM post WHERE lexeme = {terms[0]}), b AS (SELECT article_id, position AS q, w AS v FROM post WHERE lexeme = {terms[1]}),
    ids AS (SELECT DISTINCT article_id FROM a JOIN pub USING (article_id) WHERE article_id IN (SELECT article_id FROM b)),
    r AS (SELECT article_id, 1 - exp(sum(ln(1 - sqrt(u * v) / (1.005 + 0.05 * exp(abs(p - q) / 1.5 - 2))))) AS rank FROM a JOIN b USING (article_id) WHERE abs(p - q) <= 100 GROUP BY 1),
    f AS (SELECT article_id, coalesce(rank, 1e-20) AS rank FROM ids LEFT JOIN r USING (article_id))
    SELECT article_id, round(rank, 3) AS rank, 1 AS hit_count FROM f ORDER BY f.rank DESC, article_id LIMIT 100"""


SQL = {
    "agg1_word_freq_all": BASE + _PUB + f" {_FREQ} GROUP BY 1",
    "agg1_word_freq_curated": BASE + _PUB + f" {_FREQ} AND {curated_sql('normalized')} GROUP BY 1",
    "agg2_lemma_freq": BASE + _PUB + LEMMA + f" SELECT lemma AS label, count(*)::BIGINT AS count FROM ptok JOIN lem ON normalized = form WHERE is_alpha AND {curated_sql('lemma')} GROUP BY 1",
    "agg3_top_words": BASE + _PUB + f" {_FREQ} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
    "flt6_label_search": BASE + _PUB + f" {_FREQ} AND {curated_sql('normalized')} AND contains(normalized, 'регион') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 160",
    "w1_bigrams": BASE + _PUB + _BIGRAM.replace("COND", curated_sql("normalized")).replace("LABEL", "normalized") + " SELECT label, count(*)::BIGINT AS count FROM pair WHERE label IS NOT NULL GROUP BY 1",
    "agg4_lemma_bigrams": BASE + _PUB + LEMMA + _BIGRAM.replace("ptok", "(SELECT p.*, lemma FROM ptok p LEFT JOIN lem ON is_alpha AND normalized = form)").replace("COND", curated_sql("lemma")).replace("LABEL", "lemma") + " SELECT label, count(*)::BIGINT AS count FROM pair WHERE label IS NOT NULL GROUP BY 1",
    "w2_top_bigrams": BASE + _PUB + _BIGRAM.replace("COND", "true").replace("LABEL", "normalized") + " SELECT label, count(*)::BIGINT AS count, min(article_id) AS first_article FROM pair WHERE label IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, min((article_id, section_no, sentence, idx)) LIMIT 50",
    "agg5_compare_periods": BASE + _CMP + " SELECT * FROM cmp",
    "l1_compare_left_desc": BASE + _CMP + " SELECT * FROM cmp ORDER BY left_count DESC, shared DESC, label LIMIT 40 OFFSET 20",
    "agg22_text_sizes": BASE + LEMMA + " SELECT article_id, count(*)::BIGINT AS token_count, count(DISTINCT lemma)::BIGINT AS lemma_count FROM tok LEFT JOIN lem ON is_alpha AND normalized = form GROUP BY 1",
    "j4_token_lemmas": BASE + LEMMA + " SELECT section, lemma, count(*)::BIGINT AS tokens, count(DISTINCT normalized)::BIGINT AS forms FROM tok LEFT JOIN lem ON is_alpha AND normalized = form GROUP BY ALL",
    "m22_lemmas": BASE + LEMMA + " SELECT form, language, stem, lemma FROM lem",
    "agg6_compare_subcorpora": BASE + _PUB + LEMMA + f", side AS (SELECT lemma AS label, count(*) FILTER (p.language = 'ru')::BIGINT AS left_count, count(*) FILTER (p.year >= 2010)::BIGINT AS right_count FROM ptok t JOIN pub p USING (article_id) JOIN lem ON t.normalized = lem.form WHERE t.is_alpha GROUP BY 1) SELECT label, left_count, right_count, least(left_count, right_count) AS shared, left_count + right_count AS total FROM side WHERE left_count > 0 AND right_count > 0 AND {curated_sql('label')}",
    "w7_section_offsets": f"WITH {TEXT}, n AS (SELECT article_id, length(coalesce(title_text, '')) AS a, length(coalesce(abstract_text, '')) AS b, length(coalesce(keywords_text, '')) AS c, length(coalesce(body_text, '')) AS e FROM txt), o AS (SELECT *, CASE WHEN a > 0 THEN a + 2 ELSE 0 END AS sb, CASE WHEN b > 0 THEN b + 2 ELSE 0 END AS wb, CASE WHEN c > 0 THEN c + 2 ELSE 0 END AS wc FROM n), r AS (SELECT article_id, 'title' AS section, 0 AS start, a AS n FROM o UNION ALL SELECT article_id, 'abstract', sb, b FROM o UNION ALL SELECT article_id, 'keywords', sb + wb, c FROM o UNION ALL SELECT article_id, 'body', sb + wb + wc, e FROM o) SELECT article_id, section, start::INT AS start, (start + n)::INT AS stop FROM r WHERE n > 0",
    "scl13_token_spans": f"WITH {TEXT}, p AS (SELECT article_id, u.piece, u.i FROM txt, LATERAL (SELECT unnest(regexp_extract_all(body_text, {_PIECE})) AS piece, generate_subscripts(regexp_extract_all(body_text, {_PIECE}), 1) AS i) AS u), q AS (SELECT article_id, piece, sum(length(piece)) OVER (PARTITION BY article_id ORDER BY i) AS stop FROM p) SELECT article_id, count(*)::BIGINT AS tokens, sum(stop - length(piece))::BIGINT AS start_sum, max(stop)::INT AS last_end FROM q WHERE length(piece) <= 120 AND NOT regexp_matches(piece, {_SPACE}) GROUP BY 1",
    "scl14_sections": f"WITH {TEXT}, f AS (SELECT article_id, {_FLAT} AS flat, length(coalesce(title_text, '')) AS a, length(coalesce(abstract_text, '')) AS b, length(coalesce(keywords_text, '')) AS c, length(coalesce(body_text, '')) AS e FROM txt), o AS (SELECT *, CASE WHEN a > 0 THEN a + 2 ELSE 0 END AS sb, CASE WHEN b > 0 THEN b + 2 ELSE 0 END AS wb FROM f), p AS (SELECT o.*, u.piece, u.i FROM o, LATERAL (SELECT unnest(regexp_extract_all(flat, {_PIECE})) AS piece, generate_subscripts(regexp_extract_all(flat, {_PIECE}), 1) AS i) AS u), q AS (SELECT *, sum(length(piece)) OVER (PARTITION BY article_id ORDER BY i) - length(piece) AS pos FROM p), r AS (SELECT article_id, pos, CASE WHEN a > 0 AND pos <= a THEN 'title' WHEN b > 0 AND pos BETWEEN sb AND sb + b THEN 'abstract' WHEN c > 0 AND pos BETWEEN sb + wb AND sb + wb + c THEN 'keywords' ELSE 'body' END AS section FROM q WHERE length(piece) <= 120 AND NOT regexp_matches(piece, {_SPACE})) SELECT article_id, section, count(*)::BIGINT AS tokens, min(pos)::INT AS first_at FROM r GROUP BY ALL",
    "fts1_lexemes": BASE + LEXEME + " SELECT form, config, lexeme FROM lexm",
    "fts2_query_configs": "SELECT record_id, CASE WHEN regexp_matches(coalesce(title, ''), '^[A-Za-z][A-Za-z\\s-]*$') THEN 'english' ELSE 'russian' END AS config FROM article_metadata",
    "m14_payload_articles": BASE + ", pub AS (SELECT * FROM article WHERE is_published)" + _POST + _rank_sql([_lexeme("рынок")]).replace("SELECT article_id, round(rank, 3) AS rank, 1 AS hit_count FROM r ORDER BY r.rank DESC, article_id LIMIT 100", "SELECT article_id FROM (SELECT article_id FROM r ORDER BY r.rank DESC, article_id LIMIT 100) JOIN pub USING (article_id) WHERE year >= 2010 AND language = 'ru'"),
    "set4_mode_alone": "SELECT article_id FROM article_metadata WHERE false",
    "scl13_tokens": BASE + " SELECT section, is_alpha, count(*)::BIGINT AS tokens, count(DISTINCT normalized)::BIGINT AS forms, sum(sentence)::BIGINT AS sentence_sum, sum(idx)::BIGINT AS idx_sum FROM tok GROUP BY ALL",
    "scl3_token_languages": BASE + r" SELECT CASE WHEN regexp_matches(low, '^[A-Za-z][A-Za-z-]*$') THEN 'en' WHEN regexp_matches(low, '^[\x{0400}-\x{052f}-]+$') THEN CASE WHEN regexp_matches(low, '[ѣѢіІѳѲѵѴѫѪѭѬѧѦѩѨѿѾҁҀѯѮѱѰ]') THEN 'cu' ELSE 'ru' END ELSE 'other' END AS language, count(*)::BIGINT AS tokens, count(DISTINCT low)::BIGINT AS forms FROM tok WHERE is_alpha GROUP BY 1",
    "ts3_word_hits": BASE + " SELECT article_id, count(*)::BIGINT AS hit_count FROM tok WHERE is_alpha AND normalized = 'рынок' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "ts3_lemma_hits": BASE + LEMMA + f" SELECT article_id, count(*)::BIGINT AS hit_count FROM tok WHERE is_alpha AND normalized IN ({_STEM.format(stem=stem_sql(chr(39) + 'markets' + chr(39), 'russian', 'duckdb', stops=False))}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "ts5_contexts": BASE + _context_sql("'рынок'"),
    "ts5_lemma_contexts": BASE + LEMMA + _context_sql(_SAME.format("рынка")),
    "fts1_postings": BASE + _POST + " SELECT config, lexeme, count(*)::BIGINT AS places, count(DISTINCT article_id)::BIGINT AS articles, sum(position)::BIGINT AS position_sum FROM post GROUP BY ALL",
    "fts3_and_not": BASE + _POST + f" SELECT article_id FROM post GROUP BY 1 HAVING bool_or(lexeme = {_lexeme('market', 'english')}) AND bool_or(lexeme = {_lexeme('policies', 'english')}) AND NOT bool_or(lexeme = {_lexeme('consumption', 'english')})",
    "fts3_or": BASE + _POST + f" SELECT DISTINCT article_id FROM post WHERE lexeme IN ({_lexeme('кластеры')}, {_lexeme('cluster')})",
    "fts4_phrase": BASE + _POST + f" SELECT DISTINCT b.article_id FROM post b JOIN post c ON b.article_id = c.article_id AND c.position = b.position + 1 JOIN post e ON b.article_id = e.article_id AND e.position = b.position + 2 WHERE b.lexeme = {_lexeme('прочих')} AND c.lexeme = {_lexeme('равных')} AND e.lexeme = {_lexeme('условиях')}",
    "fts6_rank_term": BASE + ", pub AS (SELECT * FROM article WHERE is_published)" + _POST + _rank_sql([_lexeme("кластеров")]),
    "fts6_rank_terms": BASE + ", pub AS (SELECT * FROM article WHERE is_published)" + _POST + _rank_sql([_lexeme("market", "english"), _lexeme("policy", "english")]),
    "flt2_catalogue_search": f"""WITH {ARTICLE}, {TEXT}, pub AS (SELECT * FROM article WHERE is_published),
      ids AS (SELECT article_id FROM pub WHERE contains(lower(coalesce(title, '')), 'кластер') OR contains(lower(coalesce(abstract, '')), 'кластер')
        UNION SELECT article_id FROM txt WHERE contains(lower(coalesce(body_text, '')), 'кластер')
        UNION SELECT article_id FROM pub, unnest(keywords) AS u(k) WHERE contains(lower(regexp_replace(u.k, '[ \\t\\x{{a0}}]+', ' ', 'g')), 'кластер')
        UNION SELECT l.article_id FROM article_author l JOIN author a USING (author_id) WHERE contains(lower(CASE WHEN trim(coalesce(l.display_name, '')) <> '' THEN l.display_name ELSE concat_ws(' ', nullif(last_name, ''), nullif(first_name, ''), nullif(middle_name, '')) END), 'кластер') OR contains(lower(coalesce(a.last_name, '')), 'кластер'))
      SELECT article_id FROM pub WHERE article_id IN (SELECT article_id FROM ids)""",
    "flt9_missing_body": f"WITH {ARTICLE}, {TEXT} SELECT article_id FROM article WHERE is_published AND article_id NOT IN (SELECT article_id FROM txt WHERE body_text > '')",
    "scl9_quality": f"WITH {TEXT}{_QUAL} SELECT article_id, char_count, word_count, private_use_count, round(density, 6) AS alpha_density, flags FROM q3",
    "m18_audit": f"WITH {ARTICLE}, {TEXT}{_QUAL} SELECT article_id, coalesce(flags, 'empty_text') AS flags FROM article LEFT JOIN q3 USING (article_id) WHERE is_published AND coalesce(flags, 'empty_text') <> '' ORDER BY 1 LIMIT 80",
    "agg23_audit_counters": f"""WITH {ARTICLE}, {TEXT}{_QUAL} SELECT count(*)::BIGINT AS articles, count_if(coalesce(flags, 'empty_text') <> '')::BIGINT AS flagged, count_if(coalesce(private_use_count, 0) > 0)::BIGINT AS private_use,
      count_if(coalesce(char_count, 0) = 0)::BIGINT AS empty, count_if(coalesce(source_file, '') = '' AND coalesce(original_url, '') = '')::BIGINT AS without_source FROM article LEFT JOIN q3 USING (article_id) WHERE is_published""",
    "agg23_missing_vectors": BASE + _POST + " SELECT article_id FROM article WHERE is_published AND article_id NOT IN (SELECT article_id FROM post)",
    "m2_saved_texts": BASE + " SELECT section, count(*)::BIGINT AS tokens, count(DISTINCT article_id)::BIGINT AS articles FROM tok WHERE section <> 'body' OR article_id NOT IN (SELECT article_id FROM article WHERE language = 'en') GROUP BY 1",
    "m11_repair_candidates": f"WITH {ARTICLE}, {TEXT}{_QUAL} SELECT article_id FROM article JOIN q3 USING (article_id) WHERE is_published AND flags <> ''",
    "scl6_sanitized": f"WITH {TEXT} SELECT article_id, md5({clean_sql('body_text')}) AS hash FROM txt",
    "scl12_flattened": f"WITH {TEXT} SELECT article_id, length(concat_ws(chr(10) || chr(10), nullif({clean_sql('title_text')}, ''), nullif({clean_sql('abstract_text')}, ''), nullif({clean_sql('keywords_text')}, ''), nullif({clean_sql('body_text')}, '')))::INT AS chars FROM txt",
    "scl11_paragraphs": f"WITH {TEXT} SELECT article_id, len(list_filter(string_split_regex(regexp_replace(coalesce(body_text, ''), '\\r\\n?', chr(10), 'g'), '\\n[\\s\\x{{a0}}]*\\n'), lambda s: regexp_replace(s, '[\\s\\x{{a0}}]+', '', 'g') <> ''))::INT AS paragraphs FROM txt",
    "agg1_documents_freq": r"SELECT u.t AS label, count(*)::BIGINT AS count FROM documents, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS u(t) GROUP BY 1",
}
