"""Filters, full-text search, word search with context (FLT1-FLT18, FTS2-FTS8, TS1-TS9)."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlex.functions import text as T
from loomlex.functions.stemming import stem
from loomlex.operators import index

TOP = 100
CONTEXT = 7
HITS = 5


@dataclass(frozen=True)
class ArticleFilter:
    """FLT1: conditions that hold together; None, '' and 0 mean no condition."""

    year_from: int | None = None
    year_to: int | None = None
    volume: str | None = None
    number: str | None = None
    author_id: int | None = None
    language: str | None = None
    keyword: str | None = None
    title: str | None = None

    def empty(self) -> bool:
        return not any(vars(self).values())


def apply_filter(articles: DataFrame, f: ArticleFilter, links: DataFrame | None = None, keywords: DataFrame | None = None) -> DataFrame:
    """Articles that meet ``f``.  Authors and keywords are semi joins, so no row can double."""
    out = articles
    for value, cond in (
        (f.year_from, lambda v: F.col("year") >= v), (f.year_to, lambda v: F.col("year") <= v),
        (f.volume, lambda v: F.upper("volume") == v.upper()), (f.number, lambda v: F.upper("number") == v.upper()),
        (f.language, lambda v: F.col("language") == v), (f.title, lambda v: T.has(F.col("title"), F.lit(v))),
    ):
        if value:
            out = out.where(cond(value))
    if f.author_id:
        out = out.join(links.where(F.col("author_id") == f.author_id), "article_id", "left_semi")
    if f.keyword:
        out = out.join(keywords.where(F.contains("normalized", F.lit(f.keyword.lower()))), "article_id", "left_semi")
    return out


def catalogue_filter(articles: DataFrame, texts: DataFrame, links: DataFrame, keywords: DataFrame, query: str) -> DataFrame:
    """Articles that have ``query`` in title, abstract, body, a keyword or an author's name (FLT2)."""
    q = F.lit(query)
    ids = reduce(DataFrame.unionByName, (
        articles.where(T.has(F.col("title"), q) | T.has(F.col("abstract"), q)).select("article_id"),
        texts.where(T.has(F.col("body_text"), q)).select("article_id"),
        keywords.where(T.has(F.col("name"), q)).select("article_id"),
        links.where(T.has(F.col("name"), q) | T.has(F.col("last_name"), q)).select("article_id"),
    ))
    return articles.join(ids, "article_id", "left_semi")


def missing_body(articles: DataFrame, texts: DataFrame) -> DataFrame:
    """Articles without a text or with an empty body (FLT9)."""
    return articles.join(texts.where("body_text > ''"), "article_id", "left_anti")


# ------------------------------------------------------------ full text


#: A phrase: (place from 0, lexeme) of its words; stop words leave gaps.
Phrase = tuple[tuple[int, str], ...]


@dataclass(frozen=True)
class Query:
    """Alternatives of conjunctions of phrases; ``banned`` phrases exclude (FTS3)."""

    any_of: tuple[tuple[Phrase, ...], ...] = ()
    banned: tuple[Phrase, ...] = ()
    terms: tuple[str, ...] = field(default=())


def words_of(text: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[^\W\d_]+", text or "")]


def query_config(text: str) -> str:
    """Configuration of a query: 'english' for Latin letters, blanks and hyphens only (FTS2)."""
    return "english" if re.fullmatch(r"[A-Za-z][A-Za-z\s-]*", text or "") else "russian"


def stems_of(spark: SparkSession, words: list[str], config: str) -> dict[str, str]:
    """Lexemes of a query's words, by the very expression that the index was built with."""
    if not words:
        return {}
    df = spark.createDataFrame([(w,) for w in sorted(set(words))], "word string").select("word", T.modern_cyrillic(F.col("word")).alias("form"))
    return {r["word"]: r["lexeme"] for r in df.select("word", stem("form", config).alias("lexeme")).collect()}


def parse_query(spark: SparkSession, text: str, phrase: bool = False) -> Query:
    """Grammar of web searches: words are joined by AND, 'or' separates, '-' excludes, quotes keep
    words together; ``phrase`` takes the whole text as one phrase (FTS3, FTS4)."""
    parts = [("", text or "", "")] if phrase else re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text or "")
    stems = stems_of(spark, words_of(text), query_config((text or "").strip()))

    def phrase_of(words: list[str]) -> Phrase:
        found = [(i, x) for i, w in enumerate(words) if (x := stems.get(w, ""))]
        return tuple((i - found[0][0], x) for i, x in found)

    groups, banned, now = [], [], []
    for sign, quoted, word in parts:
        if not quoted and word.lower() == "or" and not sign:
            groups.append(now)
            now = []
        elif p := phrase_of(words_of(quoted or word)):
            (banned if sign else now).append(p)
    groups.append(now)
    kept = tuple(tuple(g) for g in groups if g)
    return Query(kept, tuple(banned), tuple(dict.fromkeys(w for g in kept for p in g for _, w in p)))


def phrase_ids(postings: DataFrame, phrase: Phrase) -> DataFrame:
    """Articles with the words of ``phrase`` at their distances: every word votes for the place where the
    phrase would begin, so one aggregation serves any length (FTS4)."""
    own = index.of_lexemes(postings, (w for _, w in phrase))
    if len(phrase) == 1:
        return own.select("article_id").distinct()
    at = F.array(*(F.when(F.col("lexeme") == w, F.lit(i)) for i, w in phrase))
    votes = own.select("article_id", "position", F.explode(F.array_compact(at)).alias("i"))
    full = votes.groupBy("article_id", (F.col("position") - F.col("i")).alias("start")).agg(F.count_distinct("i").alias("n")).where(F.col("n") == len(phrase))
    return full.select("article_id").distinct()


def match(postings: DataFrame, q: Query) -> DataFrame:
    """Ids of the articles that meet the query (FTS3-FTS5); only postings of its lexemes are read."""
    sets = []
    for group in q.any_of:
        single = sorted({p[0][1] for p in group if len(p) == 1})
        ids = index.of_lexemes(postings, single).groupBy("article_id").agg(F.count_distinct("lexeme").alias("n")).where(F.col("n") == len(single)).select("article_id") if single else None
        for p in (p for p in group if len(p) > 1):
            found = phrase_ids(postings, p)
            ids = found if ids is None else ids.join(found, "article_id", "left_semi")
        sets.append(ids)
    if not sets:
        return postings.select("article_id").limit(0)
    out = reduce(DataFrame.unionByName, sets).distinct()
    for p in q.banned:
        out = out.join(phrase_ids(postings, p), "article_id", "left_anti")
    return out


WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def rank(postings: DataFrame, ids: DataFrame, terms: tuple[str, ...], conjunctive: bool = False) -> DataFrame:
    """(article_id, rank) by place weights (FTS6).

    One term or alternatives: for each term the sum of w_j / (j + 1)^2 over its places, the heaviest
    place counted in full, over pi^2 / 6 and the number of terms.  Conjunctions: one minus the
    product over pairs of places of different terms of 1 - sqrt(w w') d, where d falls with the
    distance of the places; pairs further than 100 apart add nothing.
    """
    w = F.create_map(*(x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))))
    hits = index.of_lexemes(postings, terms).join(ids, "article_id", "left_semi").withColumn("w", w[F.col("weight")])
    if not conjunctive or len(terms) < 2:
        per = hits.groupBy("article_id", "lexeme").agg(F.array_sort(F.collect_list(F.struct("position", "w"))).alias("p"))
        term = F.transform("p", lambda x, j: F.struct(x["w"].alias("w"), (-j).alias("j"), (x["w"] / ((j + 1) * (j + 1))).alias("part")))
        top = F.array_max(term)
        share = F.aggregate(term, F.lit(0.0), lambda a, x: a + x["part"]) + top["w"] - top["part"]
        return per.select("article_id", (share / 1.64493406685).alias("s")).groupBy("article_id").agg((F.sum("s") / len(terms)).alias("rank"))
    left, right = hits.select("article_id", F.col("lexeme").alias("a"), F.col("position").alias("p"), F.col("w").alias("u")), hits.select("article_id", F.col("lexeme").alias("b"), F.col("position").alias("q"), F.col("w").alias("v"))
    far = F.abs(F.col("p") - F.col("q"))
    pairs = left.withColumn("cell", F.explode(F.array(*(F.floor(F.col("p") / 100) + i for i in (-1, 0, 1))))).join(right.withColumn("cell", F.floor(F.col("q") / 100)), ["article_id", "cell"]).where((F.col("a") < F.col("b")) & (far <= 100))
    d = 1.0 / (1.005 + 0.05 * F.exp(far / 1.5 - 2))
    got = pairs.groupBy("article_id").agg((1 - F.exp(F.sum(F.log1p(-F.sqrt(F.col("u") * F.col("v")) * d)))).alias("rank"))
    return ids.join(got, "article_id", "left").select("article_id", F.coalesce("rank", F.lit(1e-20)).alias("rank"))


def search(postings: DataFrame, articles: DataFrame, text: str, mode: str = "fulltext", top: int = TOP) -> DataFrame:
    """Best ``top`` articles with rank and hit_count 1 (FTS5-FTS8); ties in order of ids."""
    q = parse_query(postings.sparkSession, text, mode == "phrase")
    ids = match(postings, q).join(articles, "article_id", "left_semi")
    ranked = rank(postings, ids, q.terms, conjunctive=len(q.any_of) == 1)
    return ranked.select("article_id", F.round("rank", 3).alias("rank"), F.lit(1).alias("hit_count"), F.col("rank").alias("full")).orderBy(F.desc("full"), "article_id").limit(top).drop("full")


def headlines(sentences: DataFrame, ids: DataFrame, forms: tuple[str, ...], most: int = 3, width: int = 28) -> DataFrame:
    """Up to three fragments of up to ``width`` tokens of the body with the hits among them, escaped and
    marked (FTS7).

    A fragment begins with the first hit that no fragment before it holds, takes in the hits that fit
    and is then filled up on both sides alike, without running into the fragment before.
    """
    own = sentences.where("section = 'body'").join(ids.select("article_id"), "article_id", "left_semi")
    parts = own.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("sentence", "tokens", "norms"))).alias("s"))
    flat = parts.select("article_id", F.flatten(F.transform("s", lambda x: x["tokens"])).alias("t"), F.flatten(F.transform("s", lambda x: x["norms"])).alias("w"))
    hits = F.filter(F.transform("w", lambda x, i: F.when(x.isin(*forms), i)), lambda i: i.isNotNull())
    flat = flat.select("article_id", "t", "w", hits.alias("h")).where(F.size("h") > 0)
    empty = F.array().cast("array<struct<a:int,b:int>>")
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    fits = lambda acc, i: (F.size(acc) > 0) & (i - last(acc)["a"] < width)
    grown = lambda acc, i: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["a"].alias("a"), i.alias("b"))))
    cover = F.aggregate("h", empty, lambda acc, i: F.when(fits(acc, i), grown(acc, i)).when(F.size(acc) < most, F.concat(acc, F.array(F.struct(i.alias("a"), i.alias("b"))))).otherwise(acc))

    def filled(acc, x):
        lead = F.floor((width - (x["b"] - x["a"] + 1)) / 2).cast("int")
        left = F.greatest(x["a"] - lead, F.when(F.size(acc) > 0, last(acc)["b"] + 1).otherwise(0))
        right = F.least(left + width - 1, F.size("t") - 1)
        return F.concat(acc, F.array(F.struct(left.alias("a"), right.alias("b"))))

    spans = F.aggregate(cover, empty, filled)
    marked = F.transform("t", lambda x, i: F.when(F.get("w", i).isin(*forms), F.concat(F.lit(T.MARK_START), x, F.lit(T.MARK_END))).otherwise(x))
    part = lambda x: T.render_marks(F.array_join(F.slice("m", x["a"] + 1, x["b"] - x["a"] + 1), " "))
    return flat.select("article_id", "h", "w", "t", marked.alias("m"), spans.alias("x")).select("article_id", F.transform("x", part).alias("contexts"))


def forms_of_lexemes(lexemes: DataFrame, terms: tuple[str, ...]) -> tuple[str, ...]:
    """Word forms whose lexeme a query names; their number is bounded by the endings of a language."""
    return tuple(sorted({r[0] for r in lexemes.where(F.col("lexeme").isin(*terms)).select("form").collect()})) if terms else ()


# ------------------------------------------------------------ words in context


def query_forms(spark: SparkSession, query: str, lexicon: DataFrame | None = None) -> tuple[str, ...]:
    """Normalised forms that a word search means (TS1, TS2): the query without outer blanks, in small letters
    and modern spelling, or every form that shares its lemma when a lexicon is given.

    The whole query is one word.  Forms that share a lemma are few: the endings of a language bound them.
    """
    asked = spark.createDataFrame([(query or "",)], "q string").select(T.modern_cyrillic(F.lower(T.strip(F.col("q")))).alias("form"))
    q = asked.collect()[0][0]
    if not q or lexicon is None:
        return (q,) if q else ()
    same = lexicon.where(F.col("form") == q).select("lemma")
    if "stem" in lexicon.columns and same.isEmpty():  # a form that no text has is analysed like the others
        same = lexicon.join(F.broadcast(index.analysed(asked).drop("form")), ["language", "stem"]).select("lemma")  # one row
    found = lexicon.join(same.distinct(), "lemma", "left_semi").select("form")
    return tuple(sorted({q} | {r[0] for r in found.collect()}))


def word_hits(sentences: DataFrame, forms: tuple[str, ...], top: int = TOP) -> DataFrame:
    """(article_id, hit_count) of the sentences' words among ``forms``, most hits first (TS1-TS3)."""
    n = F.size(F.filter("norms", lambda w: w.isin(*forms))) if forms else F.lit(0)
    found = sentences.select("article_id", n.alias("n")).where("n > 0")
    return found.groupBy("article_id").agg(F.sum("n").cast("bigint").alias("hit_count")).orderBy(F.desc("hit_count"), "article_id").limit(top)


def contexts(sentences: DataFrame, hits: DataFrame, forms: tuple[str, ...], before: int = CONTEXT, hits_each: int = HITS) -> DataFrame:
    """(article_id, hit_no, context): the first hits of each article with ``before`` tokens on either
    side, the hit marked (TS4, TS5, W3, W4, J13).

    Only articles with a hit are gathered, one array an article; the neighbours are a slice of it.
    """
    own = sentences.join(F.broadcast(hits.select("article_id")), "article_id", "left_semi")  # at most TOP rows
    parts = own.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "sentence", "tokens", "norms"))).alias("s"))
    flat = parts.select("article_id", F.flatten(F.transform("s", lambda x: x["tokens"])).alias("t"), F.flatten(F.transform("s", lambda x: x["norms"])).alias("w"))
    places = F.filter(F.transform("w", lambda x, i: F.when(x.isin(*forms), i)), lambda i: i.isNotNull())
    one = flat.select("article_id", "t", F.posexplode(F.slice(places, 1, hits_each)).alias("hit_no", "i"))
    left = F.slice(F.col("t"), F.greatest(F.col("i") - before, F.lit(0)) + 1, F.least(F.col("i"), F.lit(before)))
    right = F.slice(F.col("t"), F.col("i") + 2, F.lit(before))
    hit = F.concat(F.lit("["), F.get("t", F.col("i")), F.lit("]"))
    return one.select("article_id", (F.col("hit_no") + 1).alias("hit_no"), F.trim(F.concat_ws(" ", left, hit, right)).alias("context"))


def metadata_results(articles: DataFrame) -> DataFrame:
    """No text query: all filtered articles, newest year first (TS6)."""
    return articles.select("article_id", "year", "title", F.lit(0).alias("hit_count")).orderBy(F.desc("year"), "title", "article_id")


def recent(log: DataFrame, user: Column | int, n: int) -> DataFrame:
    """Newest ``n`` rows of a user's log (TS9, L7)."""
    return log.where(F.col("user_id") == user).orderBy(F.desc("created_at"), F.desc("activity_id")).limit(n)


def suggestions(values: DataFrame, column: str, query: str, most: int = 20) -> DataFrame:
    """Distinct values that contain ``query``, Cyrillic titles first (FLT17, L5, L6)."""
    v = values.select(F.col(column).alias("value")).where(T.has(F.col("value"), F.lit(query)) & (T.text(F.col("value")) != "")).distinct()
    return v.orderBy(T.title_rank(F.col("value")), F.lower("value"), "value").limit(max(1, min(most, 400)))


def resolve_city(cities: DataFrame, value: str) -> DataFrame:
    """City a filter means: same key, same name, else the first whose key has it (FLT13)."""
    key = T.city_key(F.lit(value))
    tier = F.when(F.col("normalized_name") == key, 0).when(F.lower("display_name") == value.lower(), 1).when(F.contains("normalized_name", key), 2)
    return cities.withColumn("tier", tier).where("tier is not null").orderBy("tier", "display_name", "city_location_id").limit(1)


def related(articles: DataFrame, most: int = 4) -> DataFrame:
    """First four other articles of the same section, NULL being a section too.

    The candidates of a section are its first ``most`` + 1 articles, found by a bounded window, so a
    section that holds a third of all articles joins five rows, not all of them.
    """
    order = Window.partitionBy("section").orderBy(F.desc("year"), "title", "article_id")
    first = articles.select("section", "year", "title", "article_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most + 1)
    a, b = articles.select(F.col("article_id").alias("a"), "section"), first.select(F.col("article_id").alias("b"), F.col("section").alias("s"), "n")
    both = a.join(b, F.col("section").eqNullSafe(F.col("s"))).where("a <> b")
    keep = Window.partitionBy("a").orderBy("n")
    return both.withColumn("place", F.row_number().over(keep)).where(F.col("place") <= most).select(F.col("a").alias("article_id"), F.col("b").alias("related_id"), "place")


# ------------------------------------------------------------ saved payloads


def payload_articles(payload: dict, articles: DataFrame, links: DataFrame, keywords: DataFrame, run_search) -> DataFrame:
    """Ids of the articles that a saved payload means (M14, SET4): none for an empty one or a mode alone, those of
    ``run_search(text, mode)`` when it has a text query, else those of its filters."""
    kept = {k: v for k, v in payload.items() if k not in ("saved_query", "subcorpus", "page") and v not in (None, "", [])}
    if set(kept) <= {"search_mode"}:
        return articles.select("article_id").limit(0)
    f = ArticleFilter(**{a: int(kept[b]) if a in ("year_from", "year_to", "author_id") else str(kept[b]) for a, b in (
        ("year_from", "year_from"), ("year_to", "year_to"), ("volume", "volume"), ("number", "issue_number"), ("author_id", "author"), ("language", "language"), ("keyword", "keyword"), ("title", "title")) if b in kept})
    own = apply_filter(articles, f, links, keywords).select("article_id")
    if not kept.get("text_query"):
        return own
    return run_search(kept["text_query"], kept.get("search_mode", "fulltext")).join(own, "article_id", "left_semi").select("article_id")


def serialize_query(items: dict) -> str:
    """FLT4: a form's values as JSON; one value stands alone, several as a list, empty ones drop out."""
    out = {}
    for key, value in items.items():
        if key in ("saved_query", "subcorpus", "page"):
            continue
        many = [v for v in value if v not in ("", None, [])] if isinstance(value, (list, tuple)) else [value] if value not in ("", None, []) else []
        if many:
            out[key] = many if len(many) > 1 else many[0]
    return json.dumps(out, ensure_ascii=False)


def any_value(form: dict) -> bool:
    """TS7: a search runs only if some field has a value."""
    return any(v not in (None, "", [], False) for v in form.values())


def comparison_pair(left_article=None, right_article=None, left_subcorpus=None, right_subcorpus=None) -> tuple[str, object, object] | None:
    """FLT8: two articles, else two sub-corpora, else nothing; a mixed or half pair is none."""
    if left_article and right_article:
        return "article", left_article, right_article
    if left_subcorpus and right_subcorpus:
        return "subcorpus", left_subcorpus, right_subcorpus
    return None


def analytics_scope(articles: DataFrame, members: DataFrame, pair: tuple[str, object, object] | None = None) -> DataFrame:
    """SET5: ids that an export covers; both sides of a comparison when there is one, else every article."""
    if pair is None:
        return articles.select("article_id")
    kind, left, right = pair
    if kind == "article":
        return articles.where(F.col("article_id").isin(left, right)).select("article_id")
    return members.where(F.col("subcorpus_id").isin(left, right)).select("article_id").distinct().join(articles, "article_id", "left_semi")
