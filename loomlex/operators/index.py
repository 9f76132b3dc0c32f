"""Token table, vocabulary, lemmas and the inverted index (SCL4, SCL5, SCL13-15, W5-W7, AGG22, FTS1, FTS9, M1, M3, M22).

Text is cut into sentences and sentences into tokens by array functions, so numbering needs no
window and no shuffle: a sentence's tokens stay in one array.  The sentences are staged once and serve
frequencies, bigrams, contexts and the index; words are analysed once each, not once a token.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlex.functions import text as T
from loomlex.functions.stemming import stem
from loomlex.operators import catalog
from loomlex.session import broadcast_if_small, kept, ship_package, spread

#: A run of letters, a run of digits, or one other visible character.
TOKEN = r"\p{L}+|\p{N}+|[^\p{L}\p{N}\p{Z}\s]"
#: Text up to a mark that ends a sentence.
SENTENCE = "[^.!?…]+[.!?…]?|[.!?…]"
LONGEST = 120
SECTIONS = (("title", "title_text", "A"), ("abstract", "abstract_text", "B"), ("keywords", "keywords_text", "B"), ("body", "body_text", "C"))
CONFIGS = ("russian", "english")
#: Folders of the index, and files a folder is written in, so that no task writes a whole one.
BUCKETS, SPLITS = 32, 4


def sentences(texts: DataFrame) -> DataFrame:
    """One row a sentence, no shuffle: (article_id, section, section_no, weight, sentence, tokens, norms).

    ``norms`` has the modern spelling in small letters of alphabetic tokens and NULL for others.
    """
    fields = F.array(*(F.struct(F.lit(i).alias("section_no"), F.lit(name).alias("section"), F.lit(w).alias("weight"), T.sanitize(F.col(c)).alias("t")) for i, (name, c, w) in enumerate(SECTIONS)))
    one = texts.select("article_id", F.explode(fields).alias("f")).select("article_id", "f.*").where("t <> ''")
    cut = one.select("article_id", "section", "section_no", "weight", F.posexplode(F.regexp_extract_all("t", F.lit(SENTENCE), F.lit(0))).alias("sentence", "s"))
    toks = F.filter(F.regexp_extract_all("s", F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) <= LONGEST)
    cut = cut.select("article_id", "section", "section_no", "weight", "sentence", toks.alias("tokens"))
    norms = F.transform("tokens", lambda t: F.when(t.rlike("^\\p{L}+$"), T.modern_cyrillic(F.lower(t))))
    return cut.withColumn("norms", norms)


def sentence_table(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the newest texts, staged once (M1, M3)."""
    return kept(spark, d, ("article_text",), "sentences", lambda: sentences(catalog.texts(spark, d)))


def tokens(sents: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Token table: place (section_no, sentence, idx), token, normalized, is_alpha and lemma.

    ``lexicon`` (form, lemma) is a table of lemmas; a form without an entry is its own lemma (J4).
    """
    t = sents.select("article_id", "section", "section_no", "weight", "sentence", F.posexplode(F.arrays_zip("tokens", "norms")).alias("idx", "z"))
    t = t.select("article_id", "section", "section_no", "weight", "sentence", "idx", F.col("z.tokens").alias("token"), F.coalesce("z.norms", F.lower("z.tokens")).alias("normalized"), F.col("z.norms").isNotNull().alias("is_alpha"))
    if lexicon is None:
        return t.withColumn("lemma", F.when(F.col("is_alpha"), F.col("normalized")))
    listed = broadcast_if_small(lexicon.select(F.col("form").alias("normalized"), F.col("lemma").alias("listed")))
    return t.join(listed, "normalized", "left").withColumn("lemma", F.when(F.col("is_alpha"), F.coalesce("listed", "normalized"))).drop("listed")


def token_spans(texts: DataFrame, column: str = "body_text") -> DataFrame:
    """(article_id, position, token, char_start, char_end) over the raw column; positions count from 0.

    Offsets aren't to be had from the JVM's regular expressions, so this one runs in Arrow batches.
    """
    ship_package(texts.sparkSession)
    schema = pa.schema([("article_id", pa.int64()), ("position", pa.int32()), ("token", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(TOKEN.replace(r"\s", r" \t\n\x0b\f\r")).finditer  # white space as the JVM has it
        for b in batches:
            cols: tuple[list, ...] = tuple([] for _ in schema)
            for aid, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = [x for x in find(s or "") if x.end() - x.start() <= LONGEST]
                for col, values in zip(cols, ([aid] * len(m), range(len(m)), [x.group() for x in m], [x.start() for x in m], [x.end() for x in m])):
                    col.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return texts.select("article_id", column).mapInArrow(run, "article_id bigint, position int, token string, char_start int, char_end int")


def section_offsets(texts: DataFrame) -> DataFrame:
    """(article_id, section, section_no, start, stop) of the non-empty fields in the flattened text: running
    lengths and two for the empty line between (W7).  Lengths are those of the raw fields."""
    sizes = F.array(*(F.length(T.text(F.col(c))) for _, c, _ in SECTIONS))
    start = lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, n: a + F.when(n > 0, n + 2).otherwise(0)) if i else F.lit(0)
    rows = F.array(*(F.struct(F.lit(name).alias("section"), F.lit(i).alias("section_no"), start(i).alias("start"), (start(i) + F.get(sizes, i)).alias("stop")) for i, (name, _, _) in enumerate(SECTIONS)))
    return texts.select("article_id", F.explode(rows).alias("r")).select("article_id", "r.*").where("stop > start")


def flat_tokens(texts: DataFrame) -> DataFrame:
    """Tokens of the flattened text with their places in it and the section these fall into (SCL14): the first
    field whose bounds, both included, hold the place; else the body."""
    flat = texts.select("article_id", T.flatten(*(F.col(c) for _, c, _ in SECTIONS)).alias("flat"))
    bounds = section_offsets(texts).groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "section", "start", "stop"))).alias("b"))  # four at most
    spans = token_spans(flat, "flat").join(bounds, "article_id", "left")
    own = F.get(F.filter("b", lambda x: (x["start"] <= F.col("char_start")) & (F.col("char_start") <= x["stop"])), 0)["section"]
    return spans.select("article_id", "position", "token", "char_start", "char_end", F.coalesce(own, F.lit("body")).alias("section"))


# ------------------------------------------------------------ words


def vocabulary(sents: DataFrame) -> DataFrame:
    """(form, n) of all alphabetic tokens, counted before the shuffle."""
    return sents.select(F.explode("norms").alias("form")).where("form is not null").groupBy("form").agg(F.count(F.lit(1)).alias("n"))


def analysed(forms: DataFrame) -> DataFrame:
    """(form, language, stem) of distinct forms; stop words have stems as well."""
    lang = T.token_language(F.col("form"), F.lit("ru"))
    return forms.select("form", lang.alias("language"), stem("form", "russian", stops=False).alias("stem"))


def lemmas(forms: DataFrame) -> DataFrame:
    """(form, language, stem, lemma): the lemma is the shortest form at hand of the same language and stem, the
    first by code points among equals (SCL4, SCL5, M22).  Every form is analysed once.

    A dictionary may be given to the operators instead of this table; its columns are form and lemma.
    """
    a = analysed(forms)
    first = a.groupBy("language", "stem").agg(F.min_by("form", F.struct(F.length("form"), "form")).alias("lemma"))
    return a.join(first, ["language", "stem"]).select("form", "language", "stem", "lemma")


def lexemes(forms: DataFrame) -> DataFrame:
    """(form, config, lexeme) of distinct forms under both configurations; stop words have none (FTS1)."""
    both = F.array(*(F.struct(F.lit(c).alias("config"), stem("form", c).alias("lexeme")) for c in CONFIGS))
    return forms.select("form", F.explode(both).alias("x")).select("form", "x.*").where("lexeme <> ''")


def word_table(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary, staged once; its words are analysed on all cores however few files it fills."""
    return spread(kept(spark, d, ("article_text",), "words", lambda: vocabulary(sentence_table(spark, d))))


def lemma_table(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, ("article_text",), "lemmas", lambda: lemmas(word_table(spark, d)))


def lexeme_table(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, ("article_text",), "lexemes", lambda: lexemes(word_table(spark, d)))


def text_sizes(sents: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Tokens and distinct lemmas of every article (AGG22).  Narrow rows of one text only meet again
    under its id, with partial sums for the count."""
    total = sents.groupBy("article_id").agg(F.sum(F.size("tokens")).alias("token_count"))
    words = sents.select("article_id", F.explode(F.array_distinct(F.array_compact("norms"))).alias("form"))
    if lexicon is not None:
        words = words.join(broadcast_if_small(lexicon.select("form", "lemma")), "form", "left").select("article_id", F.coalesce("lemma", "form").alias("form"))
    words = words.distinct()
    kinds = words.groupBy("article_id").agg(F.count(F.lit(1)).alias("lemma_count"))
    return total.join(kinds, "article_id", "left").select("article_id", "token_count", F.coalesce("lemma_count", F.lit(0)).cast("bigint").alias("lemma_count"))


# ------------------------------------------------------------ inverted index


def postings(sents: DataFrame, words: DataFrame) -> DataFrame:
    """(article_id, config, lexeme, position, weight) of every word under both configurations (FTS1).

    The parts of a vector follow each other as title, abstract, keywords and body, each first in
    the Russian and then in the English configuration; stop words leave gaps.  ``words`` are
    :func:`lexemes` of the forms.
    """
    own = sents.select("article_id", "section_no", "weight", "sentence", F.array_compact("norms").alias("words"))
    parts = own.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "sentence", "weight", "words"))).alias("p"))

    def size_of(no: int) -> F.Column:
        return F.aggregate("p", F.lit(0), lambda a, x: a + F.when(x["section_no"] == no, F.size(x["words"])).otherwise(0))

    sizes = F.array(*map(size_of, range(len(SECTIONS))))
    flat = F.flatten(F.transform("p", lambda x: F.transform(x["words"], lambda w: F.struct(w.alias("form"), x["weight"].alias("weight"), x["section_no"].alias("section_no")))))
    one = parts.select("article_id", sizes.alias("n"), flat.alias("f")).select("article_id", "n", F.posexplode("f").alias("i", "x"))
    one = one.select("article_id", "x.form", "x.weight", "i", F.get("n", F.col("x.section_no")).alias("own"), F.aggregate(F.slice("n", F.lit(1), F.col("x.section_no")), F.lit(0), lambda a, k: a + k).alias("before"))
    at = F.col("i") + F.col("before") + 1 + F.when(F.col("config") == "english", F.col("own")).otherwise(0)
    return one.join(broadcast_if_small(words), "form").select("article_id", "config", "lexeme", at.alias("position"), "weight")


def bucket(lexeme) -> F.Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(BUCKETS)).cast("int")


def posting_table(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index, written once in folders by a hash of the lexeme, sorted by lexeme (FTS9).

    A query that names its lexemes through :func:`of_lexemes` reads the folders and row groups of these only.
    """

    def build() -> DataFrame:
        p = postings(sentence_table(spark, d), lexeme_table(spark, d)).withColumn("bucket", bucket("lexeme"))
        return p.repartition("bucket", F.pmod("article_id", F.lit(SPLITS))).sortWithinPartitions("bucket", "lexeme", "article_id", "position")

    return kept(spark, d, ("article_text",), "postings", build, by="bucket")


def of_lexemes(index: DataFrame, names) -> DataFrame:
    """Postings of some lexemes."""
    names = sorted(set(names))
    if not names:
        return index.limit(0)
    out = index.where(F.col("lexeme").isin(*names))
    if "bucket" in index.columns:
        spark = index.sparkSession
        folders = spark.createDataFrame([(n,) for n in names], "lexeme string").select(bucket("lexeme")).distinct().collect()  # at most BUCKETS
        out = out.where(F.col("bucket").isin(*(r[0] for r in folders)))
    return out


def replace_articles(kept_rows: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of a token table or an index after the texts of the ``changed`` articles were saved anew (M2): theirs go,
    the fresh ones come.  An article whose text is empty now is in ``changed`` only."""
    return kept_rows.join(changed.select("article_id").distinct(), "article_id", "left_anti").unionByName(fresh, allowMissingColumns=True)
