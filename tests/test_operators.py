"""Operators against small hand-made tables and brute force."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomlex.functions import stemming
from loomlex.operators import analytics, catalog, geo, index, maintenance, search, subcorpus
from loomlex.sinks import exports
from loomlex.sources import batch_import
from loomlex.streaming import ingest

TEXTS = "article_id long, title_text string, abstract_text string, keywords_text string, body_text string"


def texts(spark, *bodies):
    return spark.createDataFrame([(i, None, "", None, b) for i, b in enumerate(bodies, 1)], TEXTS)


def tokens_of(s):
    return re.findall(r"[^\W\d_]+|\d+|[^\w\s]", s)


def test_bigrams_match_a_plain_scan(spark):
    rng = random.Random(3)
    bodies = [" ".join(rng.choice(["рынок", "спрос", "труд", ",", "7", ".", "капитал"]) for _ in range(60)) for _ in range(20)]
    want = Counter()
    for b in bodies:
        last = None
        for t in tokens_of(b):
            if t.isalpha():
                if last:
                    want[f"{last} {t}"] += 1
                last = t
            else:
                last = None
    got = analytics.bigrams(index.sentences(texts(spark, *bodies)), "all")
    assert {r["label"]: r["count"] for r in got.collect()} == dict(want)


def test_contexts(spark):
    body = " ".join(f"w{'abcdefghij'[i % 10]}" if i != 12 else "hit" for i in range(30)) + " hit"
    df = texts(spark, body, "nothing here", None)
    sents, forms = index.sentences(df), search.query_forms(spark, " HIT ")
    assert forms == ("hit",) and search.query_forms(spark, "  ") == () and search.word_hits(sents, ()).count() == 0
    hits = search.word_hits(sents, forms)
    assert [tuple(r) for r in hits.collect()] == [(1, 2)]
    rows = search.contexts(sents, hits, forms).orderBy("hit_no").collect()
    assert rows[0]["context"].split() == [*("w" + "abcdefghij"[i % 10] for i in range(5, 12)), "[hit]", *("w" + "abcdefghij"[i % 10] for i in range(13, 20))]
    assert rows[1]["context"].endswith("[hit]")


def indexed(spark, df):
    sents = index.sentences(df)
    return index.postings(sents, index.lexemes(index.vocabulary(sents)))


def test_full_text(spark):
    p = indexed(spark, texts(spark, "big red cats", "red big cat", "Red cat and a dog", "", "рынки труда", "рынок капитала и труда"))
    ids = lambda q, phrase=False: sorted(r[0] for r in search.match(p, search.parse_query(spark, q, phrase)).collect())
    assert ids("red cat") == [1, 2, 3] and ids('"red cat"') == [1, 3] and ids("red -dog") == [1, 2] and ids("dogs or big") == [1, 2, 3]
    assert ids("big cat", True) == [2] and ids("") == [] and ids("-dog") == [] and ids("and the a") == []
    assert ids("cat and a dog", True) == [3] and ids("cat dog", True) == []  # stop words leave their gaps
    assert ids("труд") == [5, 6] and ids("рынка капитал", True) == [] and ids("рынок капитала", True) == [6]
    arts = spark.range(1, 5).withColumnRenamed("id", "article_id")
    top = search.search(p, arts, "red cat").collect()
    assert top[0]["article_id"] in (1, 3) and top[0]["rank"] >= top[-1]["rank"] and {r["hit_count"] for r in top} == {1}
    places = {(r["config"], r["position"]) for r in p.where("article_id = 5 and lexeme like 'труд%'").collect()}
    assert places == {("russian", 2), ("english", 4)}  # the English copy follows the Russian one


def test_stems(spark):
    pairs = {
        "english": "generalizations general running run happily happili relational relat skies sky consistency consist knightly knight hopping hop hoping hope agreed agre ties tie gas gas controlled control the -",
        "russian": "важнейшими важн вагонов вагон показались показа промышленность промышлен поезжайте поезжа последовательно последовательн markets market не -",
    }
    for config, listed in pairs.items():
        words = listed.split()
        df = spark.createDataFrame([(w,) for w in words[::2]], "w string").select("w", stemming.stem("w", config).alias("s"))
        assert {r["w"]: r["s"] or "-" for r in df.collect()} == dict(zip(words[::2], words[1::2]))
    assert len(stemming.ENGLISH_STOPS) == 127 and len(stemming.RUSSIAN_STOPS) == 159


def test_lemmas(spark):
    sents = index.sentences(texts(spark, "рынок рынки рынку market markets Marketing ѣлка", "markets"))
    lex = index.lemmas(index.vocabulary(sents))
    own = {r["form"]: r["lemma"] for r in lex.collect()}
    assert own["markets"] == own["marketing"] == "market" and own["рынку"] == own["рынки"] and "елка" in own
    assert {r["label"]: r["count"] for r in analytics.frequency(sents, None, "all", lexicon=lex).collect()}["market"] == 4
    assert set(search.query_forms(spark, "MARKETED", lex)) >= {"market", "markets", "marketing"}
    assert [tuple(r) for r in search.word_hits(sents, search.query_forms(spark, "market", lex)).collect()] == [(1, 3), (2, 1)]
    given = spark.createDataFrame([("рынки", "рынок")], "form string, lemma string")  # a dictionary in place of the table
    assert {r["label"]: r["count"] for r in analytics.frequency(sents, None, "all", lexicon=given).collect()}["рынок"] == 2
    b = {r["label"]: r["count"] for r in analytics.bigrams(sents, "all", lexicon=lex).collect()}
    assert b["market market"] == 2


def test_headlines(spark):
    words = [f"w{'abcdefghij'[i % 10]}" for i in range(100)]
    for i in (3, 40, 41, 44, 70, 99):
        words[i] = "hit"
    sents = index.sentences(texts(spark, " ".join(words), "nothing", "a < hit"))
    got = {r["article_id"]: r["contexts"] for r in search.headlines(sents, spark.range(1, 4).withColumnRenamed("id", "article_id"), ("hit",)).collect()}
    assert set(got) == {1, 3} and got[3] == ["a &lt; <mark>hit</mark>"]
    cut = [c.replace("<mark>", "").replace("</mark>", "").split() for c in got[1]]
    assert len(cut) == 3 and all(10 <= len(c) <= 28 for c in cut) and [c.count("<mark>") for c in got[1]] == [1, 3, 1]
    assert cut[0] == words[:28] and "hit" in cut[1][5:20] and all(words[i : i + len(c)] == c for i, c in ((words.index("hit") - 3, cut[0]),))


def test_index_is_pruned(spark, tmp_path):
    texts(spark, "рынок труда", "капитал").withColumn("text_id", F.col("article_id")).withColumn("updated_at", F.lit(None).cast("timestamp")).write.parquet(str(tmp_path / "article_text.parquet"))
    p = index.posting_table(spark, str(tmp_path))
    own = index.of_lexemes(p, ["рынок"])
    assert {r["lexeme"] for r in own.collect()} == {"рынок"}
    assert "bucket" in own._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]  # other folders aren't read
    assert index.of_lexemes(p, []).count() == 0 and p.count() == index.posting_table(spark, str(tmp_path)).count()
    texts(spark, "новый текст").withColumn("text_id", F.col("article_id") + 9).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "article_text.parquet"))
    assert index.of_lexemes(index.posting_table(spark, str(tmp_path)), ["рынок"]).count() == 0  # the tables changed, so the index is built anew


def test_frequency_and_comparison(spark):
    s = index.sentences(texts(spark, "Рынок рынок труд", "рынок"))
    top = analytics.top(analytics.frequency(s), 2).collect()
    assert [tuple(r) for r in top] == [("рынок", 3), ("труд", 1)]
    one, two = (spark.createDataFrame([(i,)], "article_id long") for i in (1, 2))
    assert [tuple(r) for r in analytics.shared_labels(analytics.frequencies_of(s, one, two)).collect()] == [("рынок", 2, 1, 1, 3)]
    assert [tuple(r) for r in analytics.shared_labels(analytics.frequencies_of(s, one, one.unionByName(two))).collect()] == [("рынок", 2, 3, 2, 5), ("труд", 1, 1, 1, 2)]
    a, b = (spark.createDataFrame(x, "label string, count long") for x in ([("x", 5), ("y", 1)], [("x", 2), ("z", 9)]))
    assert [tuple(r) for r in analytics.compare(a, b).collect()] == [("x", 5, 2, 2, 7)]
    assert analytics.page_bounds("-3", "x") == (0, 35) and analytics.page_bounds(1, 999) == (1, 160) and analytics.page_bounds(0, 1, 4, 24, 8) == (0, 4)


def test_sections_of_the_flattened_text(spark):
    df = spark.createDataFrame([(1, "Title", "", "kw", "Body text"), (2, None, None, None, None)], TEXTS)
    assert [(r["section"], r["start"], r["stop"]) for r in index.section_offsets(df).orderBy("start").collect()] == [("title", 0, 5), ("keywords", 7, 9), ("body", 11, 20)]
    assert [(r["token"], r["section"], r["char_start"]) for r in index.flat_tokens(df).orderBy("position").collect()] == [("Title", "title", 0), ("kw", "keywords", 7), ("Body", "body", 11), ("text", "body", 16)]


def test_payloads_mean_articles(spark):
    a = spark.createDataFrame([(1, 2020, "3", "1", "ru", "Рынок"), (2, 2010, "IV", "2", "en", "other")], "article_id long, year int, volume string, number string, language string, title string")
    none = spark.createDataFrame([], "article_id long, author_id long, normalized string")
    found = lambda p: sorted(r[0] for r in search.payload_articles(p, a, none, none, lambda q, m: a.where(F.col("title") == q)).collect())
    assert found({}) == found({"search_mode": "lemma", "page": 2, "title": ""}) == [] and found({"year_from": "2015"}) == [1] and found({"issue_number": "2"}) == [2]
    assert found({"text_query": "other"}) == [2] and found({"text_query": "other", "language": "ru"}) == []
    assert search.serialize_query({"a": ["x"], "b": ["y", "", "й"], "page": ["2"], "c": "", "d": 0}) == '{"a": "x", "b": ["y", "й"], "d": 0}'
    assert search.any_value({"a": "", "b": None, "c": [1]}) and not search.any_value({"a": "", "b": []})
    assert search.comparison_pair(1, 2, 3, 4) == ("article", 1, 2) and search.comparison_pair(1, None, 3, 4) == ("subcorpus", 3, 4) and search.comparison_pair(1, None, None, 4) is None
    members = spark.createDataFrame([(1, 1), (2, 2), (2, 9)], "subcorpus_id long, article_id long")
    assert sorted(r[0] for r in search.analytics_scope(a, members, ("subcorpus", 1, 2)).collect()) == [1, 2] and search.analytics_scope(a, members).count() == 2


def test_newest_keeps_one_row(spark):
    rows = [(1, "2020-01-01", 1, "a"), (1, "2021-01-01", 2, "b"), (1, "2021-01-01", 2, "b"), (2, None, 3, "c"), (None, "2020-01-01", 4, "d")]
    df = spark.createDataFrame(rows, "k long, at string, id long, v string")
    assert sorted(r["v"] for r in catalog.newest(df, "k", "at", "id").collect()) == ["b", "c"]
    assert catalog.newest(df.limit(0), "k", "at", "id").count() == 0


def test_filters(spark):
    a = spark.createDataFrame([(1, 2020, "3", "1", "ru", "100% Рынок"), (2, 2010, "IV", "2", "en", "other")], "article_id long, year int, volume string, number string, language string, title string")
    link = spark.createDataFrame([(1, 7), (1, 7)], "article_id long, author_id long")
    kw = spark.createDataFrame([(2, "новый рынок")], "article_id long, normalized string")
    ids = lambda **f: [r[0] for r in search.apply_filter(a, search.ArticleFilter(**f), link, kw).select("article_id").orderBy("article_id").collect()]
    assert ids() == [1, 2] and ids(year_from=2015) == [1] and ids(volume="iv") == [2] and ids(author_id=7) == [1] and ids(keyword="РЫНОК") == [2] and ids(title="100% р") == [1] and ids(title="1_0") == []


def test_marks_overlap_like_brute_force(spark):
    rng = random.Random(1)
    marks = [(i, rng.randrange(3), rng.randrange(4), a := rng.randrange(9000), a + rng.randrange(0, 3000)) for i in range(120)]
    m = spark.createDataFrame(marks, "mark_id long, user_id long, article_id long, char_start int, char_end int")
    got = {tuple(r) for r in subcorpus.overlapping(m, m.withColumnRenamed("mark_id", "wanted_id")).collect()}
    want = {(x[0], y[0]) for x in marks for y in marks if x[1:3] == y[1:3] and x[3] < x[4] and y[3] < y[4] and x[3] < y[4] and x[4] > y[3]}
    assert got == want


def test_membership(spark):
    key = "subcorpus_id long, article_id long"
    members = spark.createDataFrame([(1, 1, "manual"), (1, 2, "filter")], key + ", source string")
    new = subcorpus.refresh(members, spark.createDataFrame([(1, 1), (1, 3), (1, 3)], key))
    assert {tuple(r) for r in new.collect()} == {(1, 1, "manual"), (1, 3, "filter")}
    left, gone = subcorpus.remove_members(members, spark.createDataFrame([(1, 2)], key))
    assert left.count() == gone.count() == 1
    assert {tuple(r) for r in subcorpus.restore_members(left, gone).collect()} == {(1, 1, "manual"), (1, 2, "filter")} and subcorpus.restore_members(members, gone).count() == 2
    saved = spark.createDataFrame([(1, 7, "a"), (2, 7, "b")], "user_id long, query_id long, name string")
    assert sorted(r["name"] for r in subcorpus.rename_query(saved, 1, 7, "new").collect()) == ["b", "new"] and subcorpus.delete_query(saved, 2, 7).first()["name"] == "a"


def test_histogram_edges(spark):
    rows = [(i, n) for i, n in enumerate((1, 2, 4, 5, 9, 10, 24, 25, 99, 100))]
    h = geo.activity_histogram(spark.createDataFrame(rows, "city_location_id long, articles long"))
    assert [tuple(r) for r in h.orderBy("bucket").select("cities", "articles").collect()] == [(1, 1), (2, 6), (2, 14), (2, 34), (2, 124), (1, 100)]
    assert geo.activity_histogram(spark.createDataFrame([], "city_location_id long, articles long")).agg(F.sum("cities")).first()[0] == 0


def test_gazetteer(spark):
    v = spark.createDataFrame([(1, "Уральский федеральный университет, г. Екатеринбург"), (2, "нигде"), (3, None), (4, "Санкт-Петербургский университет")], "id long, name string")
    got = {r["id"]: r["display_name"] for r in geo.resolve(v, geo.gazetteer(spark), "id", "name").collect()}
    assert got == {1: "Екатеринбург", 2: None, 3: None, 4: "Санкт-Петербург"}
    a = spark.createDataFrame([(1, "Казань", "Россия", "Московский институт"), (2, None, "", "Казанский институт, г. Глазов"), (3, "", None, None)], "affiliation_id long, city string, country string, name string")
    rows = {r["affiliation_id"]: (r["city_name"], r["geography_source"], r["geography_confidence"]) for r in geo.refresh_geography(a, geo.gazetteer(spark)).collect()}
    # the longest alias of all wherever it stands; its own name is surer than another one
    assert rows == {1: ("Москва", "gazetteer", 0.82), 2: ("Казань", "gazetteer", 0.82), 3: (None, "unresolved", 0.0)}
    assert geo.refresh_geography(a.limit(1).withColumn("name", F.lit("")), geo.gazetteer(spark)).first()["geography_confidence"] == 0.95


def test_geocoder_answers_and_roles(spark):
    a = spark.createDataFrame([(1, "", "", "Институт моря"), (2, "Казань", "", "Институт моря"), (3, "", "", "нигде")], "affiliation_id long, city string, country string, name string")
    lookup = spark.createDataFrame([("Институт моря", "Лукоморск"), ("Институт моря", "Ясск")], "name string, display_name string")
    rows = {r["affiliation_id"]: (r["city_name"], r["geography_source"], r["geography_confidence"]) for r in geo.refresh_geography(a, geo.gazetteer(spark), lookup).collect()}
    assert rows == {1: ("Лукоморск", "geocoder", 0.62), 2: ("Казань", "gazetteer", 0.95), 3: (None, "unresolved", 0.0)}
    roles = spark.createDataFrame([("reader", False), ("editor", True)], "role string, can_edit boolean")
    users = spark.createDataFrame([(1, "editor"), (2, None), (3, "gone")], "user_id long, role string")
    assert {(r["user_id"], r["role"], r["can_edit"]) for r in maintenance.synced_roles(users, roles, "reader").collect()} == {(1, "editor", True), (2, "reader", False), (3, "reader", False)}


def test_staged_tables_are_released(spark):
    import os

    from loomlex import session

    staged = session.stage_table(spark.range(3))
    path = staged.inputFiles()[0].removeprefix("file://")
    assert staged.count() == 3 and os.path.exists(path)
    assert session.release(spark) >= 1 and not os.path.exists(path)


def test_upserts_and_orphans(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n")], "k long, v string")
    b = spark.createDataFrame([(None, "m"), (2, "y")], "k long, v string")
    assert sorted((r["k"] or 0, r["v"]) for r in maintenance.upsert(a, b, ["k"]).collect()) == [(0, "m"), (1, "x"), (2, "y")]
    titles = ["A b", "a  B", "!", None, "a b", "A b 2", "A-b-2", "a b 3", "", "x" * 300, "x" * 300]
    s = maintenance.unique_slugs(spark.createDataFrame(list(enumerate(titles)), "id long, title string"), "title", "id")
    slugs = [r["slug"] for r in s.orderBy("id").collect()]
    assert slugs == ["a-b", "a-b-4", "article", "article-2", "a-b-5", "a-b-2", "a-b-2-2", "a-b-3", "article-3", "x" * 220, "x" * 220 + "-2"]
    assert len(set(slugs)) == len(titles)
    n = spark.createDataFrame([("a", " "), ("b", "new"), ("c", None)], "slug string, body_text string")
    f, o = spark.createDataFrame([("a", "file")], "slug string, text string"), spark.createDataFrame([("a", "old"), ("c", "old")], "slug string, body_text string")
    assert {tuple(r) for r in maintenance.body_with_fallback(n, f, o).collect()} == {("a", "file", "file"), ("b", "new", "import"), ("c", "old", "existing")}
    fails = spark.createDataFrame([("u", f"2024-01-01 00:{i:02d}:00") for i in range(9)] + [("v", "2024-01-01 00:00:00")], "user string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r["user"], r["failures"]) for r in maintenance.locked_out(fails, "user", "ts").collect()] == [("u", 9)]
    j = spark.createDataFrame([(1, False), (3, True), (2, True)], "journal_id int, is_active boolean")
    assert maintenance.active_journal(j).first()["journal_id"] == 2
    k = maintenance.split_keywords(spark.createDataFrame([(1, "A, a ,, B")], "id long, k string"), "id", "k")
    assert {(r["name"], r["normalized"]) for r in k.collect()} == {("A", "a"), ("B", "b")}


def test_import_package(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/a.txt").write_text("Текст статьи", "utf-8")
    art = {"slug": "a", "title": "T", "year": 2024, "text_file": "texts/a.txt", "keywords": ["k"], "authors": [{"last_name": "И", "first_name": "П"}]}
    (tmp_path / "metadata.json").write_text(json.dumps({"journal": {"title": "J"}, "articles": [art, {"slug": "b", "title": "U"}]}), "utf-8")
    rows = {r["slug"]: r for r in batch_import.read_package(spark, str(tmp_path)).collect()}
    assert rows["a"]["body_text"] == "Текст статьи" and rows["a"]["journal"] == "J" and rows["b"]["body_text"] is None
    assert batch_import.package_authors(batch_import.read_package(spark, str(tmp_path))).first()["author_order"] == 1
    up = {r["kind"]: r for r in batch_import.read_uploads(spark, str(tmp_path / "texts")).collect()}
    assert up["txt"]["text"] == "Текст статьи" and len(up["txt"]["checksum"]) == 64
    (tmp_path / "texts/b.pdf").write_bytes(b"no pdf")
    (tmp_path / "texts/c.exe").write_bytes(b"MZ")
    (tmp_path / "texts/d.txt").write_bytes(b"x" * 100)
    problems = {r["path"][-5:]: r["problem"] for r in batch_import.read_uploads(spark, str(tmp_path / "texts"), 50).collect()}
    assert problems == {"a.txt": "", "b.pdf": "other first bytes", "c.exe": "unknown kind", "d.txt": "too large"}


def test_best_extraction(spark):
    good = "слово и дело " * 80
    rows = [("f", "primary", 1, good, "", 0), ("f", "other", 1, good * 9, "", 0)]  # a healthy first text is taken at once
    rows += [("g", "primary", 1, good, "", 0), ("g", "primary", 2, "", "", 1), ("g", "other", 1, good, "", 0), ("g", "other", 2, "ещё", "", 0)]  # a page of images only is empty too
    rows += [("h", "primary", 1, " ", None, 0), ("h", "other", 1, None, " ", 0)]
    got = {r["file"]: r for r in batch_import.best_extraction(spark.createDataFrame(rows, "file string, engine string, page int, plain string, layout string, images int")).collect()}
    assert [got[k]["engine"] for k in "fgh"] == ["primary", "other", "primary"] and got["h"]["empty_pages"] == 1 and got["g"]["text"].count("\n\n") == 1
    p = batch_import.best_extraction(spark.createDataFrame([r for r in rows if r[1] == "primary"], "file string, engine string, page int, plain string, layout string, images int")).where("file = 'g'").first()
    assert p["empty_pages"] == p["image_pages"] == 1


def test_html_pages(spark):
    html = '<meta name="citation_title" content=" A  B "><meta name="citation_author" content="X Y"><meta name="citation_author" content="Z"><meta name="citation_author_institution" content="Uni"><meta name="citation_firstpage" content="5"><meta name="citation_date" content="2024/1/2"><h1>Том 3</h1><a href="/issue/view/9">i</a>'
    df = spark.createDataFrame([("http://h/article/view/12", html), ("http://h/", None)], "url string, html string")
    r = batch_import.article_metadata(df).where("number = '12'").first()
    assert r["title"] == "A B" and [tuple(a) for a in r["authors"]] == [("X Y", "Uni"), ("Z", "")] and r["pages"] == "5" and r["language"] == "ru" and str(r["date"]) == "2024-01-02"
    assert [x["link"] for x in batch_import.issue_links(df).collect()] == ["http://h/issue/view/9"]
    bare = '<div class="item abstract"><h2>A</h2><div class="value"><p>One</p><p>Two</p></div></div><section class="item references"><div class="value"><p>R  1</p><p> </p><p>R2</p></div></section>'
    b = batch_import.article_metadata(spark.createDataFrame([("http://h/article/view/1", bare)], "url string, html string")).first()
    assert b["abstract"] == "One\nTwo" and b["references"] == ["R 1", "R2"] and b["title"] == ""
    issue = """<h1 class="current_issue_title">Том 7, № 2 (2021)</h1><section class="published"><span>Опубликован:</span><span class="value">05.03.2021</span></section>
      <div class="sections"><div class="section"><h2>Экономика</h2><div class="obj_article_summary"><h3 class="title"><a href="/article/view/5">T</a></h3><a class="obj_galley_link" href="/article/view/5/6">PDF</a></div></div>
      <div class="section"><div class="obj_article_summary"><p>no title</p></div><div class="obj_article_summary"><h3 class="title"><a href="/article/view/8">U</a></h3></div></div></div>"""
    pages = spark.createDataFrame([("http://h/issue/view/3", issue.replace("7,", "7"))], "url string, html string")
    got = [tuple(r) for r in batch_import.issue_articles(pages).orderBy("pos").select("volume", "number", "year", F.col("day").cast("string"), "url", "pdf_url", "section").collect()]
    assert got == [("7", "2", 2021, "2021-03-05", "http://h/article/view/5", "http://h/article/view/5/6", "Экономика"), ("7", "2", 2021, "2021-03-05", "http://h/article/view/8", "", "U")]
    themed = pages.withColumn("html", F.replace("html", F.lit("current_issue_title"), F.lit("theme_title")))
    assert batch_import.issue_articles(themed, ("current_issue_title", "theme_title")).first()["volume"] == "7"
    h = spark.sql("select 'Том 3 № 2 (2024)' as h").select(batch_import.issue_heading(F.col("h")).alias("x")).first()["x"]
    assert tuple(h) == ("3", "2", 2024)


def test_exports(spark, tmp_path):
    page = json.loads(exports.json_page(spark.range(5).orderBy("id"), 1, 2).first()["page"])
    assert [r["id"] for r in page["rows"]] == [1, 2] and page["total"] == 5 and page["has_more"]
    r = spark.createDataFrame([("t", "a", 2024, None, 1, ["<mark>x</mark> y", "z"])], "title string, author_line string, year int, section string, hit_count int, contexts array<string>")
    assert exports.search_table(r).first()["contexts"] == "x y | z"
    assert exports.bundle({"a": spark.range(3)}, 3) == {"a": [{"id": 0}, {"id": 1}, {"id": 2}]}
    with pytest.raises(ValueError):
        exports.bundle({"a": spark.range(4)}, 3)  # never cut without a word
    exports.write_bundle({"a": spark.range(4)}, str(tmp_path / "bundle"))
    assert spark.read.json(str(tmp_path / "bundle/a")).count() == 4
    spark.range(5).write.parquet(str(tmp_path / "in/t.parquet"))
    assert [(m["name"], m["rows"]) for m in exports.backup(spark, str(tmp_path / "in"), ["t"], str(tmp_path / "out")).collect()] == [("t", 5)] and spark.read.parquet(str(tmp_path / "out/t.parquet")).count() == 5


def test_stream_of_texts(spark, tmp_path):
    src = str(tmp_path / "in")
    df = texts(spark, "рынок рынок")
    df.write.parquet(src)
    q = ingest.ingest_texts(spark, src, df.schema, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first()["count"] == 2
