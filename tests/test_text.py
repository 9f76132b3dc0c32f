"""Column functions against plain values."""

import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomlex.functions import cleaning
from loomlex.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_white_space_and_letters(spark):
    assert one(spark, T.squeeze(F.col("a")), a=" a \n b ") == "a b"
    assert one(spark, T.squeeze(F.col("a")), a=None) == ""
    assert one(spark, T.modern_cyrillic(F.col("a")), a="ѣѯѴ") == "ексИ"
    assert one(spark, T.city_key(F.col("a")), a="г. Ёлка-Град!") == "елка-град"


def test_sanitize(spark):
    raw = "со­фт\r\nинстру-\n  мент \x07 x\n\n\n\ny z "
    want = "софт\nинструмент x\n\ny\nz"
    assert one(spark, T.sanitize(F.col("a")), a=raw) == want == cleaning.sanitize(raw)
    assert one(spark, T.private_use_count(F.col("a")), a=raw) == 1
    assert one(spark, T.sanitize(F.col("a")), a=None) == ""


def test_quality_flags(spark):
    flags = lambda a: one(spark, T.quality(F.col("a"))["flags"], a=a)
    assert flags(None) == ["empty_text"]
    assert flags("" + "слово " * 130) == ["private_use_symbols"]
    assert flags("12 34 56 78 слово") == ["suspiciously_short_text", "low_alpha_density"]
    assert "fragmented_lines" in flags("\n".join("абвгдежзик"[i % 10] for i in range(30)))


def test_labels(spark):
    keep = lambda w, mode="curated", scripts="exclude_latin": one(spark, T.meaningful(F.col("a"), mode, scripts), a=w)
    assert keep("рынок") and keep("кое-что") and keep("market", scripts="any") and keep("a", "all")
    assert not any(map(keep, ("market", "это", "да", "doi", "10.1", "слово1", "", "---")))
    match = lambda a, q: one(spark, T.label_matches(F.col("a"), q), a=a)
    assert match("новый рынок", "рын") and match("новый рынок", "") and match("он и я", "я")
    assert not match("новый рынок", "но") and not match("рынок", "мир")


def test_marks_names_and_dates(spark):
    marked = f"<b>{T.MARK_START}x{T.MARK_END}</b>"
    assert one(spark, T.render_marks(F.col("a")), a=marked) == "&lt;b&gt;<mark>x</mark>&lt;/b&gt;"
    n = one(spark, T.split_crawled_name(F.col("a")), a="Ivan P. Petrov")
    assert (n["last_name"], n["first_name"], n["middle_name"]) == ("Petrov", "Ivan", "P")
    assert one(spark, T.parse_date(F.col("a")), a="3.1.2024") == datetime.date(2024, 1, 3)
    assert one(spark, T.parse_date(F.col("a")), a="soon") is None
    assert one(spark, T.city_label(F.col("a"), F.col("b"), F.col("c")), a="Москва", b="Москва", c="Россия") == "Москва, Россия"


def test_payloads(spark):
    df = spark.sql("select map('text_query', 'a b', 'page', '2', 'title', '', 'search_mode', 'lemma') as p")
    row = df.select(T.clean_payload(F.col("p")).alias("c"), T.has_filters(F.col("p")).alias("h"), T.query_string(T.clean_payload(F.col("p"))).alias("q")).first()
    assert row["c"] == {"text_query": "a b", "search_mode": "lemma"} and row["h"] and row["q"] == "search_mode=lemma&text_query=a+b"
    assert df.select(T.describe_payload(F.col("p")).alias("d")).first()["d"] == ["Запрос: a b"]


@settings(max_examples=60, deadline=None)
@given(st.text("абв .!\n", max_size=400), st.integers(20, 60))
def test_chunks_cover_the_text(text, most):
    out = cleaning.cut_chunks(text, most)
    assert all(text[a:b] == t and 0 < b - a <= most for t, a, b in out)
    assert all(x[2] <= y[1] for x, y in zip(out, out[1:]))
    assert "".join(text.split()) == "".join("".join(t.split()) for t, _, _ in out)


def test_repair_cp1251(spark):
    for raw, want in (("РґР°", "да"), ("да", "да"), (None, None), ("", ""), ("a–b", "a–b"), ("Ð\x90", "Ð\x90"), ("мир 漢", "мир 漢")):
        assert one(spark, T.repair_cp1251(F.col("a")), a=raw) == want


def test_chunks_after_a_long_sentence():
    long, short = "слово " * 30 + "конец.", "Ещё одна фраза."
    text = f"Начало. {long} {short} {short}\n \nВторой"
    out = [t for t, _, _ in cleaning.cut_chunks(text, 60)]
    assert out[0] == "Начало." and all(not (x.startswith("слово") and short in x) for x in out)  # the rest stands alone
    assert any(x.startswith(f"{short} {short}") for x in out) and cleaning.cut_chunks("а\n \nб", 60) == [("а\n \nб", 0, 5)]  # only two line feeds part


def test_names(spark):
    n = lambda f, a: tuple(one(spark, f(F.col("a")), a=a))
    assert n(T.split_name, "Петров И. П.") == ("Петров", "И", "П") and n(T.split_name, "Петров") == ("Петров", "", "") and n(T.split_name, "а б в г д") == ("а", "б", "в г д")
    assert n(T.split_crawled_name, "Ivan Petrov") == ("Petrov", "Ivan", "") and n(T.split_crawled_name, "Petrov") == ("Petrov", "", "")
    assert one(spark, T.truncate(F.col("a"), 5), a="абвгдеж") == "абвг…" and one(spark, T.truncate(F.col("a"), 5), a="абвгд") == "абвгд"


def test_kinds_of_lines():
    kinds = {"": "blank", "Литература:": "back", "Keywords: a": "back", "ISSN 1": "margin", "12": "margin", "Раздел 3": "margin", "1. Иванов. URL: x (дата обращения: 1)": "margin", "1. Введение": "intro", "Обычная строка": "plain"}
    assert {x: cleaning.kind_of(x) for x in kinds} == kinds
    assert cleaning.window_of(["a", "", "b c", "d"], "c d", 4) == (0, 3) and cleaning.window_of(["a", "b c", "d"], "c d", 1) is None and cleaning.window_of(["x"], "", 2) is None
    body = "Название статьи о рынке\nИванов И.И., Ижевск\n\nАннотация первая строка текста здесь\nвторая строка.\n\nУДК 33\nТекст дальше.\n\nReferences\n1. x"
    assert cleaning.clean_body(body, "Название статьи о рынке", "Аннотация первая строка") == "Текст дальше."  # a leading repeat of the abstract goes
    assert cleaning.clean_body(body.replace("Аннотация п", "П"), "Название статьи о рынке", "первая строка текста не та") == "Первая строка текста здесь вторая строка.\n\nТекст дальше."


def test_body_cleaner():
    body = "ISSN 0000\nЗАГОЛОВОК\n\n12\nВведение\nПервый абзац текста .\n\nВторой абзац( да ).\n\nЛитература\n1. x"
    assert cleaning.clean_body(body, "Заголовок", "") == "Первый абзац текста.\n\nВторой абзац (да)." or cleaning.clean_body(body, "Заголовок", "").startswith("Первый абзац текста.")
    assert cleaning.clean_body(None) == "" and cleaning.clean_body(" \n ") == ""


def test_bytes():
    assert cleaning.decode_upload("да".encode("cp1251")) == "да" and cleaning.decode_upload("﻿да".encode()) == "да" and cleaning.decode_upload(None) == ""
    assert cleaning.article_slug(" ! ") == "article" and cleaning.author_slug("Ünal, É.") == "unal-e" and cleaning.author_slug("Ы").startswith("author-")
    assert cleaning.slugify("Новый рынок!") == "новый-рынок" and len(cleaning.slugify("!!!")) == 10
