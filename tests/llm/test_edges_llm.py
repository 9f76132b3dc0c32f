"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every query."""

import datetime

import pytest
from pyspark.sql import functions as F

TS = datetime.datetime(2024, 1, 1)
LONG = "Очень длинный текст о рынке. " * 4000
SCHEMAS = {
    "article_metadata": "record_id long, article_id long, slug string, title string, year int, language string, keywords array<string>, is_published boolean, authors array<struct<first_name:string,last_name:string,middle_name:string,affiliation:string>>, ingested_at timestamp",
    "article_text": "text_id long, article_id long, title_text string, abstract_text string, keywords_text string, body_text string, created_at timestamp, updated_at timestamp",
    "author": "author_id long, last_name string, first_name string, middle_name string, slug string",
    "affiliation": "affiliation_id long, name string, city string, country string, created_at timestamp",
    "city_location": "city_location_id long, display_name string, normalized_name string, region string, country string, latitude decimal(9,6), longitude decimal(9,6)",
    "organisation_reference": "org_id long, name string, short_name string, name_en string, city_location_id long",
    "user_activity": "activity_id long, user_id long, activity_type string, title string, payload string, created_at timestamp, updated_at timestamp",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, journal_slug string, url string, fetched_at timestamp",
    "mixture_target": "source string, target_share double, max_repeats int",
    "container_size": "container_name string, capacity_tokens int",
}
ROWS = {
    "article_metadata": [(1, 1, "a", "T", 2020, None, None, True, None, TS), (1, 1, "a", "T", 2020, None, None, True, None, TS), (2, 2, None, None, None, "ru", ["", None, "x"], None, [], None), (3, None, None, None, None, "??", ["y"], True, None, TS)],
    "article_text": [(1, 1, None, None, None, LONG, TS, TS), (1, 1, None, None, None, LONG, TS, TS), (2, 2, "", "", "", "", None, None), (3, 3, None, None, None, None, TS, TS), (4, None, None, None, None, " \n\n ", TS, TS), (5, 5, "t", "a", "k", "?? ??? ����", TS, TS)],
    "author": [(1, None, None, None, None), (2, "", "", "", ""), (3, "Петров", "Иван", None, "s"), (3, "Петров", "Иван", None, "s"), (4, "Петров", "И.", "", "t"), (5, " . - ", "1", "?", "u"), (6, "Щ" * 3000, "И", "", "v"), (None, "Петров", "Иван", "", "")],
    "affiliation": [(1, None, None, None, TS), (2, "", "", "", TS), (3, "  ", "  ", "x", TS), (4, "Тестовский университет", "г. Тестов", "Россия", TS), (4, "Тестовский университет", "г. Тестов", "Россия", TS), (5, "слово " * 300, "буква " * 300, None, TS)],
    "city_location": [(101, "Тестов", "тестов", "", "Россия", None, None), (102, None, None, None, None, None, None)],
    "organisation_reference": [(501, "Тестовский университет", "ТУ", "Testov University", 101), (502, None, None, None, None)],
    "user_activity": [(1, 1, "search", None, None, TS, TS), (2, None, None, "", "", TS, TS), (3, 1, "login", "РџРѕРёСЃРє", "{}", TS, TS), (3, 1, "login", "РџРѕРёСЃРє", "{}", TS, TS)],
    "documents": [(1, None, None, None, None, None, None, None), (2, "", "ru", "s", 0, None, None, TS), (3, LONG, "ru", "s", 9, "j", "u", TS), (3, LONG, "ru", "s", 9, "j", "u", TS), (None, "текст без номера", None, "s", 3, None, None, None)],
    "mixture_target": [("s", 0.5, 2), ("none", 0.5, 3), (None, 0.1, 1)],
    "container_size": [("c", 512), (None, None)],
}


def write(spark, path, rows):
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(rows[name], schema)
        for extra in ("id", "value", "lang_", "text_", "n", "w"):
            df = df.withColumn(extra, F.lit(1))
        df.coalesce(1).write.parquet(f"{path}/{name}.parquet")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    odd, empty = str(tmp_path_factory.mktemp("odd")), str(tmp_path_factory.mktemp("empty"))
    write(spark, odd, ROWS)
    write(spark, empty, {k: [] for k in SCHEMAS})
    return odd, empty


def names():
    from loomlex.llm import registry

    return sorted(registry.queries())


@pytest.mark.parametrize("name", names())
def test_odd_and_empty_tables(spark, folders, name):
    from loomlex.llm import registry

    query = registry.queries()[name]
    assert query(spark, folders[1]).count() == 0
    rows = [r.asDict() for r in query(spark, folders[0]).collect()]
    if name == "p3_found":
        assert {(r["author_id_a"], r["author_id_b"]) for r in rows} == {(3, 4)} and len(rows) == 1
    if name == "p4_found":
        got = {(r["affiliation_id"], r["field_name"]): r["ref_id"] for r in rows}
        assert len(rows) == 8 and got[4, "name"] == 501 and got[4, "city"] == 101 and got[1, "name"] == got[3, "city"] == 0 and (2, "city") not in got
    if name == "p2_found":
        assert {(r["field_name"], r["record_id"]) for r in rows} >= {("article_text.body_text", 5)}
    if name == "p9_found":
        assert [r["doc_id"] for r in rows] in ([], [3])  # one phrase 4000 times over; once, though the row is there twice
    if name == "p7_containers":
        assert {r["doc_id"] for r in rows} == {1, 2, 3, None} and all(r["container_id"] is None for r in rows if r["n_tokens"] == 0)
    if name == "p8_mixture":
        assert {r["doc_id"] for r in rows if not r["repeats"]} == {1, 2} and len(rows) == 2 + 3 * 2 and all((r["slot"] is None) == (r["repeats"] == 0) for r in rows)
