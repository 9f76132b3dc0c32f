"""Geography: gazetteer, alias matching and roll-ups of author affiliations (SRC15, J6, J8, M12, AGG12-AGG19)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlex.functions import text as T

#: Cities with country, latitude, longitude, region and the words that tell them.
GAZETTEER = (
    ("Ижевск", "Россия", 56.852738, 53.211489, "Удмуртская Республика", ("ижевск", "ижевский", "ижевская", "ижгту", "удмуртский", "удмуртская", "удмуртнефтегеофизика", "национальный банк по удмуртской республике", "казначейства по удмуртской республике",)),
    ("Сарапул", "Россия", 56.461611, 53.803696, "Удмуртская Республика", ("сарапул", "сарапульский",)),
    ("Глазов", "Россия", 58.140965, 52.674417, "Удмуртская Республика", ("глазов", "глазовский",)),
    ("Москва", "Россия", 55.755864, 37.617698, "Москва", ("москва", "московский", "мирэа", "мисис", "плеханова", "рудн", "российский университет дружбы", "патриса лумумбы", "виноградова", "государственный институт русского языка", "гаугн", "государственный академический университет гуманитарных наук", "ранхигс", "российская академия народного хозяйства", "внии центр", "внии «центр»", "фгуп внии", "всероссийский научно-исследовательский институт центр",)),
    ("Санкт-Петербург", "Россия", 59.938951, 30.315635, "Санкт-Петербург", ("санкт-петербург", "санкт петербург", "санкт-петербургский", "санкт петербургский", "петербург", "петербургский", "герцена", "лэти",)),
    ("Пушкин", "Россия", 59.721995, 30.416771, "Санкт-Петербург", ("ленинградский государственный университет им. а. с. пушкина",)),
    ("Казань", "Россия", 55.796127, 49.106405, "Республика Татарстан", ("казань", "казанский",)),
    ("Кемерово", "Россия", 55.354968, 86.087314, "Кемеровская область", ("кемерово", "кемеровский",)),
    ("Красноярск", "Россия", 56.009466, 92.852416, "Красноярский край", ("красноярск", "красноярский", "сибирский государственный университет науки",)),
    ("Курган", "Россия", 55.441004, 65.341118, "Курганская область", ("курган", "курганский",)),
    ("Луганск", "Россия", 48.574041, 39.307815, "Луганская Народная Республика", ("луганск", "луганский",)),
    ("Саранск", "Россия", 54.180761, 45.186226, "Республика Мордовия", ("саранск", "мордовский",)),
    ("Пермь", "Россия", 58.010455, 56.229443, "Пермский край", ("пермь", "пермский",)),
    ("Йошкар-Ола", "Россия", 56.634366, 47.89997, "Республика Марий Эл", ("йошкар-ола", "поволжский государственный технологический университет",)),
    ("Самара", "Россия", 53.195873, 50.100193, "Самарская область", ("самара", "самарский", "университет мир", "поволжский государственный университет телекоммуникаций",)),
    ("Уфа", "Россия", 54.735152, 55.958736, "Республика Башкортостан", ("уфа", "уфимский", "уфиц ран", "институт социально-экономических исследований уфиц",)),
    ("Екатеринбург", "Россия", 56.838011, 60.597474, "Свердловская область", ("екатеринбург", "уральский федеральный", "уральский государственный", "уро ран",)),
    ("Челябинск", "Россия", 55.159897, 61.402554, "Челябинская область", ("челябинск", "челябинский",)),
    ("Череповец", "Россия", 59.122612, 37.903461, "Вологодская область", ("череповец", "череповецкий",)),
    ("Вологда", "Россия", 59.220492, 39.891568, "Вологодская область", ("вологда", "вологодский",)),
    ("Сыктывкар", "Россия", 61.668797, 50.836497, "Республика Коми", ("сыктывкар", "сыктывкарский",)),
    ("Томск", "Россия", 56.484703, 84.948173, "Томская область", ("томск", "томский",)),
    ("Минск", "Беларусь", 53.902284, 27.561831, "", ("минск", "белорусский национальный",)),
    ("Иджеван", "Армения", 40.878933, 45.1487, "Тавушская область", ("иджеван", "иджеванский",)),
    ("Ереван", "Армения", 40.177628, 44.512546, "", ("ереван", "ереванский государственный университет",)),
    ("Дьер", "Венгрия", 47.687456, 17.650397, "", ("дьер", "дьере", "университет святого иштвана",)),
    ("Пула", "Хорватия", 44.866623, 13.849579, "", ("пула", "пулы",)),
    ("Чжэнчжоу", "Китай", 34.746611, 113.625328, "Хэнань", ("чжэнчжоу", "чжэнчжоуский",)),
)
#: Buckets of the activity histogram (least, label).
BUCKETS = ((1, "1"), (2, "2–4"), (5, "5–9"), (10, "10–24"), (25, "25–99"), (100, "100+"))


def upsert_cities(cities: DataFrame, seeds: DataFrame) -> DataFrame:
    """Listed cities as verified rows, one for each key and country, in place of those at hand."""
    new = seeds.select(T.city_key(F.col("display_name")).alias("normalized_name"), "country", "display_name", "region", "latitude", "longitude", F.lit("gazetteer").alias("geocode_source"), F.lit(True).alias("is_verified"), F.lit(False).alias("needs_review"))
    new = new.dropDuplicates(["normalized_name", "country"])
    old = cities.select(*(F.col(c).cast(t).alias(c) for c, t in new.dtypes))
    return old.join(new, ["normalized_name", "country"], "left_anti").select(*new.columns).unionByName(new)


def gazetteer(spark: SparkSession) -> DataFrame:
    """The built-in cities with their aliases (SRC15, M19)."""
    rows = [(i, *row[:-1], list(row[-1])) for i, row in enumerate(GAZETTEER)]
    return spark.createDataFrame(rows, "seed int, display_name string, country string, latitude double, longitude double, region string, aliases array<string>")


def from_cities(cities: DataFrame) -> DataFrame:
    """A gazetteer from a table of cities: every name is its only alias."""
    return cities.select(F.col("city_location_id").cast("int").alias("seed"), "display_name", "country", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"), "region", F.array("normalized_name").alias("aliases"))


def resolve(values: DataFrame, seeds: DataFrame, key: str, value: str) -> DataFrame:
    """Best alias that stands in ``value`` between blanks: the longest, then the first listed.

    The name of a city is its first alias.  An equality join on runs of words instead of a test of
    every value against every alias: a value gives its runs of as many words as the longest alias has.
    Rows without a match come back with NULLs; equal values are resolved once.  ``own_name`` tells
    whether the alias is the city's name.
    """
    names = F.concat(F.array("display_name"), F.coalesce("aliases", F.array()))
    alias = seeds.select("seed", "display_name", "country", F.posexplode(names).alias("no", "alias")).withColumn("alias", T.city_key(F.col("alias"))).where("alias <> ''")
    longest = alias.agg(F.max(F.size(F.split("alias", " ")))).collect()[0][0] or 1
    v = values.select(T.city_key(F.col(value)).alias("k")).distinct()
    w = F.split("k", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(w) - i + 1)), lambda n: F.array_join(F.slice(w, i, n), " "))))
    hits = v.select("k", F.explode(F.array_distinct(runs)).alias("alias")).join(alias, "alias")
    own = T.city_key(F.col("display_name")) == F.col("alias")
    best = hits.groupBy("k").agg(F.min_by(F.struct("seed", "display_name", "country", "alias", own.alias("own_name")), F.struct(-F.length("alias"), "seed", "no")).alias("b"))
    return values.select(key, T.city_key(F.col(value)).alias("k")).join(best, "k", "left").select(key, "b.seed", "b.display_name", "b.country", "b.alias", "b.own_name")


def refresh_geography(affiliations: DataFrame, seeds: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """City, source and confidence of every affiliation (M12): one search over city, country and name
    together; 0.95 where the alias found is the city's own name, 0.82 where it is another one.

    ``lookup`` (name, display_name) are answers of a geocoder for names that no alias tells; they have
    0.62 (SRC14; asking one is left to the caller).
    """
    a = affiliations.select("affiliation_id", T.text(F.col("name")).alias("name"), F.concat_ws(" ", T.text(F.col("city")), T.text(F.col("country")), T.text(F.col("name"))).alias("all"))
    found = resolve(a, seeds, "affiliation_id", "all")
    seed, own, city = F.col("seed").isNotNull(), F.coalesce("own_name", F.lit(False)), F.col("display_name")
    if lookup is None:
        found = found.withColumn("answer", F.lit(None).cast("string"))
    else:
        answers = lookup.groupBy("name").agg(F.min("display_name").alias("answer"))
        found = found.join(a.select("affiliation_id", "name").join(answers, "name", "left").select("affiliation_id", "answer").distinct(), "affiliation_id")
    asked = F.col("answer").isNotNull()
    return found.select(
        "affiliation_id", F.when(seed, city).otherwise(F.col("answer")).alias("city_name"), F.when(seed, "gazetteer").when(asked, "geocoder").otherwise("unresolved").alias("geography_source"),
        F.when(own, 0.95).when(seed, 0.82).when(asked, 0.62).otherwise(0.0).alias("geography_confidence"))


def base(links: DataFrame, articles: DataFrame, placed: DataFrame) -> DataFrame:
    """(article_id, year, title, author_id, affiliation_id, city…) of published, placed authors.

    The base of all roll-ups; cache or stage it when several are asked for.
    """
    pub = articles.where("is_published").select("article_id", "year", "title")
    return links.where("affiliation_id is not null").select("article_id", "author_id", "affiliation_id").join(placed, "affiliation_id").join(pub, "article_id")


def cities(b: DataFrame) -> DataFrame:
    """AGG12."""
    key = ["city_location_id", "display_name", "country", "region", "lat", "lon"]
    return b.groupBy(*key).agg(F.count_distinct("article_id").alias("articles"), F.count_distinct("author_id").alias("authors"), F.count_distinct("affiliation_id").alias("affiliations"))


def countries(b: DataFrame) -> DataFrame:
    """AGG13."""
    return b.groupBy("country").agg(F.count_distinct("city_location_id").alias("cities"), F.count_distinct("author_id").alias("authors"), F.count_distinct("article_id").alias("articles"))


def level(count) -> F.Column:
    """SCL33: number of the bucket, 0 for the first and for what is below it."""
    out = F.lit(0)
    for i, (least, _) in enumerate(BUCKETS):
        out = F.when(count >= least, F.lit(i)).otherwise(out)
    return out


def marker(country) -> F.Column:
    """SCL33: shape of a marker."""
    return F.when(F.lower(T.text(country)) == "россия", "circle").otherwise("diamond")


def activity_histogram(city_rows: DataFrame) -> DataFrame:
    """AGG14: cities and summed articles of the six buckets; empty ones stay."""
    got = city_rows.groupBy(level(F.col("articles")).alias("bucket")).agg(F.count(F.lit(1)).alias("c"), F.sum("articles").alias("a"))
    all_of = city_rows.sparkSession.createDataFrame([(i, label) for i, (_, label) in enumerate(BUCKETS)], "bucket int, label string")
    return all_of.join(got, "bucket", "left").select("bucket", "label", F.coalesce("c", F.lit(0)).alias("cities"), F.coalesce("a", F.lit(0)).alias("articles"))


def article_list(b: DataFrame) -> DataFrame:
    """AGG15: newest year first."""
    return b.groupBy("article_id", "year", "title").agg(F.count_distinct("author_id").alias("authors")).orderBy(F.desc("year"), "title", "article_id")


def timeline(b: DataFrame) -> DataFrame:
    """AGG16."""
    return b.groupBy("year").agg(F.count_distinct("article_id").alias("articles"), F.count_distinct("author_id").alias("authors"))


def totals(b: DataFrame) -> DataFrame:
    """AGG17, AGG18: one row."""
    return b.agg(F.count_distinct("article_id").alias("articles"), F.count_distinct("author_id").alias("authors"), F.count_distinct("affiliation_id").alias("affiliations"), F.count_distinct("city_location_id").alias("cities"), F.count_distinct("country").alias("countries"))


def years(b: DataFrame) -> DataFrame:
    """AGG17: years at hand, newest first, in one row."""
    return b.agg(F.sort_array(F.collect_set("year"), asc=False).alias("years"))  # as many as there are years


def of_city(b: DataFrame, city_id: int, year: int | None = None) -> DataFrame:
    """Rows of a city; a year that the data lack is no condition (FLT14)."""
    out = b.where(F.col("city_location_id") == city_id)
    if year is not None and not b.where(F.col("year") == year).isEmpty():
        out = out.where(F.col("year") == year)
    return out


def with_empty_city(city_rows: DataFrame, city: DataFrame) -> DataFrame:
    """AGG19: a row of zeros for a chosen city that has none."""
    zero = city.join(city_rows.select("city_location_id"), "city_location_id", "left_anti")
    return city_rows.unionByName(zero.select(*(c for c in city_rows.columns if c in city.columns), *(F.lit(0).cast("bigint").alias(c) for c in city_rows.columns if c not in city.columns)).select(*city_rows.columns))


def top_city(city_rows: DataFrame) -> DataFrame:
    """AGG18."""
    return city_rows.orderBy(F.desc("articles"), F.desc("authors"), "display_name", "city_location_id").limit(1)


def palette(df: DataFrame, colours: list[str], place: str) -> DataFrame:
    """SCL33: colours in turn by place."""
    return df.withColumn("colour", F.element_at(F.array(*map(F.lit, colours)), (F.col(place) % len(colours) + 1).cast("int")))
