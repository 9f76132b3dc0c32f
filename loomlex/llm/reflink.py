"""Problem 4: free-entered affiliations and cities mapped to reference lists, in SQL only.

Both sides are normalised (case, blanks, look-alike letters, punctuation); a value gives all runs
of as many words as the longest form has, a reference entry all forms in which it is usually written.  Forms
that a run equals are found by an equality join.  Values without one, or with short names only, go
on to a partition-based pigeonhole join: a form that may be k edits away is cut into k+1 segments, one of which must occur
unchanged in the value at a place shifted by at most k; the substrings of the value at those places
join the segments on (k, length, segment number, text), ``levenshtein`` verifies, and values that
no form verifies are reported with 0 through an anti-join.

A form at distance 2 counts only when two neighbouring letters were swapped or when its telling
first word is at most one edit away, so that towns with a common stem aren't mixed up.  Forms that
several entries share (short names) are settled by the value's city, or stay unmatched.

Nulls and edges: a NULL or blank name gives 0; a NULL or empty city gives no row, a blank one 0;
repeated rows give one result; an empty reference list leaves everything unmatched; very long
values give a number of runs in proportion to their words; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlex.session import stage_table, table

#: Latin letters that look like Cyrillic ones, in small letters.
LATIN, LOOKS = "aceopxyktmhbi", "асеорхуктмнві"
#: Cyrillic letters in Latin ones, those of one letter each, then the others.
ONE_CYR, ONE_LAT = "абвгдеёзийклмнопрстуфхцыэ", "abvgdeeziiklmnoprstufhcie"
MANY = (("щ", "shch"), ("ш", "sh"), ("ч", "ch"), ("ж", "zh"), ("ю", "iu"), ("я", "ia"), ("ь", ""), ("ъ", ""), ("і", "i"), ("ї", "i"), ("є", "e"), ("ґ", "g"))


def _norm(c: str) -> str:
    """Small letters, look-alikes of words with Cyrillic letters made Cyrillic, words by single blanks."""
    flat = f"regexp_replace(lower({c}), '[\\\\s\\\\u00A0]+', ' ')"
    words = f"transform(split({flat}, ' '), w -> if(w rlike '[а-яёіїєґ]', translate(w, '{LATIN}ё', '{LOOKS}е'), w))"
    bare = f"regexp_replace(regexp_replace(array_join({words}, ' '), '[-‐–''’]', ''), '[^a-zа-яіїєґ0-9]+', ' ')"
    return f"trim({bare})"


def _latin(c: str) -> str:
    """One spelling for the usual transliterations."""
    out = f"translate(lower({c}), '{ONE_CYR}', '{ONE_LAT}')"
    for a, b in MANY:
        out = f"replace({out}, '{a}', '{b}')"
    for a, b in (("kh", "h"), ("ts", "c"), ("tz", "c"), ("yu", "iu"), ("ya", "ia"), ("ju", "iu"), ("ja", "ia"), ("y", "i"), ("j", "i"), ("iia", "ia"), ("ii", "i")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _initials(words: str) -> str:
    return f"concat(element_at({words}, 1), ' ', array_join(transform({_rest(words)}, w -> left(w, 1)), ''))"


def _rest(words: str) -> str:
    """All words but the first."""
    return f"slice({words}, 2, greatest(size({words}) - 1, 0))"


ORG_FORMS = f"""
WITH r AS (
  SELECT o.org_id AS ref_id, o.city_location_id AS city_id, split({_norm('o.name')}, ' ') AS w, {_norm('o.short_name')} AS short,
         {_latin(_norm('o.name_en'))} AS en, {_norm('c.normalized_name')} AS city
  FROM {{orgs}} o LEFT JOIN {{cities}} c ON o.city_location_id = c.city_location_id
  WHERE o.org_id IS NOT NULL)
SELECT DISTINCT ref_id, city_id, kind, form, k FROM (
  SELECT ref_id, city_id, 'name' AS kind, array_join(w, ' ') AS form, 2 AS k FROM r
  UNION ALL SELECT ref_id, city_id, 'name', concat_ws(' ', array_join({_rest('w')}, ' '), w[0]), 2 FROM r
  UNION ALL SELECT ref_id, city_id, 'place', concat(array_join({_rest('w')}, ' '), ' ', city), 2 FROM r WHERE city <> ''
  UNION ALL SELECT ref_id, city_id, 'latin', en, 2 FROM r
  UNION ALL SELECT ref_id, city_id, 'initials', {_initials('w')}, 1 FROM r WHERE size(w) > 2
  UNION ALL SELECT ref_id, city_id, 'acronym', concat(short, ' ', city), 1 FROM r WHERE short <> '' AND city <> ''
  UNION ALL SELECT ref_id, city_id, 'short', short, 0 FROM r WHERE short <> ''
) WHERE form <> ''
"""

CITY_FORMS = f"""
WITH r AS (SELECT city_location_id AS ref_id, country, {_norm('normalized_name')} AS city, {_norm("regexp_replace(lower(normalized_name), '^([а-я])[а-я]+-', '$1')")} AS brief FROM {{cities}} WHERE city_location_id IS NOT NULL)
SELECT DISTINCT ref_id, CAST(NULL AS BIGINT) AS city_id, country, kind, form, k FROM (
  SELECT ref_id, country, 'city' AS kind, city AS form, 2 AS k FROM r
  UNION ALL SELECT ref_id, country, 'latin', {_latin('city')}, 1 FROM r
  UNION ALL SELECT ref_id, country, 'city', brief, 1 FROM r WHERE brief <> city
  UNION ALL SELECT ref_id, country, 'city', regexp_replace(city, '^([а-я]{{{{1}}}})[а-я]+ ', '$1 '), 1 FROM r WHERE city LIKE '% %'
  UNION ALL SELECT ref_id, country, 'city', regexp_replace(city, '^([а-я]{{{{3}}}})[а-я]+ ', '$1 '), 1 FROM r WHERE city LIKE '% %'
  UNION ALL SELECT ref_id, country, 'city', regexp_replace(city, '^([а-я]{{{{4}}}})[а-я]+ ', '$1 '), 1 FROM r WHERE city LIKE '% %'
) WHERE form <> ''
"""

#: Runs of words of every value: (id, kind of form that may match, text).
ORG_RUNS = f"""
WITH v AS (
  SELECT id, lower(value) rlike '[а-я]\\\\.|[а-я]-[трл]([^а-я]|$)' AS short_written,
         filter(split({_norm('value')}, ' '), w -> NOT w IN ('', 'г', 'гор', 'город')) AS w
  FROM {{vals}}),
s AS (SELECT id, short_written, slice(w, i, n) AS p FROM v LATERAL VIEW explode(sequence(1, size(w))) a AS i LATERAL VIEW explode(sequence(1, least({{span}}, size(w) - i + 1))) b AS n WHERE size(w) > 0)
SELECT DISTINCT id, kind, q FROM (
  SELECT id, kind, array_join(p, ' ') AS q FROM s LATERAL VIEW explode(if(size(p) = 1, array('short'), array('name', 'place', 'acronym'))) a AS kind
  UNION ALL SELECT id, 'latin', {_latin("array_join(p, ' ')")} FROM s WHERE size(p) > 2 AND NOT array_join(p, '') rlike '[а-яіїєґ]'
  UNION ALL SELECT id, 'initials', {_initials('p')} FROM s WHERE short_written AND size(p) > 2
)
"""

CITY_RUNS = f"""
WITH v AS (
  SELECT id, {_norm('value')} rlike '^в ' AS inside,
         transform(split({_norm("regexp_replace(regexp_replace(lower(value), '(^|[ ,])в[.] *', '$1верхний '), '[,;/()]+', ' qq ')")}, ' '), w -> CASE w WHEN 'нижнем' THEN 'нижний' WHEN 'верхнем' THEN 'верхний' WHEN 'новом' THEN 'новый' ELSE w END) AS w
  FROM {{vals}}),
parts AS (SELECT id, inside, array_join(filter(split(trim(part), ' '), x -> NOT x IN ('', 'г', 'гор', 'город', 'в', 'пос')), ' ') AS q FROM v LATERAL VIEW explode(split(array_join(w, ' '), 'qq')) a AS part)
SELECT DISTINCT id, kind, q, inside FROM (
  SELECT id, inside, 'city' AS kind, q FROM parts WHERE NOT q rlike '(^| )(обл|область|ул|россия|рф|край|район)( |$)|[0-9]'
  UNION ALL SELECT id, inside, 'latin', {_latin('q')} FROM parts WHERE q rlike '^[a-z ]+$'
) WHERE q <> ''
"""

EXACT = "SELECT r.id, f.ref_id, f.city_id, f.kind, 0 AS dist FROM {runs} r JOIN {forms} f ON r.kind = f.kind AND r.q = f.form"

#: The pigeonhole join.  Segment i of a form of length n starts at floor(i n / (k + 1)).
FUZZY = """
WITH seg AS (
  SELECT ref_id, city_id, kind, form, k, length(form) AS n, i, CAST(floor(i * length(form) / (k + 1)) AS INT) AS at,
         CAST(floor((i + 1) * length(form) / (k + 1)) - floor(i * length(form) / (k + 1)) AS INT) AS size
  FROM {forms} LATERAL VIEW explode(sequence(0, k)) a AS i WHERE k > 0 AND length(form) > 2 * (k + 1)),
piece AS (SELECT *, substring(form, at + 1, size) AS text FROM seg),
kinds AS (SELECT DISTINCT kind, k, n, i, at, size FROM seg),
probe AS (
  SELECT r.id, r.kind, r.q, s.k, s.n, s.i, substring(r.q, s.at + shift + 1, s.size) AS text
  FROM {runs} r JOIN kinds s ON r.kind = s.kind AND s.n = length(r.q) - r.delta
  LATERAL VIEW explode(sequence(greatest(-s.i, r.delta - (s.k - s.i)), least(s.i, r.delta + (s.k - s.i)))) a AS shift
  WHERE abs(r.delta) <= s.k AND greatest(-s.i, r.delta - (s.k - s.i)) <= least(s.i, r.delta + (s.k - s.i)) AND s.at + shift >= 0),
pair AS (
  SELECT DISTINCT p.id, p.q, f.ref_id, f.city_id, f.kind, f.form, f.k
  FROM probe p JOIN piece f ON p.kind = f.kind AND p.k = f.k AND p.n = f.n AND p.i = f.i AND p.text = f.text)
SELECT id, ref_id, city_id, kind, dist FROM (SELECT *, levenshtein(q, form) AS dist FROM pair)
WHERE dist <= k AND (kind NOT IN ('initials', 'acronym') OR (kind = 'initials' AND substring_index(q, ' ', -1) = substring_index(form, ' ', -1)) OR (kind = 'acronym' AND substring_index(q, ' ', 1) = substring_index(form, ' ', 1)))
  AND (dist < 2 OR array_sort(split(q, '')) = array_sort(split(form, '')) OR (kind <> 'city' AND levenshtein(substring_index(q, ' ', 1), substring_index(form, ' ', 1)) < 2 AND levenshtein(substring_index(q, ' ', -1), substring_index(form, ' ', -1)) < 2))
"""


def _shifted(spark: SparkSession, runs: DataFrame) -> DataFrame:
    return spark.sql("SELECT *, delta FROM {runs} LATERAL VIEW explode(sequence(-2, 2)) a AS delta", runs=runs)


def match(spark: SparkSession, runs: DataFrame, forms: DataFrame) -> DataFrame:
    """(id, ref_id, city_id, kind, dist) of all verified pairs; fuzzy ones only for values without an exact one
    or with short names only, which a misspelt full name may hold by chance."""
    runs, forms = stage_table(runs, "runs"), stage_table(forms, "forms")
    exact = stage_table(spark.sql(EXACT, runs=runs, forms=forms), "exact")
    left = spark.sql("SELECT r.* FROM {runs} r LEFT ANTI JOIN (SELECT id FROM {exact} WHERE kind <> 'short') e ON r.id = e.id", runs=runs, exact=exact)
    fuzzy = spark.sql(FUZZY, runs=_shifted(spark, left), forms=forms)
    return exact.unionByName(fuzzy)


def link_cities(spark: SparkSession, values: DataFrame, cities: DataFrame) -> DataFrame:
    """(id, ref_id) for ``values`` (id, value, country); 0 where the list has no such city."""
    forms = stage_table(spark.sql(CITY_FORMS, cities=cities), "cities")
    found = match(spark, spark.sql("SELECT id, kind, q FROM {r}", r=spark.sql(CITY_RUNS, vals=values)), forms.drop("country"))
    return spark.sql(
        """
        WITH land AS (SELECT DISTINCT ref_id, CASE WHEN lower(country) IN ('россия', 'рф', 'russia') THEN 'россия' ELSE lower(country) END AS land FROM {forms}),
        v AS (SELECT id, min(CASE WHEN lower(trim(country)) IN ('россия', 'рф', 'russia') THEN 'россия' ELSE lower(trim(country)) END) AS land FROM {vals} GROUP BY id),
        best AS (
          SELECT f.id, f.ref_id, rank() OVER (PARTITION BY f.id ORDER BY f.dist, CASE WHEN l.land = v.land THEN 0 ELSE 1 END) AS place
          FROM (SELECT id, ref_id, min(dist) AS dist FROM {found} GROUP BY id, ref_id) f JOIN land l ON f.ref_id = l.ref_id JOIN v ON f.id = v.id),
        one AS (SELECT id, min(ref_id) AS ref_id FROM best WHERE place = 1 GROUP BY id HAVING count(DISTINCT ref_id) = 1)
        SELECT id, ref_id FROM one
        UNION ALL SELECT DISTINCT v.id, CAST(0 AS BIGINT) FROM {vals} v LEFT ANTI JOIN one ON v.id = one.id
        """,
        forms=forms, found=found, vals=values,
    )


def link_organisations(spark: SparkSession, values: DataFrame, orgs: DataFrame, cities: DataFrame, towns: DataFrame) -> DataFrame:
    """(id, ref_id) for ``values`` (id, value); ``towns`` (id, ref_id) are the values' cities."""
    forms = stage_table(spark.sql(ORG_FORMS, orgs=orgs, cities=cities), "organisations")
    span = spark.sql("SELECT coalesce(max(size(split(form, ' '))), 1) AS n FROM {forms} WHERE kind <> 'initials'", forms=forms).collect()[0][0]
    found = match(spark, spark.sql(ORG_RUNS, vals=values, span=span), forms)
    return spark.sql(
        """
        WITH c AS (
          SELECT f.id, f.ref_id, min(f.dist + CASE f.kind WHEN 'short' THEN 20 WHEN 'acronym' THEN 10 WHEN 'initials' THEN 5 ELSE 0 END) AS cost,
                 max(CASE WHEN t.ref_id = f.city_id THEN 1 ELSE 0 END) AS same_town
          FROM {found} f LEFT JOIN {towns} t ON f.id = t.id GROUP BY f.id, f.ref_id),
        best AS (SELECT id, ref_id, rank() OVER (PARTITION BY id ORDER BY cost, same_town DESC) AS place FROM c),
        one AS (SELECT id, min(ref_id) AS ref_id FROM best WHERE place = 1 GROUP BY id HAVING count(DISTINCT ref_id) = 1)
        SELECT id, ref_id FROM one
        UNION ALL SELECT DISTINCT v.id, CAST(0 AS BIGINT) FROM {vals} v LEFT ANTI JOIN one ON v.id = one.id
        """,
        found=found, towns=towns, vals=values,
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Reference entry of every affiliation's name and city, 0 for none."""
    aff = table(spark, d, "affiliation")
    cities = table(spark, d, "city_location")
    city_values = spark.sql("SELECT affiliation_id AS id, city AS value, country FROM {aff} WHERE city <> ''", aff=aff)
    name_values = spark.sql("SELECT affiliation_id AS id, name AS value FROM {aff}", aff=aff)
    towns = stage_table(link_cities(spark, city_values, cities), "towns")
    names = link_organisations(spark, name_values, table(spark, d, "organisation_reference"), cities, towns)
    return spark.sql(
        "SELECT id AS affiliation_id, 'name' AS field_name, ref_id FROM {names} UNION ALL SELECT id, 'city', ref_id FROM {towns}", names=names, towns=towns)


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that mean no entry of their list, with the number of rows they stand in."""
    return spark.sql(
        """SELECT f.field_name, CASE f.field_name WHEN 'name' THEN a.name ELSE a.city END AS value, count(*) AS affiliations
        FROM {found} f JOIN {aff} a ON f.affiliation_id = a.affiliation_id WHERE f.ref_id = 0 GROUP BY 1, 2""",
        found=p4_found(spark, d), aff=table(spark, d, "affiliation"))


SQL: dict[str, str] = {}
QUERIES = {"p4_found": p4_found, "p4_unmatched": p4_unmatched}
