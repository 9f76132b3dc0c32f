"""Problem 6: occurrences and record counts of every term, kept up to date by signed deltas.

A *record* is an article; it may own several rows.  A change of the source is a set of rows that
left and a set that came.  Their occurrences get signs -1 and +1.  A term counts a record once,
however many rows of the record have it, so the rows that stay in a touched record are counted
too, once with the old state (-1) and once with the new one (+1).  ``text_delta`` and ``list_delta``
aggregate these signed rows into changes per term.

:class:`TermStore` keeps the counts in hash buckets.  ``apply`` merges the changes into new files of
the buckets that have such terms, then puts down a manifest that names the files of every bucket
and the changes merged so far.  A change whose id the manifest has is left alone, and a merge that
fails half-way leaves the old manifest in force, so a change may be sent again.  Queries read
the store: the first load is a change of an empty store, later rows are a second change.

Nulls and edges: a NULL or empty text or list has no terms; a row with NULL ``article_id`` adds
occurrences but no record; repeated rows add occurrences each and the article once; an empty
table gives no rows; a row with NULL in the column that orders changes is in the first load; other
columns are ignored; the number of records is kept as that of the term ''.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlex.session import broadcast_if_small, drop_at_exit, shared_dir, ship_package, stage_table, table

BUCKETS = 16
#: The term whose records are all records that have a row.
RECORDS = ""
#: Entries after which a task hands on what it has counted so far.
FLUSH = 400_000

_DELTA = "term string, d_occurrences bigint, d_records bigint"
_PART = "article_id bigint, sign int, term string, occurrences bigint, records bigint"


def _letters() -> re.Pattern:
    """Runs of category L: word characters less digits, the underscore and numerals."""
    odd = "".join(
        re.escape(c)
        for c in map(chr, range(sys.maxunicode + 1))
        if unicodedata.category(c) in ("Nl", "No", "Mn", "Mc", "Pc") and re.match(r"[^\W\d_]", c)
    )
    return re.compile(rf"[^\W\d_{odd}]+")


class _Terms(dict):
    """Piece of text without white space -> its lower-cased terms."""

    def __init__(self) -> None:
        self.find = _letters().findall

    def __missing__(self, piece: str) -> tuple[str, ...]:
        if len(self) > FLUSH:
            self.clear()
        self[piece] = found = tuple(sys.intern(t.lower()) for t in self.find(piece))
        return found


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = _Terms()
    sums: dict[int, tuple[Counter, Counter]] = {1: (Counter(), Counter()), -1: (Counter(), Counter())}
    schema = pa.schema([("article_id", pa.int64()), ("sign", pa.int32()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])

    def out(ids, signs, names, occ, rec):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, signs, names, occ, rec), schema.types, strict=True)], schema=schema)

    def flush():
        for sign, (occ, rec) in sums.items():
            if occ:
                names = list(occ)
                yield out([None] * len(names), [sign] * len(names), names, list(occ.values()), [rec[t] for t in names])
                occ.clear()
                rec.clear()

    for b in batches:
        for article, sign, many, text in zip(*(b.column(c).to_pylist() for c in ("article_id", "sign", "many", "text")), strict=True):
            row: dict[str, int] = {} if article is None else {RECORDS: 0}
            for piece, n in Counter((text or "").split()).items():
                for t in terms[piece]:
                    row[t] = row.get(t, 0) + n
            if many:  # the article has other rows: its terms must meet before it counts once
                k = len(row)
                if k:
                    yield out([article] * k, [sign] * k, list(row), list(row.values()), [1] * k)
                continue
            occ, rec = sums[sign]
            occ.update(row)
            if article is not None:
                rec.update(row.keys())
        if sum(len(o) for o, _ in sums.values()) > FLUSH:
            yield from flush()
    yield from flush()


def text_delta(rows: DataFrame) -> DataFrame:
    """Changes per term from signed rows (article_id, sign, text): d_occurrences, d_records.

    Terms are the maximal runs of Unicode letters, lower-cased.  Rows are counted where they lie;
    only articles with more than one row send (article, term) pairs through a shuffle, however
    many rows one article has.
    """
    ship_package(rows.sparkSession)
    many = rows.groupBy("article_id", "sign").count().where("count > 1 and article_id is not null")
    many = stage_table(many.select("article_id", "sign", F.lit(True).alias("many")), "many")
    flagged = rows.join(broadcast_if_small(many), ["article_id", "sign"], "left")
    part = flagged.select("article_id", "sign", F.coalesce("many", F.lit(False)).alias("many"), "text").mapInArrow(_count_rows, _PART)
    part = part.groupBy("article_id", "sign", "term").agg(
        F.sum("occurrences").alias("occurrences"),
        F.when(F.col("article_id").isNull(), F.sum("records")).otherwise(F.lit(1)).alias("records"),
    )
    return _net(part)


def list_delta(rows: DataFrame) -> DataFrame:
    """As :func:`text_delta` for signed rows (article_id, sign, terms array): every entry is a term.

    Blanks, tabs and no-break spaces are collapsed, outer blanks removed, case lowered; entries
    that are NULL or empty then are dropped.
    """
    clean = F.lower(F.trim(F.regexp_replace("entry", "[ \t ]+", " ")))
    flat = rows.select("article_id", "sign", F.explode("terms").alias("entry")).select("article_id", "sign", clean.alias("term")).where("term <> ''")
    part = flat.groupBy("article_id", "sign", "term").agg(F.count(F.lit(1)).alias("occurrences"))
    return _net(part.withColumn("records", F.col("article_id").isNotNull().cast("long")))


def _net(part: DataFrame) -> DataFrame:
    return (
        part.groupBy("term")
        .agg(F.sum(F.col("occurrences") * F.col("sign")).alias("d_occurrences"), F.sum(F.col("records") * F.col("sign")).alias("d_records"))
        .where("d_occurrences <> 0 or d_records <> 0")
    )


def signed_changes(old: DataFrame | None, new: DataFrame, row_id: str, value: str) -> DataFrame:
    """Signed rows (article_id, sign, ``value``) of the articles whose rows differ between snapshots.

    A row is the same when ``row_id``, ``article_id`` and the hash of ``value`` agree.
    """
    cols = ["article_id", value]
    if old is None:
        return new.select(*cols, F.lit(1).alias("sign"))
    key = lambda d, s: d.groupBy(row_id, "article_id", F.xxhash64(value).alias("h")).agg((F.lit(s) * F.count(F.lit(1))).alias("n"))
    moved = key(old, -1).unionByName(key(new, 1)).groupBy(row_id, "article_id", "h").agg(F.sum("n").alias("n")).where("n <> 0")
    touched = stage_table(moved.select("article_id").distinct(), "touched")
    side = lambda d, s: d.join(touched, d["article_id"].eqNullSafe(touched["article_id"]), "left_semi").select(*cols, F.lit(s).alias("sign"))
    return side(old, -1).unionByName(side(new, 1))


def added_changes(before: DataFrame, added: DataFrame, value: str) -> DataFrame:
    """As :func:`signed_changes` where rows only come: ``added`` to ``before``.

    Only the ids of the two meet; of the rows before, those of records that have new rows as well are
    read, and counted with either sign.
    """
    cols = ["article_id", value]
    both = stage_table(added.select("article_id").where("article_id is not null").distinct().join(before.select("article_id").distinct(), "article_id", "left_semi"), "touched")
    stay = before.join(broadcast_if_small(both), "article_id", "left_semi")
    return added.select(*cols, F.lit(1).alias("sign")).unionByName(stay.select(*cols, F.explode(F.array(F.lit(-1), F.lit(1))).alias("sign")))


class TermStore:
    """Counts (term, occurrences, records) below ``path``, in hash buckets named by a manifest."""

    SCHEMA = "term string, occurrences bigint, records bigint"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.jvm = spark.sparkContext._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def state(self) -> dict:
        """The newest manifest: number, folder of every bucket, ids of the changes merged."""
        if not self.fs.exists(self._at("")):
            return {"number": 0, "buckets": {}, "changes": []}
        names = [f.getPath().getName() for f in self.fs.listStatus(self._at(""))]
        found = [int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)[.]json", n))]
        if not found:
            return {"number": 0, "buckets": {}, "changes": []}
        stream = self.fs.open(self._at(f"manifest-{max(found)}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        part, final = self._at(f"part-{uuid.uuid4().hex}"), self._at(f"manifest-{state['number']}.json")
        out = self.fs.create(part, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self.fs.rename(part, final):
            raise OSError(f"another writer has put down {final}")

    def apply(self, change: str, delta: DataFrame) -> bool:
        """Merge ``delta`` (term, d_occurrences, d_records); False if ``change`` is merged already.

        Only buckets with terms of the delta are read and written; terms that fall to nothing leave.
        """
        state = self.state()
        if change in state["changes"]:
            return False
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        delta = stage_table(delta.select("term", F.col("d_occurrences").alias("occurrences"), F.col("d_records").alias("records"), bucket.alias("bucket")), "delta")
        hit = [r[0] for r in delta.select("bucket").distinct().collect()]  # at most ``buckets``
        old = [state["buckets"][str(b)] for b in hit if str(b) in state["buckets"]]
        both = delta.select("term", "occurrences", "records").unionByName(self._read(old)) if old else delta
        new = both.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).where("occurrences > 0 or records > 0")
        number = state["number"] + 1
        folder = f"{self.path}/v{number}-{uuid.uuid4().hex}"
        new.withColumn("bucket", bucket).repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(folder)
        written = {s.getPath().getName() for s in self.fs.listStatus(self.jvm.org.apache.hadoop.fs.Path(folder))}
        kept = {b: p for b, p in state["buckets"].items() if int(b) not in set(hit)}
        kept |= {str(b): f"{folder}/bucket={b}" for b in hit if f"bucket={b}" in written}
        self._commit({"number": number, "buckets": kept, "changes": [*state["changes"], change]})
        return True

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(*folders)

    def read(self) -> DataFrame:
        """Counts of all terms and of RECORDS."""
        folders = list(self.state()["buckets"].values())
        return self._read(folders) if folders else self.spark.createDataFrame([], self.SCHEMA)

    def records(self, prefix: str = "") -> int:
        """Number of records, of a field where keys begin with its name."""
        one = self.read().where(F.col("term") == prefix + RECORDS).select("records").collect()
        return one[0][0] if one else 0


def verdicts(counts: DataFrame, n_records: int, rare_below: int = 3, common_above: float = 0.1) -> DataFrame:
    """Adds verdict: 'rare' (records < ``rare_below``), 'common' (> ``common_above`` of all), else NULL."""
    return counts.withColumn("verdict", F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * n_records, "common"))


def _two_changes(rows: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Rows up to the median of ``by`` (or without it), and the rows after."""
    cut = rows.agg(F.percentile_approx(by, 0.5)).collect()[0][0]
    late = F.coalesce(F.col(by) > F.lit(cut), F.lit(False))
    return rows.where(~late), rows.where(late)


def of_field(delta: DataFrame, field: str) -> DataFrame:
    """Changes under keys that name their field as well, so that one store holds several."""
    return delta.withColumn("term", F.concat(F.lit(field + "\t"), "term"))


def _all_counts(spark: SparkSession, d: str) -> DataFrame:
    """Both fields in one store: the rows up to the median time of change are loaded, the later ones merged as a
    change, the counts read from the store."""
    path = f"{shared_dir(spark)}/loomlex-terms-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    store = TermStore(spark, path)
    body, words = "article_text.body_text", "article_metadata.keywords"
    text = table(spark, d, "article_text").select("article_id", "updated_at", F.col("body_text").alias("text"))
    keys = table(spark, d, "article_metadata").select("article_id", "ingested_at", F.col("keywords").alias("terms"))
    (text1, text2), (keys1, keys2) = _two_changes(text, "updated_at"), _two_changes(keys, "ingested_at")
    signed = lambda rows, value: rows.select("article_id", value, F.lit(1).alias("sign"))
    store.apply("load", of_field(text_delta(signed(text1, "text")), body).unionByName(of_field(list_delta(signed(keys1, "terms")), words)))
    store.apply("late rows", of_field(text_delta(added_changes(text1, text2, "text")), body).unionByName(of_field(list_delta(added_changes(keys1, keys2, "terms")), words)))
    counts = store.read().select(F.substring_index("term", "\t", 1).alias("field_name"), F.substring_index("term", "\t", -1).alias("term"), "occurrences", "records")
    return verdicts(counts.where(F.col("term") != RECORDS), store.records(body + "\t"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms too rare or too common, from the whole of both fields."""
    return _all_counts(spark, d).where("verdict is not null").select("field_name", "term", "verdict")


def p6_term_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its occurrences, its articles and its verdict ('' when it is of use)."""
    return _all_counts(spark, d).select("field_name", "term", "occurrences", "records", F.coalesce("verdict", F.lit("")).alias("verdict"))


_SQL = r"""
WITH n AS (SELECT count(DISTINCT article_id) AS n FROM article_text),
t AS (
  SELECT 'article_text.body_text' AS field_name, article_id, lower(u.term) AS term
  FROM article_text, unnest(regexp_extract_all(body_text, '\p{L}+')) AS u(term)
  UNION ALL
  SELECT 'article_metadata.keywords', article_id, lower(trim(regexp_replace(u.k, '[ \t\x{00a0}]+', ' ', 'g'), ' '))
  FROM article_metadata, unnest(keywords) AS u(k)
),
c AS (
  SELECT field_name, term, count(*)::BIGINT AS occurrences, count(DISTINCT article_id)::BIGINT AS records
  FROM t WHERE term <> '' GROUP BY ALL
),
v AS (
  SELECT c.*, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.1 * n.n THEN 'common' ELSE '' END AS verdict FROM c, n
)
"""
SQL = {
    "p6_found": _SQL + "SELECT field_name, term, verdict FROM v WHERE verdict <> ''",
    "p6_term_counts": _SQL + "SELECT field_name, term, occurrences, records, verdict FROM v",
}
QUERIES = {"p6_found": p6_found, "p6_term_counts": p6_term_counts}
