"""Problem 3: author rows that spell one person.

1. *Reading.*  Letters are brought to one alphabet (look-alikes, the usual transliterations), the
   parts of a name to their roles, whatever field and order they stand in, and short forms of
   given names to the full one.  Rows with the same reading are one *form* from here on.
2. *Pigeonhole segment join* on distinct surnames with their first initial: a surname within k edits
   keeps one of its k + 1 segments, at a place shifted by at most k.  The segments are an inverted
   index, the substrings of a surname at those places are looked up in it; a banded edit distance
   verifies.  k is 2 for surnames of ``LONG`` letters or more, else 1; with k = 1 surnames with the
   two letters at a cut swapped are looked up too, so that swaps count as one edit.  Two edits, or
   one in a surname of four letters or fewer, ask for equal given and middle names besides.
3. *Persons.*  Forms with full given name and middle name that agree are joined to components;
   forms without the middle name, then forms with initials only, join the one component they agree
   with.  A form that agrees with several persons stays apart, so that it can't join them.  Forms
   are compared within surname, initial and middle initial (or the lack of one), so that a surname
   that very many bear isn't paired with itself as a whole.

Nulls and edges: NULL and '' parts are missing parts; rows without any surname have no pairs;
repeated rows of one id are one row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlex.session import ship_package, stage_table, table

#: A given name stands with so many surnames, and in one of so many rows (so there are no more of them).
GIVEN_SURNAMES, GIVEN_SHARE = 4, 20_000
#: Surnames from this length on may differ by two edits.
LONG = 7
#: A name with less than one row to so many of a name one edit away is a misspelling of that one.
GIVEN_RATIO = 8

#: Look-alike Latin letters in words with Cyrillic ones.
_LOOKS = str.maketrans("aceopxyktmhbi", "асеорхуктмнви")
#: Latin spellings of Cyrillic letters, longest first, then single letters.
_MANY = (("shch", "щ"), ("sch", "щ"), ("sh", "ш"), ("ch", "ч"), ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("tz", "ц"), ("yu", "ю"), ("iu", "ю"), ("ju", "ю"), ("ya", "я"), ("ia", "я"), ("ja", "я"), ("yo", "е"), ("jo", "е"), ("ye", "е"), ("je", "е"))
_ONE = str.maketrans({**dict(zip("abcdefghijklmnopqrstuvwyz", "абцдефгхииклмнопкрстуввиз")), "x": "кс"})
_SAME = str.maketrans({"ё": "е", "й": "и", "ы": "и", "э": "е", "і": "и", "ї": "и", "є": "е", "ґ": "г", "ь": "", "ъ": ""})
#: Full given names and their usual short forms.
SHORT_FORMS = """
александр саша шура саня; александра саша шура; алексей леша алеша; анастасия настя; андрей андрюша; анна аня нюра; антон тоша; богдан бодя; борис боря; вадим вадик; валентина валя; валерий валера;
василий вася; вера верочка; виктор витя; виктория вика; виталий виталик; владимир вова володя; вячеслав слава; галина галя; геннадий гена; георгий гоша жора; григорий гриша; дарья даша; денис дениска;
дмитрий дима митя; евгений женя; евгения женя; екатерина катя; елена лена; жанна жанночка; зоя зоечка; иван ваня; игорь гарик; илья илюша; инна инночка; ирина ира; константин костя; кирилл кирюша; ксения ксюша;
лариса лара; любовь люба; людмила люда мила; максим макс; маргарита рита; марина маша мариша; мария маша; михаил миша; надежда надя; наталья наташа ната; николай коля; нина нинуля; оксана ксюша; олег олежка; ольга оля; павел паша;
петр петя; полина поля; роман рома; римма римуля; сергей сережа; светлана света; степан степа; тамара тома; татьяна таня; тимофей тима; ульяна уля; федор федя; эдуард эдик; юлия юля; юрий юра; яков яша; яна яночка;
alexander alex sandy; andrew drew andy; anthony tony; catherine kate cathy; charles charlie chuck; christopher chris; daniel dan danny; edward ed ned ted eddie; elizabeth liz beth betty; frederick fred; harriet hattie; helen nell;
henry harry hank; james jim jimmy; john jack johnny; joseph joe; katherine kate kathy kitty; margaret peggy meg maggie; mary molly polly; matthew matt; michael mike mick; nicholas nick; olivia liv livvy; patricia pat patty; peter pete; richard dick rick rich;
robert bob rob bobby; samuel sam; sarah sally; stephen steve; susan sue; thomas tom tommy; victoria vicky; virginia ginny; walter walt; william bill will billy
"""

_PATRONYMIC = re.compile(r"(?:ович|евич|ич|овна|евна|ична)$")
_SPLIT = re.compile(r"[\s.,]+")
#: Key of forms without a middle name.
NONE = "-"


def code(text: str | None) -> str:
    """One spelling of a word: Cyrillic letters without those that transliterations confuse."""
    s = "".join(c for c in (text or "").lower() if c.isalpha())
    if any("Ѐ" <= c <= "ӿ" for c in s):
        s = s.translate(_LOOKS)
    else:
        for a, b in _MANY:
            s = s.replace(a, b)
        s = s.translate(_ONE)
    s = s.translate(_SAME)
    return s.replace("кс", "х").replace("ияо", "яо").replace("ия", "я").replace("ии", "и").replace("ии", "и")


def _short_forms() -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for group in SHORT_FORMS.replace("\n", " ").split(";"):
        full, *short = (code(w) for w in group.split())
        for s in (full, *short):
            out.setdefault(s, set()).add(full)
    return {k: frozenset(v) for k, v in out.items()}


FULL_OF = _short_forms()
#: Latin first letters, so that an initial and a full name of either alphabet meet.
_FIRST = {"ч": "ц", "ш": "с", "щ": "с", "ж": "з", "ю": "и", "я": "и"}


def initials(given: str) -> frozenset[str]:
    """Classes of the first letters of a given name's full forms, or of its own."""
    return frozenset(_FIRST.get(f[:1], f[:1]) for f in FULL_OF.get(given, (given,)) if f)


def near(a: str, b: str) -> bool:
    """At most one edit apart, a swap of neighbours counting as one (a band of width one)."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def words_of(field: str | None) -> list[str]:
    """Codes of a field's words; hyphenated words are one."""
    return [c for w in _SPLIT.split(field or "") if (c := code(w))]


def read(last: str | None, first: str | None, middle: str | None, given_names) -> tuple[str, str, str]:
    """(surname, given name or initial, middle name or initial) as codes."""
    fields = [[(w, f) for x in _SPLIT.split(t or "") if (w := code(x))] for f, t in enumerate((last, first, middle))]
    every = [w for f in fields for w in f]
    raw = [x for t in (last, first, middle) for x in _SPLIT.split(t or "") if code(x)]
    short = [len([c for c in x if c.isalpha()]) <= 2 or len(w) == 1 for x, (w, _) in zip(raw, every)]
    letters = [w for (w, _), s in zip(every, short) if s]
    names = [x for x, s in zip(every, short) if not s]
    known = lambda w: w in given_names or w in FULL_OF
    patronymic = ""
    if len(names) > 1:
        found = [x for x in names if _PATRONYMIC.search(x[0]) and len(x[0]) > 5]
        if found and (len(found) < len(names)):
            patronymic = found[-1][0]
            names.remove(found[-1])
    surname = given = ""
    if len(names) == 1:
        surname = names[0][0]
        if letters == [] and patronymic and known(surname):
            surname, given = "", surname
    elif len(names) >= 2:
        givens = [x for x in names if known(x[0])]
        if not givens:
            givens = [x for x in names if len(x[0]) > 3 and any(near(x[0], g) for g in given_names)]
        if len(givens) == 1:
            pick = givens[0]
        else:
            pick = next((x for x in names if x[1] == 1), names[1])
        given = pick[0]
        rest = [x for x in names if x is not pick]
        surname = "".join(x[0] for x in rest if x[1] != 2) or rest[0][0]
        if not patronymic:
            patronymic = next((x[0] for x in rest if x[1] == 2 and x[0] != surname), "")
    if not given and letters:
        given, letters = letters[0], letters[1:]
    if not patronymic and letters:
        patronymic = letters[0]
    return surname, given, patronymic


def is_full(part: str) -> bool:
    return len(part) > 2 or part in FULL_OF


def edits(a: str, b: str, most: int) -> int:
    """Edit distance where it is at most ``most``, else ``most`` + 1 (banded)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        row = new
    return min(row[-1], most + 1)


def reach(surname: str) -> int:
    """k of a surname."""
    return 2 if len(surname) >= LONG else 1


def close(a: str, b: str) -> bool:
    """Whether two surnames are within the reach of both."""
    return near(a, b) or min(reach(a), reach(b)) > 1 and edits(a, b, 2) <= 2


def given_agree(a: str, b: str, given_names, sure: bool = False) -> bool:
    """Whether two given names can be one; ``sure`` when the rest of the name is the same in full."""
    if not a or not b:
        return True
    if not is_full(a) or not is_full(b):
        return bool(initials(a) & initials(b))
    if a == b:
        return True
    fa, fb = FULL_OF.get(a), FULL_OF.get(b)
    if fa and fb:
        return bool(fa & fb)
    known_a, known_b = a in given_names or fa, b in given_names or fb
    if known_a and known_b:
        return False
    if sure and min(len(a), len(b)) > 5 and edits(a, b, 2) <= 2:
        return True
    return near(a, b) or any(near(x, b) for x in fa or ()) or any(near(a, x) for x in fb or ())


def middle_agree(a: str, b: str) -> bool:
    if not a or not b:
        return True
    if len(a) <= 2 or len(b) <= 2:
        return _FIRST.get(a[:1], a[:1]) == _FIRST.get(b[:1], b[:1])
    return near(a, b)


def same_given(a: str, b: str) -> bool:
    return is_full(a) and is_full(b) and (a == b or bool(FULL_OF.get(a, frozenset()) & FULL_OF.get(b, frozenset())))


def agree(a: tuple[str, str, str], b: tuple[str, str, str], given_names) -> bool:
    """Whether two forms can be one person's."""
    if a[0] != b[0]:
        plain = min(len(a[0]), len(b[0])) > 4 and near(a[0], b[0])
        if not plain and not (close(a[0], b[0]) and same_given(a[1], b[1]) and a[2] and b[2] and middle_agree(a[2], b[2])):
            return False
    if (a[0] == b[0] + "а" or b[0] == a[0] + "а") and not (is_full(a[1]) and a[1] == b[1]):
        return False  # the surnames of a man and a woman
    changed = (a[0] != b[0]) + (is_full(a[1]) and is_full(b[1]) and a[1] != b[1] and not same_given(a[1], b[1])) + (len(a[2]) > 2 and len(b[2]) > 2 and a[2] != b[2])
    sure = a[0] == b[0] and a[2] == b[2] and bool(a[2])
    return changed <= 2 and given_agree(a[1], b[1], given_names, sure) and middle_agree(a[2], b[2])


# ------------------------------------------------------------------ Spark


def _map(df: DataFrame, schema: str, fn) -> DataFrame:
    """``fn(row tuple) -> iterable of tuples`` over Arrow batches."""
    ship_package(df.sparkSession)
    names = [c.strip().split()[0] for c in schema.split(",")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}
    types = [kinds[c.strip().split()[1]] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for x in zip(*(c.to_pylist() for c in b.columns)) for r in fn(x)]
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)

    return df.mapInArrow(run, schema)


def without_misspelt(rows: dict[str, int]) -> frozenset[str]:
    """The names that aren't rare beside a name one edit away, by their rows; listed names stay."""
    index: dict[tuple[int, int, str], list[str]] = {}
    for g in rows:
        for i, t in segments(g):
            index.setdefault((len(g), i, t), []).append(g)

    def rare(g: str) -> bool:
        return any(rows[o] > GIVEN_RATIO * rows[g] and near(g, o) for p in probes(g) for o in index.get(p, ()))

    return frozenset(g for g in rows if g in FULL_OF or not rare(g))


def given_lexicon(authors: DataFrame) -> frozenset[str]:
    """First names that stand with several surnames, by the codes of plainly filled fields.

    With the rows of a table the surnames of a misspelt name grow as well, so names are held against
    their neighbours' rows, a ratio that stays the same.
    """

    def plain(r):
        last, first = words_of(r[1]), words_of(r[2])
        if len(last) == 1 and len(first) == 1 and len(first[0]) > 2 and len(last[0]) > 2:
            yield first[0], last[0]

    rows = _map(authors.select("author_id", "last_name", "first_name").distinct(), "given string, surname string", plain).groupBy("given", "surname").agg(F.count(F.lit(1)).alias("n"))
    by_name = rows.groupBy("given").agg(F.count(F.lit(1)).alias("surnames"), F.sum("n").alias("n"))
    total = by_name.agg(F.sum("n")).collect()[0][0] or 0
    often = by_name.where((F.col("surnames") >= GIVEN_SURNAMES) & (GIVEN_SHARE * F.col("n") >= total))
    return without_misspelt({r["given"]: r["n"] for r in often.collect()})  # at most GIVEN_SHARE names


def segments(surname: str, k: int = 1) -> list[tuple[int, str]]:
    """The k + 1 segments of a surname, for the index."""
    n = len(surname)
    return [(i, surname[n * i // (k + 1) : n * (i + 1) // (k + 1)]) for i in range(k + 1)]


def probes(surname: str, k: int = 1) -> list[tuple[int, int, str]]:
    """(length, segment number, substring) where a surname within k edits may have a segment.

    For every length in reach, segment i stands shifted by no more edits than fit before it, and the
    rest by no more than fit behind it.  With k = 1 the two letters at the cut are tried swapped.
    """
    out = set()
    n, cut = len(surname), len(surname) // 2
    swapped = surname[: cut - 1] + surname[cut] + surname[cut - 1] + surname[cut + 1 :] if k == 1 and 0 < cut < n else surname
    for s in {surname, swapped}:
        for m in range(max(1, n - k), n + k + 1):
            for i in range(k + 1):
                x, y = m * i // (k + 1), m * (i + 1) // (k + 1)
                for shift in range(max(-i, n - m - (k - i)), min(i, n - m + (k - i)) + 1):
                    if x + shift >= 0 and y + shift <= n and y > x:
                        out.add((m, i, s[x + shift : y + shift]))
    return sorted(out)


def surname_pairs(forms: DataFrame) -> DataFrame:
    """Pairs (a, b, initial) of different surnames within the reach of both that share an initial.

    Two edits count only beside equal given and middle names, so with k = 2 surnames are looked up among
    those of their middle initial (``second``) as well.
    """
    keys = stage_table(forms.where("surname <> '' and initial <> '' and length(surname) > 2").select("surname", "initial", "second").distinct(), "surnames")
    block = F.when(F.col("k") == 1, F.col("initial")).otherwise(F.concat_ws("|", "initial", "second"))
    blocks = keys.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).where(f"k = 1 or (length(surname) >= {LONG} and second <> '{NONE}')").select("surname", block.alias("block"), "initial", "k").distinct()
    shape = "block string, initial string, k int, n int, part int, text string"
    index = _map(blocks, "a string, " + shape, lambda r: [(*r[:4], len(r[0]), i, t) for i, t in segments(r[0], r[3])])
    probe = _map(blocks, "b string, " + shape, lambda r: [(*r[:4], n, i, t) for n, i, t in probes(r[0], r[3])]).drop("initial")
    found = probe.join(index, ["block", "k", "n", "part", "text"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "initial").distinct()
    return _map(found, "a string, b string, initial string", lambda r: [r] if close(r[0], r[1]) else [])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(form, person) with the least form of every component, by star contraction.

    ``edges`` (a, b) may come in either direction.  Every round hangs each node on the least of its
    neighbours; rounds grow with the logarithm of the longest path.
    """
    e = stage_table(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: neighbours above a node hang on its least neighbour
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        # small star: a node and its lower neighbours hang on the least of them
        small = down.join(low, "a")
        new = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = stage_table(new, "edges")
        if new.count() == e.count() and new.exceptAll(e).isEmpty():
            break
        e = new
    return nodes.join(e.select(F.col("a").alias("form"), F.col("b").alias("root")), "form", "left").select("form", F.coalesce("root", "form").alias("person"))


def persons(authors: DataFrame) -> DataFrame:
    """(author_id, person) of every row with a surname; ``person`` is the id of a form."""
    authors = authors.select("author_id", "last_name", "first_name", "middle_name").where("author_id is not null")
    given_names = given_lexicon(authors)

    def parse(r):
        s, g, m = read(r[1], r[2], r[3], given_names)
        yield r[0], s, g, m, "".join(sorted(initials(g))), _FIRST.get(m[:1], m[:1]) or NONE

    rows = stage_table(_map(authors, "author_id bigint, surname string, given string, middle string, initials string, second string", parse), "names")
    level = F.when((F.length("given") > 2) & (F.col("middle") != ""), 3).when(F.length("given") > 2, 2).otherwise(1)
    key = F.concat_ws("|", "surname", "given", "middle")
    forms = stage_table(rows.where("surname <> ''").select(key.alias("form"), "surname", "given", "middle", "initials", "second", level.alias("level")).distinct(), "forms")
    keyed = forms.withColumn("initial", F.explode(F.split("initials", ""))).drop("initials")  # a short form may stand for names of two initials

    pairs = stage_table(surname_pairs(keyed), "pairs")
    same = keyed.select(F.col("surname").alias("a"), F.col("surname").alias("b"), "initial").distinct()
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "initial")).unionByName(same)
    side = lambda x: keyed.select(*(F.col(c).alias(f"{x}_{c}") for c in ("form", "surname", "given", "middle", "second", "level")), F.col("initial"))
    # a form with a middle name meets those with its initial and those without one; two of a kind meet once
    other = side("y").withColumnRenamed("y_surname", "b").withColumn("second", F.explode(F.array_distinct(F.array("y_second", F.lit(NONE)))))
    near_by = (
        side("x").withColumnRenamed("x_surname", "a").withColumn("second", F.col("x_second")).join(links, ["a", "initial"])
        .join(other, ["b", "initial", "second"]).where((F.col("x_form") < F.col("y_form")) | (F.col("x_second") == NONE) & (F.col("y_second") != NONE))
    )
    agreed = _map(
        near_by.select("x_form", "y_form", "a", "x_given", "x_middle", "b", "y_given", "y_middle", "x_level", "y_level"),
        "a string, b string, a_level int, b_level int",
        lambda r: [(r[0], r[1], r[8], r[9])] if agree((r[2], r[3], r[4]), (r[5], r[6], r[7]), given_names) else [],
    )
    agreed = stage_table(agreed.distinct(), "agreed")

    person = stage_table(components(forms.where("level = 3").select("form"), agreed.where("a_level = 3 and b_level = 3")), "persons")
    for lower in (2, 1):
        # forms that lack a part join the one person they agree with, or else each other
        mixed = agreed.where((F.greatest("a_level", "b_level") > lower) & (F.least("a_level", "b_level") == lower))
        up = mixed.select(F.when(F.col("a_level") == lower, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(F.col("a_level") == lower, F.col("b")).otherwise(F.col("a")).alias("form"))
        votes = up.join(person, "form").groupBy("low").agg(F.countDistinct("person").alias("n"), F.min("person").alias("person"))
        own = forms.where(F.col("level") == lower).select("form")
        joined = own.join(votes, own["form"] == votes["low"], "left").select("form", "n", "person")
        alone = joined.where("n is null").select("form")
        peers = agreed.where((F.col("a_level") == lower) & (F.col("b_level") == lower))
        free = peers.join(alone, peers["a"] == alone["form"], "left_semi").join(alone, peers["b"] == alone["form"], "left_semi")
        apart = components(alone, free)
        unsure = joined.where("n > 1").select("form", F.col("form").alias("person"))
        person = stage_table(person.unionByName(joined.where("n = 1").select("form", "person")).unionByName(apart).unionByName(unsure), "persons")

    # forms without a given name join the only person of their surname
    bare = forms.where("given = ''").select("form", "surname")
    known = forms.where("given <> ''").select("form", "surname").join(person, "form").groupBy("surname").agg(F.countDistinct("person").alias("n"), F.min("person").alias("only"))
    moved = bare.join(known.where("n = 1"), "surname").select(F.col("form").alias("bare"), "only")
    person = person.join(moved, person["form"] == moved["bare"], "left").select("form", F.coalesce("only", "person").alias("person"))
    return rows.where("surname <> ''").withColumn("form", key).join(person, "form").select("author_id", "person").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of author rows of one person."""
    of = persons(table(spark, d, "author"))
    of = stage_table(of, "of")
    return of.select(F.col("author_id").alias("author_id_a"), "person").join(of.select(F.col("author_id").alias("author_id_b"), "person"), "person").where("author_id_a < author_id_b").select("author_id_a", "author_id_b")


def p3_persons(spark: SparkSession, d: str) -> DataFrame:
    """Every author row with the least row of its person and the number of the person's rows."""
    of = stage_table(persons(table(spark, d, "author")), "of")
    sizes = of.groupBy("person").agg(F.min("author_id").alias("person_id"), F.count(F.lit(1)).alias("spellings"))
    return of.join(sizes, "person").select("author_id", "person_id", "spellings")


SQL: dict[str, str] = {}
QUERIES = {"p3_found": p3_found, "p3_persons": p3_persons}
