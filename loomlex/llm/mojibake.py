"""Problem 2: text decoded in a wrong encoding, found and restored by expectation-maximisation.

Every token of a value has a hidden *chain*: clean, or a way it may have been damaged (bytes of
encoding T read as encoding W, once or twice).  A chain explains a token by the character model's
probability of the token after undoing the chain.  The share of each chain is latent per group
(field and source): the E-step gives each suspect token the posterior of the chains under its
group's shares, the M-step adds these up over all records of the group, so weak evidence in one
record leans on what the group's other records show.  Each record is then repaired by posterior,
neighbouring tokens of one chain as one stretch.

*Word list and character model* come from the counts of every token of every value, read whole.  A
damaged word that recurs is told from a clean one by the counts: it decodes to a word that is
``RATIO`` times as frequent; a join of the words with what they decode to finds them.  The character
model is counted over every clean token where the tokens lie; the driver gets the sums by trigram, as
many as the alphabets have.  Every clean word that stands three times is known: the ``LEXICON`` most
frequent ones are held in memory, with more than that all are in a file that the workers look up.

*Short words.*  Among two or three letters nearly every pair of encodings turns some word into
another one.  A token of ordinary looks that is short or decodes to no known word, and one whose
decoding has odd case, therefore count only in a record whose other tokens show the same chain.

Letters lost in decoding can't be restored: replacement characters, and question marks in the
place of letters, mark a value as affected and stay as they are.

Nulls and edges: NULL, empty and plain ASCII values are never affected (but for lost letters);
tokens of any length are read; repeated rows give one result; empty tables give no rows; other
columns are ignored; of more than ``GROUPS`` groups the smaller ones share the shares of their field.
"""

from __future__ import annotations

import atexit
import math
import os
import re
import shutil
import sqlite3
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator, Set
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlex.session import ship_package, spread, stage_table, table

ROUNDS = 3
#: Known words that are held in memory, the most frequent ones; further ones are looked up in a file.
LEXICON = 60_000
#: A word that decodes to a word so many times as frequent is a damaged one.
RATIO = 3
CACHE = 300_000
#: Counts that a task holds before it hands them on.
FLUSH = 100_000
#: Groups with shares of their own; the evidence of further ones goes to a common group of their field.
GROUPS = 500

_TOKEN = re.compile(r"[^ \t\r\n]+")
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Letters of Russian, Ukrainian, English, German and French, and marks around them.
_PLAIN = re.compile(r"[A-Za-zА-Яа-яЁёІіЇїЄєҐґÀÂÄÆÇÉÈÊËÎÏÔÖŒÙÛÜŸàâäæçéèêëîïôöœùûüÿß0-9'’.,:;%/§№°±()«»+-]*")
_EDGE = "\"'.,;:!?()[]{}<>«»“”„…*|/\\—–-"
_MARKS = frozenset(_EDGE)
_LOST_LETTER = re.compile(r"\?(?=[^\W\d_])|^[^\w?]*\?{2,}[^\w?]*$|(?<=[^\W\d_])\?+(?=[^\W\d_])|\?{2,}[-/]\?|-\?{2,}")
_ODD_MARK = re.compile(r"�|\?[\w?/-]|(?<![^\W_])\?")
_LINKLIKE = re.compile(r"://|www\.|[?&]\w+=")

#: Chains of (encoding that misread, encoding that was meant), innermost last.
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    (("cp1251", "utf-8"),),
    (("cp1252", "utf-8"),),
    (("cp866", "utf-8"),),
    (("koi8-r", "utf-8"),),
    (("cp437", "utf-8"),),
    (("cp1251", "utf-8"), ("cp1251", "utf-8")),
    (("cp1252", "utf-8"), ("cp1252", "utf-8")),
    (("cp1251", "utf-8"), ("cp1252", "utf-8")),
    (("cp1252", "utf-8"), ("cp1251", "utf-8")),
    (("cp1252", "cp1251"),),
    (("koi8-r", "cp1251"),),
    (("cp866", "cp1251"),),
    (("cp1251", "koi8-r"),),
    (("cp1252", "koi8-r"),),
    (("cp866", "koi8-r"),),
    (("cp1251", "cp866"),),
    (("cp1252", "cp866"),),
    (("koi8-r", "cp866"),),
    (("cp1251", "cp1252"),),
    (("cp866", "cp1252"),),
    (("koi8-r", "cp1252"),),
    (("cp1251", "iso8859-5"),),
    (("iso8859-5", "cp1251"),),
    (("cp1252", "iso8859-5"),),
    (("mac-cyrillic", "cp1251"),),
    (("cp1251", "mac-cyrillic"),),
)
CLEAN, LOST = -1, -2
_OUTER = sorted({steps[0][0] for steps in CHAINS})


@lru_cache(maxsize=None)
def _bytes_of(encoding: str) -> dict[str, int]:
    """Character -> byte; bytes that the encoding leaves open stand for the control of that number."""
    out: dict[str, int] = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 160):
        out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=None)
def _chars_of(encoding: str) -> list[str]:
    by = {b: c for c, b in reversed(_bytes_of(encoding).items())}
    return [by.get(b, chr(b)) for b in range(256)]


def raw_of(wrong: str, text: str) -> bytes | None:
    """The bytes that ``wrong`` shows as ``text``."""
    try:
        return bytes(map(_bytes_of(wrong).__getitem__, text))
    except KeyError:
        return None


def read_raw(chain: int, raw: bytes | None) -> str | None:
    """The text before the damage, from the bytes of the outermost encoding."""
    for n, (wrong, meant) in enumerate(CHAINS[chain]):
        if n:
            raw = raw_of(wrong, text)
        if raw is None:
            return None
        try:
            text = raw.decode("utf-8") if meant == "utf-8" else "".join(map(_chars_of(meant).__getitem__, raw))
        except UnicodeDecodeError:
            return None
    return text


def undo(chain: int, text: str) -> str | None:
    """The text before the damage, or None where this chain can't have made it."""
    return read_raw(chain, raw_of(CHAINS[chain][0][0], text))


def damage(chain: int, text: str) -> str:
    """The other way round, for tests; raises where an encoding lacks a character."""
    for wrong, meant in reversed(CHAINS[chain]):
        text = "".join(map(_chars_of(wrong).__getitem__, text.encode(meant)))
    return text


def tokens_of(text: str) -> list[str]:
    """Runs without blank, tab or line end; other white space may be a damaged letter's second half."""
    return _TOKEN.findall(text) if _ODD_SPACE.search(text) else text.split()


@lru_cache(maxsize=2)
def _connection(file: str, pid: int) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{SparkFiles.get(file)}?mode=ro&immutable=1", uri=True, check_same_thread=False)


class Words(Set):
    """Any number of words: ``often`` in memory, all of them in a file that Spark brings to every worker."""

    def __init__(self, often: frozenset[str], file: str) -> None:
        self.often, self.file = often, file

    @classmethod
    def of(cls, words: DataFrame, often: frozenset[str]) -> Words:
        """All of ``words``, which pass through the driver one partition at a time."""
        folder = tempfile.mkdtemp(prefix="loomlex-words-")
        atexit.register(shutil.rmtree, folder, True)
        file = f"{uuid.uuid4().hex}.sqlite"
        db = sqlite3.connect(os.path.join(folder, file))
        db.execute("create table words (word blob primary key) without rowid")
        db.executemany("insert into words values (?)", ((r[0].encode(),) for r in words.toLocalIterator()))
        db.commit()
        db.close()
        words.sparkSession.sparkContext.addFile(os.path.join(folder, file))
        return cls(often, file)

    @classmethod
    def _from_iterable(cls, it) -> frozenset:
        return frozenset(it)

    def _ask(self, sql: str, *args):
        return _connection(self.file, os.getpid()).execute(sql, args)

    def __contains__(self, word) -> bool:
        return word in self.often or self._ask("select 1 from words where word = ?", word.encode("utf-8", "surrogatepass")).fetchone() is not None

    def __iter__(self) -> Iterator[str]:
        return (r[0].decode() for r in self._ask("select word from words"))

    def __len__(self) -> int:
        return self._ask("select count(*) from words").fetchone()[0]


def trigrams(token: str) -> list[str]:
    """Trigrams of the lower-cased token, bounded by blanks."""
    s = f"  {token.lower()} "
    return [s[i - 2 : i + 1] for i in range(2, len(s))]


class CharModel:
    """Interpolated trigrams of lower-cased characters, tokens bounded by blanks; and the known words."""

    def __init__(self, three: dict[str, int], words: Set[str]) -> None:
        self.name = uuid.uuid4().hex
        two, one = Counter(), Counter()
        for k, n in three.items():
            two[k[1:]] += n
            one[k[2]] += n
        c2: Counter = Counter()
        for k, n in three.items():
            c2[k[:2]] += n
        c1: Counter = Counter()
        for k, n in two.items():
            c1[k[0]] += n
        total = sum(one.values()) + 1
        self.one = {c: math.log(0.02 * n / total + 1e-7) for c, n in one.items()}
        p1 = {c: n / total for c, n in one.items()}
        self.two = {k: math.log(0.2 * n / (c1[k[0]] + 4) + 0.02 * p1[k[1]] + 1e-7) for k, n in two.items()}
        p2 = {k: n / (c1[k[0]] + 4) for k, n in two.items()}
        self.three = {k: math.log(0.78 * n / (c2[k[:2]] + 2) + 0.2 * p2[k[1:]] + 0.02 * p1[k[2]] + 1e-7) for k, n in three.items()}
        self.words = words

    def log(self, token: str) -> float:
        s = f"  {token.lower()} "
        three, two, one = self.three, self.two, self.one
        out = 0.0
        for i in range(2, len(s)):
            p = three.get(s[i - 2 : i + 1])
            if p is None:
                p = two.get(s[i - 1 : i + 1])
                if p is None:
                    p = one.get(s[i], -16.1)
            out += p
        return out


#: A run of letters that mixes Latin and Cyrillic, or a letter of another script.
_MIXED = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ɏ](?=[Ѐ-ӿ])(?=[^\\W\\d_])|[Ѐ-ӿ](?<=[^\\W\\d_])(?=[A-Za-zªµºÀ-ÖØ-öø-ɏ])|[^\\W\\d_\\x00-ɏЀ-ӿ]")


def one_script(text: str) -> bool:
    """No run of letters mixes Latin and Cyrillic, and no letter is of another script."""
    return not _MIXED.search(text)


class Explainer(dict):
    """Token -> ((gain, chain, restored), ...) of the chains that explain it better than clean text
    does; an empty tuple for a token that is surely clean.  Gains are in nats, without priors."""

    #: A token at least this likely by character needs no second look.
    GOOD = -2.6
    #: Most gain of an explanation that can't stand alone.
    WEAK = 2.0

    def __init__(self, model: CharModel) -> None:
        self.model = model

    def __missing__(self, token: str) -> tuple:
        if len(self) > CACHE:
            self.clear()
        self[token] = found = self._explain(token)
        return found

    def _explain(self, token: str) -> tuple:
        m = self.model
        if token.isascii() or token.lower().strip(_EDGE) in m.words:
            return ()
        if token[-1] in "¬\xad‐" and usual(token[:-1]):  # a word cut at the end of a line
            return ()
        own = m.log(token)
        if own / (len(token) + 1) > self.GOOD:
            return ()
        plain, mean_own = ordinary(token), own / (len(token) + 1)
        raws = {wrong: raw_of(wrong, token) for wrong in _OUTER}  # chains that begin alike share the bytes
        out = []
        for c, steps in enumerate(CHAINS):
            fixed = read_raw(c, raws[steps[0][0]])
            if not fixed or fixed == token:
                continue
            core = fixed.strip(_EDGE)
            known = core.lower() in m.words or not core and set(fixed) <= _MARKS
            one_byte = steps[-1][1] != "utf-8"
            # one byte for one byte: most strings decode, so the result must look like words
            if one_byte and not known and len(core) < 5 or not fixed.isprintable() or not one_script(fixed):
                continue
            new = m.log(fixed)
            mean = new / (len(fixed) + 1)
            weak = False
            if one_byte:
                if not known and (mean < -2.9 or mean_own > mean - 1.5):
                    continue
                weak = plain and (len(core) < 4 or not known) or not usual(core) and not (core.isupper() and token.isupper())
            elif not known and core and mean < -4.5 and len(fixed) * 2 > len(token) + 2:
                continue
            gain = new - own + (3.0 if known else 0.0)
            if weak:
                gain = min(gain, self.WEAK)
            if gain > 0 and all(fixed != x for _, _, x in out):  # chains that agree here count as the first
                out.append((gain, c, fixed))
        out.sort(reverse=True)
        return tuple(out[:4])


_KEPT: dict[str, Explainer] = {}


def explainer(model: CharModel) -> Explainer:
    """The worker process's explainer for ``model``: what one task found out serves the next."""
    if model.name not in _KEPT:
        _KEPT.clear()
        _KEPT[model.name] = Explainer(model)
    return _KEPT[model.name]


class Shares:
    """Log shares of the chains for each group."""

    def __init__(self, by_group: dict[str, list[float]] | None = None) -> None:
        k = len(CHAINS)
        self.start = [math.log(0.97)] + [math.log(0.03 / k)] * k
        self.by_group = by_group or {}

    def of(self, group: str) -> list[float]:
        return self.by_group.get(group) or self.by_group.get(group.partition("|")[0] + "|") or self.start

    def posterior(self, group: str, options: tuple) -> tuple[float, dict[int, float]]:
        """(posterior of clean, posterior of each chain)."""
        log = self.of(group)
        scores = {CLEAN: log[0]} | {c: log[1 + c] + g for g, c, _ in options}
        top = max(scores.values())
        weights = {c: math.exp(x - top) for c, x in scores.items()}
        total = sum(weights.values())
        return weights.pop(CLEAN) / total, {c: w / total for c, w in weights.items()}


def lost(tokens: list[str]) -> bool:
    """Whether letters were lost: replacement characters, or question marks where letters belong."""
    for i, t in enumerate(tokens):
        if "�" in t:
            return True
        if "?" not in t or _LINKLIKE.search(t):
            continue
        if _LOST_LETTER.search(t):
            return True
        # a lone mark before a word in small letters or a number stands for a dash or a sign
        if t == "?" and 0 < i < len(tokens) - 1 and (tokens[i + 1][0].islower() or tokens[i + 1][0].isdigit()):
            return True
    return False


class Repairer:
    """Finds and repairs damaged stretches of a value."""

    def __init__(self, model: CharModel, shares: Shares) -> None:
        self.explain, self.shares = explainer(model), shares

    def suspect(self, text: str) -> bool:
        if text.isascii():
            return bool(_ODD_MARK.search(text))
        if _ODD_MARK.search(text):
            return True
        explain = self.explain
        return any(explain[t] for t in set(tokens_of(text)))

    def chains(self, text: str, group: str) -> list[tuple[int, int, int]]:
        """(start, end, chain) of every damaged token, by posterior."""
        out = []
        spans = [(m.start(), m.end(), self.explain[m.group()]) for m in _TOKEN.finditer(text)]
        seen: Counter = Counter()
        for a, b, options in spans:
            if options:
                clean, by = self.shares.posterior(group, options)
                c = max(by, key=by.get)
                if by[c] > 0.9:
                    out.append((a, b, c))
                    seen[c] += b - a
        if not seen:
            return []
        done = {a for a, _, _ in out}
        for a, b, options in spans:  # the record's own evidence raises its chains
            if a not in done and (own := [(g, c) for g, c, _ in options if c in seen and g > 1.0]):
                out.append((a, b, max(own)[1]))
        return sorted(out)

    def repair(self, text: str, group: str) -> tuple[bool, str]:
        """(affected, text with damaged stretches restored)."""
        if not text or not self.suspect(text):
            return False, text
        gone = lost(tokens_of(text))
        found = self.chains(text, group)
        if not found:
            return gone, text
        out, at, i = [], 0, 0
        while i < len(found):
            a, b, c = found[i]
            j = i + 1
            while j < len(found) and found[j][2] == c and found[j][0] - b < 12 and undo(c, text[a : found[j][1]]):
                b = found[j][1]
                j += 1
            out += [text[at:a], undo(c, text[a:b]) or text[a:b]]
            at, i = b, j
        return True, "".join([*out, text[at:]])


def usual(token: str) -> bool:
    """Looks like a word of the alphabets at hand: one script, ordinary case, few accents."""
    core = token.strip(_EDGE)
    if not _PLAIN.fullmatch(core):
        return False
    if core.isascii():
        return True
    if not one_script(core) or not (core[1:].islower() or not core[1:]):
        return False
    return core[0] > "ɐ" or 2 * sum(c > "\x7f" for c in core) <= len(core)


def ordinary(token: str) -> bool:
    """A word in small letters, with a capital, or an acronym, of one script and without odd signs."""
    core = token.strip(_EDGE)
    return bool(_PLAIN.fullmatch(core)) and one_script(core) and (core.isupper() or core[1:].islower() or len(core) < 2)


def decodings(word: str) -> set[str]:
    """What ``word`` may have been before damage, of usual looks and not the same but for case."""
    out = {undo(c, word) for c in range(len(CHAINS))}
    return {f for f in out if f and f.lower() != word.lower() and usual(f)}


def _values(spark: SparkSession, d: str) -> DataFrame:
    """Both fields as (field_name, record_id, source, value)."""
    a = table(spark, d, "user_activity").select(F.lit("user_activity.title").alias("field_name"), F.col("activity_id").alias("record_id"), F.col("activity_type").alias("source"), F.col("title").alias("value"))
    b = table(spark, d, "article_text").select(F.lit("article_text.body_text").alias("field_name"), F.col("text_id").alias("record_id"), F.year("created_at").cast("string").alias("source"), F.col("body_text").alias("value"))
    return a.unionByName(b)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def group_of(field: str, source: str | None) -> str:
    return f"{field}|{source or ''}"


def token_counts(values: DataFrame) -> DataFrame:
    """(grp, token, n) over all values, staged; counted where the values lie before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("grp", pa.string()), ("token", pa.string()), ("n", pa.int64())])
        by: dict[str, Counter] = {}
        for b in batches:
            for field, source, text in zip(*(b.column(c).to_pylist() for c in ("field_name", "source", "value")), strict=True):
                if text:
                    by.setdefault(group_of(field, source), Counter()).update(tokens_of(text))
            if sum(map(len, by.values())) > FLUSH:
                yield _columns([(g, t, n) for g, c in by.items() for t, n in c.items()], schema)
                by.clear()
        yield _columns([(g, t, n) for g, c in by.items() for t, n in c.items()], schema)

    part = spread(values.select("field_name", "source", "value")).mapInArrow(count, "grp string, token string, n bigint")
    return stage_table(part.groupBy("grp", "token").agg(F.sum("n").alias("n")), "tokens")


def fit_model(counts: DataFrame) -> CharModel:
    """Known words and character model of the clean tokens among ``counts`` (token, n)."""

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("token", pa.string()), ("core", pa.string()), ("n", pa.int64())])
        for b in batches:
            pairs = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            yield _columns([(t, t.strip(_EDGE), n) for t, n in pairs if usual(t) or ordinary(t)], schema)

    def origins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("core", pa.string())])
        for b in batches:
            pairs = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            yield _columns([(w, n, f) for w, n in pairs if not w.isascii() for f in decodings(w)], schema)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gram", pa.string()), ("n", pa.int64())])
        sums: Counter = Counter()
        for b in batches:
            for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                weight = 1 + int(math.log2(n))  # types tell more than their repeats
                for g in trigrams(t):
                    sums[g] += weight
        yield _columns(list(sums.items()), schema)

    tokens = counts.groupBy("token").agg(F.sum("n").alias("n")).mapInArrow(cores, "token string, core string, n bigint")
    tokens = stage_table(tokens, "cores")
    words = stage_table(tokens.where("core <> ''").groupBy("core").agg(F.sum("n").alias("n")), "words")
    before = words.mapInArrow(origins, "word string, n bigint, core string")
    damaged = stage_table(before.join(words.withColumnRenamed("n", "m"), "core").where(F.col("m") > RATIO * F.col("n")).select(F.col("word").alias("core")).distinct(), "damaged")
    clean = words.join(damaged, "core", "left_anti").groupBy(F.lower("core").alias("word")).agg(F.sum("n").alias("n"))
    known = stage_table(clean.where((F.col("n") >= 3) & (F.length("word") > 1)), "known")
    often = frozenset(r["word"] for r in known.orderBy(F.desc("n"), "word").limit(LEXICON).collect())
    held = often if known.count() <= LEXICON else Words.of(known.select("word"), often)
    three = tokens.join(damaged, "core", "left_anti").select("token", "n").mapInArrow(grams, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return CharModel({r["gram"]: r["n"] for r in three.orderBy("gram").collect()}, held)  # letters of the alphabets and marks, to the third at most


def em_shares(counts: DataFrame, model: CharModel, rounds: int = ROUNDS) -> Shares:
    """Chain shares of each group from all its records, by their tokens (grp, token, n)."""
    spark = counts.sparkSession
    held = spark.sparkContext.broadcast(model)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("grp", pa.string()), ("token", pa.string()), ("n", pa.int64())])
        explain = explainer(held.value)
        for b in batches:
            rows, clean = [], Counter()
            for g, t, n in zip(*(b.column(c).to_pylist() for c in ("grp", "token", "n")), strict=True):
                if explain[t]:
                    rows.append((g, t, n))
                else:
                    clean[g] += n
            yield _columns(rows + [(g, "", n) for g, n in clean.items()], schema)

    ev = stage_table(counts.mapInArrow(suspects, "grp string, token string, n bigint").groupBy("grp", "token").agg(F.sum("n").alias("n")), "evidence")
    largest = [r[0] for r in ev.groupBy("grp").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "grp").limit(GROUPS).collect()]
    if len(largest) == GROUPS:
        ev = ev.withColumn("grp", F.when(F.col("grp").isin(largest), F.col("grp")).otherwise(F.concat(F.substring_index("grp", "|", 1), F.lit("|"))))
    shares = Shares()
    for _ in range(rounds):
        state = spark.sparkContext.broadcast(shares)

        def expect(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("grp", pa.string()), ("chain", pa.int32()), ("w", pa.float64())])
            explain, sums = explainer(held.value), {}
            for b in batches:
                for g, t, n in zip(*(b.column(c).to_pylist() for c in ("grp", "token", "n")), strict=True):
                    clean, by = state.value.posterior(g, explain[t] if t else ())
                    sums[g, CLEAN] = sums.get((g, CLEAN), 0.0) + n * clean
                    for c, w in by.items():
                        sums[g, c] = sums.get((g, c), 0.0) + n * w
            yield _columns([(g, c, w) for (g, c), w in sums.items()], schema)

        got = ev.mapInArrow(expect, "grp string, chain int, w double").groupBy("grp", "chain").agg(F.sum("w").alias("w"))
        by_group: dict[str, list[float]] = {}
        for r in got.collect():  # at most (GROUPS + fields) x (chains + 1)
            for g in {r["grp"], r["grp"].partition("|")[0] + "|"}:
                by_group.setdefault(g, [0.0] * (1 + len(CHAINS)))[1 + r["chain"]] += r["w"]
        shares = Shares({g: [math.log((x + (200.0 if i == 0 else 0.05)) / (sum(w) + 201.5)) for i, x in enumerate(w)] for g, w in by_group.items()})
    return shares


def repaired(values: DataFrame) -> DataFrame:
    """Affected values: field_name, record_id, original, restored."""
    ship_package(values.sparkSession)
    counts = token_counts(values)
    model = fit_model(counts)
    shares = em_shares(counts, model)
    held = values.sparkSession.sparkContext.broadcast((model, shares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = Repairer(*held.value)
        for b in batches:
            keep, fixed = [], []
            groups = zip(*(b.column(c).to_pylist() for c in ("field_name", "source", "value")), strict=True)
            for i, (field, source, text) in enumerate(groups):
                if text:
                    hit, new = fix.repair(text, group_of(field, source))
                    if hit:
                        keep.append(i)
                        fixed.append(new)
            part = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("field_name"), part.column("record_id"), part.column("value"), pa.array(fixed, pa.string())], names=["field_name", "record_id", "original", "restored"])

    return spread(values).mapInArrow(run, "field_name string, record_id bigint, original string, restored string")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every affected value once."""
    return repaired(_values(spark, d)).select("field_name", "record_id").distinct()


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every affected value with its text as far as it can be restored."""
    return repaired(_values(spark, d)).select("field_name", "record_id", "restored").distinct()


SQL: dict[str, str] = {}
QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired}
