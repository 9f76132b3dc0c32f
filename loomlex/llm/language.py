"""Problem 1: language of every stretch of a body, and labels that are missing or not right.

Word-first backoff: a known word is scored by its log frequency in each language; an unseen word
falls back to its character 4-grams, then to 3-, 2- and 1-grams, until enough of them are known.
A sentence takes the language with the greatest sum; neighbouring sentences of one language make
a stretch.  A sentence of which hardly any word is known is read again after undoing wrong decodings.

*Confidence.*  Words of a sentence aren't independent, so their sum is divided by a temperature, fitted
so that the posteriors of short pieces of held-out sentences have the least log loss.  The
confidence of a stretch is the mean tempered posterior of its language over its words: the share of
the stretch that is expected to be in that language.

*Fit.*  Counts come from a bounded sample of bodies (``SAMPLE``, the first ``SAMPLE_CHARS`` characters of
each), once by their labels and again by the sentences' own languages, which takes out wrong labels
and mixed bodies; words that look garbled aren't counted.  Every body is read whole afterwards, and may have any number of languages.

Nulls and edges: NULL and blank bodies are no cases; a body without a readable sentence takes the
language of its title and abstract; repeated rows of an article are one article; a NULL
article_id is left out; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlex.llm.mojibake import CHAINS, undo, usual
from loomlex.session import blank, ship_package, spread, table

LANGUAGES = ("ru", "en", "uk", "de", "fr")
L = len(LANGUAGES)
#: Bodies the counts are fitted on, and characters of each, at most.
SAMPLE, SAMPLE_CHARS = 4_000, 3_000
WORDS, GRAMS = 60_000, 60_000
CACHE = 300_000
LEAST_WORDS = 4
#: Words of a piece and temperatures tried when confidence is calibrated; one row in HELD_OUT is kept for it.
PIECE, TEMPERATURES, HELD_OUT = 3, (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0), 5

_JOIN = re.compile(r"[-‐¬­]\s*\n\s*(?=[^\W\d_A-ZА-ЯЁІЇЄҐ])")
_END = re.compile(r"(?<=[.!?…])[»”\"’)\]]*\s+(?=[«“\"„(\[]*[A-ZА-ЯЁІЇЄҐÀ-ÖØ-Þ])|\n\s*\n")
_STRIP = "\"'.,;:!?()[]{}<>«»“”„…*|/\\—–-0123456789%№§"


def sentences(text: str) -> list[tuple[int, str]]:
    """(offset, sentence); offsets are those of ``text`` unless it has words cut at line ends."""
    out, at = [], 0
    for m in _END.finditer(text):
        out.append((at, text[at : m.end()]))
        at = m.end()
    if at < len(text):
        out.append((at, text[at:]))
    return out


def join_lines(text: str) -> str:
    return _JOIN.sub("", text) if "\n" in text else text


class Counts:
    """Words and character n-grams by language."""

    def __init__(self) -> None:
        self.words: dict[str, list[int]] = {}

    def add(self, words: list[str], lang: int) -> None:
        get = self.words.setdefault
        for w in words:
            get(w, [0] * L)[lang] += 1

    def model(self) -> tuple[dict[str, list[float]], dict[str, list[float]]]:
        """Log frequencies: {word: by language}, {n-gram: by language}."""
        total = [1 + sum(c[i] for c in self.words.values()) for i in range(L)]
        kept = sorted((w for w, c in self.words.items() if sum(c) >= 2), key=lambda w: (-sum(self.words[w]), w))[:WORDS]
        words = {w: [math.log((c + 0.2) / (t + 0.2 * len(kept))) for c, t in zip(self.words[w], total)] for w in kept}
        grams: dict[str, list[float]] = {}
        for w, c in self.words.items():
            for g in set(_grams(w)):
                row = grams.setdefault(g, [0.0] * L)
                for i in range(L):
                    row[i] += 1 + math.log(c[i]) if c[i] else 0.0
        out: dict[str, list[float]] = {}
        for n in (1, 2, 3, 4):
            own = sorted((g for g in grams if len(g) == n), key=lambda g: (-sum(grams[g]), g))[:GRAMS]
            sums = [1 + sum(grams[g][i] for g in own) for i in range(L)]
            for g in own:
                out[g] = [math.log((x + 0.5) / (t + 0.5 * len(own))) for x, t in zip(grams[g], sums)]
        return words, out


def _grams(word: str, sizes: tuple[int, ...] = (1, 2, 3, 4)) -> list[str]:
    s = f" {word} "
    return [s[i : i + n] for n in sizes for i in range(len(s) - n + 1)]


class Scorer:
    """Rows of log scores by token; row 0 is for tokens without letters."""

    def __init__(self, words: dict[str, list[float]], grams: dict[str, list[float]], temperature: float = 1.0) -> None:
        self.known, self.grams, self.temperature = words, grams, temperature
        self.reset()

    def reset(self) -> None:
        self.rows: list[list[float]] = [[0.0] * L]
        self.sure: list[float] = [0.0]
        self.ids: dict[str, int] = {}

    def _id(self, token: str) -> int:
        w = token.lower().strip(_STRIP)
        if not w or not any(c.isalpha() for c in w):
            i = 0
        else:
            i = len(self.rows)
            row = self.known.get(w)
            self.sure.append(1.0 if row else 0.0)
            self.rows.append(row or self.backoff(w))
        self.ids[token] = i
        return i

    def backoff(self, word: str) -> list[float]:
        """Mean score of the longest n-grams of which at least a third is known."""
        for n in (4, 3, 2, 1):
            all_of = _grams(word, (n,))
            found = [self.grams[g] for g in all_of if g in self.grams]
            if found and 3 * len(found) >= len(all_of):
                return [sum(col) / len(found) for col in zip(*found)]
        return [0.0] * L

    def sums(self, parts: list[str]) -> np.ndarray | None:
        """Sums of the scores of each part, a row for each."""
        rows = [[self.rows[self.ids[t] if t in self.ids else self._id(t)] for t in p.split()] for p in parts]
        return np.array([np.sum(r, 0) if r else np.zeros(L) for r in rows]) if rows else None

    def languages(self, parts: list[str]) -> list[tuple[int, float, int, float]]:
        """(language, confidence, words, share of known words) of each part; language -1 for none."""
        if len(self.rows) > CACHE:
            self.reset()
        ids, get, sizes, flat = self.ids, self.ids.get, [], []
        for p in parts:
            tokens = p.split()
            sizes.append(len(tokens))
            for t in tokens:
                i = get(t)
                flat.append(self._id(t) if i is None else i)
        if not flat:
            return [(-1, 0.0, 0, 0.0)] * len(parts)
        idx = np.array(flat)
        rows = np.array([self.rows[i] for i in flat])
        sure = np.array([self.sure[i] for i in flat])
        ends = np.cumsum(sizes)
        cum = np.vstack([np.zeros(L), np.cumsum(rows, 0)])
        sums = cum[ends] - cum[ends - sizes]
        n = np.concatenate([[0], np.cumsum(idx > 0)])
        known = np.concatenate([[0.0], np.cumsum(sure)])
        counts = n[ends] - n[ends - sizes]
        shares = (known[ends] - known[ends - sizes]) / np.maximum(counts, 1)
        out = []
        for s, c, k in zip(sums, counts.tolist(), shares.tolist()):
            if not c:
                out.append((-1, 0.0, 0, 0.0))
                continue
            best = int(s.argmax())
            out.append((best, float(1 / np.exp(np.maximum((s - s[best]) / self.temperature, -50.0)).sum()), c, k))
        return out


def read_again(scorer: Scorer, part: str) -> tuple[int, float, int, float]:
    """The best reading of a sentence over all ways to undo a wrong decoding."""
    best = (-1, 0.0, 0, 0.0)
    core = part.strip()
    for c in range(len(CHAINS)):
        fixed = undo(c, core)
        if fixed and fixed != core:
            got = scorer.languages([fixed])[0]
            if got[2] >= LEAST_WORDS and got[3] > max(best[3], 0.5):
                best = got
    return best


def segments(scorer: Scorer, text: str) -> list[tuple[int, int, int, float, int]]:
    """Stretches (start, end, language, confidence, sentences) of a text whose lines are joined."""
    cut = sentences(text)
    found = scorer.languages([s for _, s in cut])
    out: list[list] = []
    for (at, s), (lang, sure, n, known) in zip(cut, found):
        if n >= 3 and known < 0.4 and not s.isascii():
            again = read_again(scorer, s)
            lang, sure, n, known = again if again[0] >= 0 else (lang, sure, n, known)
        lost = s.count("?") + s.count("�")
        if lang < 0 or n < LEAST_WORDS or 2 * lost > len(s) or known < 0.2:
            if out:
                out[-1][1] = at + len(s)
            continue
        if out and out[-1][2] == lang:
            out[-1][1] = at + len(s)
            out[-1][3] += sure * n
            out[-1][4] += 1
            out[-1][5] += n
        else:
            out.append([at, at + len(s), lang, sure * n, 1, n])
    return [(a, e, lang, sure / n, many) for a, e, lang, sure, many, n in out]


@lru_cache(maxsize=CACHE)
def countable(token: str) -> str:
    """The bare word of a token; '' for none, and for one that looks garbled, lest garbled words become known."""
    w = token.lower().strip(_STRIP)
    return w if w and usual(w) else ""


def bare_words(text: str) -> list[str]:
    return [w for t in text.split() if (w := countable(t))]


def clear_sentences(scorer: Scorer, text: str) -> Iterator[tuple[str, int]]:
    """(sentence, language) of the sentences that leave no doubt."""
    cut = [s for _, s in sentences(text)]
    for s, (lang, sure, n, known) in zip(cut, scorer.languages(cut)):
        if n >= LEAST_WORDS and sure > 0.99 and known > 0.6 and "�" not in s and "??" not in s:
            yield s, lang


def calibrate(scorer: Scorer, truth: list[tuple[str, int]]) -> tuple[float, float, float]:
    """(temperature, log loss at 1, log loss at that temperature) on pieces of sentences of known language."""
    pieces, right = [], []
    for s, lang in truth:
        words = s.split()
        for i in range(0, len(words) - PIECE + 1, PIECE):
            pieces.append(" ".join(words[i : i + PIECE]))
            right.append(lang)
    sums = scorer.sums(pieces)
    if sums is None:
        return 1.0, 0.0, 0.0

    def loss(t: float) -> float:
        x = (sums - sums.max(1, keepdims=True)) / t
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(right)), right]).mean())

    best = min(TEMPERATURES, key=loss)
    return best, loss(1.0), loss(best)


def fit(rows: list[tuple[str, str]]) -> tuple[dict, dict, float]:
    """Model of (text, label) rows; labels other than one language only join the second round."""
    texts = [join_lines(t) for t, _ in rows]
    first = Counts()
    for t, (_, label) in zip(texts, rows):
        if label in LANGUAGES:
            first.add(bare_words(t), LANGUAGES.index(label))
    scorer = Scorer(*first.model())
    second, kept = Counts(), []
    for i, t in enumerate(texts):
        for s, lang in clear_sentences(scorer, t):
            if i % HELD_OUT:
                second.add(bare_words(s), lang)
            else:
                kept.append((s, lang))
    temperature, _, _ = calibrate(Scorer(*second.model()), kept)
    for s, lang in kept:
        second.add(bare_words(s), lang)
    return *second.model(), temperature


def label_of(c):
    """Canonical label (languages in code order joined by '-'), NULL when missing or not valid."""
    x = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    parts = F.array_sort(F.split(x, "-"))
    good = F.forall(parts, lambda p: p.isin(*LANGUAGES)) & (F.size(parts) <= 2) & (F.size(F.array_distinct(parts)) == F.size(parts))
    return F.when(good, F.array_join(parts, "-"))


def _fit_from(spark: SparkSession, d: str) -> tuple[dict, dict, float]:
    text = table(spark, d, "article_text")
    picked = text.select("text_id").where("text_id is not null").orderBy(F.xxhash64("text_id"), "text_id").limit(SAMPLE).distinct()
    part = text.join(F.broadcast(picked), "text_id", "left_semi").select("text_id", "article_id", F.substring("body_text", 1, SAMPLE_CHARS).alias("body")).dropDuplicates(["text_id"])  # at most SAMPLE ids
    labels = table(spark, d, "article_metadata").groupBy("article_id").agg(F.min(label_of(F.col("language"))).alias("label"))
    rows = part.join(labels, "article_id", "left").orderBy("article_id", "body").select("body", "label").collect()
    return fit([(r["body"], r["label"]) for r in rows if r["body"] and not r["body"].isspace()])


def _segments_frame(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of every body: text_id, article_id, start, end, lang, confidence, sentences."""
    ship_package(spark)
    held = spark.sparkContext.broadcast(_fit_from(spark, d))  # at most WORDS words and 4 x GRAMS n-grams
    src = table(spark, d, "article_text").where(~blank(F.col("body_text"))).select("text_id", "article_id", F.col("body_text").alias("body"), F.concat_ws(". ", "title_text", "abstract_text").alias("rest"))
    names = ("text_id", "article_id", "start", "end", "lang", "confidence", "sentences")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*held.value)
        for b in batches:
            rows = []
            for tid, aid, body, rest in zip(*(b.column(c).to_pylist() for c in ("text_id", "article_id", "body", "rest")), strict=True):
                found = segments(scorer, join_lines(body))
                if not found and rest and (other := segments(scorer, join_lines(rest))):
                    found = [(0, len(body), other[0][2], other[0][3], 0)]
                rows += [(tid, aid, a, e, LANGUAGES[g], round(sure, 6), n) for a, e, g, sure, n in found]
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=list(names))

    return spread(src).mapInArrow(run, "text_id bigint, article_id bigint, start bigint, end bigint, lang string, confidence double, sentences int")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of every body that is in two or more, or whose label is missing or not right."""
    by_text = _segments_frame(spark, d).where("article_id is not null").groupBy("article_id", "text_id", "lang").agg(F.sum("sentences").alias("n"))
    by_article = by_text.groupBy("article_id").agg(*(F.max(F.when(F.col("lang") == x, F.col("n"))).alias(x) for x in LANGUAGES))
    counts = F.array(*(F.struct((-F.col(x)).alias("n"), F.lit(x).alias("lang")) for x in LANGUAGES))
    ranked = F.array_sort(F.filter(counts, lambda s: s["n"].isNotNull()))
    whole = F.filter(ranked, lambda s: s["n"] <= -2)
    # a body of one sentence has the language of that sentence
    langs = F.transform(F.when(F.size(whole) > 0, whole).otherwise(F.slice(ranked, 1, 1)), lambda s: s["lang"])
    bodies = by_article.select("article_id", langs.alias("langs")).withColumn("own", F.array_join(F.array_sort("langs"), "-"))
    label = label_of(F.col("language"))
    labels = table(spark, d, "article_metadata").groupBy("article_id").agg(
        F.min(label).alias("least"), F.max(label).alias("most"), F.bool_or(label.isNull()).alias("missing"))
    both = bodies.join(labels, "article_id", "left")
    right = ~F.coalesce("missing", F.lit(True)) & (F.col("least") == F.col("own")) & (F.col("most") == F.col("own"))
    return both.where((F.size("langs") > 1) | ~F.coalesce(right, F.lit(False))).select("article_id", F.explode("langs").alias("lang"))


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every stretch of every body."""
    return _segments_frame(spark, d)


SQL: dict[str, str] = {}
QUERIES = {"p1_found": p1_found, "p1_segments": p1_segments}
