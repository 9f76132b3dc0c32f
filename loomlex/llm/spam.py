"""Problem 9: documents that are mostly link lists, tag lists, menus or stuffed keywords.

A text is cut into units (lines; long lines at sentence ends).  A hidden Markov model labels each
unit prose, reference (bibliographies, contents, glossaries: no spam), link list, tag list, menu or
stuffed phrases.  A unit emits three things: a layout symbol, a level of repetition (how often
the most frequent pair of content words recurs around it) and its words.  The model starts from
layout rules on a bounded sample and is then re-estimated on that sample by Viterbi training, so
that words carry the labels to units the rules can't tell.  A document is flagged when more than
half of its characters lie in units of the last four labels.

Nulls and edges: a NULL, empty or blank text is never flagged; repeated rows give one
result; an empty table gives no rows.  Whole texts are labelled; only the training sample
is bounded (``SAMPLE`` documents, the first ``SAMPLE_CHARS`` characters of each).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlex.session import ship_package, spread, table

PROSE, REFERENCE, LINK, TAG, MENU, STUFFED = range(6)
STATES = 6
SAMPLE = 5_000
SAMPLE_CHARS = 20_000
ROUNDS = 3
#: Words the model keeps, at most.
VOCABULARY = 40_000
WINDOW = 60
#: Weight of the overall word shares in those of a state, in words.
PRIOR_WORDS = 1_000
#: Words of a unit that count in full.
UNIT_WORDS = 6

_CUT = re.compile(r"(?<=[.!?…])\s+(?=[\"«“(\[]?[^\W\d_a-zа-яёіїєґ])")
_URL = re.compile(r"https?://|www\.|href=|\]\(")
_SEPARATOR = re.compile(r"\s[|/»>•·*~→]+\s|;")
_NUMBERED = re.compile(r"^\s*(?:\[?\d+[.)\]]|.*\.{3,}\s*\d+\s*$|.*\s//\s.*\d{4})")
_LABEL = re.compile(r"^\s*(?:key\s?words|ключевые слова|ключові слова|schlüsselwörter|schlagwörter|mots[- ]clés)\s*[:.—-].{0,600}$", re.I)
_DEFINITION = re.compile(r"^\s*[^\W\d_][^.!?—–]{0,60}\s[—–-]\s.{25,}[.;]?\s*$")
_END = re.compile(r"[.!?…][»”\")\]]*\s*$")
_URL_TOKEN = re.compile(r"\S*(?:https?://|www\.)\S*")
_STRIP = "\"'.,;:!?()[]{}<>«»“”„…*|/\\#•·=_~→—–-"

SENTENCE, URL, HASH, SEPARATED, COMMAS, SHORT, NUMBERED, DEFINITION, LABEL, OTHER = range(10)
SYMBOLS = 10
LEVELS = 4


def units_of(text: str) -> list[str]:
    """Lines, and the sentences of lines longer than 160 characters; blank ones left out."""
    out = []
    for line in text.splitlines():
        if len(line) > 160:
            out += [u for u in _CUT.split(line) if u and not u.isspace()]
        elif line and not line.isspace():
            out.append(line)
    return out


def symbol_of(unit: str, words: int) -> int:
    """Layout of a unit."""
    commas = unit.count(",")
    if words >= 8 and unit[-1] in ".!?" and commas * 3.5 < words and not unit[0].isdigit() and "//" not in unit and "www." not in unit and "](" not in unit and unit.count("#") < 3 and unit.count(" / ") + unit.count(" | ") + unit.count(" • ") + unit.count(";") < 3 and not _LABEL.match(unit):
        return SENTENCE  # the usual case
    if _LABEL.match(unit):
        return LABEL
    if _NUMBERED.match(unit):
        return NUMBERED
    if (links := len(_URL.findall(unit))) and 10 * links >= words:  # a sentence may hold a link
        return URL
    if unit.count("#") >= 3:
        return HASH
    if len(_SEPARATOR.findall(unit)) >= 3:
        return SEPARATED
    ends = bool(_END.search(unit))
    if commas >= 4 and words / (commas + 1) <= 3.5:
        return COMMAS
    if ends and words >= 6:
        return SENTENCE
    if not ends and words <= 8:
        return SHORT
    if _DEFINITION.match(unit):
        return DEFINITION
    return OTHER


def repetition(words: list[str], starts: list[int]) -> list[int]:
    """Level 0..3 for each unit: how often the most frequent pair of neighbouring long words recurs nearby."""
    n = len(words)
    levels = []
    for at in range(0, max(n, 1), WINDOW):
        part = [w for w in words[at : at + WINDOW] if len(w) > 3]
        # a pair that occurs four times leaves at least six words that aren't new
        top = max(Counter(zip(part, part[1:])).values()) if len(part) - len(set(part)) > 5 else 0
        levels.append(3 if top >= 7 else 2 if top >= 6 else 1 if top >= 4 else 0)
    return [max(levels[a // WINDOW], levels[min(max(b - 1, a) // WINDOW, len(levels) - 1)]) for a, b in zip(starts, [*starts[1:], n])]


class Words(dict):
    """Token -> its bare lower-case form, '' when nothing is left."""

    def __missing__(self, token: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[token] = w = "<url>" if _URL_TOKEN.fullmatch(token) else "<n>" if token.strip(_STRIP).isdigit() else token.lower().strip(_STRIP)
        return w


def features(text: str, bare: Words) -> tuple[list[int], list[int], list[int], list[list[str]]]:
    """Lengths, symbols, repetition levels and words of the units."""
    units = units_of(text)
    words = [[w for t in u.split() if (w := bare[t])] for u in units]
    starts, n = [], 0
    for w in words:
        starts.append(n)
        n += len(w)
    flat = [w for ws in words for w in ws]
    symbols = [symbol_of(u, len(w)) for u, w in zip(units, words)]
    return [len(u) for u in units], symbols, repetition(flat, starts) if units else [], words


def seed(symbols: list[int], levels: list[int], words: list[list[str]]) -> list[int]:
    """First labels, by layout alone; -1 where the layout doesn't tell."""
    out = []
    shorts = sum(s in (SHORT, URL, HASH, SEPARATED, COMMAS) for s in symbols)
    for s, level, w in zip(symbols, levels, words):
        if s == URL:
            out.append(LINK)
        elif s == HASH or (s == COMMAS and level >= 1):
            out.append(TAG)
        elif s == SEPARATED:
            out.append(MENU)
        elif level == 3:
            out.append(STUFFED)
        elif s in (NUMBERED, DEFINITION, LABEL):
            out.append(REFERENCE)
        elif s == SHORT and shorts >= 6 and shorts > 0.8 * len(symbols):
            out.append(MENU)
        elif s == SENTENCE and level <= 1 and len(w) >= 8 or level == 0 and len(symbols) <= 3 and s in (SHORT, OTHER):
            out.append(PROSE)
        else:
            out.append(-1)
    return out


class Model:
    """Logarithms of start, transition and emission shares."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}

    def fit(self, docs, labels: list[list[int]]) -> Model:
        start, move = np.full(STATES, 1.0), np.full((STATES, STATES), 0.5) + 2 * np.eye(STATES)
        symbol, level = np.full((STATES, SYMBOLS), 0.5), np.full((STATES, LEVELS), 0.5)
        counts: dict[str, list[int]] = {}
        for (_, symbols, levels, words), path in zip(docs, labels):
            last = -1
            for s, v, ws, y in zip(symbols, levels, words, path):
                if y >= 0:
                    symbol[y, s] += 1
                    level[y, v] += 1
                    for w in set(ws):  # a phrase repeated in a unit tells its words once
                        counts.setdefault(w, [0] * STATES)[y] += 1
                    if last >= 0:
                        move[last, y] += 1
                    else:
                        start[y] += 1
                last = y
        kept = sorted((w for w, c in counts.items() if sum(c) >= 3), key=lambda w: (-sum(counts[w]), w))[:VOCABULARY]
        table = np.array([counts[w] for w in kept], float).reshape(-1, STATES)
        # a state that never saw a word takes the word's overall share, the less the more words it saw
        overall = table.sum(1, keepdims=True) / max(table.sum(), 1.0)
        share = (table + PRIOR_WORDS * overall) / (table.sum(0) + PRIOR_WORDS)
        self.index = {w: i for i, w in enumerate(kept, 1)}
        # row 0: a word that the model doesn't know tells nothing; a word counts half, words of a unit aren't independent
        self.word = np.vstack([np.zeros(STATES), 0.5 * (np.log(share) - np.log(share).mean(1, keepdims=True))])
        log = lambda x: np.log(x / x.sum(-1, keepdims=True))
        self.start, self.move, self.symbol, self.level = log(start), log(move), log(symbol), log(level)
        self.level[[PROSE, REFERENCE], LEVELS - 1] = np.minimum(self.level[[PROSE, REFERENCE], LEVELS - 1], np.log(1e-4))
        return self

    def emissions(self, symbols, levels, words) -> np.ndarray:
        e = self.symbol[:, symbols].T + self.level[:, levels].T
        get = self.index.get
        ids = [get(w, 0) for ws in words for w in ws]
        sizes = np.array([len(ws) for ws in words])
        if ids:
            running = np.vstack([np.zeros(STATES), np.cumsum(self.word[ids], 0)])
            ends = np.cumsum(sizes)
            # the words of a long unit tell no more than UNIT_WORDS do, or its layout and repetition would be drowned
            e = e + (running[ends] - running[ends - sizes]) * np.minimum(1.0, UNIT_WORDS / np.maximum(sizes, 1))[:, None]
        return e

    def path(self, e: np.ndarray) -> list[int]:
        """Viterbi's path; at once when one label wins every unit by more than any move could repay."""
        order = np.sort(e, 1)
        best = e.argmax(1)
        spread = 2 * (self.move.max() - self.move.min())
        if (best == best[0]).all() and (order[:, -1] - order[:, -2] > spread).all():
            return best.tolist()
        move = self.move.T.tolist()
        score = (self.start + e[0]).tolist()
        back = []
        for row in e[1:].tolist():
            new, came = [], []
            for y in range(STATES):
                m = move[y]
                opts = [score[x] + m[x] for x in range(STATES)]
                b = max(opts)
                came.append(opts.index(b))
                new.append(b + row[y])
            back.append(came)
            score = new
        y = score.index(max(score))
        out = [y]
        for came in reversed(back):
            y = came[y]
            out.append(y)
        return out[::-1]


def label(model: Model, text: str | None, bare: Words) -> tuple[list[int], list[int]]:
    """(lengths, labels) of the units of a text."""
    if not text or text.isspace():
        return [], []
    lengths, symbols, levels, words = features(text, bare)
    if not lengths:
        return [], []
    return lengths, model.path(model.emissions(symbols, levels, words))


def spam_share(lengths: list[int], labels: list[int]) -> float:
    return sum(n for n, y in zip(lengths, labels) if y >= LINK) / total if (total := sum(lengths)) else 0.0


def train(texts: list[str], rounds: int = ROUNDS) -> Model:
    bare = Words()
    docs = [f for t in texts if t and not t.isspace() and (f := features(t, bare))[0]]
    seeds = [seed(s, v, w) for _, s, v, w in docs]
    model = Model().fit(docs, seeds)
    for _ in range(rounds):  # what the layout tells stays; the model fills in the rest
        paths = [model.path(model.emissions(s, v, w)) for _, s, v, w in docs]
        model.fit(docs, [[a if a >= 0 else b for a, b in zip(x, y)] for x, y in zip(seeds, paths)])
    return model


def sample_texts(docs: DataFrame, text: str, key: str) -> list[str]:
    n = docs.count()
    part = docs.where(F.col(text).isNotNull())
    if n > SAMPLE:
        part = part.where(F.pmod(F.xxhash64(key), F.lit(max(1, n // SAMPLE))) == 0)
    return [r[0] for r in part.select(F.substring(text, 1, SAMPLE_CHARS)).limit(SAMPLE + SAMPLE // 2).collect()]


def line_shares(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """For every row: characters by label, and the share of spam labels."""
    ship_package(docs.sparkSession)
    model = model or train(sample_texts(docs, text, key))
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY words
    names = ("prose", "reference", "link", "tag", "menu", "stuffed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, bare = held.value, Words()
        for b in batches:
            sums, shares = [], []
            for t in b.column(1).to_pylist():
                lengths, labels = label(m, t, bare)
                by = [0] * STATES
                for n, y in zip(lengths, labels):
                    by[y] += n
                sums.append(by)
                shares.append(spam_share(lengths, labels))
            cols = [pa.array([s[y] for s in sums], pa.int64()) for y in range(STATES)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(shares, pa.float64())], names=["doc_id", *(f"{x}_chars" for x in names), "spam_share"])

    return spread(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{x}_chars bigint" for x in names) + ", spam_share double")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of whose characters more than half are spam."""
    return line_shares(table(spark, d, "documents")).where(F.col("spam_share") > 0.5).select("doc_id").distinct()


def p9_line_shares(spark: SparkSession, d: str) -> DataFrame:
    """Characters of every document by the label of their line."""
    return line_shares(table(spark, d, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"p9_found": p9_found, "p9_line_shares": p9_line_shares}
