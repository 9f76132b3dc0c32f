"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomlex.session import ship_package, spread

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: how this vocabulary splits text into pieces before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the piece cache after which it starts anew.
CACHE = 300_000

_ADJACENT = re.compile(r"\s | \s")


class TokenCounter(dict):
    """``count(text)`` equals the length of the tokenizer's own encoding.

    No piece of the pattern runs from a non-blank into a blank, so a text in which no blank
    touches other white space is counted word by word, each with its leading blank, from a cache.
    """

    def __init__(self, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> None:
        import tiktoken

        with open(os.path.join(folder, vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = n = len(self.encode(" " + word))
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if _ADJACENT.search(text):
            return len(self.encode(text))
        head, *rest = text.split(" ")
        return len(self.encode(head)) + sum([self[w] for w in rest])


_COUNTERS: dict[tuple[str, str], TokenCounter] = {}


def counter(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> TokenCounter:
    """One counter for each worker process."""
    if (folder, vocabulary) not in _COUNTERS:
        _COUNTERS[folder, vocabulary] = TokenCounter(folder, vocabulary)
    return _COUNTERS[folder, vocabulary]


def token_sizes(docs: DataFrame, keep: list[str], text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` of ``docs`` and n_tokens; a NULL or empty text has 0 tokens.

    A narrow stage: only ``keep`` and the text are read, the text doesn't leave the task.
    """
    ship_package(docs.sparkSession)
    src = spread(docs.select(*keep, docs[text].alias("__text")))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(folder, vocabulary).count
        for b in batches:
            n = pa.array([count(t) for t in b.column("__text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), n], names=[*keep, "n_tokens"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__text")
    return src.mapInArrow(sizes, f"{kinds}, n_tokens bigint")
