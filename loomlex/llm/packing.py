"""Problem 7: bounded-space online best-fit packing of texts into containers of fixed capacity.

Texts are dealt by a hash of their id into lanes of about ``LANE`` texts; a lane is packed by one
task, in the order of ids, whatever the cluster.  At any time at most ``OPEN`` containers of a lane
are open.  A bitset has bit f set while an open container has f tokens free, so the best fit (the
least free space that suffices) is the lowest set bit at or above the size.  When nothing fits and
``OPEN`` containers are open, the fullest is closed.  A text longer than the capacity is cut into
full containers and one rest; every other text stays whole.

Nulls and edges: a NULL or empty text has 0 tokens and one row with container_id NULL; repeated
ids are packed each; NULL ids are packed too; no texts or no containers give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlex.llm.tokens import token_sizes
from loomlex.session import stage_table, table

LANE = 20_000
OPEN = 256
#: Most container kinds; the list of kinds is read by the driver.
KINDS = 1_000

_OUT = "container_name string, capacity_tokens int, doc_id bigint, n_tokens bigint, piece_no int, start_token bigint, piece_tokens bigint, container_id bigint"


class Bins:
    """Open containers of one capacity."""

    def __init__(self, capacity: int, open_most: int) -> None:
        self.capacity, self.most = capacity, open_most
        self.bits, self.count, self.next = 0, 0, 0
        self.by_free: dict[int, list[int]] = defaultdict(list)

    def _take(self, free: int) -> int:
        ids = self.by_free[free]
        one = ids.pop()
        if not ids:
            self.bits ^= 1 << free
        self.count -= 1
        return one

    def _keep(self, one: int, free: int) -> None:
        if free:
            self.by_free[free].append(one)
            self.bits |= 1 << free
            self.count += 1

    def put(self, size: int) -> int:
        """Number of the container that gets an item of ``size`` (1..capacity)."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            one = self._take(free)
        else:
            if self.count >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest is closed
            one, free = self.next, self.capacity
            self.next += 1
        self._keep(one, free - size)
        return one


def pack(sizes: DataFrame, kinds: list[tuple[str, int]], lane: int = LANE, open_most: int = OPEN) -> DataFrame:
    """Containers for ``sizes`` (doc_id, n_tokens), packed once for each (name, capacity)."""
    if any(c < 1 for _, c in kinds):
        raise ValueError("a capacity must be positive")
    lanes = max(1, -(-sizes.count() // lane))
    dealt = sizes.select("doc_id", F.col("n_tokens").cast("long"), F.pmod(F.xxhash64("doc_id"), F.lit(lanes)).alias("lane"))
    dealt = dealt.repartition(lanes, "lane").sortWithinPartitions("lane", "doc_id", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins = None, []
        for b in batches:
            cols: tuple[list, ...] = tuple([] for _ in range(8))
            add = [c.append for c in cols]

            def row(*values):
                for f, v in zip(add, values, strict=True):
                    f(v)

            for doc, n, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "lane")), strict=True):
                if at != now:
                    now, bins = at, [(name, cap, Bins(cap, open_most)) for name, cap in kinds]
                for name, cap, one in bins:
                    if not n:
                        row(name, cap, doc, 0, 0, 0, 0, None)
                        continue
                    start = piece = 0
                    while start < n:
                        size = min(cap, n - start)
                        row(name, cap, doc, n, piece, start, size, (at << 32) + one.put(size))
                        start += size
                        piece += 1
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])

    return dealt.mapInArrow(run, _OUT)


def kinds_of(containers: DataFrame) -> list[tuple[str, int]]:
    rows = containers.select("container_name", "capacity_tokens").where("capacity_tokens is not null").distinct().orderBy("capacity_tokens", "container_name").limit(KINDS + 1).collect()
    if len(rows) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of containers")
    return [(r[0], r[1]) for r in rows]


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container of every text, or of every piece of a text longer than the capacity, for each kind."""
    sizes = stage_table(token_sizes(table(spark, d, "documents"), ["doc_id"]), "sizes")
    return pack(sizes, kinds_of(table(spark, d, "container_size")))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, tokens held and share of space used, for each kind."""
    return (
        p7_containers(spark, d)
        .where("container_id is not null")
        .groupBy("container_name", "capacity_tokens", "container_id")
        .agg(F.sum("piece_tokens").alias("tokens"))
        .groupBy("container_name", "capacity_tokens")
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
        .withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4))
    )


SQL: dict[str, str] = {}
QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
