"""Ranked lexical search: windows of documents scored item by item in small arrays.

Texts are cut into terms inside tasks; of each document the terms that some item asks for are kept with their counts, and
written as postings. Document frequencies are aggregated from these. A task then sorts its postings by doc_id and takes
them in windows of WINDOW documents. Inside a window postings are turned to run by term; every posting's contribution is
known, as it does not depend on the item. For an item, the contributions of its terms are scatter-added into an array of
the window's size, which fits a core's cache; a bitset by term and document says which places were touched; only these
are harvested into the item's heap of the best, and set back to 0. Each task hands on its heaps, at most `top` rows an
item, and a ranked window over these gives the result. Postings are never shuffled.

Items are taken in blocks of about BLOCK_TERMS terms, so that what tasks know of the items has a bound.

Cases: null and wordless texts have no terms; as documents they count nowhere and are never found, as items they find
nothing. Documents that repeat a doc_id are ranked each; items that repeat an item_id are one item with the terms of all.
A null doc_id ranks before others on equal scores; a null item_id is an item like others. Very long texts are cut in one
task each, in memory of their size. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, discard, persisted, read_table
from .decontaminate import WORD

WINDOW = 4096
#: Terms of a block of items: tasks hold the block's distinct terms, some hundred bytes each.
BLOCK_TERMS = 500_000
#: Bytes that are no part of a term become blanks, A-Z become a-z, all others stay.
TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct terms of every item that has any."""
    cut = items.select("item_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"({WORD})"), F.lit(1))).alias("term"))
    return cut.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document that has terms: n counts all of them, terms are places in `terms`."""
    places = {t.encode(): i for i, t in enumerate(terms)}
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, sizes, at, tf = [], [0], [], []
            for text in b.column(1):
                buffer = text.as_buffer()
                words = bytes(buffer).translate(TABLE).split() if buffer else []
                counts = Counter(words)
                own = [(places[w], c) for w, c in counts.items() if w in places]
                ns.append(len(words))
                at += [x for x, _ in own]
                tf += [c for _, c in own]
                sizes.append(len(at))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32())) for x in (at, tf)]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array([x > 0 for x in ns], pa.bool_()))

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, counts array<int>")


class Heap:
    """The best (score, place), larger scores first, then earlier places."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    def offer(self, scores: np.ndarray, places: np.ndarray) -> None:
        least = self.rows[0][0] if len(self.rows) == self.top else 0
        better = scores > least
        scores, places = scores[better], places[better]
        if len(scores) > self.top:
            best = np.lexsort((places, -scores))[: self.top]
            scores, places = scores[best], places[best]
        for s, p in zip(scores.tolist(), places.tolist(), strict=True):
            if len(self.rows) < self.top:
                heapq.heappush(self.rows, (s, -p))
            else:
                heapq.heappushpop(self.rows, (s, -p))


def score_window(first: int, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, total: tuple[int, int], items: list[np.ndarray], heaps: list[Heap]) -> None:
    """Offers the documents of one window, numbered from `first` on, to the heaps of all items."""
    docs, length = total
    m = 50 + (50 * n * docs) // length
    doc = np.repeat(np.arange(len(n)), sizes)
    order = np.argsort(terms, kind="stable")
    term, doc, tf = terms[order], doc[order], counts[order].astype(np.int64)
    adds = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
    begins = np.searchsorted(term, np.arange(len(weights) + 1))
    # A bitset for each term that the window holds: a bit for each document.
    words = (len(n) + 63) // 64
    held = np.flatnonzero(np.diff(begins))
    row = np.full(len(weights), -1, np.int32)
    row[held] = np.arange(len(held))
    bits = np.zeros(len(held) * words, np.uint64)
    cell = row[term].astype(np.int64) * words + (doc >> 6)
    if len(cell):
        edge = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        bits[cell[edge]] = np.bitwise_or.reduceat(np.uint64(1) << (doc & 63).astype(np.uint64), edge)
    bits = bits.reshape(len(held), words)
    sums = np.zeros(len(n), np.int64)
    for own, heap in zip(items, heaps, strict=True):
        own = own[row[own] >= 0]
        if not len(own):
            continue
        for t in own.tolist():
            a, z = begins[t], begins[t + 1]
            sums[doc[a:z]] += adds[a:z]
        taken = np.bitwise_or.reduce(bits[row[own]], 0)
        hit = np.flatnonzero(np.unpackbits(taken.view(np.uint8), bitorder="little")[: len(n)])
        heap.offer(sums[hit], first + hit)
        sums[hit] = 0


def best_of(rows: DataFrame, weights: np.ndarray, total: tuple[int, int], items: list[np.ndarray], top: int, window: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of every item; rows are postings."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heap(top) for _ in items]
        names: dict[int, object] = {}
        held: list[pa.RecordBatch] = []
        size = first = 0

        def flush() -> None:
            nonlocal held, size, first
            t = pa.Table.from_batches(held).combine_chunks()
            if t.num_rows:
                lists = t.column("terms").chunk(0)
                sizes = np.diff(lists.offsets.to_numpy())
                score_window(first, t.column("n").to_numpy(), sizes, lists.flatten().to_numpy(), t.column("counts").chunk(0).flatten().to_numpy(), weights, total, items, heaps)
                live = {-p for h in heaps for _, p in h.rows}
                fresh = sorted(p for p in live if p >= first)
                got = t.column("doc_id").take(pa.array([p - first for p in fresh], pa.int64())).to_pylist()
                for p in names.keys() - live:
                    del names[p]
                names.update(zip(fresh, got, strict=True))
            first, held, size = first + t.num_rows, [], 0

        for b in batches:
            at = 0
            while at < b.num_rows:
                some = b.slice(at, window - size)
                held.append(some)
                size, at = size + some.num_rows, at + some.num_rows
                if size == window:
                    flush()
        if held:
            kinds = held[0].schema.field("doc_id").type
            flush()
        elif first:
            kinds = b.schema.field("doc_id").type
        out = [(i, names[-p], s) for i, h in enumerate(heaps) for s, p in h.rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], kinds), pa.array([x[2] for x in out], pa.int64())], ["item", "doc_id", "score"])

    return rows.sortWithinPartitions("doc_id").mapInArrow(run, f"item int, doc_id {kind}, score long")


def rank(docs: DataFrame, items: DataFrame, top: int = 50, window: int = WINDOW, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's `top` best documents with a score above 0."""
    spark = docs.sparkSession
    kinds = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
    asked = persisted(item_terms(items), "items")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
    out = None
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        terms = sorted({t for r in block for t in r.terms})
        place = {t: i for i, t in enumerate(terms)}
        own = [np.array([place[t] for t in r.terms], np.int32) for r in block]
        rows = persisted(postings(docs, terms), "postings")
        n_docs, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not terms:
            discard(rows)
            continue
        weights = np.zeros(len(terms), np.int64)
        for t, df in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect():  # at most a row a term of the block
            weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        best = best_of(rows, weights, (n_docs, length), own, top, window)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(block)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        ranked = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    discard(asked)
    return spark.createDataFrame([], kinds) if out is None else out


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS length FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
f AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
c AS (SELECT p.r, p.t, f.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.w) * docs) // length))) AS x FROM p JOIN f USING (t) JOIN d USING (r), s),
z AS (SELECT item_id, r, CAST(sum(x) AS BIGINT) AS score FROM q JOIN c USING (t) GROUP BY item_id, r HAVING sum(x) > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM z JOIN d USING (r)) WHERE rank <= 50
"""
