"""Best-fit packing of documents into sequences, in bulk-synchronous sweeps.

Pieces are numbered within their length, sequences' gaps within their size, so both are sorted by ranges of ranks. Bands
of lengths, each to half of the one before, are placed from the longest on. In a sweep every gap offers room for one
piece, or for as many of the band's longest as it holds. Gaps and pieces in descending order of size are brackets: a gap
opens one level, a piece closes the last open one, which is its successor among the gaps that are still free. The levels
follow from counts by size and ranks by running sums, so no row needs a global order; rows meet by level, a few in each.
Where more pieces want a gap than it has room for, the first ranks (longest first) take it, and the rest wait. Gaps
shrink, and the next sweep follows. When a sweep places few, new sequences are opened for the band's longest pieces,
and it is swept again; what is left after OPENINGS of these opens sequences of its own.

Every step is a Spark job over written tables; the driver holds counts by length and by gap (at most 2048 numbers each) and
the next sequence number. The last job reads the tables of all rounds in one scan, so that its plan stays small. Rows that meet in a window are those of one level, or of one (size, salt).

Cases: null and empty texts are their end id alone. Longer documents are cut; full pieces fill sequences of their own.
Repeated rows are packed as often as they come. An empty table packs to nothing. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, persisted, read_table

SEQUENCE = 2048
#: Bands end at limit / 2, / 4, ... down to limit / NARROWEST; the last one holds all that is shorter.
NARROWEST = 32
#: A sweep that places less than this share of a band's pieces is its last before sequences are opened.
LEAST_SHARE = 0.05
OPENINGS = 2


def cut(docs: DataFrame, tokenizer_path: str, limit: int = SEQUENCE, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, part, local_rank[, ids]) of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        enc = encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        seen = [0] * (limit + 1)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                at: list[int] = []
                rows: list[tuple] = []
                kept: list[np.ndarray] = []
                for k, x in enumerate(enc.encode(some.column(1).to_pylist())):
                    data = np.frombuffer(x, enc.kind).astype("<u4").tobytes() + end
                    for piece, start in enumerate(range(0, len(data) // 4, limit)):
                        own = data[4 * start : 4 * (start + limit)]
                        n = len(own) // 4
                        at.append(k)
                        rows.append((piece, start, n, zlib.crc32(own), part, seen[n]))
                        seen[n] += 1
                        if keep_ids:
                            kept.append(np.frombuffer(own, "<u4").astype(np.int32))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                arrays = [some.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
                if keep_ids:
                    arrays, names = [*arrays, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, local_rank long" + ", ids array<int>" * keep_ids)


def levels(there: dict[int, int], wanted: dict[int, int]) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
    """Levels that are open before the gaps of each size (size: number), and before the pieces of each length, with how many of these close one."""
    opens, closes, at = {}, {}, 0
    for size in sorted({*there, *wanted}, reverse=True):
        if size in there:
            opens[size] = at
            at += there[size]
        if size in wanted:
            closes[size] = at, min(at, wanted[size])
            at -= closes[size][1]
    return opens, closes


def sweep(gaps: DataFrame, ranks: DataFrame, left: dict[int, tuple[int, int]], upper: int, number: int) -> tuple[DataFrame | None, dict[int, int]]:
    """Places (length, rank, sequence, slot, round) for pieces of left (length: first rank, number) in gaps (sequence, gap), if any, and how many of each length."""
    spark = gaps.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    room = F.greatest(F.floor(F.col("gap") / upper).cast("int"), F.lit(1))
    slots = gaps.select("sequence", F.least("gap", F.lit(upper).cast("long")).alias("size"), F.explode(F.sequence(F.lit(0), room - 1)).alias("slot"))
    slots = slots.withColumn("salt", F.pmod(F.xxhash64("sequence", "slot"), F.lit(salts)))
    dealt = slots.groupBy("size", "salt").agg(F.count("*").alias("n"))
    there = {r["size"]: r["n"] for r in dealt.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most `upper` rows
    opens, closes = levels(there, {length: n for length, (_, n) in left.items()})
    taken = {length: n for length, (_, n) in closes.items()}
    if not any(taken.values()):
        return None, taken
    below = F.broadcast(spark.createDataFrame(list(opens.items()), "size long, open long"))
    lengths = F.broadcast(spark.createDataFrame([(length, at, left[length][0], n) for length, (at, n) in closes.items()], "length long, open long, first long, matched long"))
    before = dealt.select("size", "salt", (F.sum("n").over(W.partitionBy("size").orderBy("salt")) - F.col("n")).alias("before"))
    numbered = slots.withColumn("place", F.row_number().over(W.partitionBy("size", "salt").orderBy("sequence", "slot")) - 1)
    opened = numbered.join(before, ["size", "salt"]).join(below, "size").select((F.col("open") + F.col("before") + F.col("place")).alias("level"), "size", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("rank"), "sequence", "slot")
    own = F.col("rank") - F.col("first")
    closed = ranks.join(lengths, "length").where((own >= 0) & (own < F.col("matched"))).select((F.col("open") - 1 - own).alias("level"), F.col("length").alias("size"), F.lit(1).alias("kind"), "rank", F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("int").alias("slot"))
    level = W.partitionBy("level").orderBy(F.desc("size"), "kind")
    met = opened.union(closed).withColumns({"sequence": F.coalesce("sequence", F.lag("sequence").over(level)), "slot": F.coalesce("slot", F.lag("slot").over(level))})
    return persisted(met.where("kind = 1").select(F.col("size").alias("length"), "rank", "sequence", "slot", F.lit(number).alias("round")), "matches"), taken


def longest_first(ranks: DataFrame, left: dict[int, tuple[int, int]], first: int, each: int, number: int, at_round: int) -> tuple[DataFrame, dict[int, int]]:
    """Places of the longest pieces of left, each a sequence, in `number` new sequences from `first` on; and how many of each length."""
    rows, at = [], 0
    for length in sorted(left, reverse=True):
        begin, n = left[length]
        rows.append((length, begin, at, min(n, max(0, each * number - at))))
        at += n
    lengths = F.broadcast(ranks.sparkSession.createDataFrame(rows, "length long, first long, before long, opened long"))
    own = F.col("rank") - F.col("first")
    place = F.col("before") + own
    some = ranks.join(lengths, "length").where((own >= 0) & (own < F.col("opened")))
    opened = some.select("length", "rank", (first + F.floor(place / each)).alias("sequence"), (place % each).cast("int").alias("slot"), F.lit(at_round).alias("round"))
    return persisted(opened, "matches"), {r[0]: r[3] for r in rows}


def pack(pieces: DataFrame, limit: int = SEQUENCE) -> DataFrame:
    """pieces (a written table) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = persisted(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` rows
    before = counts.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local_rank")).drop("before", "part", "local_rank")
    ranks = persisted(ranked.select("length", "rank"), "ranks")
    full = ranks.where(F.col("length") == limit).select("length", "rank", F.col("rank").alias("sequence"), F.lit(0).alias("slot"), F.lit(0).alias("round"))
    placed: list[DataFrame] = []
    sequences = totals.pop(limit, 0)
    left = {length: (0, n) for length, n in totals.items()}
    gaps = persisted(spark.createDataFrame([], "sequence long, gap long"), "gaps")
    rounds = 0

    def take(match: DataFrame, taken: dict[int, int], gaps: DataFrame, fresh: bool) -> DataFrame:
        """Books a round's matches; the gaps that are left, of which those that hold no piece any more go."""
        nonlocal rounds
        rounds += 1
        placed.append(match)
        for length, n in taken.items():
            begin, number = left.pop(length)
            if number > n:
                left[length] = (begin + n, number - n)
        used = match.groupBy("sequence").agg(F.sum("length").alias("used"))
        if fresh:
            now = gaps.union(used.select("sequence", limit - F.col("used")))
        else:
            now = gaps.join(used, "sequence", "left").select("sequence", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"))
        out = persisted(now.where(F.col("gap") >= min(left, default=limit)), "gaps")
        discard(gaps)
        return out

    upper = limit - 1
    while left:
        lower = upper // 2 if upper == limit - 1 or upper > limit // NARROWEST else 0
        band = lambda lower=lower: {length: x for length, x in left.items() if length > lower}

        def swept(gaps: DataFrame, upper: int = upper, band=band) -> tuple[DataFrame, bool]:
            wanted = sum(n for _, n in band().values())
            match, taken = sweep(gaps, ranks, band(), upper, rounds + 1)
            if match is None:
                return gaps, False
            return take(match, taken, gaps, False), sum(taken.values()) >= LEAST_SHARE * wanted

        more = upper < limit - 1
        while more and band():
            gaps, more = swept(gaps)
        for k in range(OPENINGS + 1):
            if not band():
                break
            each, every = limit // upper, sum(n for _, n in band().values())
            needed = -(-sum(length * n for length, (_, n) in band().items()) // limit)
            number = -(-every // each) if k == OPENINGS or each == 1 else min(needed, -(-every // each))
            match, taken = longest_first(ranks, band(), sequences, each, number, rounds + 1)
            sequences += number
            gaps = take(match, taken, gaps, True)
            if band():
                gaps, _ = swept(gaps)
        upper = lower
    discard(gaps)
    # One scan of all rounds' tables, however many there were.
    places = full.union(spark.read.schema(placed[0].schema).parquet(*[x.stored_path for x in placed])) if placed else full
    # A sequence has as many pieces as ids, at most.
    offset = F.sum("length").over(W.partitionBy("sequence").orderBy("round", "slot", "rank")) - F.col("length")
    places = places.select("length", "rank", F.col("sequence").alias("sequence_id"), offset.alias("offset"))
    return ranked.join(places, ["length", "rank"]).select(*[c for c in pieces.columns if c not in ("part", "local_rank")], "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) from packed pieces with ids; a sequence has at most `limit` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def pack_documents(docs: DataFrame, tokenizer_path: str, limit: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    return pack(persisted(cut(docs, tokenizer_path, limit, keep_ids=keep_ids), "pieces"), limit)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
