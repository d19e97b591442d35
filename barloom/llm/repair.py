"""Token ids in binary shards, compressed by Re-Pair grammars.

Documents are range-partitioned by id, tokenised and cut into shards of whole documents. In a shard the frequent
pairs of adjacent ids (never across two documents) are replaced by nonterminals, again and again, until none that is
counted is seen MIN_COUNT times; of overlapping pairs the more frequent is replaced first, and neither rounds nor rules
are limited. Rules that are used less than twice are written out again. The shard stores the rules and the remaining
symbols of every document, both in as many bits as the largest symbol needs. Any range of ids is decoded without decoding
the rest: expansion lengths, which follow from the rules, say which symbols hold it.

A shard is one row of a Parquet table in the shared folder: Spark's committer makes the write safe against lost
executors, and a task holds one shard at a time (one document at least, however long).

Payload, little-endian: b"RPG3", then unsigned 32-bit: documents, ids, terminals (first nonterminal), rules, rounds,
symbols, bits a symbol; the first rule of each round; symbols per document; ids per document; then, packed in so many
bits each, the lowest first: rules as pairs of symbols, padded to a byte; symbols.

Cases: null and empty texts are their end id alone. Null ids come first. Rows with equal ids follow each other, ordered
by their texts' hash. An empty table has no shards. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import persisted, read_table

SHARD_IDS = 1 << 20
#: A rule costs two symbols and each of its places saves one; and with rules in their tens of thousands symbols need
#: another bit, which costs more than rare pairs save.
MIN_COUNT = 16
MAGIC = b"RPG3"
#: Places of the table that names the chosen pair of a position.
TABLE_BITS = 20


def pack(x: np.ndarray, bits: int) -> bytes:
    """Unsigned numbers in as many bits each, the lowest bit first."""
    if bits == 16:
        return x.astype("<u2").tobytes()
    out = []
    for i in range(0, len(x), 1 << 18):  # a multiple of 8
        part = x[i : i + (1 << 18)].astype(np.uint32)
        out.append(np.packbits(((part[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    """n numbers of :func:`pack` at a place, and the place after them."""
    size = -(-n * bits // 8)
    if bits == 16:
        return np.frombuffer(data, "<u2", n, at).astype(np.uint32), at + size
    flat = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * bits, bitorder="little").reshape(n, bits)
    out = np.zeros(n, np.uint32)
    for k in range(bits):
        out |= flat[:, k].astype(np.uint32) << np.uint32(k)
    return out, at + size


def chosen_places(hit: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the places to replace, where overlapping ones compete: the more frequent pair wins; of equal ones in a
    run every second is taken, from its left end."""
    n = len(hit)
    joined = np.concatenate(([False], np.diff(hit) == 1))
    begin = ~(joined & np.concatenate(([False], weight[1:] == weight[:-1])))
    first = np.flatnonzero(begin)
    run = np.cumsum(begin) - 1
    level = weight[first]
    # Runs that touch a run of more frequent pairs wait.
    touches = joined[first]
    left = touches & (np.concatenate(([0], level[:-1])) > level)
    right = np.concatenate((touches[1:] & (level[1:] > level[:-1]), [False]))
    own = (np.arange(n) - first[run]) % 2 == 0
    take = own & ~(left | right)[run]
    return take


def compress(ids: np.ndarray, sizes: np.ndarray, terminals: int, min_count: int = MIN_COUNT) -> bytes:
    """One shard: ids of its documents one after the other, and their numbers.

    A round counts pairs of neighbours and gives a rule to each that is frequent; where such pairs overlap, the more
    frequent one is replaced, and what it leaves intact is counted again. A pair that is frequent in the next round so
    holds a nonterminal of this one or was passed over, and only such places are counted.
    """
    s = ids.astype(np.uint32)
    last = np.zeros(len(s), bool)
    last[np.cumsum(sizes[sizes > 0]) - 1] = True
    fresh = ~last
    rules: list[np.ndarray] = []
    starts: list[int] = []
    top = terminals
    table = np.full(1 << TABLE_BITS, -1, np.int32)
    while len(where := np.flatnonzero(fresh)) >= min_count:
        wide = top > 1 << 16
        left, right = s[where], s[where + 1]
        key = left.astype(np.uint64) << np.uint64(32) | right if wide else left * np.uint32(1 << 16) + right
        ordered = np.sort(key)
        edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(edge, len(ordered)))
        frequent = counts >= min_count
        chosen, weights = ordered[edge[frequent]], counts[frequent]
        if not len(chosen):
            break
        # A table by the pairs' low bits names the one chosen pair that a position may hold; pairs that share a place of
        # the table are looked up in order.
        fold = lambda x: (x ^ (x >> x.dtype.type(13))) & x.dtype.type((1 << TABLE_BITS) - 1)
        at, order = fold(chosen), np.arange(len(chosen), dtype=np.int32)
        table[at] = order
        table[at[table[at] != order]] = -2
        place = table[fold(key)]
        table[at] = -1
        held = np.flatnonzero(place != -1)
        place, own, hit = place[held], key[held], where[held]
        shared = np.flatnonzero(place == -2)
        place[shared] = np.searchsorted(chosen, own[shared]).clip(max=len(chosen) - 1)
        same = chosen[place] == own
        hit, place = hit[same], place[same]
        take = chosen_places(hit, weights[place])
        # Only pairs with enough places left get a rule.
        used = np.bincount(place[take], minlength=len(chosen))
        good = used >= 2
        take &= good[place]
        number = np.cumsum(good) - 1
        shift = chosen.dtype.type(32 if wide else 16)
        pair = np.stack([chosen >> shift, chosen & ((chosen.dtype.type(1) << shift) - chosen.dtype.type(1))], 1).astype(np.uint32)[good]
        starts.append(top - terminals)
        rules.append(pair)
        fresh[where] = False
        fresh[hit[~take]] = True
        done = hit[take]
        s[done] = top + number[place[take]]
        last[done] |= last[done + 1]
        fresh[done] = True
        fresh[done[done > 0] - 1] = True
        keep = np.ones(len(s), bool)
        keep[done + 1] = False
        s, last, fresh = s[keep], last[keep], fresh[keep]
        fresh &= ~last
        top += len(pair)
        if not len(pair):
            break
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    s, last, pairs, starts = pruned(s, last, pairs, starts, terminals)
    per_doc = np.zeros(len(sizes), np.uint32)
    per_doc[sizes > 0] = np.diff(np.flatnonzero(last), prepend=-1)
    bits = max(1, int(terminals + len(pairs) - 1).bit_length())
    head = struct.pack("<4s7I", MAGIC, len(sizes), len(ids), terminals, len(pairs), len(starts), len(s), bits)
    u4 = lambda x: np.asarray(x, "<u4").tobytes()
    return b"".join([head, u4(starts), u4(per_doc), u4(sizes), pack(pairs.ravel(), bits), pack(s, bits)])


def pruned(s: np.ndarray, last: np.ndarray, pairs: np.ndarray, starts: list[int], terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Without rules that nothing uses, and without those that only one symbol of the text uses, which is written out."""
    while len(pairs):
        n = len(pairs)
        in_text = np.bincount(s[s >= terminals] - terminals, minlength=n)
        inner = pairs[pairs >= terminals] - terminals
        in_rules = np.bincount(inner, minlength=n)
        gone = (in_rules == 0) & (in_text <= 1)
        if not gone.any():
            break
        old = np.zeros(len(s), bool)
        own = s >= terminals
        old[own] = gone[s[own] - terminals]
        at = np.arange(len(s)) + np.cumsum(old) - old
        size = len(s) + int(old.sum())
        wider, ends = np.empty(size, np.uint32), np.zeros(size, bool)
        wider[at], ends[at] = s, last
        rule = pairs[s[old] - terminals]
        wider[at[old]], wider[at[old] + 1] = rule[:, 0], rule[:, 1]
        ends[at[old]], ends[at[old] + 1] = False, last[old]
        number = np.concatenate([np.arange(terminals, dtype=np.uint32), (terminals + np.cumsum(~gone) - 1).astype(np.uint32)])
        before = np.concatenate([[0], np.cumsum(~gone)])
        s, last, pairs, starts = number[wider], ends, number[pairs[~gone]], [int(before[x]) for x in starts]
    return s, last, pairs, starts


class Shard:
    """A stored shard, for decoding whole or in part."""

    def __init__(self, data: bytes):
        magic, docs, self.n_ids, self.terminals, rules, rounds, symbols, bits = struct.unpack_from("<4s7I", data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = 32
        heads = []
        for n in (rounds, docs, docs):
            heads.append(np.frombuffer(data, "<u4", n, at))
            at += 4 * n
        self.starts, self.per_doc, self.sizes = heads
        flat, at = unpack(data, at, 2 * rules, bits)
        self.rules = flat.reshape(-1, 2)
        self.symbols, _ = unpack(data, at, symbols, bits)

    @cached_property
    def lengths(self) -> np.ndarray:
        """Ids that each symbol stands for."""
        out = np.ones(self.terminals + len(self.rules), np.int64)
        edges = [*self.starts.tolist(), len(self.rules)]
        for a, z in pairwise(edges):
            out[self.terminals + a : self.terminals + z] = out[self.rules[a:z]].sum(1)
        return out

    def expand(self, s: np.ndarray) -> np.ndarray:
        for begin in self.starts[::-1].tolist():
            pair = s >= self.terminals + begin
            at = np.arange(len(s)) + np.cumsum(pair) - pair
            out = np.empty(len(s) + int(pair.sum()), np.uint32)
            rule = self.rules[s[pair] - self.terminals]
            out[at] = s
            out[at[pair]], out[at[pair] + 1] = rule[:, 0], rule[:, 1]
            s = out
        return s

    @cached_property
    def written_out(self) -> tuple[np.ndarray, np.ndarray]:
        """What all symbols stand for, one after the other, and where each of them begins."""
        return np.concatenate([np.arange(self.terminals, dtype=np.uint32), self.expand(self.rules.ravel())]), np.cumsum(self.lengths) - self.lengths

    def spelled(self, s: np.ndarray) -> np.ndarray:
        """Ids of symbols, looked up in what each stands for."""
        flat, begins = self.written_out
        n = self.lengths[s]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(s) else 0
        return flat[np.repeat(begins[s] - (ends - n), n) + np.arange(total)]

    def ids(self) -> np.ndarray:
        return self.spelled(self.symbols)

    def range(self, start: int, n: int) -> np.ndarray:
        """ids [start, start + n) of the shard; only the symbols that hold them are expanded."""
        ends = np.cumsum(self.lengths[self.symbols])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, min(start + n, self.n_ids), "left")
        skip = start - (int(ends[a - 1]) if a else 0)
        return self.expand(self.symbols[a : b + 1])[skip : skip + n]


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shards (part, shard, ids_before, doc_ids, n_ids, payload) of docs (doc_id, text) in ascending order of doc_id; stored, then read back."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.kind).tobytes()
        terminals = max(enc.tokenizer.get_vocab_size(), end_id + 1)
        part = TaskContext.get().partitionId()
        doc_ids: list = []
        held: list[bytes] = []
        size = shard = before = 0
        kinds = None

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(x) // enc.kind.itemsize for x in held], np.int64)
            payload = compress(np.frombuffer(b"".join(held), enc.kind), sizes, terminals)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([doc_ids], pa.list_(kinds)), pa.array([int(sizes.sum())], pa.int64()), pa.array([payload], pa.binary())], ["part", "shard", "ids_before", "doc_ids", "n_ids", "payload"])

        for b in batches:
            kinds = b.schema.field(0).type
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                for d, x in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist()), strict=True):
                    doc_ids.append(d)
                    held.append(x + end)
                    size += len(x) // enc.kind.itemsize + 1
                    if size >= shard_ids:
                        yield flush()
                        doc_ids, held, before, shard, size = [], [], before + size, shard + 1, 0
        if held:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return persisted(ordered.mapInArrow(run, f"part int, shard int, ids_before long, doc_ids array<{kind}>, n_ids long, payload binary"), "repair-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the stored shards."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s = Shard(b.column("payload")[i].as_py())
                ids = s.ids().astype("<u4")
                ends = np.cumsum(s.sizes, dtype=np.int64)
                begins = ends - s.sizes
                crcs = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays([b.column("doc_ids")[i].values, pa.array(begins + b.column("ids_before")[i].as_py()), pa.array(s.sizes.astype(np.int64)), pa.array(crcs, pa.int64()), pa.array([b.column("part")[i].as_py()] * n, pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "part"])

    docs = shards.select("doc_ids", "ids_before", "part", "payload").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, part int")
    # One row for each partition of the writing job: their running sum places the partitions.
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offsets = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("offset"))
    return docs.join(offsets, "part").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op10_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_shards(write_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
