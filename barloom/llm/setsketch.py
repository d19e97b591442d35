"""Near-duplicates by SetSketch registers.

A document is the set of its distinct shingles. A SetSketch register is the smallest of exponentially distributed
hashes of the set's elements, rounded down on a scale of powers of BASE; the sketch of a union is the larger of both
registers, and registers of similar sets are equal more often.

1. Sketch: registers, a 128-bit key of the set and the text, per document, written once. Words are hashed by a keyed
   128-bit digest.
2. Equal keys are one class; one document stands for it from here on.
3. Bands of ROWS registers are hashed. In each bucket every member is a candidate with the bucket's smallest member.
4. Candidates: the two sketches' order statistics give the likelihood of each Jaccard similarity; only where no
   similarity over the threshold is within MARGIN of the likeliest is the pair dropped. The rest is verified on the
   shingles of both texts themselves.
5. Links that do not run over a bucket's smallest member: where a group of buckets that share members holds several
   components, the members outside the largest are compared with all members. Shingles that one member alone has bound
   what it can share with any other; members that this rules out leave first, so texts that share a frame but not enough
   of it cost no comparison. The rest meets in blocks of bounded bytes over an index of shingles; what the blocks emit is
   links alone, one for each pair of components, and these too are verified on the texts.
6. Components of all links; the smallest document id names them.

Two sets at similarity 0.8 share none of BANDS buckets with a probability under 2e-7. The scale holds the registers of
sets of one shingle to a hundred million, so small sets are not truncated to equal registers.

Cases: null and blank texts have empty sets and are linked with nothing; fewer words than a shingle are one shingle.
Rows with equal doc_id and different texts are documents of their own; a null doc_id never names a component unless all
its ids are null. An empty table gives no rows. Extra columns are ignored by :func:`classes` and kept by :func:`dedup`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, hub_join, persisted, read_table, text_of, tmp_name
from .components import components

BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
BASE = 1.02
#: The register of an exponential variable of 1, so that those of the smallest sets are over 0.
OFFSET = 400
KIND = np.dtype("<u2")
#: Log-likelihood that a similarity over the threshold may lie below the likeliest one: five standard deviations.
MARGIN = 12.5
#: Members, and shingles of members (8 bytes each), of either side of a block.
BLOCK = 256
BLOCK_SHINGLES = 1 << 20
#: Uids up to which a table of them is broadcast (16 bytes each).
BROADCAST_IDS = 500_000
#: Word digests that a Python worker keeps; later words are hashed whenever they occur.
CACHE_WORDS = 400_000

U = np.uint64


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    return r.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


class Digests(dict):
    """128-bit keyed digests by word, found once."""

    def __missing__(self, word: bytes) -> bytes:
        out = hashlib.blake2b(word, digest_size=16, key=b"shingle words").digest()
        if len(self) < CACHE_WORDS and len(word) <= 64:
            self[word] = out
        return out


@lru_cache(1)
def digests() -> Digests:
    return Digests()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def shingle_set(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def shingle_hashes(words: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each distinct shingle, sorted by the first."""
    h = np.frombuffer(b"".join(map(digests().__getitem__, words)), "<u8").reshape(-1, 2)
    n = min(k, len(words))
    every = h[: len(h) - n + 1]
    for j in range(1, n):
        every = mix(every * U(0xD1342543DE82EF95) + h[j : len(h) - n + 1 + j])
    if not len(every):
        return every[:, 0], every[:, 1]
    every = mix(every + U(n))
    first, at = np.unique(every[:, 0], return_index=True)
    return first, every[at, 1]


def registers(s: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes: exponential variables, the least of each, on a scale of powers of BASE."""
    odd, add = tables()
    x = (s >> U(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(least, (odd[:, None] * x[None, i : i + 4096] + add[:, None]).min(axis=1), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(OFFSET - np.log(exponential) / np.log(BASE)), 0, 65535).astype(KIND)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """(uid, doc_id, t1, t2, text, n, k1, k2, registers) of docs (doc_id, text); t1 and t2 are hashes of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                n, keys, sketches = [], [], []
                for text in part.column("text").to_pylist():
                    w = words_of(text)
                    first, second = shingle_hashes(w, words)
                    n.append(len(shingle_set(w, words)))
                    digest = hashlib.blake2b(first.tobytes() + second.tobytes(), digest_size=16).digest()
                    keys.append(np.frombuffer(digest, np.int64))
                    sketches.append(registers(first).tobytes() if w else None)
                own = [pa.array(n, pa.int64()), pa.array([int(x[0]) for x in keys], pa.int64()), pa.array([int(x[1]) for x in keys], pa.int64()), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, *own], [*part.schema.names, "n", "k1", "k2", "registers"])

    keyed = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", *text_key("t1", "t2"), "text")
    return keyed.mapInArrow(run, f"uid long, doc_id {kind}, t1 long, t2 long, text string, n long, k1 long, k2 long, registers binary")


def text_key(*names: str) -> list:
    """Two 64-bit hashes of the text."""
    return [F.xxhash64(*([F.lit(1)] * i), text_of()).alias(x) for i, x in enumerate(names)]


def order_probability(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likely(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a similarity of the threshold or more is credible for each pair of sketches, given both cardinalities."""
    more, less = (ra > rb).sum(1)[:, None], (ra < rb).sum(1)[:, None]
    equal = ra.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.minimum(np.linspace(0, 1, 101)[None, :], np.minimum(u / v, v / u))
    p, q = order_probability(np.maximum(u - v * j, 1e-9)), order_probability(np.maximum(v - u * j, 1e-9))
    fit = more * np.log(p) + less * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))
    at = j >= threshold - 0.005
    return np.where(at, fit, -np.inf).max(1) >= fit.max(1) - MARGIN


def few(uids: DataFrame) -> DataFrame:
    """A written table of uids, broadcast where it is counted small."""
    return F.broadcast(uids) if uids.count() <= BROADCAST_IDS else uids


def verified(pairs: DataFrame, store: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b) whose shingle sets have 100 * shared >= percent * united."""

    def credible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                p = b.slice(i, 512)
                na, nb = (p.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("n_a", "n_b"))
                ra, rb = (np.frombuffer(b"".join(p.column(c).to_pylist()), KIND).reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
                good = pa.array(likely(ra, rb, na, nb, percent / 100))
                yield pa.RecordBatch.from_arrays([p.column("a").filter(good), p.column("b").filter(good)], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last, own, good = None, set(), []
            for x, ta, tb in zip(b.column("a").to_pylist(), b.column("t_a"), b.column("t_b"), strict=True):
                if x != last:
                    last, own = x, shingle_set(words_of(ta.as_py()), words)
                other = shingle_set(words_of(tb.as_py()), words)
                shared = len(own & other)
                good.append(100 * shared >= percent * (len(own) + len(other) - shared))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(good), b.column("b").filter(good)], ["a", "b"])

    side = lambda x: store.select(F.col("uid").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    left = persisted(both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(credible, "a long, b long"), "credible-pairs")
    needed = persisted(left.select(F.col("a").alias("uid")).union(left.select("b")).distinct(), "verified-uids")
    texts = store.select("uid", "text").join(few(needed), "uid", "left_semi")
    text = lambda x: texts.select(F.col("uid").alias(x), F.col("text").alias(f"t_{x}"))
    full = left.join(text("b"), "b").join(text("a"), "a")
    out = persisted(full.select("a", "b", "t_a", "t_b").mapInArrow(compare, "a long, b long"), "links")
    discard(left, needed)
    return out


def runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of every run [start, end), one run after the other."""
    sizes = ends - starts
    last = np.cumsum(sizes)
    return np.arange(last[-1] if len(last) else 0) + np.repeat(starts - (last - sizes), sizes)


def linked(g: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(a, b): for each odd member of a block, one of its partners in each other component."""
    g = g.sort_values("uid")
    odd, rest = g[g["odd"]], g[~g["odd"]]
    out: list[tuple[int, int]] = []
    if len(odd) and len(rest):
        sets = [np.frombuffer(x, np.int64) for x in rest["items"]]
        sizes = np.array([len(x) for x in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        roots, ids = rest["root"].to_numpy(), rest["uid"].to_numpy()
        for uid, root, data in zip(odd["uid"], odd["root"], odd["items"], strict=True):
            own = np.frombuffer(data, np.int64)
            shared = np.bincount(owner[runs(np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right"))], minlength=len(sets))
            good = np.flatnonzero((roots != root) & (100 * shared >= percent * (sizes + len(own) - shared)))
            _, one = np.unique(roots[good], return_index=True)
            out += [(uid, ids[i]) for i in good[one]]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def crossing(pairs: DataFrame, store: DataFrame, found: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between different components inside the groups of buckets that pairs (a: smallest member, b: member) describe."""
    groups = components(pairs)
    root = found.select("node", F.col("root").alias("own"))
    members = persisted(groups.join(root, "node", "left").select(F.col("node").alias("uid"), F.col("root").alias("g"), F.coalesce("own", "node").alias("root")), "members")
    mixed = members.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("g")
    open_ = persisted(hub_join(members, persisted(mixed, "mixed"), "g"), "open-members")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                own = [shingle_hashes(words_of(t), words)[0] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("uid", "g", "root")), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["uid", "g", "root", "n", "items"])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, data in zip(b.column("uid").to_pylist(), b.column("items"), strict=True):
                t = np.frombuffer(data.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), uid)), pa.array(t)], ["uid", "token"])

    texts = store.select("uid", "text").join(F.broadcast(open_) if open_.count() <= BROADCAST_IDS else open_, "uid")
    full = persisted(texts.select("uid", "g", "root", "text").mapInArrow(sets, "uid long, g long, root long, n long, items binary"), "open-sets")
    every = full.select("uid", "items").mapInArrow(tokens, "uid long, token long")
    # A shingle that one member alone has names that member: no join back.
    lone = persisted(every.groupBy("token").agg(F.min("uid").alias("uid"), F.count("*").alias("df")).where("df = 1").groupBy("uid").agg(F.count("*").alias("lone")), "lone-shingles")
    counted = persisted(full.select("uid", "g", "root", "n").join(lone, "uid", "left").withColumn("lone", F.coalesce("lone", F.lit(0))), "open-counts")
    least = persisted(counted.groupBy("g").agg(F.min("lone").alias("least")), "least-lone")
    # Of x and y at most n_x - lone_x are shared, of n_x + lone_y at least.
    may = persisted(hub_join(counted, least, "g").where(100 * (F.col("n") - F.col("lone")) >= percent * (F.col("n") + F.col("least"))).select("uid", "g", "root", "n"), "open-left")
    sizes = may.groupBy("g", "root").agg(F.count("*").alias("n"), F.sum("n").alias("s"))
    main = sizes.groupBy("g").agg(F.max(F.struct("n", "root", "s")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("top.n < n")
    parts = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    main = persisted(main.select("g", F.col("top.root").alias("main"), parts(F.col("n"), F.col("s")).alias("blocks"), parts(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("odd_blocks")), "blocks")
    dealt = hub_join(may.select("uid", "g", "root"), main, "g").withColumn("odd", F.col("root") != F.col("main"))
    place = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = dealt.select("uid", "g", "root", F.lit(False).alias("odd"), place("blocks").alias("x"), all_of("odd_blocks").alias("y"))
    odd = dealt.where("odd").select("uid", "g", "root", "odd", all_of("blocks").alias("x"), place("odd_blocks").alias("y"))
    met = rest.union(odd).join(full.select("uid", "items"), "uid")
    out = persisted(met.groupBy("g", "x", "y").applyInPandas(lambda p: linked(p, percent), "a long, b long").distinct(), "crossing")
    discard(groups, members, open_, full, lone, counted, least, may, main)
    return out


def labelled(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, t1, t2, n, root) for every row of docs; rows of one component have the same root."""
    store = persisted(sketch(docs, words), "sketch")
    sets = store.where("n > 0")
    # Tables that aggregation gives and that their own rows are joined with are written first: a join whose sides are
    # both read from a shuffle is one that adaptive execution can split where a key holds many rows.
    nodes = persisted(sets.groupBy("k1", "k2").agg(F.min("uid").alias("rep"), F.count("*").alias("size")).where("size > 1").drop("size"), "copies")
    node = F.when(F.col("n") > 0, F.coalesce("rep", "uid")).otherwise(F.col("uid")).alias("node")
    rows = persisted(store.select("uid", "doc_id", "t1", "t2", "n", "k1", "k2").join(nodes, ["k1", "k2"], "left").select("doc_id", "t1", "t2", "n", node), "sets")
    reps = sets.select("uid", "registers").join(rows.where("n > 0").select(F.col("node").alias("uid")).distinct(), "uid", "left_semi")
    width = ROWS * KIND.itemsize
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", i * width + 1, width)) for i in range(BANDS)])
    buckets = reps.select("uid", F.explode(bands).alias("bucket"))
    least = persisted(buckets.groupBy("bucket").agg(F.min("uid").alias("a"), F.count("*").alias("size")).where("size > 1").drop("size"), "buckets")
    pairs = persisted(buckets.join(least, "bucket").where("uid <> a").select("a", F.col("uid").alias("b")).distinct(), "candidates")
    direct = verified(pairs, store, words, percent)
    found = components(direct)
    across = crossing(pairs, store, found, words, percent)
    more = verified(across, store, words, percent)
    roots = components(direct.union(more)) if not more.isEmpty() else found
    out = persisted(rows.join(roots.select("node", "root"), "node", "left").select("doc_id", "t1", "t2", "n", F.coalesce("root", "node").alias("root")), "labelled")
    discard(store, nodes, rows, least, pairs, direct, across, more, *{id(x): x for x in (found, roots)}.values())
    return out


def classes(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    rows = labelled(docs, words, percent)
    names = rows.groupBy("root").agg(F.min("doc_id").alias("name"), F.count("*").alias("size")).where("size > 1").drop("size")
    names = persisted(names, "names")
    return rows.join(names, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("name", "doc_id").alias("component_id"))


def dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs per component: that of the smallest doc_id (nulls last), of equal ones that whose text hashes lowest.

    Rows without words are in no group and stay, all of them.
    """
    rows = labelled(docs, words, percent).where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2")).alias("first")
    d, x, y = (tmp_name(docs, stem) for stem in ("kept_id", "kept_t1", "kept_t2"))
    kept = rows.groupBy("root").agg(first).select(F.col("first.doc_id").alias(d), F.col("first.t1").alias(x), F.col("first.t2").alias(y))
    a, b = tmp_name(docs, "text_key1"), tmp_name(docs, "text_key2")
    keyed = docs.withColumns(dict(zip((a, b), text_key("k1", "k2"), strict=True)))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = (F.col(a) == F.col(x)) & (F.col(b) == F.col(y)) & F.col("doc_id").eqNullSafe(F.col(d))
    one = keyed.where(worded).join(kept, same, "left_semi").dropDuplicates(["doc_id", a, b])
    return one.union(keyed.where(~worded)).select(*docs.columns)


def op9_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(read_table(spark, sf_dir, "documents"), words=2)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
