import bisect
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as s
from pyspark.sql import functions as F

from barloom.llm import packing, repair
from barloom.llm.tokens import Encoder

from .conftest import ODD

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
STRANGE = ["a  b", " lead", "trail ", "a\n\nb", "a \nb", "x\ty", "", "<|endoftext|> hi", "a^b ^ c", "Don't stop 123 4567 !!! ??", "ΣΑΣ ς é İ", "\n", "a\n", "\na b", "a\x1cb c", "it's we'll\nI'd", "日本 語 😀 😀😀", " x y", "éte é", "ouan$$$ THE!! a*** b.c", "x" * 3000, "naïve Straße ŒUVRE ª º Ⅷ"]


@pytest.fixture(scope="module", params=NAMES)
def encoder(request):
    return Encoder(P.path(request.param))


def same(encoder, texts):
    got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)]
    assert got == [encoder._raw(t or "") for t in texts]


def test_encoder_equals_the_library(encoder):
    same(encoder, [*STRANGE, None, *[t for _, t in ODD]])
    same(encoder, [" ".join(STRANGE)] * 3)


@settings(max_examples=60, deadline=None)
@given(s.lists(s.text(alphabet=s.sampled_from(list("abÉßΣ12 .,'!\n\t$^|é日")), max_size=40), max_size=6))
def test_encoder_on_random_texts(texts):
    for name in NAMES:
        same(test_encoder_on_random_texts.__dict__.setdefault(name, Encoder(P.path(name))), texts)


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomial_hashes_confuse(encoder, n):
    texts = [thue_morse(n, "a", "b"), thue_morse(n, "b", "a")]
    same(encoder, texts)
    same(encoder, ["x " + t + " y" for t in texts])
    for t in texts:
        same(encoder, [t])


def best_fit_decreasing(lengths, limit):
    gaps = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else limit
        bisect.insort(gaps, gap - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(4))
def test_packing_against_sequential_best_fit(spark, seed):
    r = random.Random(seed)
    limit = 128
    kinds = [lambda: r.randrange(1, 129), lambda: r.choice([43, 44, 85, 40]), lambda: min(128, int(r.expovariate(1 / 30)) + 1), lambda: 50 if r.random() < 0.5 else r.randrange(1, 70)]
    lengths = [kinds[seed]() for _ in range(3000)]
    seen = Counter()
    rows = []
    for i, n in enumerate(lengths):
        rows.append((i, 0, 0, n, 0, i % 3, seen[i % 3, n]))
        seen[i % 3, n] += 1
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long")
    got = packing.pack(pieces, limit).collect()
    assert sorted((x.doc_id, x.length) for x in got) == list(enumerate(lengths))
    fill = {}
    for x in got:
        fill.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    assert len(fill) <= 1.03 * best_fit_decreasing(lengths, limit) + 1


def test_packing_against_the_library(spark, docs):
    path = P.path(NAMES[1])
    table = docs(ODD)
    rows = packing.pack_documents(table, path, limit=64, keep_ids=True)
    encoder = Encoder(path)
    want = []
    for d, t in ODD:
        ids = np.array([*encoder._raw(t or ""), 0], "<u4")
        want += [(d, p, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for p, a in enumerate(range(0, len(ids), 64))]
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows.collect()]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(got, key=key) == sorted(want, key=key)
    packed = packing.sequences(rows).collect()
    assert all(len(r.ids) <= 64 for r in packed) and sum(len(r.ids) for r in packed) == sum(x[3] for x in want)
    assert packing.pack_documents(table.limit(0), path).count() == 0


@settings(max_examples=40, deadline=None)
@given(s.lists(s.lists(s.integers(0, 6), max_size=60), min_size=1, max_size=12), s.sampled_from([300, 70_000]))
def test_repair_round_trip(texts, terminals):
    sizes = np.array([len(t) for t in texts])
    ids = np.array([x for t in texts for x in t], np.uint32)
    shard = repair.Shard(repair.compress(ids, sizes, terminals, min_count=2))
    assert shard.ids().tolist() == ids.tolist() and shard.sizes.tolist() == sizes.tolist()
    for _ in range(5):
        a, n = random.randrange(len(ids) + 1), random.randrange(1, 20)
        assert shard.range(a, n).tolist() == ids[a : a + n].tolist()


def test_repair_makes_rules_and_keeps_documents_apart():
    ids = np.array([1, 2, 3, 4] * 500 + [9], np.uint32)
    shard = repair.Shard(repair.compress(ids, np.array([2000, 1]), 10))
    assert len(shard.symbols) < 400 and shard.per_doc.sum() == len(shard.symbols) and shard.per_doc[1] == 1


@pytest.mark.parametrize("terminals", [500, 65_000])
def test_repair_leaves_no_frequent_pair(terminals):
    r = np.random.default_rng(3)
    passage = r.integers(0, 500, 300)
    ids = np.concatenate([np.concatenate([passage, r.integers(0, 500, 50)]) for _ in range(400)]).astype(np.uint32)
    shard = repair.Shard(repair.compress(ids, np.array([350] * 400), terminals))
    assert shard.ids().tolist() == ids.tolist() and shard.range(1234, 999).tolist() == ids[1234:2233].tolist()
    ends = set((np.cumsum(shard.per_doc) - 1).tolist())
    pairs = Counter((a, b) for i, (a, b) in enumerate(itertools.pairwise(shard.symbols.tolist())) if i not in ends)
    assert max(pairs.values()) < repair.MIN_COUNT and shard.lengths.max() >= 300


def test_shards_in_ascending_order(spark, docs):
    path = P.path(NAMES[0])
    table = docs(ODD)
    shards = repair.write_shards(table, path, shard_ids=200)
    assert shards.count() > 1
    rows = repair.read_shards(shards).orderBy("start").collect()
    encoder = Encoder(path)
    want = {}
    for d, t in ODD:
        ids = np.array([*encoder._raw(t or ""), 0], "<u4")
        want.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    got = {}
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert repair.read_shards(repair.write_shards(table.limit(0), path)).count() == 0
    assert shards.where(F.size("doc_ids") == 0).count() == 0


#: Every character that Python or the vocabularies take for white space.
BLANKS = [chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


@pytest.mark.parametrize("name", NAMES)
def test_ids_of_every_white_space_run(name):
    encoder = Encoder(P.path(name))
    same = lambda t: np.frombuffer(encoder.encode([t])[0], encoder.kind).tolist() == encoder._raw(t)
    for a, b in itertools.product(BLANKS, repeat=2):
        assert same(f"a{a}{b}b") and same(f"a\n{a}{b}b") and same(f"a {a}b{b}\nc") and same(f"{a}a b{b}")
    r = random.Random(9)
    for _ in range(5000):
        assert same("".join(r.choice([*BLANKS, "\n", " ", " ", "a", "é", "Wort.", "b1"]) for _ in range(r.randint(1, 10))))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_shards_are_smaller_than_plain_packed_ids(sf):
    import pyarrow.parquet as pq

    encoder = Encoder(P.path("byte_bpe_50k.json"))
    texts = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"]).column("text").to_pylist()[:1500]
    held = [x + np.array([0], encoder.kind).tobytes() for x in encoder.encode(texts)]
    sizes = np.array([len(x) // encoder.kind.itemsize for x in held])
    ids = np.frombuffer(b"".join(held), encoder.kind)
    vocabulary = encoder.tokenizer.get_vocab_size()
    payload = repair.compress(ids, sizes, vocabulary)
    assert len(payload) < 0.75 * len(repair.pack(ids, (vocabulary - 1).bit_length()))
    shard = repair.Shard(payload)
    assert (shard.ids() == ids).all()
    uses = np.bincount(np.concatenate([shard.symbols[shard.symbols >= vocabulary], shard.rules[shard.rules >= vocabulary]]) - vocabulary, minlength=len(shard.rules))
    alone = np.bincount(shard.symbols[shard.symbols >= vocabulary] - vocabulary, minlength=len(shard.rules))
    assert uses.min() >= 1 and not ((uses == 1) & (alone == 1)).any()


def test_bits():
    r = np.random.default_rng(1)
    for bits in (1, 7, 9, 16, 17, 31):
        x = r.integers(0, 1 << bits, 1003).astype(np.uint32)
        data = repair.pack(x, bits)
        assert len(data) == -(-1003 * bits // 8) and repair.unpack(data, 0, 1003, bits)[0].tolist() == x.tolist()
    assert repair.unpack(b"", 0, 0, 9)[0].tolist() == []


def test_packing_reads_all_rounds_in_one_small_plan(spark):
    lengths = [random.Random(4).randint(1, 63) for _ in range(600)]
    pieces = spark.createDataFrame([(i, 0, 0, n, 0, 0, sum(m == n for m in lengths[:i])) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long")
    out = packing.pack(pieces, limit=64)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 5 and plan.count("BroadcastHashJoin") <= 3  # of some twenty rounds
    held = Counter()
    for r in out.collect():
        held[r.sequence_id] += r.length
    assert out.count() == 600 and sum(held.values()) == sum(lengths) and max(held.values()) <= 64


def test_levels_are_brackets():
    # gaps 9, 9, 5 and pieces 9, 6, 6, 5: of the two gaps of 9 one takes the 9, one a 6; the 5 takes the gap of 5.
    assert packing.levels({9: 2, 5: 1}, {9: 1, 6: 2, 5: 1}) == ({9: 0, 5: 0}, {9: (2, 1), 6: (1, 1), 5: (1, 1)})
    assert packing.levels({}, {3: 2}) == ({}, {3: (0, 0)})


def test_a_word_is_kept_once_whatever_follows_it(encoder):
    own = Encoder(P.path(NAMES[0] if encoder.spaced else NAMES[1]))
    same(own, ["a foo foo, foo;", "été ΣΑΣ, straße. ½x é,"])
    own = Encoder(P.path(NAMES[0] if encoder.spaced else NAMES[1]))
    own.encode(["a foo foo, foo;"])
    tables = [t for v in vars(own).values() for t in (v if isinstance(v, list) else [v]) if isinstance(t, dict) and t is not own.tails]
    assert sum(map(len, tables)) == 4  # a, foo, and foo with either mark
