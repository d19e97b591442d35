import hashlib
import itertools
import math
import random
import re
import struct
import textwrap
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import decontaminate as dc
from barloom.llm import licenses, line_dedup, mpeg, quality, toxicity, url_rules

from .conftest import ODD


# Decontamination ----------------------------------------------------------------------------------------------------
def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_scan(rows, items, n=13):
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            k = min(n, len(v))
            grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
            for i in range(len(w) - k + 1 if k else 0):
                if tuple(w[i : i + k]) in grams:
                    hit.update(range(i, i + k))
                    found.add("" if item is None else str(item))
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


ITEMS = [(1, "Alpha beta, gamma."), (2, " ".join(f"t{i}" for i in range(20))), (3, None), (4, "..."), (10, "Alpha beta, gamma."), (2, "one"), (None, "same text here")]


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_scan_equals_brute_force(spark, docs, broadcast):
    r = random.Random(1)
    rows = [*ODD, (20, "x ALPHA beta gamma y alpha beta gamma beta gamma"), (21, " ".join(f"t{i}" for i in range(3, 19))), (22, " ".join(f"T{i}" for i in range(40)))]
    rows += [(30 + i, " ".join(r.choice(["alpha", "beta", "gamma", "one", *[f"t{j}" for j in range(20)]]) for _ in range(60))) for i in range(20)]
    found = dc.scan(docs(rows), spark.createDataFrame(ITEMS, "item_id long, text string"), broadcast_grams=broadcast)
    assert sorted(((x.doc_id, x.n_words, x.n_hit, x.item_ids) for x in found.collect()), key=str) == brute_scan(rows, ITEMS)


def test_decontaminate_documents_and_spans(spark, docs):
    item = spark.createDataFrame([(2, ITEMS[1][1])], "item_id long, text string")
    rows = [*ODD, (22, "before " + ITEMS[1][1] + " after"), (23, " ".join(f"z{i}" for i in range(900)) + " " + ITEMS[1][1])]
    table = docs(rows)
    kept = dc.decontaminate(table, item)
    assert kept.columns == table.columns and kept.count() == len(rows) - 1 and kept.where("doc_id = 22").count() == 0
    cut = {r.doc_id: r.text for r in dc.decontaminate(table, item, action="span").where("doc_id > 20").collect()}
    assert cut == {22: "before after", 23: " ".join(f"z{i}" for i in range(900))}
    assert dc.decontaminate(table.limit(0), item).count() == 0 and dc.decontaminate(table, item.limit(0)).count() == len(rows)


# Lines --------------------------------------------------------------------------------------------------------------
def brute_lines(rows, min_sites):
    sites, first = {}, {}
    for d, t, site in rows:
        for i, x in enumerate((t or "").split("\n")):
            if x.strip(" "):
                key = re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" "))
                sites.setdefault(key, set()).add(site)
                first.setdefault(key, []).append((d, i))
    bad = {k: min(first[k]) for k, v in sites.items() if len(v) >= min_sites}
    out = []
    for d, t, _ in rows:
        if t is None:
            out.append((d, None, 0))
            continue
        parts = t.split("\n")
        key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" "))
        kept = [x for i, x in enumerate(parts) if not (x.strip(" ") and key(x) in bad and bad[key(x)] != (d, i))]
        out.append((d, "\n".join(kept), len(parts) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_sites", [2, 5, 8])
def test_lines_equal_brute_force(docs, min_sites):
    r = random.Random(2)
    pool = [f"Shared line {i}" for i in range(12)]
    rows = [(i, "\n".join(r.choice([*pool, f"own {i}", "", " shared LINE 3 "]) for _ in range(r.randrange(1, 9))), f"s{r.randrange(9)}") for i in range(120)]
    rows += [(500, None, "s1"), (501, "", "s2"), (502, "  \n ", "s3")]
    table = docs(rows)
    out = line_dedup.dedup_lines(table, min_sites=min_sites)
    assert out.columns == [*table.columns, "n_lines", "n_removed"]
    assert sorted(((x.doc_id, x.text, x.n_removed) for x in out.collect()), key=str) == brute_lines(rows, min_sites)


def test_lines_odd_rows(docs):
    table = docs(ODD)
    out = line_dedup.dedup_lines(table, min_sites=2)
    assert out.count() == len(ODD) and out.where("text is null").count() == 1
    assert line_dedup.dedup_lines(table.limit(0)).count() == 0


# URLs ---------------------------------------------------------------------------------------------------------------
URLS = [("https://WWW.Example.COM/en/71?x", "www.example.com", "/en/71", "example.com/en/7", "allow"), ("http://a.com/en/1", "a.com", "/en/1", "com/en/", "block"), ("http://x.net/de/9", "x.net", "/de/9", "net/de/", "allow"), ("http://example.net/de/81#f", "example.net", "/de/81", "example.net/de/8", "block"), ("http://o.org/es/", "o.org", "/es/", "org/es/", "block"), ("http://notcom/en/1", "notcom", "/en/1", None, "allow"), (None, "", "", None, "allow"), ("no scheme/en/", "", "", None, "allow"), ("http://b.com?q=/en/", "b.com", "", None, "allow"), ("ftp://c.com#/en/", "c.com", "", None, "allow")]


def test_fixed_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string")
    out = url_rules.judge(pages, spark.createDataFrame([], "page_id long, blocked int"))
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()), key=str)
    assert got == sorted([(i, *u[1:]) for i, u in enumerate(URLS)] * 2, key=str)
    assert url_rules.judge(pages.limit(0), spark.createDataFrame([], "page_id long, blocked int")).count() == 0


def brute_rules(rows, p):
    n = len(rows)
    counts, bad = {}, {}
    for items, y in rows:
        for k in range(1, len(items) + 1):
            for c in itertools.combinations(sorted(items), k):
                counts[c] = counts.get(c, 0) + 1
                bad[c] = bad.get(c, 0) + y
    base = sum(y for _, y in rows) / n
    least = max(p.min_support, min(1.0, p.min_count / n))
    # Token sets tried: tokens that can be in a rule, those of the same rows as one, and the label.
    where = {}
    for i, (items, _) in enumerate(rows):
        for t in items:
            where.setdefault(t, set()).add(i)
    one = {min(t for t in where if where[t] == own): own for t, own in where.items() if sum(rows[i][1] for i in own) / n >= least - 1e-12}
    one["="] = {i for i, (_, y) in enumerate(rows) if y}
    tried = sum(len(set.intersection(*[one[t] for t in c])) / n >= least - 1e-12 for k in range(1, 8) for c in itertools.combinations(one, k))

    def significant(c):
        share = min(bad[c] / counts[c], 1 - 1e-12)
        return counts[c] * (share * math.log(share / base) + (1 - share) * math.log((1 - share) / (1 - base))) >= math.log(tried / p.alpha)

    good = {c: bad[c] / counts[c] for c in counts if bad[c] / n >= least - 1e-12 and bad[c] / counts[c] >= p.min_confidence and bad[c] / counts[c] / base >= p.min_lift and significant(c)}
    return {c for c in good if not any(set(o) < set(c) and good[o] >= good[c] for o in good)}


def test_mined_rules_equal_brute_force(spark):
    r = random.Random(4)
    rows = []
    for _ in range(400):
        items = sorted({r.choice("abcdef") for _ in range(3)})
        rows.append((items, int(r.random() < (0.95 if {"a", "b"} <= set(items) else 0.1))))
    p = url_rules.RuleParams(min_support=0.01)
    mined = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, blocked int"), p)
    assert {tuple(x.rule_tokens) for x in mined.collect()} == brute_rules(rows, p) != set()
    urls = spark.createDataFrame([(i, x[0]) for i, x in enumerate(rows)], "page_id long, tokens array<string>")
    want = {i for i, (items, _) in enumerate(rows) if any(set(c) <= set(items) for c in brute_rules(rows, p))}
    assert {x.page_id for x in url_rules.match(urls, mined, "page_id", p).collect()} == want


def test_chance_makes_no_rules(spark):
    """Labels that say nothing of the tokens: thousands of token sets, some blocked by chance alone."""
    r = random.Random(12)
    rows = [(sorted({f"t{r.randint(0, 40)}" for _ in range(6)}), int(r.random() < 0.15)) for _ in range(1500)]
    p = url_rules.RuleParams(min_support=0.001)
    df = spark.createDataFrame(rows, "tokens array<string>, blocked int")
    assert url_rules.mine(df, p).count() == 0
    assert url_rules.mine(df, url_rules.RuleParams(min_support=0.001, alpha=1e9)).count() > 5


def test_rules_that_fail_in_the_held_out_fold_go(spark):
    rules = spark.createDataFrame([("a", ["a"], 0.9, 2.0, 0.1), ("b & c", ["b", "c"], 0.9, 2.0, 0.1), ("d", ["d"], 0.9, 2.0, 0.1)], "rule_id string, rule_tokens array<string>, confidence double, lift double, support double")
    held = spark.createDataFrame([(["a", "x"], 1)] * 9 + [(["a"], 0)] + [(["b", "c"], 0), (["b", "c", "x"], 1), (["b"], 1)], "tokens array<string>, blocked int")
    got = {r.rule_id: (r.held_hits, r.held_blocked) for r in url_rules.confirmed(held, rules).collect()}
    assert got == {"a": (10, 9), "d": (0, 0)}


def test_ordinary_urls_are_let_through(spark):
    """At sf0.1 the text labels say nothing of URLs: what is mined may block few URLs that no rule and no seed term concerns."""
    d = "/root/testdata/sf0.1"
    out = url_rules.op7_url_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("page_id"), "quality"), "page_id", "left").collect()
    plain = [r for r in out if r["rule"] is None and not set(re.split("[.-]", r.host)) & set(url_rules.SEED_TERMS)]
    good = [r for r in plain if r.quality == 1]
    assert len(good) > 300 and sum(r.verdict == "block" for r in good) < 0.02 * len(good) and sum(r.verdict == "block" for r in plain) < 0.02 * len(plain)


def test_urls_of_many_tokens_are_mined_and_matched_whole(spark):
    deep = "/".join(f"d{chr(97 + i)}" for i in range(24))
    keys = lambda i: "&".join([*(f"k{i}x{j}=1" for j in range(20)), "track=1"])
    rows = [(i, f"http://a.info/{deep}/p?{keys(i)}#z" if i % 2 else f"http://a.info/{deep}/p?{keys(i)[:-8]}", i % 2) for i in range(80)]
    pages = spark.createDataFrame([r[:2] for r in rows] + [(500, f"http://b.info/{'x/' * 30}?{keys(500)}"), (501, f"http://b.info/{'x/' * 30}?a")], "page_id long, url string")
    out = {r.page_id: (r.verdict, r.mined_rule) for r in url_rules.judge(pages, spark.createDataFrame([(r[0], r[2]) for r in rows], "page_id long, blocked int")).collect()}
    assert all(out[i] == (("block", "q:track") if i % 2 else ("allow", None)) for i, _, _ in rows)
    assert out[500] == ("block", "q:track") and out[501] == ("allow", None)


def test_mined_rules_of_inseparable_tokens_equal_brute_force(spark):
    r = random.Random(8)
    rows = []
    for _ in range(400):
        drawn = {r.choice("abcdef") for _ in range(3)}
        items = drawn | set("A" if "a" in drawn else "") | set("BC" if "b" in drawn else "") | ({f"rare{r.random()}"} if r.random() < 0.3 else set())
        rows.append((sorted(items), int(r.random() < (0.9 if {"a", "b"} <= items else 0.1))))
    p = url_rules.RuleParams(min_support=0.01)
    mined = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, blocked int"), p)
    want = brute_rules(rows, p)
    assert {tuple(x.rule_tokens) for x in mined.collect()} == want and ("A", "C") in want


def test_the_query_mines_rules(spark):
    pages = spark.createDataFrame([(i, f"http://{h}/p/{i}") for i, h in enumerate(["a.cheap-pills.info", "www.fine.info"] * 20)] + [(90, "https://b.cheap-pills.info/"), (91, "https://spammer.info/")], "page_id long, url string")
    judged = {r.page_id: (r.verdict, r.rule, r.mined_rule) for r in url_rules.judge(pages, spark.createDataFrame([(i, 0) for i in range(1, 40, 2)], "page_id long, blocked int")).collect()}
    assert judged[90] == ("block", None, "h2:cheap-pills") and judged[0][0] == "block" and judged[1] == judged[91] == ("allow", None, None)


# Media --------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 1, 23, 191, 937, 938, 5000])
def test_media_round_trip(n):
    payload = random.Random(n).randbytes(n)
    s = mpeg.parse(mpeg.store(payload))
    assert s.payload == payload and s.crc_bad == 0 and s.skipped == 0 and s.vbr == "Xing" and s.vbr_frames == s.frames == len(s.offsets)
    assert s.samples == 1152 * s.frames


def test_media_resynchronises_and_checks():
    payload = b"abc" * 900
    whole = mpeg.store(payload)
    start = mpeg.parse(whole).offsets[0]
    noise = b"\xff\xfb\x90\x00junk\xff\xe0" + whole[:start] + b"\0garbage\xff" + whole[start:] + b"TAG" + b"title".ljust(125, b"\0")
    s = mpeg.parse(noise)
    assert s.payload[-2700:] == payload or payload in s.payload
    assert s.skipped > 0 and s.tags["id3v1"] == "title"
    broken = bytearray(whole)
    broken[start + 8] ^= 1
    assert mpeg.parse(bytes(broken)).crc_bad == 1
    assert mpeg.parse(None).frames == 0 and mpeg.parse(b"no audio").payload == b""
    assert mpeg.crc16(b"123456789") == 0xAEE7


def test_media_payload_may_hold_a_tag_mark():
    for n in (192, 384, 960, 1920):
        size = len(mpeg.store(bytes(n)))
        for at in range(n - 2):
            if n > 384 and not n - 130 <= at <= n:
                continue
            payload = b"x" * at + b"TAG" + b"y" * (n - at - 3)
            media = mpeg.store(payload)
            s = mpeg.parse(media)
            assert len(media) == size and s.payload == payload and s.skipped == 0 and "id3v1" not in s.tags
            tagged = mpeg.parse(media + b"TAG" + b"title".ljust(125, b"\0"))
            assert tagged.payload == payload and tagged.skipped == 0 and tagged.tags["id3v1"] == "title"
    assert mpeg.describe(mpeg.store(bytes(5000))[:-400])["payload_missing"] > 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=40), st.sampled_from([b"TAG", b"ID3\x03\0\0\0\0\0\x0a", b"Xing\0\0\0\x0f", b"VBRI", b"\xff\xfa\x14\xc0", b"\xff", b"\xff\xfb\x90\0" * 3])), max_size=60))
def test_media_payload_may_be_anything(parts):
    payload = b"".join(parts)
    s = mpeg.parse(mpeg.store(payload))
    assert s.payload == payload and not s.skipped and not s.crc_bad and not s.seek_bad


@pytest.mark.parametrize("mark", [b"TAG", b"ID3", b"Xing", b"VBRI", b"\xff\xfa\x14\xc0"])
def test_marks_at_every_place(mark):
    for at in range(193 - len(mark)):
        payload = b"a" * at + mark + b"a" * (192 - at - len(mark))
        s = mpeg.parse(mpeg.store(payload))
        assert s.payload == payload and not s.skipped and s.frames == 1


def test_media_prefixes_and_short_frames():
    whole = mpeg.store(b"0123456789" * 60)
    for n in range(len(whole)):
        mpeg.describe(whole[:n])
    short = bytes((0xFF, 0xF3, 0x10, 0xC0))  # MPEG-2 layer III, 8 kbit/s: a frame of 26 bytes
    length = mpeg.header(short).length
    for mark in (b"Xing", b"Info"):
        frame = (short + bytes(9) + mark).ljust(length, b"\xff")
        for n in range(len(frame) + 1):
            mpeg.parse(frame[:n])


def layered(word, fill):
    """A protected frame of the header word whose checksum holds, and the same with one covered bit changed."""
    h = mpeg.header(word)
    body = (fill * h.length)[: h.length - 6]
    n = mpeg.covered_bits(h, body)
    crc = mpeg.crc16(word[2:] + body[: (n + 7) // 8], 16 + n)
    bad = bytearray(body)
    bad[0] ^= 0x80
    return word + crc.to_bytes(2) + body, word + crc.to_bytes(2) + bytes(bad), n


@pytest.mark.parametrize("word,bits", [(b"\xff\xfe\x54\xc0", 128), (b"\xff\xfe\x54\x00", 256), (b"\xff\xfe\x54\x40", 4 * 36), (b"\xff\xfc\xa4\xc0", 4 * 11 + 3 * 12 + 2 * 4), (b"\xff\xfc\xa4\x00", 2 * (4 * 11 + 3 * 12 + 2 * 4)), (b"\xff\xf4\x84\xc0", 4 * 4 + 3 * 7 + 2 * 19)])
def test_checksums_of_layers_one_and_two(word, bits):
    good, bad, n = layered(word, b"\0")
    assert n == bits
    assert mpeg.parse(good * 3).crc_bad == 0 and mpeg.parse(good + bad + good).crc_bad == 1
    good, bad, n = layered(word, b"\xff")  # every allocation chosen: layer II adds two bits for each
    assert n > bits or mpeg.header(word).layer == 1
    assert mpeg.parse(good * 3).crc_bad == 0 and mpeg.parse(good + bad + good).crc_bad == 1


def test_tags_and_tables():
    frame = mpeg.frame(9, b"")
    two_four = lambda key, value: key + mpeg.syncsafe(len(value)) + b"\0\0" + value
    body = two_four(b"TIT2", b"\1" + "Ünïcode".encode("utf-16")) + two_four(b"TPE1", b"\3" + "é".encode() * 100)
    s = mpeg.parse(b"ID3\x04\0\0" + mpeg.syncsafe(len(body)) + body + frame * 2)
    assert s.tags == {"TIT2": "Ünïcode", "TPE1": "é" * 100} and s.frames == 2 and not s.skipped
    old = b"TT2" + (6).to_bytes(3) + b"\0short"
    assert mpeg.parse(b"ID3\x02\0\0" + mpeg.syncsafe(len(old)) + old + frame * 2).tags == {"TT2": "short"}
    only_bytes = mpeg.frame(9, b"Xing" + (2).to_bytes(4) + (4 * len(frame)).to_bytes(4))
    s = mpeg.parse(only_bytes + frame * 3)
    assert s.vbr == "Xing" and s.vbr_frames is None and s.vbr_bytes == 4 * len(frame) and s.frames == 3
    lies = mpeg.frame(9, b"Xing" + struct.pack(">III", 7, 300, 301 * len(frame)) + bytes(100))
    s = mpeg.parse(lies + frame * 300)
    assert s.seek_bad > 90 and not mpeg.parse(mpeg.store(bytes(200_000))).seek_bad
    points = struct.pack(">HHHIIHHHH", 1, 0, 0, 11 * len(frame), 10, 5, 1, 2, 2) + struct.pack(">5H", *[2 * len(frame)] * 5)
    vbri = (mpeg.frame(9, b"")[:36] + b"VBRI" + points).ljust(len(frame), b"\0")
    s = mpeg.parse(vbri + frame * 10)
    assert s.vbr == "VBRI" and s.vbr_frames == 10 and len(s.seeks) == 5 and not s.seek_bad


def test_media_table(docs):
    rows = mpeg.features(mpeg.encode(docs(ODD))).collect()
    want = sorted(((d, len((t or "").encode()), hashlib.sha256(mpeg.padded(t)).hexdigest()) for d, t in ODD), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.payload_sha256) for r in rows), key=str) == want
    assert all(r.payload_bytes % 192 == 0 and r.payload_bytes > 0 for r in rows)
    assert mpeg.features(mpeg.encode(docs(ODD).limit(0))).count() == 0


# Classifiers --------------------------------------------------------------------------------------------------------
def test_fold():
    assert toxicity.fold("1d10t ІDІОT  M0r0n, c1@wn!") == " idiot idiot moron ciawn "
    assert toxicity.fold(None) == "  "


def test_exception_phrases_cancel_hits():
    a = toxicity.automaton({" trash ": 3.0, " tras": 2.0}, [" trash can "])
    assert toxicity.hits(" some trash here ", a) == (3.0, 3.0, 1)
    assert toxicity.hits(" the trash can ", a)[2] == 0


def test_toxicity_held_out(spark, docs):
    r = random.Random(5)
    clean = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        t = [r.choice(clean) for _ in range(30)]
        y = int(i % 6 == 0)
        if y:
            t[r.randrange(30)] = r.choice(["sl1mebag", "slimebag", "SLIMEBAG", "slimebags"])
        rows.append((i, " ".join(t)))
        labels.append((i, 1, y))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score(docs(rows), lab).collect()
    held = [r for r in out if r.held_out]
    assert held and all(r.predicted == int(r.doc_id % 6 == 0) for r in held) and all(0 <= r.score <= 1 for r in out)
    odd = toxicity.score(docs(ODD), lab.limit(0))
    assert odd.count() == len(ODD) and {r.score for r in odd.collect()} == {0.0}
    assert toxicity.score(docs(ODD).limit(0), lab).count() == 0


def test_quality_held_out_and_shrinkage(spark, docs):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        y = int(i % 4 != 0)
        t = " ".join(r.choice(["plain", "words", "here", "and", "there"]) + ("" if y else r.choice(["%%%", "***", "$$$"])) for _ in range(40))
        rows.append((i, t, f"site{i % 5}"))
        labels.append((i, y, 0))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    table = docs(rows)
    out = quality.score(table, lab, *quality.site_columns()).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 4 != 0) for r in out if r.held_out)
    assert all(0 < r.path_prior < 1 for r in out)
    kept = quality.accept(table, lab, *quality.site_columns())
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i in range(600) if i % 4}
    assert quality.accept(docs(ODD), lab.limit(0), *quality.site_columns()).count() == len(ODD)
    assert quality.accept(docs(ODD).limit(0), lab, *quality.site_columns()).count() == 0


def brute_quality_priors(rows, ys):
    """(host_prior, path_prior) by row of (host, path), ys holding a label or None."""
    share = lambda n, good, parent, k: (good + k * parent) / (n + k)
    known = [(h, p, y) for (h, p), y in zip(rows, ys, strict=True) if y is not None]
    mean = (sum(y for *_, y in known) + 0.5) / (len(known) + 1)

    def tally(key):
        out = {}
        for x in known:
            n, good = out.get(key(x), (0, 0))
            out[key(x)] = (n + 1, good + x[2])
        return out

    def kappa(sites, parents):
        spread = sum(n * (g / n - parents[s]) ** 2 for s, (n, g) in sites.items())
        chance = {s: parents[s] * (1 - parents[s]) for s in sites}
        total = sum(n for n, _ in sites.values())
        between = (spread - sum(chance.values())) / total
        return min(1e6, max(1.0, sum(sites[s][0] * c for s, c in chance.items()) / total / between - 1)) if between > 0 else 1e6

    hosts, paths = tally(lambda x: x[0]), tally(lambda x: x[:2])
    k1 = kappa(hosts, {h: mean for h in hosts})
    k2 = kappa(paths, {s: share(*hosts[s[0]], mean, k1) for s in paths})
    out = []
    for (h, p), y in zip(rows, ys, strict=True):
        own = (0, 0) if y is None else (1, y)
        up = share(*(a - b for a, b in zip(hosts.get(h, (0, 0)), own)), mean, k1)
        out.append((up, share(*(a - b for a, b in zip(paths.get((h, p), (0, 0)), own)), up, k2)))
    return out


def test_quality_priors_equal_brute_force(spark):
    r = random.Random(9)
    rows, ys = [], []
    for i in range(1500):
        h = r.choice("abcdef") if i % 10 else f"rare{i}"
        p = r.choice("xyz")
        held = zlib.crc32(str(i).encode()) % 5 == 0
        y = int(r.random() < {"a": 0.9, "b": 0.2}.get(h, 0.6) * (0.5 if p == "z" else 1.0))
        rows.append((h, p))
        ys.append(None if held or r.random() < 0.3 else y)
    table = spark.createDataFrame([(i, "text of one kind" if i % 2 else "other %% words", h, p) for i, (h, p) in enumerate(rows)], "doc_id long, text string, h string, p string")
    labels = spark.createDataFrame([(i, y, 0) for i, y in enumerate(ys) if y is not None], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.score(table, labels, F.col("h"), F.col("p")).collect()}
    want = brute_quality_priors(rows, ys)
    assert all(abs(got[i].host_prior - a) < 1e-9 and abs(got[i].path_prior - b) < 1e-9 for i, (a, b) in enumerate(want))
    assert max(b for _, b in want) - min(b for _, b in want) > 0.4
    odds = lambda p: math.log(p / (1 - p))
    assert all(abs(odds(x.score) - x.evidence - odds(x.path_prior)) < 1e-6 for x in got.values())


def test_toxicity_lexicon_and_hits_equal_brute_force(spark):
    r = random.Random(11)
    words = [f"w{chr(97 + i)}{chr(97 + i % 7)}" for i in range(26)] + ["an", "x", "L0ngw0rd" * 8]
    bad = ["sl1me", "slimer", "an", "L0ngw0rd" * 8]
    rows = []
    for i in range(500):
        t = [r.choice(words) for _ in range(25)]
        y = int(i % 5 == 0)
        if y:
            t[r.randrange(25)] = r.choice(bad[:2])
            t[3] = bad[3]
        elif i % 3 == 0:
            t[4:6] = ["good", "slime"]
        rows.append((" ".join(t), y))
    train = spark.createDataFrame(rows, "text string, y int")
    n1 = sum(y for _, y in rows)
    lexicon = toxicity.lexicon(train, n1, 500 - n1)
    counts = {}
    for t, y in rows:
        for term in {f" {w} " for w in toxicity.fold(t).split()} | {" " + w[:k] for w in toxicity.fold(t).split() for k in toxicity.PREFIXES if len(w) > k}:
            a, b = counts.get(term, (0, 0))
            counts[term] = (a + 1, b + y)
    want = {}
    for term, (n, k) in counts.items():
        share, base = k / n, n1 / 500
        g = 2 * n * (share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0)) if k else 0
        if k >= toxicity.MIN_DOCS and share > base and g >= 2 * math.log(len(counts)):
            want[term] = math.log(((k + 0.5) / (n1 + 1)) / ((n - k + 0.5) / (500 - n1 + 1)))
    assert want.keys() == lexicon.keys() and all(abs(want[t] - lexicon[t]) < 1e-9 for t in want)
    assert any(len(t) > 60 for t in lexicon)
    exceptions = toxicity.phrases(train, lexicon, n1 / 500)
    automaton = toxicity.automaton(lexicon, exceptions)
    for t, _ in rows:
        folded = toxicity.fold(t)
        starts = {i: max(w for term, w in lexicon.items() if folded.startswith(term, i)) for i in range(len(folded)) if any(folded.startswith(term, i) for term in lexicon)}
        spared = {k for e in exceptions for i in range(len(folded)) if folded.startswith(e, i) for k in range(i, i + len(e) - 1)}
        left = [w for i, w in starts.items() if i not in spared]
        total, most, n = toxicity.hits(folded, automaton)
        assert n == len(left) and abs(total - sum(left)) < 1e-9 and most == max(left, default=0.0)


def test_licenses(docs):
    text = "Some ordinary words about nothing much\nReleased under the MIT License.\nmore of them"
    rows = [(1, text), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "licence plates and public works of the general"), (4, "Licensed under CC BY-NC 4.0."), (5, None), (6, "")]
    rows += [(100 + i, f"filler paragraph {i} with various terms") for i in range(50)]
    model = licenses.train(docs(rows))
    found = {r.doc_id: [x.family for x in r.found if x.family != "unknown"] for r in licenses.scan(docs(rows), model).collect()}
    assert (found[1], found[2], found[3], found[4], found[5], found[6]) == (["mit"], ["gpl"], [], ["cc-by-nc"], [], [])
    assert not any(found[100 + i] for i in range(50))
    right = [(f, model.classify(t)) for f, t in licenses.made(licenses.TEMPLATES, [f"foreign{i} speech" for i in range(99)], 99)]
    known = [(f, g) for f, g in right if f != licenses.NONE]
    assert sum(g is not None and g[0] == f for f, g in known) > 0.9 * len(known)
    assert sum(g is not None and g[0] not in (f, "unknown") for f, g in right) < 0.02 * len(right)
    assert licenses.scan(docs(ODD), model).count() == len(ODD) and licenses.scan(docs(ODD).limit(0), model).count() == 0


NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "apache-2.0": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
}


def test_licenses_wrapped_and_embedded(docs):
    prose = "lorem dolor amet consetetur sadipscing elitr nonumy eirmod tempor invidunt labore"
    rows, want = [], {}
    for family, notice in sorted(NOTICES.items()):
        for width in (40, 72, 80):
            wrapped = textwrap.wrap(notice, width)
            for form in ("\n".join(wrapped), "/*\n" + "\n".join(f" * {x}" for x in wrapped) + "\n */\ncode here", f"{prose}\n" + "\n".join(f"# {x}" for x in wrapped) + f"\n{prose}", f"{prose * 9} {notice} {prose * 9}"):
                want[len(rows)] = [family]
                rows.append((len(rows), form))
    rows += [(1000 + i, f"{prose} {i}\nmore of the words in use {i}\n\nor {prose}") for i in range(50)]
    model = licenses.train(docs(rows))
    found = {r.doc_id: (r.n_paragraphs, sorted({x.family for x in r.found if x.family != "unknown"})) for r in licenses.scan(docs(rows), model).collect()}
    assert {d: found[d][1] for d in want} == want
    assert all(found[1000 + i] == (2, []) for i in range(50))


def test_readers_of_labels_ignore_nulls(spark, docs):
    lab = spark.createDataFrame([(None, None, None), (1, None, 1), (2, 0, None), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs(ODD), lab).count() == len(ODD)
    assert quality.score(docs(ODD), lab, F.lit(None).cast("string"), F.lit("p")).count() == len(ODD)
