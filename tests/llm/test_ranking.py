import math
import random
import re
from collections import Counter

import pytest

from barloom.llm.ranking import rank

from .conftest import LONG, ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=50):
    found = [(d, Counter(terms(t))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n_docs, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in asked.items():
        rows = []
        for d, c in found:
            m = 50 + (50 * sum(c.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                rows.append((-s, d is not None, d or 0, d))
        out += [(i, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(rows)[:top], 1)]
    return out


def rows(df):
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()]


def test_equals_brute_force(spark, docs):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Été", "été", "x9", "ÄB", "ß", "語"]
    text = lambda n: " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=n)) + rng.choice([".", "", "-end_of", "\x00z"])
    table = [(i, text(rng.randint(0, 60))) for i in range(400)] + [(i, "w1 w2 w3") for i in range(400, 470)]
    items = [(i, text(rng.randint(1, 8))) for i in range(20)] + [(20, None), (21, ""), (22, "unheard of"), (3, "w1")]
    q = spark.createDataFrame(items, "item_id int, text string")
    want = sorted(brute(table, items))
    for window, block in ((4096, 500_000), (64, 500_000), (7, 40)):
        assert sorted(rows(rank(docs(table).repartition(3), q, window=window, block_terms=block))) == want
    assert sorted(rows(rank(docs(table), q, top=3))) == sorted(brute(table, items, 3))


def test_odd_rows(spark, docs):
    table = ODD + [(9, "same text here for all of us")]
    items = [("a", "text line"), (None, "same words"), ("b", LONG), ("c", None)]
    q = spark.createDataFrame(items, "item_id string, text string")
    key = lambda r: (r[0] or "", r[1])
    assert sorted(rows(rank(docs(table), q)), key=key) == sorted(brute(table, items), key=key)
    assert rows(rank(docs([]), q)) == [] and rows(rank(docs(table), q.where("false"))) == [] and rows(rank(docs([(1, None)]), q)) == []


@pytest.mark.parametrize("name", ["documents"])
def test_postings_are_not_shuffled(spark, sf_dir, name):
    d, b = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plan = rank(d, b)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(item") <= 1 and "Exchange hashpartitioning(doc_id" not in plan and "Exchange rangepartitioning" not in plan
