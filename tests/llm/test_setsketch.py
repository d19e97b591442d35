import random
import re

import numpy as np
import pytest

from barloom.llm import setsketch as ss
from barloom.llm.components import components

from .conftest import ODD


def word_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute(rows, k, percent=80):
    sets = [word_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        names[r] = d if names.get(r) is None else names[r] if d is None else min(names[r], d)
    return sorted(((d, len(sets[i]), names[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("k", [2, 5])
def test_odd_rows(docs, k):
    assert got(ss.classes(docs(ODD), k)) == brute(ODD, k)


def near_copies(seed=3):
    """A large group of copies around the threshold, chains, exact copies and strangers."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(120)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(r.randrange(0, 9)):
            t[r.randrange(len(t))] = f"e{r.random()}"
        rows.append((1000 + i, " ".join(t)))
    chain = list(base)
    for i in range(20):
        chain[i * 5 : i * 5 + 3] = [f"c{i}{j}" for j in range(3)]
        rows.append((500 + i, " ".join(chain)))
    rows += [(2000 + i, "exact copy of one and the same text") for i in range(30)]
    rows += [(3000 + i, " ".join(r.choice(words) for _ in range(60))) for i in range(60)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(docs, k):
    rows = near_copies()
    assert got(ss.classes(docs(rows), k)) == brute(rows, k)


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    a, b = (np.unique(r.integers(0, 1 << 64, 900, dtype=np.uint64)) for _ in range(2))
    both = np.union1d(a, b)
    assert (np.maximum(ss.registers(a), ss.registers(b)) == ss.registers(both)).all()
    c = np.union1d(a[:880], b[:30])  # similarity about 0.95 with a
    n = lambda *x: np.array([float(len(y)) for y in x])
    ra, rb, rc = (ss.registers(x)[None] for x in (a, b, c))
    assert ss.likely(ra, rc, n(a), n(c), 0.8)[0] and not ss.likely(ra, rb, n(a), n(b), 0.8)[0]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(roots[i] == 0 for i in range(61)) and all(roots[i] == 100 for i in range(100, 140))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dedup_keeps_one_row_of_each_group(docs):
    table = docs(ODD + [(9, ODD[8][1])])
    kept = ss.dedup(table, 5)
    assert kept.columns == table.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 2, 3, 4, 5, None, 7, 8, 8], key=str)
    assert ss.dedup(table.limit(0), 5).count() == 0


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomial_hashes_confuse(docs, n):
    rows = [(1, thue_morse(n, "a", "b") + " same"), (2, thue_morse(n, "b", "a") + " same"), (3, thue_morse(n, "a", "b") + "  SAME")]
    assert got(ss.classes(docs(rows), 2)) == brute(rows, 2) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def below_the_threshold(n, seed=5):
    """n texts that share two thirds of their words with each other, and some links that skip the smallest member."""
    r = random.Random(seed)
    shared = [f"s{i}" for i in range(80)]
    rows = [(i, " ".join(shared + [f"own{i}x{j}" for j in range(14 + r.randrange(4))])) for i in range(n)]
    return rows + [(n + i, rows[i][1].replace(f"own{i}x1", "other")) for i in range(1, n, 5)]


@pytest.mark.parametrize("k", [2, 5])
def test_links_that_skip_the_smallest_member(docs, k):
    rows = below_the_threshold(60)
    assert got(ss.classes(docs(rows), k)) == brute(rows, k)


def test_candidates_grow_with_the_texts(spark, docs, monkeypatch):
    """Neither short different texts nor texts just under the threshold give a quadratic number of pairs."""
    pairs = []
    verified = ss.verified
    monkeypatch.setattr(ss, "verified", lambda p, *a: pairs.append(p.count()) or verified(p, *a))
    short = spark.range(20_000).selectExpr("id as doc_id", "concat('first', id, ' second', id) as text")
    assert ss.classes(short, 2).where("doc_id <> component_id").count() == 0
    assert sum(pairs) < 200
    pairs.clear()
    ss.classes(docs(below_the_threshold(400)), 2).count()
    assert pairs[1] <= 80


def test_a_star_of_many_nodes(spark):
    star = spark.range(1, 100_001).selectExpr("0L as a", "id as b")
    assert components(star).where("root <> 0").count() == 0
