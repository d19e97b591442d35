"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs and digit or symbol substitutions to Latin letters, and turns everything else into
single blanks. The lexicon holds whole words and word beginnings with the log-odds that labelled training rows give them;
a term enters when its G statistic beats chance over all terms tried. Exception phrases - two-word contexts of a term
that are no more toxic than the corpus - cancel the hits they cover. A text's hits are summed, normalised by its length,
and a logistic regression on these few numbers gives the score.

Bounds: learning reads at most MAX_TRAIN labelled rows, a parameter (by hash of their ids, so the sample is the same every
time). That bounds the lexicon too: a term needs MIN_DOCS toxic training rows and the G statistic, a phrase ten training
rows; all that do are kept, of words of any length. Scoring reads every whole text once.

Cases: null and empty texts have no hits and get the score of their features like any other. Without labels of both
classes every score is the training share of toxic rows (0 with no rows at all). Repeated documents are scored row by
row; of several labels of one doc_id the largest counts. Columns other than doc_id and text are never read by a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import persisted, read_table

MAX_TRAIN = 30_000
MIN_DOCS = 4
PREFIXES = (4, 5, 6, 7)
#: Cyrillic and Greek letters that look like Latin ones, and usual substitutions.
HOMOGLYPHS = dict(zip("аесорхуіјѕԁһӏмтвкнαεορτυικνχγ", "aecopxyijsdhlmtbkhaeoptuiknxy", strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
FOLD = str.maketrans(HOMOGLYPHS | DIGITS | {"​": "", "‍": "", "­": ""})
INSIDE = re.compile(r"(?<=\w)[@$!|](?=\w)")
SYMBOLS = {"@": "a", "$": "s", "!": "i", "|": "l"}
BREAK = re.compile(r"[\W_]+")
FEATURES = ["sum", "rate", "most", "words"]


def fold(text: str | None) -> str:
    """Folded words between single blanks, with a blank at either end."""
    t = (text or "").lower()
    if "@" in t or "$" in t or "!" in t or "|" in t:
        t = INSIDE.sub(lambda m: SYMBOLS[m[0]], t)
    return f" {BREAK.sub(' ', t.translate(FOLD)).strip()} "


def terms(words: set[str]) -> set[str]:
    out = {f" {w} " for w in words}
    for k in PREFIXES:
        out |= {" " + w[:k] for w in words if len(w) > k}
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) outside the held-out fold, once each."""
    return labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int = MAX_TRAIN) -> DataFrame:
    """Rows of docs outside the held-out fold with their label `y`, at most about `limit` of them."""
    known = training_labels(labels, label)
    share = min(1.0, limit / max(1, known.count()))
    # At most about `limit` ids.
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.join(F.broadcast(sample), "doc_id")


def count_terms(train: DataFrame) -> DataFrame:
    """(term, n, n1): training texts, and toxic ones, that hold a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                n: Counter[str] = Counter()
                n1: Counter[str] = Counter()
                for text, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
                    found = terms(set(fold(text).split()))
                    n.update(found)
                    if y:
                        n1.update(found)
                yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64()), pa.array([n1[t] for t in n], pa.int64())], ["term", "n", "n1"])

    return train.select("text", "y").mapInArrow(run, "term string, n long, n1 long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))


def log_ratio(n1: Column, n0: Column, total1: int, total0: int) -> Column:
    return F.log(((n1 + 0.5) / (total1 + 1)) / ((n0 + 0.5) / (total0 + 1)))


def lexicon(train: DataFrame, total1: int, total0: int) -> dict[str, float]:
    counts = persisted(count_terms(train), "terms")
    tried = max(2, counts.count())
    base = total1 / (total1 + total0)
    share = F.col("n1") / F.col("n")
    rest = 1 - share
    g = 2 * F.col("n") * (share * F.log(share / base) + F.when(rest > 0, rest * F.log(rest / (1 - base))).otherwise(0.0))
    chosen = counts.where((F.col("n1") >= MIN_DOCS) & (share > base)).select("term", g.alias("g"), log_ratio(F.col("n1"), F.col("n") - F.col("n1"), total1, total0).alias("weight")).where(F.col("g") >= 2 * math.log(tried))
    return {r["term"]: r["weight"] for r in chosen.collect()}


def phrases(train: DataFrame, words: dict[str, float], base: float) -> list[str]:
    """Two-word contexts of lexicon words that are no more toxic than the corpus."""
    plain = {t.strip() for t in words if t.endswith(" ")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter[str] = Counter()
            n1: Counter[str] = Counter()
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                w = fold(text).split()
                found = {f" {x} {z} " for x, z in zip(w, w[1:]) if x in plain or z in plain}
                n.update(found)
                if y:
                    n1.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([n1[t] for t in n], pa.int64())], ["term", "n", "n1"])

    counts = train.select("text", "y").mapInArrow(run, "term string, n long, n1 long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    benign = counts.where((F.col("n") >= 10) & (F.col("n1") <= base * F.col("n")))
    return [r["term"] for r in benign.collect()]


def automaton(words: dict[str, float], exceptions: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t, w in words.items():
        a.add_word(t, (len(t), w))
    for t in exceptions:
        a.add_word(t, (len(t), -1.0))
    a.make_automaton()
    return a


def hits(folded: str, a) -> tuple[float, float, int]:
    """Sum of the hits' weights, the largest, and their number: one hit for each word, its heaviest term."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in a.iter(folded):
        start = end - size + 1
        if weight < 0:
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    for start, end in spared:
        for k in [k for k in best if start <= k < end]:
            del best[k]
    return sum(best.values()), max(best.values(), default=0.0), len(best)


def featured(docs: DataFrame, words: dict[str, float], exceptions: list[str], kept: list[str]) -> DataFrame:
    """kept columns of docs with FEATURES and n_hits."""
    shared = docs.sparkSession.sparkContext.broadcast((words, exceptions))  # bounded by the training sample
    schema = docs.select(*kept).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(*shared.value) if shared.value[0] else None
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                rows = []
                for text in part.column("text").to_pylist():
                    t = fold(text)
                    n = t.count(" ") - 1
                    total, most, found = hits(t, a) if a else (0.0, 0.0, 0)
                    rows.append((math.log1p(total), math.log1p(1000 * total / (n + 20)), most, math.log1p(n), found))
                columns = list(zip(*rows, strict=True))
                arrays = [part.column(c) for c in kept] + [pa.array(c, pa.float64()) for c in columns[:4]] + [pa.array(columns[4], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, *FEATURES, "n_hits"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", " + ", ".join(f"{f} double" for f in FEATURES) + ", n_hits long"
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, ddl)


def score(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits for every row of docs (doc_id, text), learnt from labels (doc_id, toxic)."""
    docs = docs.select("doc_id", "text")
    train = persisted(training_rows(docs, labels, "toxic", limit), "toxic-train")
    totals = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    total1, total0 = totals.get(1, 0), totals.get(0, 0)
    words: dict[str, float] = {}
    exceptions: list[str] = []
    if total1 and total0:
        words = lexicon(train, total1, total0)
        exceptions = phrases(train, words, total1 / (total1 + total0)) if words else []
    if words:
        data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(train, words, exceptions, ["y"]))
        model = LogisticRegression(labelCol="y", regParam=1e-3, maxIter=60).fit(data.select("features", "y"))
        logit = F.lit(float(model.intercept))
        for f, w in zip(FEATURES, model.coefficients.toArray().tolist(), strict=True):
            logit = logit + F.lit(w) * F.col(f)
        value = 1 / (1 + F.exp(-logit))
    else:
        value = F.lit(total1 / (total1 + total0) if total1 + total0 else 0.0)
    out = featured(docs, words, exceptions, ["doc_id"]).withColumn("score", value)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
