"""Benchmark decontamination: a hash set of normalised benchmark n-grams against every token window of the corpus.

DataFrame functions only. A text is lower-cased (A-Z) and cut into words; the windows of n consecutive words of each
benchmark item are hashed (an item of fewer words is one window). Every document's windows are hashed the same way and
looked up in that set, which is broadcast when its counted size allows and joined by a shuffle beyond it. A hit is
verified on the words themselves. Hits, not documents, are shuffled; the words of a document inside hit windows are
counted once each however many windows hold them.

Cases: null or wordless texts have no words, no hits and are not contaminated. Items without words give no window.
Repeated documents are judged row by row; repeated item ids count once; a null item id counts as the empty string.
An empty benchmark or corpus is fine. Extra columns of documents are kept by :func:`decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read_table, text_of, tmp_name

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows of the benchmark up to which they are broadcast (about 100 bytes each).
BROADCAST_GRAMS = 1_000_000


def words_of(text: Column) -> Column:
    """Words of a text: runs of digits, letters and all that is not ASCII, A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(text), BREAKS), lambda w: w != "")


def grams_of(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct windows (hash, gram, size, items): items are the ids, as strings, that hold the window."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(text_of()).alias("w")).where("size(w) > 0")
    size = F.least(F.size("w"), F.lit(n))
    cut = words.select("item", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.slice("w", i + 1, size))).alias("gram"))
    return cut.groupBy("gram", "size").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("hash", F.xxhash64("gram"))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 13, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted strings), spans (array of [from, to) word places) for each row of docs."""
    grams = grams_of(benchmark, n)
    sizes = {r["size"]: r["count"] for r in grams.groupBy("size").count().collect()}  # at most n rows
    small = sum(sizes.values()) <= broadcast_grams
    base = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(text_of()).alias("w"))
    # Place -1 stands for the document itself, so that documents without hits come through the same shuffle; place
    # i of n words is word i % n for the (i / n)-th size. The words stay behind here: a row has its window alone.
    n_words, k = F.size("w"), F.lit(n)
    for i, size in enumerate(sorted(sizes)):
        k = F.when(F.col("place") >= i * F.col("n_words"), F.lit(size)).otherwise(k)
    placed = base.withColumn("n_words", n_words).withColumn("places", F.sequence(F.lit(-1), n_words * max(1, len(sizes)) - 1))
    at = placed.select("row", "doc_id", "n_words", "w", F.explode("places").alias("place")).withColumn("size", k)
    at = at.withColumn("pos", F.when(F.col("place") < 0, F.lit(-1)).otherwise(F.col("place") % F.greatest("n_words", F.lit(1))))
    at = at.where((F.col("place") < 0) | (F.col("pos") + F.col("size") <= F.col("n_words")))
    at = at.select("row", "doc_id", "n_words", "pos", "size", F.when(F.col("place") >= 0, F.slice("w", F.col("pos") + 1, F.col("size"))).alias("window"))
    at = at.withColumn("hash", F.when(F.col("pos") >= 0, F.xxhash64("window")))
    g = grams.select(F.col("size").alias("g_size"), F.col("hash").alias("g_hash"), "gram", "items")
    # A hash that agrees is verified on the words themselves.
    same = (F.col("hash") == F.col("g_hash")) & (F.col("size") == F.col("g_size")) & (F.col("window") == F.col("gram"))
    hits = at.join(F.broadcast(g) if small else g, same, "left").where("pos < 0 or items is not null").select("row", "doc_id", "n_words", "pos", "size", "items")
    # A document has as many places as words and sizes.
    per_doc = hits.groupBy("row", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_list(F.when(F.col("pos") >= 0, F.struct("pos", (F.col("pos") + F.col("size")).alias("end"))))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    # Words in hit windows, in order of their first place: each adds what lies beyond the furthest end so far.
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "places",
        state,
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["end"], x["pos"]))).alias("n"), F.greatest(s["end"], x["end"]).alias("end")),
        lambda s: s["n"],
    )
    start = F.array().cast("array<struct<pos:int,end:int>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["pos"].alias("pos"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (x["pos"] <= last["end"]), joined).otherwise(F.concat(acc, F.array(x)))

    return per_doc.select("doc_id", "n_words", covered.alias("n_hit"), "item_ids", F.aggregate("places", start, add).alias("spans"), "row")


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, action: str = "document") -> DataFrame:
    """docs without contaminated documents, or with ``action="span"`` with the hit words cut out of their texts.

    The text that holds no hit is returned as it is; in one with cut spans, the words of a span go with what stands before
    each, and all else stays as it was written.
    """
    if action not in ("document", "span"):
        raise ValueError(f"action: {action}")
    key = tmp_name(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64(text_of()))
    # What is found depends on the text alone: equal texts share one verdict, and the join needs no row numbers.
    found = scan(docs.select(F.xxhash64(text_of()).alias("doc_id"), "text"), benchmark, n)
    judged = found.where("n_hit > 0").withColumn("bad", contaminated()).groupBy("doc_id").agg(F.max("bad").alias("bad"), F.first("spans").alias("spans"))
    if action == "document":
        return keyed.join(judged.where("bad").select(F.col("doc_id").alias(key)), key, "left_anti").select(*docs.columns)
    cut = tmp_name(docs, "cut_spans")
    both = keyed.join(judged.select(F.col("doc_id").alias(key), F.col("spans").alias(cut)), key, "left")
    # The text is a row of pairs: what lies before a word, and the word. Pieces outside the spans stay as they are.
    gaps = F.split(text_of(), WORD, -1)
    words = F.regexp_extract_all(text_of(), F.lit(f"({WORD})"), 1)
    inside = lambda i: F.exists(F.col(cut), lambda s: (s["pos"] <= i) & (i < s["end"]))
    pieces = F.transform(words, lambda w, i: F.when(inside(i), F.lit("")).otherwise(F.concat(F.get(gaps, i), w)))
    kept = F.concat(F.array_join(pieces, ""), F.get(gaps, F.size(gaps) - 1))
    return both.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP4_SQL = r"""
WITH item AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
cut AS (SELECT item, w, least(len(w), 13) AS k FROM item WHERE len(w) > 0),
gram AS (SELECT DISTINCT item, k, w[i : i + k - 1] AS g FROM (SELECT item, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM cut)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
win AS (SELECT r, k, i, w[i : i + k - 1] AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM gram))),
hit AS (SELECT r, win.k, i, item FROM win JOIN gram ON win.g = gram.g AND win.k = gram.k),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
