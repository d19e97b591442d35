"""Line dedup by the spread of a line over sites.

DataFrame functions only. Every line of a text (cut at line ends; trimmed, A-Z lower-cased) has a hash. Lines that occur
often enough to reach the threshold at all go on; their sites' HyperLogLog sketches merge by aggregation to an estimated
number of distinct sites. Where the estimate is near the threshold the sites are counted exactly. A line on min_sites
sites or more is boilerplate: of its occurrences the first stays (smallest doc_id, then text hash, then place), so what
is said once anywhere is kept, and the others are cut out.

Hot lines meet partial aggregation only; the joins are plain equi-joins on written tables, which adaptive execution
splits where one line holds many rows, or broadcasts of tables whose size was counted.

Cases: null texts stay null, with no lines; blank lines are never cut; a null site is a site of its own. Rows with equal
doc_id and text share their fate. A null doc_id comes before all others. Empty tables give empty tables. Extra columns
are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, persisted, read_table, text_of, tmp_name

MIN_SITES = 5
#: Estimates within this share of the threshold are counted exactly; a sketch of 2^12 registers errs by 1.6 %.
NEAR = 0.25
LG_K = 12
BROADCAST_ROWS = 200_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def small(df: DataFrame, limit: int) -> DataFrame:
    """df with a broadcast hint where it has few rows; it is a written table."""
    return F.broadcast(df) if df.count() <= limit else df


def boilerplate(lines: DataFrame, min_sites: int, near: float) -> DataFrame:
    """line hashes on min_sites sites or more, from lines (line, site), a written table."""
    sketches = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    estimated = persisted(sketches, "line-sketches")
    close = estimated.where(F.abs(F.col("sites") - min_sites) <= F.ceil(F.lit(near * min_sites))).select("line")
    exact = lines.join(close, "line", "left_semi").groupBy("line").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    clear = estimated.where(F.col("sites") - min_sites > F.ceil(F.lit(near * min_sites)))
    return persisted(clear.select("line").union(exact.select("line")), "boilerplate")


def removals(docs: DataFrame, site: str, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """(doc_id, text_key, cut): places of the lines that go from each text that loses any."""
    at = docs.select("doc_id", F.xxhash64(text_of()).alias("text_key"), F.xxhash64(F.col(site)).alias("site"), F.posexplode(lines_of(F.col("text"))).alias("place", "raw"))
    hashed = at.where(F.trim("raw") != "").select("doc_id", "text_key", "site", "place", F.xxhash64(ascii_lower(F.trim("raw"))).alias("line"))
    # A line cannot be on more sites than it has occurrences: one cheap count spares most lines a sketch.
    often = persisted(hashed.groupBy("line").agg(F.count("*").alias("n"), F.min("site").alias("lo"), F.max("site").alias("hi")).where((F.col("n") >= min_sites) & ((F.col("lo") != F.col("hi")) | F.lit(min_sites <= 1))).select("line"), "often")
    lines = persisted(hashed.join(small(often, BROADCAST_ROWS), "line"), "often-lines")
    bad = boilerplate(lines, min_sites, near)
    found = lines.join(small(bad, BROADCAST_ROWS), "line")
    first = persisted(found.groupBy("line").agg(F.min(F.struct("doc_id", "text_key", "place")).alias("first")), "first-lines")
    rest = found.join(small(first, BROADCAST_ROWS), "line").where(~F.struct("doc_id", "text_key", "place").eqNullSafe(F.col("first")))
    return rest.groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("cut"))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """docs with n_lines and n_removed (in place of columns of these names); text without the lines that go, n_chars (where present) to match."""
    key, cut, gone_id, gone_key = (tmp_name(docs, x) for x in ("text_key", "cut_places", "cut_id", "cut_key"))
    gone = removals(docs, site, min_sites, near).select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key), F.col("cut").alias(cut))
    keyed = docs.withColumn(key, F.xxhash64(text_of()))
    both = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key)), "left")
    lines = lines_of(F.col("text"))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cut))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))
    out = {"text": text}
    out["n_lines"] = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    out["n_removed"] = F.when(F.col(cut).isNull(), F.lit(0)).otherwise(F.size(F.col(cut))).cast("long")
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    return both.withColumns(out).select(*names)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


OP3_SQL = f"""
WITH line AS (
  SELECT doc_id, source, i, trim(parts[i], ' ') AS raw, translate(trim(parts[i], ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS l
  FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents))),
bad AS (SELECT l, min((doc_id, i)) AS keep FROM line WHERE raw <> '' GROUP BY l HAVING count(DISTINCT coalesce(source, '')) >= {MIN_SITES}),
gone AS (SELECT doc_id, list(i) AS cut FROM line JOIN bad USING (l) WHERE (doc_id, i) <> keep GROUP BY doc_id),
doc AS (SELECT doc_id, string_split(text, chr(10)) AS parts, cut FROM documents LEFT JOIN gone USING (doc_id)),
built AS (SELECT doc_id, parts, cut, array_to_string([parts[j] for j in range(1, len(parts) + 1) if cut IS NULL OR NOT list_contains(cut, j)], chr(10)) AS t FROM doc)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_lines, CAST(coalesce(len(cut), 0) AS BIGINT) AS n_removed, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS text_sha256 FROM built
"""
