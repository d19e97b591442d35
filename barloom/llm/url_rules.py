"""URL filters: association rules mined with FP-growth from labelled URLs, matched by an inverted index.

Every step is a DataFrame function or Spark ML's FPGrowth; no Python runs on the executors.

1. A URL becomes a set of tokens: scheme, host labels counted from the right, the first label when it is a
   subdomain, path segments by place (digits folded to ``#``), query keys, fragment. All of them are mined and matched,
   however many a URL has.
2. FP-growth mines frequent token sets of labelled URLs together with the label item. A rule is
   ``tokens -> blocked`` with support, confidence and lift at or over their thresholds; a rule whose tokens contain
   those of a shorter rule of at least its confidence adds nothing and is pruned. Two reductions before mining change no
   rule: tokens that fewer blocked URLs hold than the minimum support asks are dropped, as no rule can hold them; and
   tokens of exactly the same labelled URLs are mined as one item, since a rule with two of them is always pruned, and
   each of them then takes the item's place in its rules. Frequent tokens that occur together in many different
   combinations still give as many token sets as FP-growth finds.
   A rule must be significant: the chance of as many blocked URLs among those that hold its tokens, were they blocked at
   the common rate, is under `alpha` over the number of token sets tried (Chernoff's bound, Bonferroni's correction). And
   it must hold in the fifth of the examples that it was not mined from (:func:`confirmed`). Where nothing is significant
   nothing is mined.
3. Matching: each rule is posted under its rarest token. A URL's tokens meet that index, and only then is the whole
   token set compared.

Hand-written rules come first: the longest fitting (host, path) rule gives the verdict; the mined rules judge the rest.

Labels (:func:`seeds`): of the URLs that no hand-written rule concerns, one is a blocked example where a word of its host is
a seed term or its text is labelled bad, and an allowed one where its text is labelled good and nothing blocks it. All
others are no examples. Verdicts of hand-written rules are none either: they are given anyway, and learnt from they would
spread to URLs that share a part with them. So what is mined is what such URLs have in common, and where it is found again.

Cases: a null URL or one without ``://`` has empty host and path, no tokens, fits no rule and is allowed. Repeated rows
each get a verdict. Null page ids are kept. No labels, or none of either class: no rules are mined. Of rules of equal
confidence the one with fewest tokens counts, then the first by name. Very long URLs are handled whole. Extra columns are
ignored by the query and kept by :func:`judge`, but for those named as its results, which take their place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, persisted, read_table

#: (host, path, verdict), as the query's contract fixes them.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Words of hosts that mark examples of blocked URLs.
SEED_TERMS = ("spam", "pills", "casino", "porn", "viagra", "xxx", "warez", "escort")
RESULTS = ("host", "path", "rule", "mined_rule", "confidence", "verdict")
BLOCKED = "=blocked"


@dataclass(frozen=True)
class RuleParams:
    min_support: float = 0.002
    #: Labelled URLs that hold a rule's tokens and are blocked, at least: a handful of chance hits is no rule.
    min_count: int = 3
    min_confidence: float = 0.8
    min_lift: float = 1.5
    #: Chance of any rule that is none.
    alpha: float = 0.01
    #: Above this many rules the index is joined by a shuffle instead of a broadcast.
    broadcast_rules: int = 100_000


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + F.lit(4), F.length(url))
    return F.when(F.contains(url, F.lit("://")), ascii_lower(F.regexp_extract(after, r"^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    after = F.substring(url, F.length(F.substring_index(url, "://", 1)) + F.lit(4), F.length(url))
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def host_path(df: DataFrame, url: str) -> DataFrame:
    u = F.col(url)
    return df.withColumns({"host": F.coalesce(host_of(u), F.lit("")), "path": F.coalesce(path_of(u), F.lit(""))})


def tokens(url: Column, host: Column, path: Column) -> Column:
    """All distinct tokens of a URL; null entries fall away."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    from_right = F.transform(labels, lambda x, i: F.concat(F.lit("h"), (n - i).cast("string"), F.lit(":"), x))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    placed = F.transform(segments, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), F.regexp_replace(x, r"\d+", "#")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    single = F.array(
        F.when(F.contains(url, F.lit("://")), F.concat(F.lit("s:"), ascii_lower(F.substring_index(url, "://", 1)))),
        F.when(n > 2, F.concat(F.lit("sub:"), F.get(labels, F.lit(0)))),
        F.when(F.contains(url, F.lit("#")), F.concat(F.lit("f:"), F.regexp_extract(url, r"#(.*)$", 1))),
        F.when(path.endswith("/"), F.lit("slash")),
    )
    every = F.array_compact(F.concat(from_right, placed, keys, single))
    return F.when(url.isNull() | ~F.contains(url, F.lit("://")), F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def mine(labelled: DataFrame, p: RuleParams = RuleParams()) -> DataFrame:
    """Rules (rule_id, rule_tokens, confidence, lift, support) from rows (tokens array, blocked int)."""
    rows = labelled.where("blocked is not null and size(tokens) > 0").select(F.monotonically_increasing_id().alias("uid"), "tokens", "blocked")
    rows = persisted(rows, "url-labelled")
    n, n_blocked = rows.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    support = max(p.min_support, min(1.0, p.min_count / max(1, n)))
    posted = rows.select("uid", "blocked", F.explode(F.array_distinct("tokens")).alias("token"))
    # Tokens of the same URLs have the same number of them and the same 128 bits of hash.
    same = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("uid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "uid")).alias("y")]
    often = posted.groupBy("token").agg(F.count_if(F.col("blocked") == 1).alias("n_blocked"), *same).where(F.col("n_blocked") >= support * n - 1e-6)
    classes = persisted(often.groupBy("n", "x", "y").agg(F.min("token").alias("item"), F.array_sort(F.collect_set("token")).alias("members")).select("item", "members"), "url-items")
    marked = posted.join(classes.select(F.col("item").alias("token"), "item"), "token", "left")
    held = marked.groupBy("uid").agg(F.max("blocked").alias("blocked"), F.collect_list("item").alias("kept"))
    items = held.select(F.when(F.col("blocked") == 1, F.array_append("kept", F.lit(BLOCKED))).otherwise(F.col("kept")).alias("items"))
    partitions = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=p.min_confidence, numPartitions=partitions).fit(items.repartition(partitions))
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCKED) & (F.col("lift") >= p.min_lift))
    # m URLs hold the tokens, a share c of them blocked, of all URLs a share r: the chance is at most exp(-m KL(c, r)).
    rate = min(max(n_blocked / max(1, n), 1e-12), 1 - 1e-12)
    c, m = F.least(F.col("confidence"), F.lit(1 - 1e-12)), F.col("support") * n / F.col("confidence")
    distance = m * (c * F.ln(c / rate) + (1 - c) * F.ln((1 - c) / (1 - rate)))
    tried = model.freqItemsets.count()
    rules = rules.where((F.col("confidence") > rate) & (distance >= math.log(max(1, tried) / p.alpha)))
    rules = rules.select(F.array_sort("antecedent").alias("rule_tokens"), "confidence", "lift", "support").withColumn("rule_id", F.array_join("rule_tokens", " & "))
    rules = persisted(rules, "url-rules")
    # A shorter rule of at least the same confidence makes a longer one redundant. Shorter and longer meet on a shared token.
    a, b = rules.alias("a"), rules.select(F.explode("rule_tokens").alias("t"), F.col("rule_id").alias("short_id"), F.col("rule_tokens").alias("short"), F.col("confidence").alias("short_conf")).alias("b")
    worse = a.select("rule_id", "confidence", "rule_tokens", F.explode("rule_tokens").alias("t")).join(b, "t").where((F.size("short") < F.size("rule_tokens")) & (F.col("short_conf") >= F.col("confidence")) & (F.size(F.array_except("short", "rule_tokens")) == 0))
    least = rules.join(worse.select("rule_id").distinct(), "rule_id", "left_anti")
    # Every choice of one token for each item of a rule.
    choices = least.select("rule_id", F.explode("rule_tokens").alias("item")).join(classes, "item").groupBy("rule_id").agg(F.collect_list("members").alias("choices"))
    start = F.array(F.array().cast("array<string>"))
    product = F.aggregate("choices", start, lambda acc, m: F.flatten(F.transform(acc, lambda a: F.transform(m, lambda t: F.array_append(a, t)))))
    every = least.drop("rule_tokens").join(choices, "rule_id").select(F.explode(product).alias("chosen"), "confidence", "lift", "support").withColumn("rule_tokens", F.array_sort("chosen"))
    return persisted(every.select(F.array_join("rule_tokens", " & ").alias("rule_id"), "rule_tokens", "confidence", "lift", "support"), "url-rules-pruned")


def hits(urls: DataFrame, rules: DataFrame, p: RuleParams) -> DataFrame:
    """Rows of urls (tokens, ...) with each rule (rule_id, rule_tokens, confidence) that they fit, through an index by rarest token."""
    posted = rules.select("rule_id", "rule_tokens", "confidence", F.explode("rule_tokens").alias("token"))
    frequency = posted.groupBy("token").agg(F.count("*").alias("postings"))
    index = posted.join(frequency, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("postings", "token")).alias("token"), F.first("rule_tokens").alias("rule_tokens"), F.first("confidence").alias("confidence"))
    if rules.count() <= p.broadcast_rules:
        index = F.broadcast(index)
    return urls.select("*", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("rule_tokens", "tokens")) == 0)


def confirmed(examples: DataFrame, rules: DataFrame, p: RuleParams = RuleParams()) -> DataFrame:
    """rules with held_hits and held_blocked among examples (tokens, blocked) that they were not mined from, without those whose share blocked is under the minimum confidence there."""
    found = hits(examples, rules, p).groupBy("rule_id").agg(F.count("*").alias("held_hits"), F.sum(F.col("blocked").cast("long")).alias("held_blocked"))
    out = rules.join(found, "rule_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("held_hits", "held_blocked")})
    return out.where(F.col("held_blocked") >= p.min_confidence * F.col("held_hits"))


def match(urls: DataFrame, rules: DataFrame, key: str, p: RuleParams = RuleParams()) -> DataFrame:
    """(key, mined_rule, confidence) of the best mined rule of each row of urls (key, tokens) that has one."""
    found = hits(urls.select(key, "tokens"), rules, p)
    return found.groupBy(key).agg(F.max_by("rule_id", F.struct("confidence", F.negate(F.size("rule_tokens")), "rule_id")).alias("mined_rule"), F.max("confidence").alias("confidence"))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule; null where none fits."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(pre), F.struct(F.lit(h + pre).alias("rule"), F.lit(verdict).alias("verdict"))) for h, pre, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def seeds(urls: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], terms: tuple[str, ...] = SEED_TERMS) -> DataFrame:
    """Examples (tokens, blocked, held) from urls (page_id, url, host, path, tokens) and labels (page_id, blocked); held: a fifth of the URLs, for confirming."""
    known = labels.groupBy("page_id").agg(F.max("blocked").alias("labelled"))
    fixed = fixed_rule(F.col("host"), F.col("path"), rules)["verdict"]
    listed = F.arrays_overlap(F.split("host", r"[.-]"), F.array(*[F.lit(t) for t in terms])) if terms else F.lit(False)
    bad = listed | F.coalesce(F.col("labelled") == 1, F.lit(False))
    good = F.col("labelled") == 0
    both = urls.where(fixed.isNull() & (F.size("tokens") > 0)).join(known, "page_id", "left")
    return both.select("tokens", F.when(bad, 1).when(good, 0).alias("blocked"), (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("held")).where("blocked is not null")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, p: RuleParams = RuleParams(), terms: tuple[str, ...] = SEED_TERMS) -> DataFrame:
    """pages (page_id, url, ...) with RESULTS; labels has (page_id, blocked)."""
    base = host_path(pages.drop(*[c for c in pages.columns if c.lower() in RESULTS]), "url")
    urls = base.select("page_id", "url", "host", "path", tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    examples = seeds(urls, labels, rules, terms)
    mined = persisted(confirmed(examples.where("held"), mine(examples.where("not held"), p), p), "url-rules-confirmed")
    # Equal URLs have equal verdicts: each is matched once, whatever its number of rows.
    matched = match(urls.where("size(tokens) > 0").groupBy("url").agg(F.first("tokens").alias("tokens")), mined, "url", p)
    fixed = fixed_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(fixed["verdict"], F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise("allow"))
    return base.join(matched, "url", "left").withColumns({"rule": fixed["rule"], "verdict": verdict})


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; labels.quality of the document of the same number says whether a page's text is bad."""
    pages = read_table(spark, sf_dir, "pages")
    labels = read_table(spark, sf_dir, "labels").where("quality is not null").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("blocked"))
    return judge(pages.select("page_id", "url"), labels).select("page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence")
