"""The query layer: builders, guards, views, symbol functions, stock view and factor ranks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import KEY
from .guard import Guard, temporary_views

#: Words that a read-only statement may not hold.
BLOCKED = ("attach", "detach", "copy", "create", "drop", "delete", "insert", "update", "alter", "truncate", "replace", "merge", "call", "load", "install", "set", "reset", "export", "import", "use", "refresh", "cache", "uncache", "grant", "revoke", "msck", "analyze", "add")
FILES = re.compile(r"\b(read_\w+|from_(?:csv|json|parquet)\w*)\s*\(|\b(?:parquet|csv|json|orc|text|avro|delta|binaryfile)\s*\.\s*`", re.I)


def without_comments(sql: str) -> str:
    """sql without comments; quoted text stays."""
    return re.sub(r"('(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`)|--[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", sql, flags=re.S).strip()


def bare(sql: str) -> str:
    """sql with quoted text blanked, for looking at words."""
    return re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"", "''", sql)


def check_read_only(sql: str) -> str:
    """The one SELECT or WITH statement that sql is; ValueError for anything else."""
    text = without_comments(sql).rstrip("; \n\t")
    if not text:
        raise ValueError("empty statement")
    words = bare(text)
    if ";" in words:
        raise ValueError("one statement only")
    if not re.match(r"(?i)(select|with)\b", words):
        raise ValueError("only SELECT or WITH")
    found = next((w for w in BLOCKED if re.search(rf"(?i)\b{w}\b(?!\s*\()", words)), None)
    if found or FILES.search(words):
        raise ValueError(f"not allowed: {found or 'reading files'}")
    return text


def check_relations(spark: SparkSession, sql: str) -> None:
    """ValueError unless all that sql reads, by the plan of Spark's own parser, are temporary views and its own WITH names."""
    Guard(spark, temporary_views(spark), {f.name.lower() for f in spark.catalog.listFunctions() if f.isTemporary and f.name.lower() in TABLE_MACROS}).statement(sql)


def check_expression(expr: str, spark: SparkSession | None = None) -> str:
    """expr if it is one expression without subqueries and foreign functions."""
    words = bare(without_comments(expr))
    if not words.strip() or ";" in words or any(re.search(rf"(?i)\b{w}\b", words) for w in (*BLOCKED, "select", "from")):
        raise ValueError("not a plain expression")
    if spark := spark or SparkSession.getActiveSession():
        Guard(spark, set()).expression_text(expr)
    return expr


def has_top_limit(sql: str) -> bool:
    depth = 0
    for token in re.findall(r"\(|\)|\w+", bare(without_comments(sql))):
        depth += (token == "(") - (token == ")")
        if depth == 0 and token.lower() == "limit":
            return True
    return False


def run_sql(spark: SparkSession, sql: str, limit: int = 100, unsafe_sql: bool = False) -> DataFrame:
    """A guarded ad-hoc statement, limited unless it limits itself; refused without unsafe_sql=True."""
    if not unsafe_sql:
        raise PermissionError("ad-hoc SQL needs unsafe_sql=True")
    text = check_read_only(sql)
    check_relations(spark, text)
    df = spark.sql(text)
    return df if has_top_limit(sql) else df.limit(limit)


def register_views(tables: dict[str, DataFrame], prefix: str = "") -> list[str]:
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + n for n in tables]


def symbol_code(x: str | Column) -> Column:
    """600519 of 600519, sh600519 and 600519.SH."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.contains("."), F.split_part(c, F.lit("."), F.lit(1))).when((F.length(c) == 8) & c.rlike("^[A-Za-z]{2}"), F.substring(c, 3, 6)).otherwise(c)


def symbol_market(x: str | Column) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.contains("."), F.lower(F.split_part(c, F.lit("."), F.lit(2)))).when((F.length(c) == 8) & c.rlike("^[A-Za-z]{2}"), F.lower(F.substring(c, 1, 2)))


def select(df: DataFrame, columns: list[str] | None = None, symbol: str | None = None, market: str | None = None, start: str | None = None, end: str | None = None, where: str | None = None, order_by: str | None = None, desc: bool = False, limit: int | None = None) -> DataFrame:
    """A filtered projection; bounds on the day also bound its year, so that partitions are pruned."""
    if unknown := set([*(columns or []), *([order_by] if order_by else [])]) - set(df.columns):
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    if limit is not None and limit <= 0:
        raise ValueError("limit is positive")
    day = next((c for c in ("trade_date", "ex_date") if c in df.columns), None)
    for c, v in (("symbol", symbol), ("market", market)):
        if v is not None:
            df = df.where(F.col(c) == v)
    for v, low in ((start, True), (end, False)):
        if v is not None and day:
            d = F.lit(v).cast("date")
            df = df.where(F.col(day) >= d if low else F.col(day) <= d)
            if "trade_year" in df.columns:
                df = df.where(F.col("trade_year") >= F.year(d) if low else F.col("trade_year") <= F.year(d))
    if where:
        df = df.where(F.expr(check_expression(where, df.sparkSession)))
    if order_by or day:
        c = F.col(order_by or day)
        df = df.orderBy(c.desc() if desc else c.asc(), *[x for x in KEY if x in df.columns and x != (order_by or day)])
    if columns:
        df = df.select(*columns)
    return df if limit is None else df.limit(limit)


def last_n(df: DataFrame, n: int) -> DataFrame:
    """The latest n rows of every instrument."""
    w = Window.partitionBy("market", "symbol").orderBy(F.col("trade_date").desc())
    return df.withColumn("recency", F.row_number().over(w).cast("long")).where(F.col("recency") <= n)


#: Table functions of :func:`register_macros`, and the views they read.
TABLE_MACROS = {"last_n_days": "adj_daily", "last_n_factors": "factors"}


def register_macros(spark: SparkSession) -> None:
    """symbol_code(x), symbol_market(x), and for each of the views adj_daily and factors that is registered a table function
    last_n_days(sym, n, mkt) or last_n_factors(sym, n, mkt): the latest n rows of an instrument, its symbol written in
    any way (600519, sh600519, 600519.SH). Without mkt, and without a market in sym, every market's instrument of that
    symbol is meant.
    """
    for name, value in (
        ("symbol_code", "CASE WHEN contains(x, '.') THEN split_part(x, '.', 1) WHEN length(x) = 8 AND x RLIKE '^[A-Za-z]{2}' THEN substr(x, 3, 6) ELSE x END"),
        ("symbol_market", "CASE WHEN contains(x, '.') THEN lower(split_part(x, '.', 2)) WHEN length(x) = 8 AND x RLIKE '^[A-Za-z]{2}' THEN lower(substr(x, 1, 2)) END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {value}")
    views = temporary_views(spark)
    for name, view in TABLE_MACROS.items():
        if view not in views:
            continue
        df = spark.table(view)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        names = ", ".join(f"t.`{c}`" for c in df.columns)
        body = f"""SELECT {names} FROM (
          SELECT v.*, row_number() OVER (PARTITION BY v.market, v.symbol ORDER BY v.trade_date DESC) AS place FROM {view} v
          WHERE v.symbol = symbol_code({name}.sym) AND (coalesce({name}.mkt, symbol_market({name}.sym)) IS NULL OR v.market = lower(coalesce({name}.mkt, symbol_market({name}.sym))))) t
        WHERE t.place <= {name}.n"""
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(sym STRING, n INT, mkt STRING DEFAULT NULL) RETURNS TABLE ({columns}) RETURN {body}")


def stock_view(raw: DataFrame, adjusted: DataFrame | None, factors: DataFrame, columns: list[str]) -> DataFrame:
    """Raw keys with adjusted prices (raw ones with factor 1 where adjusted is None) and factor columns, null where absent."""
    names = ("open", "high", "low", "close")
    if adjusted is None:
        bars = raw.select(*KEY, *[F.col(c).alias(f"adj_{c}") for c in names], "volume", "amount", F.lit(1.0).alias("adj_factor"))
    else:
        bars = raw.select(*KEY).join(adjusted.select(*KEY, *[f"adj_{c}" for c in names], "volume", "amount", "adj_factor"), KEY, "left")
    have = [F.col(c) if c in factors.columns else F.lit(None).cast("double").alias(c) for c in columns]
    return bars.join(factors.select(*KEY, *have), KEY, "left")


def table_summary(df: DataFrame, day: str = "trade_date") -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.countDistinct("market", "symbol").alias("symbols"), F.min(day).alias("first_date"), F.max(day).alias("last_date"))


def factor_rank(f: DataFrame, factor: str, n: int = 20, higher_is_better: bool = True) -> DataFrame:
    """Every day's first n by a factor, nulls last."""
    c = F.col(factor)
    w = Window.partitionBy("trade_date").orderBy(c.desc_nulls_last() if higher_is_better else c.asc_nulls_last(), "market", "symbol")
    return f.withColumn("rank", F.rank().over(w).cast("long")).where(F.col("rank") <= n)


def describe_table(df: DataFrame) -> DataFrame:
    """(place, name, kind, is_date_column) of df's columns; the date column is trade_date, else ex_date."""
    day = next((c for c in ("trade_date", "ex_date") if c in df.columns), None)
    rows = [(i, f.name, f.dataType.simpleString(), f.name == day) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "place int, name string, kind string, is_date_column boolean")


#: Columns of a stock view unless others, or all, are asked for.
DEFAULT_COLUMNS = ("market", "symbol", "trade_date", "adj_open", "adj_high", "adj_low", "adj_close", "volume", "amount", "ma5", "ma20", "ma60", "ret_20", "rsi_14")


def choose_columns(df: DataFrame, columns: list[str] | None = None, full: bool = False) -> DataFrame:
    if columns and (unknown := set(columns) - set(df.columns)):
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    return df if full else df.select(*(columns or [c for c in DEFAULT_COLUMNS if c in df.columns]))


def shown(df: DataFrame) -> DataFrame:
    """df for display: fractions with two places, volumes and amounts in K, M, B or T."""
    out = {}
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in ("volume", "amount") or f.name.startswith(("vol_ma", "amount_ma")):
            size = F.abs(c.cast("double"))
            scaled = lambda n, unit, c=c: F.concat(F.format_number(c / n, 2), F.lit(unit))
            text = F.when(size >= 1e12, scaled(1e12, "T")).when(size >= 1e9, scaled(1e9, "B")).when(size >= 1e6, scaled(1e6, "M")).when(size >= 1e3, scaled(1e3, "K"))
            out[f.name] = F.coalesce(text, F.format_number(c.cast("double"), 2))
        elif f.dataType.simpleString() in ("double", "float"):
            out[f.name] = F.round(c, 2)
    return df.withColumns(out) if out else df
