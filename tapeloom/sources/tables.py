"""Market tables derived from the star-schema test tables.

Suppliers and brands act as tickers, shipments as trades, events as intraday
trades, documents as articles and embeddings as article vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from .bars import build_bars

TICK_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
DAY0 = "1995-01-02"
NEWS_DAYS = 2400
# The brand series that stand in for market benchmarks.
BENCHMARKS = {"SPY": "Brand#1", "UVXY": "Brand#2", "TLT": "Brand#3", "GLD": "Brand#4", "VIXY": "Brand#5"}
MACRO_SERIES = ["vix", "vix3m", "tnx", "irx", "sp500", "rsp", "spy", "hyg", "lqd", "gld", "uup", "uso"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        F.col("l_quantity").alias("qty"),
        *TICK_ORDER,
    )


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, open, high, low, close, volume), one ticker per supplier."""
    return build_bars(ticks(spark, sf_dir), "price", "qty", ["ticker", "date"], TICK_ORDER)


def bars_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by brand: few long series."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    t = ticks(spark, sf_dir).drop("ticker").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return build_bars(t.withColumnRenamed("p_brand", "ticker"), "price", "qty", ["ticker", "date"], TICK_ORDER)


def benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for k, v in BENCHMARKS.items() for x in (v, k)])
    return (
        bars_brand(spark, sf_dir)
        .where(F.col("ticker").isin(list(BENCHMARKS.values())))
        .withColumn("ticker", F.try_element_at(names, F.col("ticker")))
    )


def macro_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table (name, date, value) of twelve market series, from brands 6 to 17."""
    brands = {f"Brand#{i + 6}": n for i, n in enumerate(MACRO_SERIES)}
    names = F.create_map(*[F.lit(x) for kv in brands.items() for x in kv])
    b = bars_brand(spark, sf_dir).where(F.col("ticker").isin(list(brands)))
    return b.select(F.try_element_at(names, F.col("ticker")).alias("name"), "date", F.col("close").alias("value"))


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
        F.lit(1.0).alias("qty"),
    )


def bars_minute(spark: SparkSession, sf_dir: str, unit: str = "minute") -> DataFrame:
    """Intraday bars (ticker, ts, date, open, high, low, close, volume), one ticker per event type."""
    t = event_ticks(spark, sf_dir).withColumn("__t", F.col("ts")).withColumn("ts", F.date_trunc(unit, "ts"))
    b = build_bars(t, "price", "qty", ["ticker", "ts"], ["__t", "event_id"])
    return b.withColumn("date", F.to_date("ts"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, sector): region of the supplier."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("r_name").alias("sector"))
    )


def _ticker_of(doc: str | Column, n: int) -> Column:
    return F.concat(F.lit("S"), F.pmod(F.col(doc) if isinstance(doc, str) else doc, F.lit(n)).cast("string"))


def news(spark: SparkSession, sf_dir: str, n_tickers: int = 100) -> DataFrame:
    """Articles: (doc_id, ticker, published_at, date, title, body, url, source)."""
    d = F.col("doc_id")
    day = F.date_add(F.lit(DAY0).cast("date"), F.pmod(d * 7, F.lit(NEWS_DAYS)).cast("int"))
    minute = F.pmod(d * 37, F.lit(1440))
    at = F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + minute * 60)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        _ticker_of("doc_id", n_tickers).alias("ticker"),
        at.alias("published_at"),
        day.alias("date"),
        F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"),
        F.col("text").alias("body"),
        F.concat_ws("/", "source", d.cast("string")).alias("url"),
        "source",
    )


def article_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, ticker, published_at, date, pos, neg, neu, art_len, embedding); ticker by label."""
    v = F.col("vec_id")
    day = F.date_add(F.lit(DAY0).cast("date"), F.pmod(v * 7, F.lit(NEWS_DAYS)).cast("int"))
    at = F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + F.pmod(v * 37, F.lit(1440)) * 60)
    e = [F.exp(F.col("embedding")[i].cast("double")) for i in range(3)]
    total = e[0] + e[1] + e[2]
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.concat(F.lit("S"), F.col("label").cast("string")).alias("ticker"),
        at.alias("published_at"),
        day.alias("date"),
        (e[0] / total).alias("pos"),
        (e[1] / total).alias("neg"),
        (e[2] / total).alias("neu"),
        (F.pmod(v * 131, F.lit(5000)) + 20).cast("double").alias("art_len"),
        "embedding",
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statements per customer nation from orders."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))

    def total(status: str) -> Column:
        return F.sum(F.when(F.col("o_orderstatus") == status, F.col("o_totalprice")).otherwise(0.0))

    q = j.groupBy(
        F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("ticker"),
        F.last_day(F.add_months(F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp")).cast("date"), 2)).alias("report_date"),
    ).agg(
        F.sum("o_totalprice").alias("revenue"),
        total("F").alias("filled"),
        total("O").alias("open_orders"),
        total("P").alias("pending"),
        F.count(F.lit(1)).alias("n_orders"),
    )
    r = F.col("revenue")
    return q.select(
        "ticker",
        "report_date",
        r.alias("revenue"),
        (r - F.col("pending")).alias("gross_profit"),
        (r - F.col("pending") - F.col("open_orders") * 0.5).alias("operating_income"),
        (F.col("filled") - F.col("open_orders") * 0.25).alias("net_income"),
        (r * 1.5 + F.col("filled")).alias("total_equity"),
        (r * 4.0).alias("total_assets"),
        (F.col("open_orders") * 2.0).alias("total_debt"),
    )
