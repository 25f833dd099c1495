"""Queries for sources, sinks and ingestion (S1-S17) and for cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions.core import half_away, rounded
from ..operators import daily as D
from ..session import materialize, work_dir
from ..sources import bars as B
from ..sources import feeds
from ..sources import tables as T
from .registry import query, r6
from .sql import BARS, BRAND, NEWS, SECTORS, event_bars, pct, std0, run

OHLCV = ["open", "high", "low", "close", "volume"]
OUT = ", ".join(r6(c, c, 8) for c in OHLCV)


def _bars(df, *cols):
    return rounded(df.select(*(cols or ("ticker", "date")), *OHLCV), 8)


@query("S1_read_daily_bars", f"WITH {BRAND} SELECT ticker, date, {OUT} FROM brand")
def s1(spark, sf):
    # plain ticker folders; headers in two orders, one of them without adjusted close, newest day first
    path, bars = work_dir(spark) + "/daily", materialize(T.bars_brand(spark, sf))
    for i, r in enumerate(bars.select("ticker").distinct().orderBy("ticker").collect()):
        own = bars.where(F.col("ticker") == r["ticker"]).orderBy(F.desc("date"))
        named = {"date": "Date", "open": "Open", "high": "High", "low": "Low", "close": "Close", "volume": " Volume"}
        cols = [F.col(c).alias(n) for c, n in named.items()]
        cols = [*cols[::-1], F.lit(None).cast("double").alias("Adj Close")] if i % 2 else cols
        own.select(*cols).coalesce(1).write.option("header", True).csv(f"{path}/{r['ticker']}")
    return _bars(B.read_daily_bars(spark, path))


@query("S2_standardize_columns", f"WITH {BARS} SELECT ticker, date, {r6('close', 'close', 8)}, {r6('volume', 'volume', 8)}, CAST(NULL AS DOUBLE) AS adj_close FROM bars")
def s2(spark, sf):
    df = T.bars_daily(spark, sf)
    raw = df.select(
        F.col("ticker").alias("Symbol"),
        F.when(F.col("volume") > 30, F.col("date")).alias("Date"),
        F.when(F.col("volume") <= 30, F.col("date")).alias("timestamp"),
        F.col("close").alias(" Close "), F.col("volume").alias("VOLUME"),
    )
    names = {"ticker": ["symbol"], "date": ["timestamp"], "close": [], "adj_close": ["adj close"], "volume": []}
    return rounded(B.standardize_columns(raw, names, {"adj_close": "double"}), 8)


@query("S3_adjust_close", f"WITH {BARS} SELECT ticker, date, {r6('CASE WHEN volume > 30 THEN close ELSE close * 0.5::DOUBLE END', 'close', 8)} FROM bars")
def s3(spark, sf):
    df = T.bars_daily(spark, sf).withColumn("adj_close", F.when(F.col("volume") <= 30, F.col("close") * 0.5))
    return rounded(B.adjust_close(df).select("ticker", "date", "close"), 8)


@query("S4_read_minute_bars", f"WITH {event_bars()} SELECT ticker, ts, {OUT} FROM mbars")
def s4(spark, sf):
    path = work_dir(spark) + "/minute"
    bars = materialize(T.bars_minute(spark, sf).drop("date"))
    bars = bars.unionByName(bars.where("volume > 1")).withColumnRenamed("ts", "timestamp")
    for r in bars.select("ticker").distinct().collect():  # a file for each ticker, which does not hold its name
        bars.where(F.col("ticker") == r["ticker"]).drop("ticker").write.parquet(f"{path}/{r['ticker']}.parquet")
    return _bars(B.read_minute_bars(spark, path), "ticker", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("S5_parse_ts", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderdate END AS parsed FROM orders""")
def s5(spark, sf):
    o, d = T.table(spark, sf, "orders"), F.col("o_orderdate")
    spellings = [
        F.date_format(d, "yyyy-MM-dd HH:mm:ss"), F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"),
        F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "MM/dd/yyyy"), F.concat(F.lit("no date "), F.col("o_orderkey").cast("string")),
    ]
    kind = F.pmod("o_orderkey", F.lit(5))
    text = F.coalesce(*[F.when(kind == i, s) for i, s in enumerate(spellings)])
    return o.select("o_orderkey", B.parse_ts(text).cast("timestamp_ntz").alias("parsed"))


CUT = """cut AS (SELECT *, DATE '1998-01-01' + CAST(length(ticker) * 30 AS INTEGER) AS cut FROM bars)"""


def _cut(df):
    return df.withColumn("cut", F.date_add(F.lit("1998-01-01").cast("date"), F.length("ticker") * 30))


@query("S6_incremental_daily", f"WITH {BARS}, {CUT}, ex AS (SELECT * FROM cut WHERE date <= cut), la AS (SELECT ticker, max(date) AS last FROM ex GROUP BY ticker) "
       f"SELECT ticker, date, {r6('close', 'close', 8)}, src FROM (SELECT ticker, date, close, 'old' AS src FROM ex UNION ALL "
       "SELECT b.ticker, b.date, b.close + 1 AS close, 'new' AS src FROM bars b LEFT JOIN la USING (ticker) WHERE la.last IS NULL OR b.date > la.last)")
def s6(spark, sf):
    df = T.bars_daily(spark, sf)
    old = _cut(df).where("date <= cut").select("ticker", "date", "close", F.lit("old").alias("src"))
    new = df.select("ticker", "date", (F.col("close") + 1).alias("close"), F.lit("new").alias("src"))
    return rounded(B.incremental_daily(old, new), 8)


MERGE = f"SELECT ticker, ts, {r6('close', 'close', 8)}, src FROM (SELECT ticker, ts, close, 'old' AS src FROM mbars WHERE close > 20 UNION ALL SELECT ticker, ts, close + 1, 'new' FROM mbars WHERE NOT close > 20)"


@query("S7_merge_bars", f"WITH {event_bars()} {MERGE}")
def s7(spark, sf):
    df = T.bars_minute(spark, sf).select("ticker", F.col("ts").cast("timestamp_ntz").alias("ts"), "close")
    old = df.where("close > 20").withColumn("src", F.lit("old"))
    new = df.withColumns({"close": F.col("close") + 1, "src": F.lit("new")})
    return rounded(B.merge_bars(old, new), 8)


@query("S8_merge_news", f"""WITH {NEWS}, u AS (
  SELECT source || '/' || (doc_id // 3) AS url, published_at, doc_id, title, 0 AS fresh FROM news WHERE doc_id % 2 = 0
  UNION ALL SELECT source || '/' || (doc_id // 3), published_at, doc_id, title, 1 FROM news),
  r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY published_at DESC, fresh, doc_id, title) AS r FROM u)
  SELECT url, published_at, doc_id, title FROM r WHERE r = 1""")
def s8(spark, sf):
    n = T.news(spark, sf).select(
        F.concat_ws("/", "source", F.expr("doc_id div 3").cast("string")).alias("url"),
        F.col("published_at").cast("timestamp_ntz").alias("published_at"), "doc_id", "title",
    )
    return feeds.merge_news(n.where("doc_id % 2 = 0"), n)


@query("S9_collection_status", f"WITH {BARS} SELECT ticker, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, CAST(max(date) - min(date) AS BIGINT) AS span_days FROM bars GROUP BY ticker")
def s9(spark, sf):
    return B.collection_status(T.bars_daily(spark, sf))


@query("S10_backfill_gaps", f"""WITH {BARS}, {CUT}, h AS (SELECT ticker, min(date) AS f, max(date) AS l FROM cut WHERE date <= cut AND ticker <> 'S7' GROUP BY ticker),
  j AS (SELECT s.ticker, f, l FROM (SELECT 'S' || s_suppkey AS ticker FROM supplier) s LEFT JOIN h USING (ticker))
  SELECT ticker, DATE '1995-01-01' AS fetch_start, DATE '2000-12-31' AS fetch_end, 'missing' AS status FROM j WHERE f IS NULL
  UNION ALL SELECT ticker, DATE '1995-01-01', f - 1, 'before' FROM j WHERE f > DATE '1995-01-01' + 5
  UNION ALL SELECT ticker, l + 1, DATE '2000-12-31', 'after' FROM j WHERE l < DATE '2000-12-31' - 5
  UNION ALL SELECT ticker, NULL, NULL, 'complete' FROM j WHERE f IS NOT NULL AND NOT f > DATE '1995-01-01' + 5 AND NOT l < DATE '2000-12-31' - 5""")
def s10(spark, sf):
    have = _cut(T.bars_daily(spark, sf)).where("date <= cut AND ticker <> 'S7'")
    tickers = T.sectors(spark, sf).select("ticker")
    return B.backfill_gaps(have, tickers, "1995-01-01", "2000-12-31")


@query("S11_viable_tickers", f"""WITH {BARS}, d AS (SELECT ticker, count(*) AS n_daily FROM bars GROUP BY ticker HAVING count(*) >= 500),
  m AS (SELECT 'S' || (user_id % 100) AS ticker, count(*) AS n_minute FROM events GROUP BY 1 HAVING count(*) >= 80)
  SELECT ticker, n_daily, n_minute FROM d JOIN m USING (ticker)""")
def s11(spark, sf):
    minute = T.table(spark, sf, "events").select(F.concat(F.lit("S"), F.pmod("user_id", F.lit(100)).cast("string")).alias("ticker"))
    return B.viable_tickers(T.bars_daily(spark, sf), minute, 500, 80)


@query("S12_journal", """SELECT 'S' || l_suppkey AS ticker, CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS run_id, 'long' AS direction,
  l_extendedprice AS entry_price, l_discount AS vol FROM lineitem""")
def s12(spark, sf):
    path = work_dir(spark) + "/journal"
    rows = T.table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("run_id"),
        F.lit("long").alias("direction"), F.col("l_extendedprice").alias("entry_price"),
        F.create_map(F.lit("vol"), F.col("l_discount")).alias("regime_features"),
    )
    feeds.write_journal(rows, path)
    # a torn line, as a writer that died would leave it
    spark.range(1).select(F.lit('{"ticker": "S1", "run_id": ').alias("value")).write.mode("append").text(path)
    j = feeds.read_journal(spark, path)
    return j.select("ticker", "run_id", "direction", "entry_price", F.col("regime_features")["vol"].alias("vol"))


@query("S13_write_features", f"WITH {BARS} SELECT ticker, date, {r6("CASE WHEN year(date) = 1998 AND ticker LIKE '%7' THEN close * 2 ELSE close END", 'close', 8)}, CAST(year(date) AS INTEGER) AS year FROM bars")
def s13(spark, sf):
    path = work_dir(spark) + "/features"
    df = T.bars_daily(spark, sf).select("ticker", "date", "close")
    B.write_features(df, path)
    # rebuild one year of some tickers; the other tickers of that year and all other years stay as they are
    B.write_features(df.where("year(date) = 1998 AND ticker LIKE '%7'").withColumn("close", F.col("close") * 2), path)
    return rounded(spark.read.parquet(path).select("ticker", "date", "close", "year"), 8)


@query("S14_build_bars", f"WITH {BARS} SELECT ticker, date, {OUT} FROM bars")
def s14(spark, sf):
    return _bars(T.bars_daily(spark, sf))


_STRIP = r"regexp_replace({x}, '(?s)\s*<[^>]*>\s*', '', 'g')"
# written out here on its own: the references that the pages hold, and the basic ones
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "\'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _STRIP = f"replace({_STRIP}, '{_name}', '{_char.replace(chr(39), chr(39) * 2)}')"
_STRIP = r"regexp_replace(" + _STRIP + r", '^\s+|\s+$', '', 'g')"


def strip_sql(x: str) -> str:
    return _STRIP.replace("{x}", x)


@query("S15_extract_article_text", f"""WITH p AS (SELECT page_id, url, regexp_replace(html, '{feeds.SCRIPT}', '', 'g') AS h FROM pages),
  q AS (SELECT page_id, url, list_transform(string_split_regex(h, '{feeds.PARAGRAPH_START}')[2:], lambda x: {strip_sql(f"regexp_replace(x, '{feeds.PARAGRAPH_END}', '')")}) AS g FROM p),
  t AS (SELECT page_id, url, array_to_string(list_filter(g, lambda x: length(x) > 40), ' ') AS g FROM q)
  SELECT page_id, url, CASE WHEN length(g) > 100 THEN g END AS article FROM t""")
def s15(spark, sf):
    return feeds.extract_article_text(T.table(spark, sf, "pages")).select("page_id", "url", "article")


@query("S16_normalize_feed", f"""WITH {NEWS}, f AS (SELECT doc_id, url, title, source AS publisher, published_at, CASE WHEN doc_id % 3 = 0 THEN title ELSE {strip_sql("body")} END AS plain, body FROM news)
  SELECT doc_id, url, nullif(title, '') AS title, publisher, published_at, CASE WHEN length(plain) < 80 THEN coalesce(nullif(body, ''), plain) ELSE plain END AS body
  FROM f WHERE length(CASE WHEN length(plain) < 80 THEN coalesce(nullif(body, ''), plain) ELSE plain END) >= 50""")
def s16(spark, sf):
    n = T.news(spark, sf)
    flat = F.to_json(F.struct(
        F.col("url").alias("link"), "title", F.col("source").alias("publisher"),
        F.unix_seconds("published_at").alias("providerPublishTime"),
        F.struct(F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("<p>"), "title", F.lit("</p>"))).otherwise(F.col("body")).alias("description"), F.col("body").alias("summary")).alias("content"),
    ))
    nested = F.to_json(F.struct(F.struct(
        F.struct(F.col("url")).alias("canonicalUrl"), "title", F.struct(F.col("source").alias("displayName")).alias("provider"),
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("pubDate"),
        F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("<p>"), "title", F.lit("</p>"))).otherwise(F.col("body")).alias("description"), F.col("body").alias("summary"),
    ).alias("content")))
    items = n.select("doc_id", F.when(F.pmod("doc_id", F.lit(2)) == 0, flat).otherwise(nested).alias("item"))
    return feeds.normalize_feed(items).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("S17_read_snapshot", f"WITH {event_bars()} SELECT ticker, ts, {r6('close', 'close', 8)} FROM mbars WHERE date = (SELECT max(date) FROM mbars)")
def s17(spark, sf):
    path = work_dir(spark) + "/snapshots"
    bars = T.bars_minute(spark, sf).select("ticker", F.col("ts").cast("timestamp_ntz").alias("ts"), "close", F.col("date").alias("snapshot"))
    bars.repartition("snapshot").write.partitionBy("snapshot").parquet(path)
    return rounded(B.read_snapshot(spark, path).select("ticker", "ts", "close"), 8)


# --- cleaning ----------------------------------------------------------------

NAMES = [*C.SECTOR_ALIASES, "tobacco", ""]
_LIST = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
_CASE = "CASE raw " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.SECTOR_ALIASES.items()) + " ELSE 'Unknown' END"
_IDS = "CASE sector " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(C.SECTORS)) + " END"


@query("P1_normalize_sector", f"WITH c AS (SELECT c_custkey, {_LIST}[CAST(c_custkey % {len(NAMES)} + 1 AS INTEGER)] AS raw FROM customer), s AS (SELECT c_custkey, {_CASE} AS sector FROM c) SELECT c_custkey, sector, CAST({_IDS} AS INTEGER) AS sector_id FROM s")
def p1(spark, sf):
    raw = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.pmod("c_custkey", F.lit(len(NAMES))) + 1).cast("int"))
    df = T.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" "), F.initcap(raw)).alias("raw"))
    df = df.select("c_custkey", C.normalize_sector("raw").alias("sector"))
    return df.withColumn("sector_id", C.sector_id("sector"))


@query("P2_mcap_bucket", """WITH c AS (SELECT c_custkey, c_acctbal * c_acctbal * c_acctbal AS cap FROM customer), b AS (SELECT c_custkey, CASE WHEN cap >= 200e9 THEN 'Mega' WHEN cap >= 10e9 THEN 'Large' WHEN cap >= 2e9 THEN 'Mid'
  WHEN cap >= 300e6 THEN 'Small' WHEN cap >= 50e6 THEN 'Micro' WHEN cap > 0 THEN 'Nano' ELSE 'Unknown' END AS bucket FROM c)
  SELECT c_custkey, bucket, CAST(CASE bucket WHEN 'Mega' THEN 0 WHEN 'Large' THEN 1 WHEN 'Mid' THEN 2 WHEN 'Small' THEN 3 WHEN 'Micro' THEN 4 WHEN 'Nano' THEN 5 ELSE 6 END AS INTEGER) AS bucket_id FROM b""")
def p2(spark, sf):
    b = F.col("c_acctbal")
    df = T.table(spark, sf, "customer").select("c_custkey", C.mcap_bucket(b * b * b).alias("bucket"))
    return df.withColumn("bucket_id", C.mcap_id("bucket"))


@query("P3_clip", f"WITH {BARS} SELECT ticker, date, {r6(f'CASE WHEN {pct('close', 1)} IS NOT NULL THEN least(greatest({pct('close', 1)}, -0.2), 0.2) END', 'ret')} FROM bars")
def p3(spark, sf):
    df = D.returns(T.bars_daily(spark, sf), (1,))
    return rounded(df.select("ticker", "date", D.clip("return_1d", -0.2, 0.2).alias("ret")))


@query("P4_clean", f"WITH {BARS} SELECT ticker, date, {r6(f'coalesce({pct('close', 1)}, 0.0)', 'a')}, {r6('CASE WHEN close > open THEN sqrt(close - open) ELSE 0.0 END', 'b')}, {r6('CASE WHEN volume > 20 THEN 1 / volume ELSE 0 END', 'c')} FROM bars")
def p4(spark, sf):
    df = D.returns(T.bars_daily(spark, sf), (1,)).select(
        "ticker", "date", F.col("return_1d").alias("a"), F.sqrt(F.col("close") - F.col("open")).alias("b"),
        F.when(F.col("volume") > 20, 1 / F.col("volume")).otherwise(float("inf")).alias("c"),
    )
    return rounded(C.clean(df, ["a", "b", "c"]))


@query("P5_winsorize_median", f"WITH {BARS}, s AS (SELECT *, median(close) OVER (PARTITION BY ticker) AS m, stddev_samp(close) OVER (PARTITION BY ticker) AS sd FROM bars) SELECT ticker, date, {r6('CASE WHEN sd > 0 THEN least(greatest(close, m - 1.5::DOUBLE * sd), m + 1.5::DOUBLE * sd) ELSE close END', 'close', 8)} FROM s")
def p5(spark, sf):
    return rounded(C.winsorize_median(T.bars_daily(spark, sf), ["close"], 1.5).select("ticker", "date", "close"), 8)


@query("P6_fix_percent_form", f"WITH {BARS}, s AS (SELECT *, median(volume) OVER (PARTITION BY ticker) AS m FROM bars) SELECT ticker, date, {r6('CASE WHEN m > 26 THEN volume / 100 ELSE volume END', 'volume')} FROM s")
def p6(spark, sf):
    return rounded(C.fix_percent_form(T.bars_daily(spark, sf), "volume", limit=26.0).select("ticker", "date", "volume"))


@query("P7_ffill", f"WITH {BARS}, s AS (SELECT *, CASE WHEN volume > 25 THEN close END AS x FROM bars) SELECT ticker, date, {r6(f'coalesce(last_value(x IGNORE NULLS) {run()}, 0.0)', 'x', 8)} FROM s")
def p7(spark, sf):
    df = T.bars_daily(spark, sf).withColumn("x", F.when(F.col("volume") > 25, F.col("close")))
    return rounded(C.ffill(df, ["x"]).select("ticker", "date", "x"), 8)


FORMULA = "return_5d / (realized_vol_20d + 0.01) + sign(return_1d)"


@query("P8_formula_feature", f"WITH {BARS}, r AS (SELECT *, {pct('close', 1)} AS return_1d, {pct('close', 5)} AS return_5d FROM bars), q AS (SELECT *, {std0('return_1d', 20)} * sqrt(252.0) AS v FROM r) SELECT ticker, date, {r6('coalesce(return_5d / (v + 0.01) + sign(return_1d), 0.0)', 'feat_momentum', 5)}, CAST(NULL AS DOUBLE) AS feat_flat FROM q")
def p8(spark, sf):
    df = D.realized_vol(D.returns(T.bars_daily(spark, sf), (1, 5)), (20,))
    df = C.formula_feature(df, "feat_momentum", FORMULA)
    df = C.formula_feature(df, "feat_flat", "volume * 0")  # constant, so rejected
    return rounded(df.select("ticker", "date", "feat_momentum", "feat_flat"), 5)


@query("P9_latest_features", f"WITH {BARS}, r AS (SELECT *, coalesce({pct('close', 1)}, 0.0) AS return_1d, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM bars) SELECT ticker, date, {r6('return_1d', 'return_1d')}, {r6('close', 'close', 8)} FROM r WHERE n = 1")
def p9(spark, sf):
    df = C.clean(D.returns(T.bars_daily(spark, sf), (1,)), ["return_1d"])
    m = C.latest_features(df, ["return_1d", "close"])
    return m.select("ticker", "date", half_away(F.col("features")["return_1d"], 6).alias("return_1d"), half_away(F.col("features")["close"], 8).alias("close"))


@query("P10_diversified_sample", f"""WITH {SECTORS}, r AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY ticker) AS r,
  list_position(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'], sector) AS p FROM sectors)
  SELECT ticker, sector FROM r WHERE r <= 3 ORDER BY p, r LIMIT 18""")
def p10(spark, sf):
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    return C.diversified_sample(T.sectors(spark, sf), 18, names).select("ticker", "sector")
