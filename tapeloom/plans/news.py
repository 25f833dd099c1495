"""News and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import rounded
from ..operators import news as N
from ..sources import tables as T
from .registry import query, r6, rounds, scaled, scaled_sql
from .sql import BARS, NEWS, VECTORS, lag, seeded_sql, win


def _count(text, terms):
    return "(" + " + ".join(f"(length({text}) - length(replace({text}, '{t}', ''))) // {len(t)}" for t in terms) + ")"


def lexicon_sql(text: str) -> str:
    p, n = _count(text, N.BULLISH), _count(text, N.BEARISH)
    return f"coalesce(({p} - {n})::DOUBLE / nullif({p} + {n}, 0), 0.0)"


@query("N1_lexicon_sentiment", f"SELECT doc_id, {r6(lexicon_sql('low'), 'sentiment')} FROM (SELECT doc_id, lower(text) AS low FROM documents)")
def n1(spark, sf):
    return rounded(T.table(spark, sf, "documents").select("doc_id", N.lexicon_sentiment("text").alias("sentiment")))


ND = f"""{NEWS}, sc AS (SELECT ticker, date, length(title) AS tl, length(body) AS bl, {lexicon_sql("lower(title || ' ' || body)")} AS s FROM news),
  nd AS (SELECT ticker, date, count(*) AS news_count, avg(tl) AS news_title_len_mean, avg(bl) AS news_article_len_mean, avg(s) AS news_sentiment_mean,
    coalesce(stddev_samp(s), 0.0) AS news_sentiment_std FROM sc GROUP BY ticker, date)"""


@query("N2_news_daily", f"WITH {ND} SELECT ticker, date, news_count, {rounds(N.DAILY_COLS[1:])} FROM nd")
def n2(spark, sf):
    return rounded(N.news_daily(T.news(spark, sf)))


@query("N3_lagged_news", f"WITH {BARS}, {ND}, j AS (SELECT b.ticker, b.date, {', '.join(f'coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}' for c in N.DAILY_COLS)} FROM bars b LEFT JOIN nd USING (ticker, date)) "
       + "SELECT ticker, date, " + ", ".join(r6(f"coalesce({lag(c)}, 0.0)", f"{c}_lag1") for c in N.DAILY_COLS) + " FROM j")
def n3(spark, sf):
    bars = T.bars_daily(spark, sf).select("ticker", "date")
    return rounded(N.lagged_news(bars, N.news_daily(T.news(spark, sf))))


@query("N4_choose_text", f"WITH {NEWS}, c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND trim(title) <> '' THEN title WHEN doc_id % 3 <> 2 AND trim(body) <> '' THEN body WHEN trim(title) <> '' THEN title ELSE '' END AS text FROM news) SELECT doc_id, text FROM c WHERE length(trim(text)) > 10")
def n4(spark, sf):
    n = T.news(spark, sf).withColumns({
        "Lsa_summary": F.when(F.pmod("doc_id", F.lit(3)) == 0, F.col("title")).otherwise("  "),
        "body": F.when(F.pmod("doc_id", F.lit(3)) != 2, F.col("body")),
    })
    return N.choose_text(n).select("doc_id", "text")


@query("N5_intraday_flag", f"WITH {NEWS} SELECT doc_id, NOT (hour(published_at) = 0 AND minute(published_at) = 0 AND second(published_at) = 0) AS has_time FROM news")
def n5(spark, sf):
    return T.news(spark, sf).select("doc_id", N.intraday_flag("published_at").alias("has_time"))


@query("N6_cap_articles", f"""WITH {NEWS.replace('% 100)', '% 10)')}, y AS (SELECT ticker, CAST(date_trunc('year', date) AS DATE) AS date, doc_id, url FROM news),
  r AS (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY {seeded_sql(42, 'url')}, url) AS k FROM y) SELECT ticker, date, doc_id, url FROM r WHERE k <= 10""")
def n6(spark, sf):
    n = T.news(spark, sf, 10).withColumn("date", F.trunc("date", "year"))
    return N.cap_articles(n).select("ticker", "date", "doc_id", "url")


POOL = """{name} AS (
  SELECT {keys}, list(m ORDER BY pos) AS embedding FROM (
    SELECT {keys}, pos, avg(x) AS m FROM (
      SELECT {keys}, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM {src}) GROUP BY {keys}, pos) GROUP BY {keys})"""
STATS = "avg(pos) AS pos_mean, avg(neg) AS neg_mean, avg(neu) AS neu_mean, avg(pos - neg) AS compound_mean, stddev_pop(pos - neg) AS compound_std, count(*) AS n_articles"
STAT_COLS = ["pos_mean", "neg_mean", "neu_mean", "compound_mean", "compound_std"]


def _vec(df, *keys):
    return rounded(df.select(*keys, scaled("embedding", 5), *STAT_COLS, "n_articles"))


@query("N7_pool_vectors", f"WITH {VECTORS}, v AS (SELECT *, date_trunc('month', date)::DATE AS month FROM vectors), {POOL.format(name='p', keys='ticker, month', src='v')}, s AS (SELECT ticker, month, {STATS} FROM v GROUP BY ticker, month) SELECT ticker, month, {scaled_sql('embedding', 'embedding', 5)}, {rounds(STAT_COLS)}, n_articles FROM p JOIN s USING (ticker, month)")
def n7(spark, sf):
    v = T.article_vectors(spark, sf).withColumn("month", F.trunc("date", "month"))
    return _vec(N.pool_vectors(v, ["ticker", "month"]), "ticker", "month")


@query("N8_impact_score", f"WITH {VECTORS} SELECT vec_id, {r6('abs(pos - neg) * ln(1 + art_len)', 'impact')} FROM vectors")
def n8(spark, sf):
    return rounded(T.article_vectors(spark, sf).select("vec_id", N.impact_score(F.col("pos") - F.col("neg"), "art_len").alias("impact")))


@query("N9_align_news_to_bars", f"""WITH {BARS}, {VECTORS}, a AS (SELECT *, abs(pos - neg) * ln(1 + art_len) AS impact FROM vectors),
  b AS (SELECT ticker, CAST(date AS TIMESTAMP) + INTERVAL 15 HOUR + to_minutes(CAST(volume AS INTEGER)) AS ts FROM bars),
  c AS (SELECT b.ticker, b.ts, a.*EXCLUDE (ticker), count(CASE WHEN a.published_at >= b.ts - INTERVAL 10 DAY THEN 1 END) OVER (PARTITION BY b.ticker, b.ts) AS n
        FROM b JOIN a ON a.ticker = b.ticker AND a.published_at < b.ts),
  d AS (SELECT *, row_number() OVER (PARTITION BY ticker, ts ORDER BY impact DESC, published_at DESC, vec_id) AS r FROM c WHERE n < 5 OR published_at >= ts - INTERVAL 10 DAY),
  e AS (SELECT * FROM d WHERE r <= 15), {POOL.format(name='p', keys='ticker, ts', src='e')}, s AS (SELECT ticker, ts, {STATS} FROM e GROUP BY ticker, ts)
  SELECT b.ticker, b.ts, {scaled_sql('embedding', 'embedding', 5)}, {', '.join(r6(f'coalesce({c}, 0.0)', c) for c in STAT_COLS)}, coalesce(n_articles, 0) AS n_articles FROM b LEFT JOIN p USING (ticker, ts) LEFT JOIN s USING (ticker, ts)""")
def n9(spark, sf):
    at = F.timestamp_seconds(F.unix_seconds(F.col("date").cast("timestamp")) + 15 * 3600 + F.col("volume").cast("bigint") * 60)
    bars = T.bars_daily(spark, sf).select("ticker", at.alias("ts"))
    out = N.align_news_to_bars(bars, T.article_vectors(spark, sf), ident="vec_id")
    return _vec(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ticker", "ts")


SEQ = ["pos_mean", "neg_mean", "compound_mean"]
NSEQ = f"""{BARS}, {VECTORS}, s AS (SELECT ticker, date, {STATS} FROM vectors GROUP BY ticker, date),
  j AS (SELECT b.ticker, b.date, {', '.join(f'coalesce({c}, 0.0) AS {c}' for c in SEQ)} FROM bars b LEFT JOIN s ON s.ticker = b.ticker AND s.date = b.date - 1),
  h AS (SELECT *, {' + '.join(f'abs({c})' for c in SEQ)} > 1e-6 AS has_news FROM j)"""


def _zs(c):
    std = f"greatest(coalesce(CASE WHEN count({c}) {win(252)} >= 2 THEN stddev_samp({c}) {win(252)} END, 1.0), 1e-8)"
    return f"CASE WHEN has_news THEN least(greatest(({c} - avg({c}) {win(252)}) / {std}, -5.0), 5.0) ELSE 0.0 END"


def _nseq(spark, sf, normalize=True):
    daily = N.pool_vectors(T.article_vectors(spark, sf), ["ticker", "date"]).select("ticker", "date", *SEQ)
    return N.news_sequences(T.bars_daily(spark, sf), daily, SEQ, normalize=normalize)


@query("N10_news_sequences", f"WITH {NSEQ} SELECT ticker, date, has_news, " + ", ".join(r6(_zs(c), c, 5) for c in SEQ) + " FROM h")
def n10(spark, sf):
    return rounded(_nseq(spark, sf).select("ticker", "date", "has_news", *SEQ), 5)


@query("N11_news_coverage", f"WITH {NSEQ}, g AS (SELECT ticker FROM h GROUP BY ticker HAVING sum(CASE WHEN has_news THEN 1 ELSE 0 END) >= 5 AND sum(CASE WHEN has_news THEN 1 ELSE 0 END) / count(*) >= 0.02) SELECT ticker, date, has_news FROM h WHERE ticker IN (SELECT ticker FROM g)")
def n11(spark, sf):
    return N.news_coverage(_nseq(spark, sf, False), 5, 0.02).select("ticker", "date", "has_news")


PAST = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query("N12_news_density_recency", f"""WITH {NSEQ}, q AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS t, CASE WHEN has_news THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS n FROM h),
  l AS (SELECT *, {' + '.join(f"coalesce(lag(n, {20 - i}) OVER (PARTITION BY ticker ORDER BY date), 0) * ({0.5 + 0.5 * i / 19!r}::DOUBLE)" for i in range(20))} AS wsum, sum(n) {PAST} AS hits, max(CASE WHEN has_news THEN t END) {PAST} AS last FROM q)
  SELECT ticker, date, {r6('CASE WHEN t >= 20 THEN hits / 20 END', 'news_density')}, {r6('CASE WHEN t >= 20 THEN wsum / 15 END', 'weighted_density')}, {r6('CASE WHEN t >= 20 THEN least(coalesce((t - 1 - last) / 20.0::DOUBLE, 1.0), 1.0) END', 'news_recency')} FROM l""")
def n12(spark, sf):
    df = N.news_density_recency(_nseq(spark, sf, False), 20)
    return rounded(df.select("ticker", "date", "news_density", "weighted_density", "news_recency"))


@query("N13_recent_sentiment", f"""WITH {VECTORS}, q AS (SELECT *, published_at >= TIMESTAMP '2001-01-15' - INTERVAL 365 DAY AS rec FROM vectors)
  SELECT ticker, count(CASE WHEN rec THEN 1 END) > 0 AS available, {r6('coalesce(avg(CASE WHEN rec THEN pos END) - avg(CASE WHEN rec THEN neg END), 0.0)', 'sentiment_score')}, count(CASE WHEN rec THEN 1 END) AS n_articles, count(*) AS total_articles FROM q GROUP BY ticker""")
def n13(spark, sf):
    return rounded(N.recent_sentiment(T.article_vectors(spark, sf), "2001-01-15 00:00:00", 365))
