"""News text, daily news tables and their alignment to bars."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import add_all, clip, col, seeded, series
from ..functions.scan import rolling_moments
from ..session import materialize

# Lexicon terms.
BULLISH = ["beat", "strong", "growth", "upgrade", "bull", "outperform", "surge", "record", "buy", "positive", "gain", "profit"]
BEARISH = ["miss", "weak", "downgrade", "bear", "underperform", "drop", "fall", "risk", "negative", "loss", "lawsuit", "concern"]
SUMMARIES = ["Lexrank_summary", "Lsa_summary", "Textrank_summary", "Luhn_summary"]
MIN_TEXT = 10
DAY = 86_400


def _hits(text: Column, terms: list[str]) -> Column:
    return add_all([F.regexp_count(text, F.lit(t)) for t in terms])


def lexicon_sentiment(c: str | Column) -> Column:
    """(bullish - bearish) / (bullish + bearish) term counts of the whole text, 0 without any."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    pos, neg = _hits(text, BULLISH), _hits(text, BEARISH)
    return F.coalesce(F.try_divide((pos - neg).cast("double"), (pos + neg).cast("double")), F.lit(0.0))


def news_daily(news: DataFrame, title: str = "title", body: str = "body", key: str = "ticker", date: str = "date") -> DataFrame:
    """Article count, mean lengths and lexicon sentiment per ticker and day."""
    t, b = F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(body), F.lit(""))
    scored = news.where(F.col(date).isNotNull()).select(
        key, date, F.length(t).alias("__tl"), F.length(b).alias("__bl"), lexicon_sentiment(F.concat_ws(" ", t, b)).alias("__s")
    )
    return scored.groupBy(key, date).agg(
        F.count(F.lit(1)).alias("news_count"),
        F.avg("__tl").alias("news_title_len_mean"),
        F.avg("__bl").alias("news_article_len_mean"),
        F.avg("__s").alias("news_sentiment_mean"),
        F.coalesce(F.stddev_samp("__s"), F.lit(0.0)).alias("news_sentiment_std"),
    )


DAILY_COLS = ["news_count", "news_title_len_mean", "news_article_len_mean", "news_sentiment_mean", "news_sentiment_std"]


def lagged_news(bars: DataFrame, daily: DataFrame, lag_rows: int = 1, cols=tuple(DAILY_COLS), key: str = "ticker", date: str = "date") -> DataFrame:
    """Daily news on trading dates, 0 where there is none, shifted by rows."""
    w = series(key, date)
    j = bars.join(daily.select(key, date, *cols), [key, date], "left")
    out = {f"{c}_lag{lag_rows}": F.lag(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), lag_rows, 0.0).over(w) for c in cols}
    return j.withColumns(out).drop(*cols)


def choose_text(news: DataFrame, summaries=tuple(SUMMARIES), body: str = "body", title: str = "title", out: str = "text",
                max_chars: int | None = None) -> DataFrame:
    """The first summary column of the table, else the body, else the title; short texts are dropped.

    ``max_chars`` cuts the text for an encoder with a fixed input size; the whole
    text is kept by default.
    """
    present = [s for s in summaries if s in news.columns][:1]
    order = [*present, body, title] if present else [title]
    blank = F.lit("")
    text = F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.col(c)) for c in order], blank)
    df = news.withColumn(out, F.substring(text, 1, max_chars) if max_chars else text)
    return df.where(F.length(F.trim(text)) > MIN_TEXT)


def intraday_flag(ts: str | Column) -> Column:
    """Whether the time of day is known (not midnight)."""
    ts = col(ts)
    return ~((F.hour(ts) == 0) & (F.minute(ts) == 0) & (F.second(ts) == 0))


def cap_articles(news: DataFrame, n: int = 10, seed: int = 42, key: str = "ticker", date: str = "date", ident: str = "url") -> DataFrame:
    """A seeded sample of at most n articles per ticker and day."""
    w = Window.partitionBy(key, date).orderBy(seeded(seed, ident), ident)
    return news.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def pool_vectors(df: DataFrame, keys: list[str], embedding: str = "embedding") -> DataFrame:
    """Mean vector and six sentiment statistics per group."""
    compound = F.col("pos") - F.col("neg")
    g = df.groupBy(*keys).agg(
        Summarizer.mean(array_to_vector(F.col(embedding))).alias("__v"),
        F.avg("pos").alias("pos_mean"),
        F.avg("neg").alias("neg_mean"),
        F.avg("neu").alias("neu_mean"),
        F.avg(compound).alias("compound_mean"),
        F.stddev_pop(compound).alias("compound_std"),
        F.count(F.lit(1)).alias("n_articles"),
    )
    return g.select(
        *keys, vector_to_array("__v").alias("embedding"), "pos_mean", "neg_mean", "neu_mean", "compound_mean", "compound_std", "n_articles"
    )


def impact_score(compound: str | Column, length: str | Column) -> Column:
    """|sentiment| times log of the article length."""
    return F.abs(col(compound)) * F.log1p(col(length))


# --- N9 ----------------------------------------------------------------------



def _top_per(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k most telling articles per group; the limit also runs before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc("impact"), F.desc("sec"), "art_id")
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def _best(parts: list[DataFrame], keys: list[str], k: int) -> DataFrame:
    """The k best of several candidate sets of the same groups."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return _top_per(both, keys, k)


def select_articles(bars: DataFrame, articles: DataFrame, min_articles: int = 5, top_k: int = 15, days: int = 10,
                    key: str = "ticker", ts: str = "ts", ident: str = "art_id", published: str = "published_at") -> DataFrame:
    """The articles each bar sees: one row per (key, ts, art_id), at most ``top_k`` per bar.

    A bar sees articles strictly before it within ``days``; with fewer than
    ``min_articles`` of those, all earlier ones.  Of what it sees the ``top_k``
    by impact stay.

    Pairing every bar with every visible article would explode, so articles are
    reduced to the best ``top_k`` of each second, minute, hour, day and month first.  All
    bars of a day share the whole days they look back on, all bars of an hour the whole
    hours, all bars of a minute the whole minutes; only seconds of the two partial minutes
    meet single bars, so a bar meets at most 120 lists however many articles an hour has.
    A best-k list of a union is contained in the union of best-k lists, so this is exact.

    The bar times, the article lists and the first selection feed several joins
    and are written once.
    """
    k = max(top_k, min_articles)
    sec = F.unix_seconds(F.col(published).cast("timestamp"))
    month = F.date_format(F.col(published).cast("timestamp"), "yyyyMM").cast("int")
    art = articles.select(
        key, F.col(ident).alias("art_id"), F.col("impact").cast("double").alias("impact"), sec.alias("sec"),
        F.floor(sec / DAY).alias("day"), F.floor(sec / 3600).alias("hour"), F.floor(sec / 60).alias("minute"), month.alias("month"),
    )
    bsec = F.unix_seconds(F.col(ts).cast("timestamp"))
    bar = bars.select(key, ts).distinct().join(articles.select(key).distinct(), key, "left_semi").select(
        key, ts, bsec.alias("bsec"), F.floor(bsec / DAY).alias("bday"), F.floor(bsec / 3600).alias("bhour"), F.floor(bsec / 60).alias("bmin"),
        F.date_format(F.col(ts).cast("timestamp"), "yyyyMM").cast("int").alias("bmonth"),
    )
    bar = materialize(bar)
    ids = ["art_id", "impact", "sec"]
    # articles of one second are seen together, so even a burst leaves k rows per second
    by_sec = materialize(_top_per(art, [key, "sec"], k))
    by_min = _top_per(by_sec, [key, "minute"], k)
    by_hour = _top_per(by_sec, [key, "hour"], k)
    by_day = _top_per(by_hour, [key, "day"], k)
    by_month = _top_per(by_day, [key, "month"], k)

    bmins = bar.select(key, "bmin", "bhour").distinct()
    bhours = bar.select(key, "bhour", "bday", "bmonth").distinct()
    bdays = bar.select(key, "bday", "bmonth").distinct()
    bmonths = bar.select(key, "bmonth").distinct()

    # whole days behind a bar's day
    whole = F.sequence(F.col("bday") - (days - 1), F.col("bday") - 1) if days > 1 else F.array().cast("array<bigint>")
    reach = bdays.withColumn("day", F.explode(whole))
    win_day = _top_per(reach.join(by_day.select(key, "day", *ids), [key, "day"]), [key, "bday"], k).select(key, "bday", *ids)
    # whole hours: earlier today, and later on the day the window starts in
    hours = by_hour.select(key, "hour", "day", *ids)
    today = bhours.join(hours.withColumnRenamed("day", "bday"), [key, "bday"]).where("hour < bhour").select(key, "bhour", *ids)
    edge = bhours.withColumn("day", F.col("bday") - days).join(hours, [key, "day"]).where(
        F.col("hour") > F.col("bhour") - days * 24
    ).select(key, "bhour", *ids)
    win_hour = _best([today, edge], [key, "bhour"], k)
    # whole minutes: earlier this hour, and later in the hour the window starts in
    minutes = by_min.select(key, "minute", "hour", *ids)
    head = bmins.join(minutes.withColumnRenamed("hour", "bhour"), [key, "bhour"]).where("minute < bmin").select(key, "bmin", *ids)
    tail = bmins.withColumn("hour", F.col("bhour") - days * 24).join(minutes, [key, "hour"]).where(
        F.col("minute") > F.col("bmin") - days * 24 * 60
    ).select(key, "bmin", *ids)
    win_min = _best([head, tail], [key, "bmin"], k)
    # partial minutes: single seconds against single bars
    seconds = by_sec.select(key, "minute", *ids)
    now = bar.select(key, ts, "bsec", F.col("bmin").alias("minute")).join(seconds, [key, "minute"]).where("sec < bsec")
    old = bar.select(key, ts, "bsec", (F.col("bmin") - days * 24 * 60).alias("minute")).join(seconds, [key, "minute"]).where(
        F.col("sec") >= F.col("bsec") - days * DAY
    )
    per_bar = bar.select(key, ts, "bday", "bhour", "bmin")
    recent = now.select(key, ts, *ids)
    window = _best(
        [
            recent.unionByName(old.select(key, ts, *ids)),
            per_bar.join(win_min, [key, "bmin"]).select(key, ts, *ids),
            per_bar.join(win_hour, [key, "bhour"]).select(key, ts, *ids),
            per_bar.join(win_day, [key, "bday"]).select(key, ts, *ids),
        ],
        [key, ts],
        k,
    )
    window = materialize(window.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key, ts))))
    enough = window.where(F.col("__n") >= min_articles).select(key, ts, *ids)

    # bars with too few: everything earlier, month by month, then day, hour, minute, article
    poor = bar.join(enough.select(key, ts).distinct(), [key, ts], "left_anti")
    all_month = _top_per(
        poor.select(key, "bmonth").distinct().join(by_month.select(key, "month", *ids), key).where("month < bmonth"), [key, "bmonth"], k
    ).select(key, "bmonth", *ids)
    all_day = _top_per(
        poor.select(key, "bday", "bmonth").distinct().join(
            by_day.select(key, "day", F.col("month").alias("bmonth"), *ids), [key, "bmonth"]
        ).where("day < bday"),
        [key, "bday"], k,
    ).select(key, "bday", *ids)
    slim = poor.select(key, ts, "bday", "bhour", "bmin", "bmonth")
    widened = _best(
        [
            recent.join(poor.select(key, ts), [key, ts], "left_semi"),
            slim.join(_top_per(head, [key, "bmin"], k), [key, "bmin"]).select(key, ts, *ids),
            slim.join(_top_per(today, [key, "bhour"], k), [key, "bhour"]).select(key, ts, *ids),
            slim.join(all_day, [key, "bday"]).select(key, ts, *ids),
            slim.join(all_month, [key, "bmonth"]).select(key, ts, *ids),
        ],
        [key, ts],
        top_k,
    )
    return _top_per(enough, [key, ts], top_k).unionByName(widened)


def align_news_to_bars(bars: DataFrame, articles: DataFrame, min_articles: int = 5, top_k: int = 15, days: int = 10,
                       key: str = "ticker", ts: str = "ts", ident: str = "art_id") -> DataFrame:
    """Pooled vector and sentiment of the articles each bar sees, NULL vector and zeros without any.

    ``articles`` carries ``ident, published_at, art_len, pos, neg, neu, embedding``.
    """
    scored = articles.withColumn("impact", impact_score(F.col("pos") - F.col("neg"), "art_len"))
    seen = select_articles(bars, scored, min_articles, top_k, days, key, ts, ident)
    facts = articles.select(F.col(ident).alias("art_id"), "pos", "neg", "neu", "embedding")
    pooled = pool_vectors(seen.select(key, ts, "art_id").join(facts, "art_id"), [key, ts])
    out = bars.join(pooled, [key, ts], "left")
    zero = ["pos_mean", "neg_mean", "neu_mean", "compound_mean", "compound_std"]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in zero} | {"n_articles": F.coalesce("n_articles", F.lit(0))})


# --- daily sequences and coverage --------------------------------------------


def news_sequences(bars: DataFrame, daily: DataFrame, cols: list[str], lag_days: int = 1, window: int = 252, normalize: bool = True,
                   key: str = "ticker", date: str = "date") -> DataFrame:
    """Day values of ``lag_days`` calendar days before on trading dates, 0 when absent.

    ``has_news`` marks rows with any value; only those are z-scored.
    """
    lagged = daily.select(key, F.date_add(date, lag_days).alias(date), *cols)
    j = bars.select(key, date).join(lagged, [key, date], "left").withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    )
    j = j.withColumn("has_news", add_all([F.abs(F.col(c)) for c in cols]) > 1e-6)
    if not normalize:
        return j
    j = rolling_moments(j, {c: [window] for c in cols}, key, date)
    out = {}
    for c in cols:
        std = F.greatest(F.coalesce(F.col(f"__d_{c}_{window}"), F.lit(1.0)), F.lit(1e-8))
        out[c] = F.when(F.col("has_news"), clip((F.col(c) - F.col(f"__m_{c}_{window}")) / std, -5, 5)).otherwise(0.0)
    return j.withColumns(out).drop(*[f"__{p}_{c}_{window}" for c in cols for p in "mdk"])


def news_coverage(df: DataFrame, min_days: int = 30, min_density: float = 0.05, key: str = "ticker", flag: str = "has_news") -> DataFrame:
    """Rows of tickers with enough news days, absolute and as a share."""
    hit = F.when(F.col(flag), 1).otherwise(0)
    good = df.groupBy(key).agg(F.sum(hit).alias("__d"), F.count(F.lit(1)).alias("__n")).where(
        (F.col("__d") >= min_days) & (F.col("__d") / F.col("__n") >= min_density)
    )
    return df.join(good, key, "left_semi")


def news_density_recency(df: DataFrame, seq_len: int, key: str = "ticker", date: str = "date", flag: str = "has_news") -> DataFrame:
    """Over the ``seq_len`` rows before each row: share with news, the same weighted
    from 0.5 (oldest) to 1.0, and rows since the last news over ``seq_len``.

    NULL until the window is full.
    """
    w = series(key, date)
    past = w.rowsBetween(-seq_len, -1)
    t = F.row_number().over(w) - 1
    df = df.withColumn("__t", t).withColumn("__h", F.when(F.col(flag), 1.0).otherwise(0.0))
    # weight of row s in the window [t - L, t) is 0.5 + 0.5 * (s - t + L) / (L - 1): linear in s
    step = 0.5 / (seq_len - 1)
    hits = F.sum("__h").over(past)
    placed = F.sum(F.col("__h") * F.col("__t")).over(past)
    weighted = hits * (0.5 + step * seq_len) + step * (placed - hits * F.col("__t"))
    last = F.max(F.when(F.col(flag), F.col("__t"))).over(past)
    since = F.coalesce(F.col("__t") - 1 - last, F.lit(seq_len)) / seq_len
    full = F.col("__t") >= seq_len
    return df.withColumns(
        {
            "news_density": F.when(full, hits / seq_len),
            "weighted_density": F.when(full, weighted / (0.75 * seq_len)),
            "news_recency": F.when(full, F.least(since, F.lit(1.0))),
        }
    ).drop("__t", "__h")


def recent_sentiment(news: DataFrame, as_of: str | Column, days: int = 7, key: str = "ticker", ts: str = "published_at") -> DataFrame:
    """Per ticker the mean sentiment of the last days: compound, else positive minus negative."""
    cutoff = (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    recent = F.col(ts).cast("timestamp") >= cutoff
    compound = F.avg(F.when(recent, F.col("compound"))) if "compound" in news.columns else F.lit(None).cast("double")
    if {"pos", "neg"} <= set(news.columns):
        compound = F.coalesce(compound, F.avg(F.when(recent, F.col("pos"))) - F.avg(F.when(recent, F.col("neg"))))
    n = F.count(F.when(recent, 1))
    return news.groupBy(key).agg(
        (n > 0).alias("available"), F.coalesce(compound, F.lit(0.0)).alias("sentiment_score"), n.alias("n_articles"),
        F.count(F.lit(1)).alias("total_articles"),
    )
