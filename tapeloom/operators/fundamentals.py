"""Fundamentals and sentiment, aligned to daily bars as known on the day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import ffill, fix_percent_form, winsorize_median
from ..functions.core import EPS, div, finite, pct_change, rows, series
from .joins import asof_join

# Names of the ratios.
VALUATION_RATIOS = ["trailing_pe", "forward_pe", "peg_ratio", "price_to_book", "ev_to_ebitda"]
HISTORY_RATIOS = [
    "gross_margin", "operating_margin", "net_margin", "roe", "roa", "debt_to_equity", "revenue_growth", "earnings_growth",
]
PAYOUT_RATIOS = ["dividend_yield"]
RATIOS = [*VALUATION_RATIOS, *HISTORY_RATIOS, *PAYOUT_RATIOS]
# Analyst grades on the 1 (strong buy) to 5 (sell) scale.
GRADES = {
    "Strong Buy": 1, "Buy": 2, "Overweight": 2, "Outperform": 2, "Hold": 3, "Neutral": 3, "Equal-Weight": 3,
    "Underweight": 4, "Underperform": 4, "Sell": 5, "Strong Sell": 5,
}


def quarterly_ratios(statements: DataFrame, key: str = "ticker", date: str = "report_date") -> DataFrame:
    """Margins, returns on equity and assets, leverage and year-on-year growth per report."""
    w = series(key, date)
    rev, ni = F.col("revenue"), F.col("net_income")
    sold = rev > 0

    def margin(c: str) -> Column:
        return F.when(sold, div(c, rev))

    earned = F.when(sold, ni)
    st = statements.withColumns({"__rev": F.when(sold, rev), "__ni": earned})
    return st.select(
        key,
        date,
        margin("gross_profit").alias("gross_margin"),
        margin("operating_income").alias("operating_margin"),
        margin("net_income").alias("net_margin"),
        div("__ni", "total_equity").alias("roe"),
        div("__ni", "total_assets").alias("roa"),
        div("total_debt", "total_equity").alias("debt_to_equity"),
        pct_change("__rev", 4, w).alias("revenue_growth"),
        pct_change("__ni", 4, w).alias("earnings_growth"),
    )


def fundamental_features(bars: DataFrame, ratios: DataFrame, snapshot: DataFrame | None = None, names=tuple(RATIOS), limit: float = 5.0,
                         key: str = "ticker", date: str = "date", report: str = "report_date") -> DataFrame:
    """The ratios of the last report on or before each bar.

    A ratio that none of a ticker's reports states, and every ratio of a ticker with
    fewer than two reports, comes from the snapshot (one row per ticker).  Then
    percent repair, winsorising per ticker, forward fill, zero fill.
    """
    have = [n for n in names if n in ratios.columns]
    stated = [(F.count(finite(n)) > 0).alias(f"__h_{n}") for n in have]
    enough = ratios.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *stated).where("__n >= 2").drop("__n")
    right = ratios.join(enough, key, "left_semi").select(key, F.col(report).alias(date), *have)
    j = asof_join(bars.select(key, date), right, [key], date, chunk=None)
    j = j.join(enough, key, "left")
    if snapshot is not None:
        extra = [n for n in names if n in snapshot.columns]
        j = j.join(snapshot.select(key, *[F.col(n).alias(f"__s_{n}") for n in extra]), key, "left")
    else:
        extra = []
    out = {}
    for n in names:
        snap = F.col(f"__s_{n}") if n in extra else F.lit(None).cast("double")
        value = F.when(F.col(f"__h_{n}"), F.col(n)).otherwise(snap) if n in have else snap
        out[f"fund_{n}"] = finite(value)
    df = j.select(key, date, *[c.alias(n) for n, c in out.items()])
    if "fund_debt_to_equity" in out:
        df = fix_percent_form(df, "fund_debt_to_equity", key)
    return ffill(winsorize_median(df, list(out), limit, key), list(out), key, date)


# Names of the sentiment columns.
SENTIMENT_COLUMNS = [
    "sent_news_volume_1d", "sent_news_volume_5d_avg", "sent_headline_sentiment", "sent_headline_sentiment_5d_avg", "sent_earnings_surprise",
    "sent_analyst_rating", "sent_analyst_rating_change", "sent_analyst_target_upside", "sent_target_price_dispersion", "sent_insider_activity",
]


def rating_change(grades: DataFrame, key: str = "ticker", date: str = "date", grade: str = "to_grade") -> DataFrame:
    """Half the fall of the mean grade from the older to the newer half of a ticker's ratings."""
    score = F.try_element_at(F.create_map(*[F.lit(x) for kv in GRADES.items() for x in kv]), F.col(grade))
    g = grades.withColumn("__s", score).where("__s IS NOT NULL")
    ties = [c for c in grades.columns if c not in (key, date)]
    g = g.withColumn("__day", F.to_date(date))
    # rows before a day are counted per day, so a ticker with very many ratings is ordered day by day
    days = g.groupBy(key, "__day").agg(F.count(F.lit(1)).alias("__c"))
    per = Window.partitionBy(key).orderBy("__day")
    days = days.select(
        key, "__day", (F.sum("__c").over(per.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")).alias("__before"),
        F.sum("__c").over(Window.partitionBy(key)).alias("__n"),
    )
    at = F.row_number().over(Window.partitionBy(key, "__day").orderBy(date, *ties)) - 1
    g = g.withColumn("__at", at).join(days, [key, "__day"]).withColumn("__i", F.col("__before") + F.col("__at"))
    old = F.col("__i") < F.floor(F.col("__n") / 2)
    return g.groupBy(key).agg(
        F.when(F.count(F.lit(1)) >= 2, (F.avg(F.when(old, F.col("__s"))) - F.avg(F.when(~old, F.col("__s")))) / 2.0).otherwise(0.0).alias("rating_change")
    )


def earnings_surprise(earnings: DataFrame) -> DataFrame:
    """(actual - estimate) over the size of the estimate, or ``surprise_pct`` (in percent) where a table has no such pair."""
    if not {"actual", "estimate"} <= set(earnings.columns):
        return earnings.withColumn("earnings_surprise", finite("surprise_pct") / 100.0).where("earnings_surprise IS NOT NULL").drop("surprise_pct")
    s = (F.col("actual") - F.col("estimate")) / (F.abs("estimate") + EPS)
    return earnings.withColumn("earnings_surprise", s).where("earnings_surprise IS NOT NULL").drop("actual", "estimate")


def sentiment_features(bars: DataFrame, news_daily: DataFrame, earnings: DataFrame, analyst: DataFrame, grades: DataFrame,
                       key: str = "ticker", date: str = "date") -> DataFrame:
    """Article volume and headline sentiment, last earnings surprise, analyst consensus and its change.

    ``news_daily`` (ticker, date, n_articles, avg_sentiment), ``earnings`` (ticker,
    date, actual and estimate, or surprise_pct), ``analyst`` (ticker, recommendation_mean,
    target_mean, target_high, target_low, current_price), ``grades`` (ticker,
    date, to_grade).
    """
    w = series(key, date)
    b = bars.select(key, date)
    counted = b.join(news_daily.select(key, date, "n_articles"), [key, date], "left").withColumn("n_articles", F.coalesce(F.col("n_articles").cast("double"), F.lit(0.0)))
    felt = asof_join(counted, news_daily.select(key, date, "avg_sentiment"), [key], date, chunk=None)
    j = asof_join(felt, earnings_surprise(earnings).select(key, date, "earnings_surprise"), [key], date, chunk=None)
    target, now = F.col("target_mean"), F.col("current_price")
    a = analyst.select(
        key,
        ((3.0 - F.col("recommendation_mean")) / 2.0).alias("sent_analyst_rating"),
        F.when(now > 0, div(target - now, now)).alias("sent_analyst_target_upside"),
        F.when(target > 0, (F.col("target_high") - F.col("target_low")) / (4 * target + EPS)).alias("sent_target_price_dispersion"),
    )
    j = j.join(a, key, "left").join(rating_change(grades, key, date), key, "left")
    zero = lambda c: F.coalesce(finite(F.col(c)), F.lit(0.0))
    j = j.withColumn("__s", zero("avg_sentiment"))
    return j.select(
        key,
        date,
        F.col("n_articles").alias("sent_news_volume_1d"),
        F.avg("n_articles").over(rows(w, 5)).alias("sent_news_volume_5d_avg"),
        F.col("__s").alias("sent_headline_sentiment"),
        F.avg("__s").over(rows(w, 5)).alias("sent_headline_sentiment_5d_avg"),
        zero("earnings_surprise").alias("sent_earnings_surprise"),
        zero("sent_analyst_rating").alias("sent_analyst_rating"),
        zero("rating_change").alias("sent_analyst_rating_change"),
        zero("sent_analyst_target_upside").alias("sent_analyst_target_upside"),
        zero("sent_target_price_dispersion").alias("sent_target_price_dispersion"),
        F.lit(0.0).alias("sent_insider_activity"),
    )
