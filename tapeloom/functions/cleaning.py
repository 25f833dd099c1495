"""Cleaning and mapping of columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import col, finite, series, zero_fill

# Sector names in id order, spellings that map to them, size classes.
SECTORS = [
    "Technology", "Healthcare", "Financials", "Consumer Discretionary",
    "Communication Services", "Industrials", "Consumer Staples",
    "Energy", "Utilities", "Real Estate", "Materials", "Unknown",
]
SECTOR_ALIASES = {
    "technology": "Technology",
    "information technology": "Technology",
    "healthcare": "Healthcare",
    "health care": "Healthcare",
    "financials": "Financials",
    "financial services": "Financials",
    "financial": "Financials",
    "consumer cyclical": "Consumer Discretionary",
    "consumer discretionary": "Consumer Discretionary",
    "communication services": "Communication Services",
    "telecommunications": "Communication Services",
    "industrials": "Industrials",
    "industrial": "Industrials",
    "consumer defensive": "Consumer Staples",
    "consumer staples": "Consumer Staples",
    "energy": "Energy",
    "utilities": "Utilities",
    "real estate": "Real Estate",
    "basic materials": "Materials",
    "materials": "Materials",
}
MCAP_BUCKETS = [("Mega", 200e9), ("Large", 10e9), ("Mid", 2e9), ("Small", 300e6), ("Micro", 50e6)]
MCAP_NAMES = ["Mega", "Large", "Mid", "Small", "Micro", "Nano", "Unknown"]


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normalize_sector(c: str | Column) -> Column:
    """Canonical sector name, ``Unknown`` for anything else."""
    return F.coalesce(F.try_element_at(_literal_map(SECTOR_ALIASES), F.trim(F.lower(col(c)))), F.lit("Unknown"))


def sector_id(sector: str | Column) -> Column:
    return F.try_element_at(_literal_map({s: i for i, s in enumerate(SECTORS)}), col(sector))


def mcap_bucket(c: str | Column) -> Column:
    """Size class of a market capitalisation."""
    c = col(c)
    out = F.when(c >= MCAP_BUCKETS[0][1], MCAP_BUCKETS[0][0])
    for name, floor in MCAP_BUCKETS[1:]:
        out = out.when(c >= floor, name)
    return out.when(c > 0, "Nano").otherwise("Unknown")


def mcap_id(bucket: str | Column) -> Column:
    return F.try_element_at(_literal_map({s: i for i, s in enumerate(MCAP_NAMES)}), col(bucket))


def clean(df: DataFrame, cols: list[str]) -> DataFrame:
    """NaN and infinities become NULL, NULL becomes 0."""
    return df.withColumns({c: zero_fill(c) for c in cols})


def winsorize_median(df: DataFrame, cols: list[str], k: float = 5.0, key: str = "ticker") -> DataFrame:
    """P5: clamp each column to median +- k standard deviations of its ticker."""
    w = Window.partitionBy(key)  # bounded by the calendar: one row per date
    out = {}
    for c in cols:
        med, std = F.median(c).over(w), F.stddev_samp(c).over(w)
        bounded = F.least(F.greatest(F.col(c), med - k * std), med + k * std)
        out[c] = F.when(F.col(c).isNull(), None).when(std > 0, bounded).otherwise(F.col(c))
    return df.withColumns(out)


def fix_percent_form(df: DataFrame, c: str, key: str = "ticker", limit: float = 10.0) -> DataFrame:
    """A ticker whose median exceeds ``limit`` reports in percent; divide it by 100."""
    med = F.median(c).over(Window.partitionBy(key))
    return df.withColumn(c, F.when(med > limit, F.col(c) / 100.0).otherwise(F.col(c)))


def ffill(df: DataFrame, cols: list[str], key="ticker", order="date", fill: float | None = 0.0) -> DataFrame:
    """Carry the last value forward, then fill the head."""
    w = series(key, order).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for c in cols:
        last = F.last(c, ignorenulls=True).over(w)
        out[c] = last if fill is None else F.coalesce(last, F.lit(fill))
    return df.withColumns(out)


FORMULA_FUNCTIONS = {
    "abs", "sqrt", "log", "log1p", "exp", "sin", "cos", "tan", "sign", "power", "round", "least", "greatest",
    "coalesce", "nullif", "try_divide", "floor", "ceil", "tanh",
}
FORMULA_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|([A-Za-z_][A-Za-z0-9_]*)|([-+*/%(),<>=]))")
FORMULA_NAME = re.compile(r"feat_[A-Za-z0-9_]+")
MAX_BAD_FRACTION = 0.30
MIN_STD = 1e-10


def check_formula(name: str, formula: str, columns: list[str]) -> None:
    """Raise unless the formula only uses known columns, numbers and arithmetic."""
    if not FORMULA_NAME.fullmatch(name):
        raise ValueError(f"formula name must look like feat_xyz: {name}")
    at, allowed = 0, set(columns)
    text = formula.rstrip()
    while at < len(text):
        m = FORMULA_TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not allowed in a formula: {text[at:at + 10]!r}")
        word = m.group(2)
        if word and word not in allowed and word.lower() not in FORMULA_FUNCTIONS:
            raise ValueError(f"unknown name in a formula: {word}")
        at = m.end()


def formula_value(df: DataFrame, formula: str) -> Column:
    """The checked formula over doubles, with a NULL where a divisor is 0."""
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "decimal")}
    words, at = [], 0
    while at < len(formula.rstrip()):
        m = FORMULA_TOKEN.match(formula, at)
        words.append(m.group(0).strip())
        at = m.end()

    def operand(i: int) -> int:
        """Where the operand that begins at word i ends."""
        while i < len(words) and words[i] in "+-":
            i += 1
        if i < len(words) and words[i] not in "()":
            i += 1
        if i < len(words) and words[i] == "(":
            depth = 0
            while i < len(words):
                depth += (words[i] == "(") - (words[i] == ")")
                i += 1
                if not depth:
                    break
        return i

    def written(i: int, end: int) -> str:
        out = []
        while i < end:
            if words[i] in ("/", "%"):
                stop = operand(i + 1)
                out.append(f"{words[i]} nullif({written(i + 1, stop)}, 0)")
                i = stop
            else:
                out.append(f"double({words[i]})" if words[i] in numeric else words[i])
                i += 1
        return " ".join(out)

    return F.expr(written(0, len(words)))


def formula_quality(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """One row per formula: share of non-finite values, spread, and whether it is accepted."""
    aggs = []
    for name, f in formulas.items():
        check_formula(name, f, df.columns)
        v = finite(formula_value(df, f))
        aggs.append(
            F.struct(
                F.lit(name).alias("name"),
                F.avg(F.when(v.isNull(), 1.0).otherwise(0.0)).alias("bad_fraction"),
                F.coalesce(F.stddev_pop(F.coalesce(v, F.lit(0.0))), F.lit(0.0)).alias("std"),
            ).alias(name)
        )
    ok = (F.col("bad_fraction") <= MAX_BAD_FRACTION) & (F.col("std") >= MIN_STD)
    return df.agg(*aggs).select(F.inline(F.array(*formulas))).withColumn("accepted", ok)


def formula_feature(df: DataFrame, name: str, formula: str) -> DataFrame:
    """Add a formula column; NULL throughout when the quality gate rejects it."""
    gate = formula_quality(df, {name: formula}).select(F.col("accepted").alias("__ok"))
    value = F.coalesce(finite(formula_value(df, formula)), F.lit(0.0))
    # the gate is one row
    return df.join(F.broadcast(gate)).withColumn(name, F.when(F.col("__ok"), value)).drop("__ok")


def latest_features(df: DataFrame, cols: list[str], key: str = "ticker", date: str = "date") -> DataFrame:
    """The features of the last date of each ticker as a map."""
    return df.groupBy(key).agg(F.max(date).alias(date), F.max_by(F.struct(*cols), date).alias("__row")).select(
        key, date, F.create_map(*[x for c in cols for x in (F.lit(c), F.col(f"__row.{c}"))]).alias("features")
    )


def diversified_sample(df: DataFrame, n: int, sectors: list[str], key: str = "ticker", sector: str = "sector") -> DataFrame:
    """P10: the first k tickers of each sector in the given sector order, n in all."""
    per = max(n // max(len(sectors), 1), 2)
    place = _literal_map({s: i for i, s in enumerate(sectors)})
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(sector).orderBy(key))).where(F.col("__r") <= per)
    return (
        ranked.withColumn("__s", F.try_element_at(place, F.col(sector)))
        .where("__s IS NOT NULL")
        .orderBy("__s", "__r")
        .limit(n)
        .drop("__r", "__s")
    )
