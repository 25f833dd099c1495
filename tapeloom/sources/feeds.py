"""Articles from feeds and web pages, merging of news, and the trade journal."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import col

# Patterns of page text, entities, host with its own article layout, length limits.
SCRIPT = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
PARAGRAPH_START = r"(?i)<p(?:\s[^>]*)?>"
PARAGRAPH_END = r"(?is)</p\s*>.*$"
ARTICLE = r"(?is)<article(?:\s[^>]*)?>(.*?)</article\s*>"
TAG = r"(?s)\s*<[^>]*>\s*"
ARTICLE_HOST = "finance.yahoo.com"
MIN_PARAGRAPH, MIN_PAGE, MIN_TEXT, SHORT_TEXT = 40, 100, 50, 80


def decode_entities(c: str | Column) -> Column:
    """Named, decimal and hexadecimal character references as characters; a hard blank as a blank, unknown ones as they are."""
    parts = F.split(col(c), "&", -1)
    names = F.create_map(*[F.lit(x) for name, code in sorted({**name2codepoint, "apos": 39}.items()) for x in (name, code)])

    def found(part: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(part, pattern, 1), F.lit(""))  # a failed cast would cost an exception a part

    def code(part: Column) -> Column:
        number = found(part, r"^#(\d{1,7});").cast("int")
        hexed = F.conv(found(part, r"^#[xX]([0-9a-fA-F]{1,6});"), 16, 10).cast("int")
        named = F.try_element_at(names, found(part, r"^([A-Za-z][A-Za-z0-9]*);"))
        return F.when(F.startswith(part, F.lit("#")), F.coalesce(number, hexed)).otherwise(named)

    def one(part: Column, code: Column) -> Column:
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        char = F.when(code == 0xA0, " ").when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(F.concat(char, F.regexp_replace(part, "^[^;]*;", "")), F.concat(F.lit("&"), part))

    # codes first: lambdas repeat an expression wherever it is named
    later = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda part: F.struct(part.alias("part"), code(part).alias("code")))
    later = F.transform(later, lambda x: one(x["part"], x["code"]))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(later, ""))


def strip_html(c: str | Column) -> Column:
    """Text of a fragment: tags removed together with the blanks around them, entities decoded."""
    out = decode_entities(F.regexp_replace(col(c), TAG, ""))
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def extract_article_text(pages: DataFrame, html: str = "html", url: str = "url", out: str = "article") -> DataFrame:
    """Article text of a page.

    Pages of the known publisher give all paragraphs of their article element;
    any page gives its paragraphs longer than 40 characters, if they come to
    more than 100 together.
    """

    def paragraphs(source: Column) -> Column:
        # as in the HTML standard, a paragraph ends at its end tag or where the next one starts
        starts = F.split(source, PARAGRAPH_START)
        parts = F.slice(starts, F.lit(2), F.size(starts))
        return F.transform(parts, lambda p: strip_html(F.regexp_replace(p, PARAGRAPH_END, "")))

    page = F.regexp_replace(F.col(html), SCRIPT, "")
    inner = F.array_join(F.filter(paragraphs(F.regexp_extract(page, ARTICLE, 1)), lambda p: p != ""), " ")
    generic = F.array_join(F.filter(paragraphs(page), lambda p: F.length(p) > MIN_PARAGRAPH), " ")
    own = F.when(F.contains(F.col(url), F.lit(ARTICLE_HOST)), F.nullif(inner, F.lit("")))
    return pages.withColumn(out, F.coalesce(own, F.when(F.length(generic) > MIN_PAGE, generic)))


_LINK = T.StructType([T.StructField("url", T.StringType())])
FEED_SCHEMA = T.StructType(
    [
        T.StructField("link", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("publisher", T.StringType()),
        T.StructField("providerPublishTime", T.LongType()),
        T.StructField(
            "content",
            T.StructType(
                [
                    T.StructField("canonicalUrl", _LINK),
                    T.StructField("clickThroughUrl", _LINK),
                    T.StructField("title", T.StringType()),
                    T.StructField("provider", T.StructType([T.StructField("displayName", T.StringType())])),
                    T.StructField("pubDate", T.StringType()),
                    T.StructField("description", T.StringType()),
                    T.StructField("summary", T.StringType()),
                ]
            ),
        ),
    ]
)


def _text(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def normalize_feed(items: DataFrame, json: str = "item", full_text: str | None = None) -> DataFrame:
    """Feed items of the flat or the nested layout as article rows.

    The text is the fetched page text if given, else the description, else (when
    that is under 80 characters) the summary; items without a link or with under
    50 characters of text are dropped.
    """
    # Spark pushes a filter below what it reads and would parse and strip once more there for each of its terms, so the
    # parsed item and the text pass as lists of one
    keep = [c for c in items.columns if c != json]
    df = items.select("*", F.explode(F.array(F.from_json(json, FEED_SCHEMA))).alias("__i"))
    published = F.coalesce(
        F.timestamp_seconds(F.nullif(F.col("__i.providerPublishTime"), F.lit(0))),
        F.try_to_timestamp(F.col("__i.content.pubDate")),
    )
    df = df.select("*", F.explode(F.array(F.coalesce(strip_html("__i.content.description"), F.lit("")))).alias("__plain"))
    plain = F.col("__plain")
    brief = F.when(F.length(plain) < SHORT_TEXT, F.coalesce(_text("__i.content.summary"), plain)).otherwise(plain)
    text = F.coalesce(_text(full_text), brief) if full_text else brief
    return df.select(
        *keep,
        F.coalesce(_text("__i.link"), _text("__i.content.canonicalUrl.url"), _text("__i.content.clickThroughUrl.url")).alias("url"),
        F.coalesce(_text("__i.title"), _text("__i.content.title")).alias("title"),
        F.coalesce(_text("__i.publisher"), _text("__i.content.provider.displayName")).alias("publisher"),
        published.alias("published_at"),
        text.alias("body"),
    ).where(F.col("url").isNotNull() & (F.length("body") >= MIN_TEXT))


def merge_news(existing: DataFrame, new: DataFrame, url: str = "url", ts: str = "published_at") -> DataFrame:
    """One row per URL, the newest; a stored row wins a tie.

    ``row_number() = 1`` is applied before the shuffle too, so a URL with very
    many copies does not gather in one task.
    """
    cols = existing.columns
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in cols if c not in (url, ts)]
    w = Window.partitionBy(url).orderBy(F.desc_nulls_last(ts), "__new", *rest)
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__new")


# The fields of a journal line.
JOURNAL_SCHEMA = (
    "timestamp string, run_id string, ticker string, direction string, entry_price double, "
    "position_size_pct double, stop_loss double, take_profit double, atr double, risk_reward_ratio double, "
    "risk_level string, regime_label string, model_confidence string, predicted_return double, "
    "sub_model_agreement double, sub_model_spread double, regime_confidence_score double, "
    "regime_features map<string,double>, approved_reason string, "
    "actual_return double, exit_price double, exit_timestamp string, exit_reason string"
)


def read_journal(spark: SparkSession, path: str, schema: str = JOURNAL_SCHEMA) -> DataFrame:
    """Journal lines as rows; only lines that are no JSON object are skipped.

    Fields are read as text and cast, so a number kept as text counts and a value
    that does not fit its field is NULL.
    """
    fields = T.StructType.fromDDL(schema).fields
    text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in fields], T.StructField("__bad", T.StringType())])
    parsed = spark.read.text(path).select(F.from_json("value", text, {"columnNameOfCorruptRecord": "__bad"}).alias("j"), F.col("value"))
    rows = parsed.where(F.col("j.__bad").isNull() & F.trim("value").startswith("{"))

    def typed(f: T.StructField) -> Column:
        c = F.col(f"j.{f.name}")
        if isinstance(f.dataType, T.StringType):
            return c.alias(f.name)
        if isinstance(f.dataType, T.MapType):
            kind = f.dataType.valueType.simpleString()
            return F.transform_values(F.from_json(c, "map<string,string>"), lambda k, v: F.trim(v).try_cast(kind)).alias(f.name)
        return F.trim(c).try_cast(f.dataType.simpleString()).alias(f.name)

    return rows.select(*map(typed, fields))


def write_journal(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
