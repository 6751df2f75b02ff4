"""The domain's tables as views over the driver's parquet tables.

Each view exists twice: as a DataFrame and as the SQL common table
expression an independent engine runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newspulse.functions import sentiment, text
from newspulse.session import spread

# --- Fixed values: parameters of the views ---------------------------------
STOPWORDS = ["the", "of", "and", "to", "in", "de", "la", "que", "und", "der", "die", "et"]
POSITIVE, NEGATIVE = ["with", "from"], ["that", "this"]
RELEVANT = ["the", "de"]
WORD = text.fixed.LETTER_WORD
LICENSE_LINE = r"(?dm)^Released under .*$"
EMAIL_LINE = r"(?dm)^.*@.*\.(com|org|net).*$"
BOILERPLATE = [LICENSE_LINE, EMAIL_LINE]
NEWS_THRESHOLD = 0.2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt over as many tasks as ``spark.newspulse.scanPartitions`` says, if it is set."""
    partitions = spark.conf.get("spark.newspulse.scanPartitions", None)
    return spread(table(spark, sf_dir, name), int(partitions) if partitions else None)


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with model label and confidence."""
    docs = dealt(spark, sf_dir, "documents")
    doc_id = F.col("doc_id")
    query = F.when(doc_id % 3 == 0, "/?utm=x").otherwise("")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.sqrt(doc_id)).cast("int"))
    kind = F.col("n_chars") % 3
    return docs.select(
        "doc_id",
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"),
        F.col("text").alias("content"),
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 09:00:00")).alias("date"),
        F.col("source").alias("press"),
        F.concat(F.lit("https://news.example/"), "source", F.lit("/"), doc_id.cast("string"), query).alias("url"),
        day.alias("date_only"),
        F.when(kind == 0, "negative").when(kind == 1, "neutral").otherwise("positive").alias("sentiment"),
        ((50 + (doc_id * 37) % 50) / 100).alias("confidence"),
    )


def scored_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News whose model label is final."""
    return news(spark, sf_dir).withColumn("final_sentiment", F.col("sentiment")).withColumn(
        "sentiment_num", sentiment.polarity("sentiment")
    )


def token_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sentiment, tokens): lower-case words of the content."""
    return news(spark, sf_dir).select(
        "doc_id", "sentiment", text.words(F.lower("content"), WORD).alias("tokens")
    )


def hand_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.when(bad, "negative").otherwise("positive").alias("hand_label")
    )


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled row per order line."""
    flag = F.col("l_returnflag")
    label = F.when(flag == "R", "negative").when(flag == "A", "positive").otherwise("neutral")
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date_only"), sentiment.polarity(label).alias("sentiment_num")
    )


def price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order price per day; cents are summed exactly, in any order."""
    cents = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("Date"))
        .agg((cents / F.count(F.lit(1))).alias("Close"))
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links found on listing pages: (month, page, pos, url)."""
    e = F.col("event_id")
    return (
        table(spark, sf_dir, "events")
        .select(
            F.floor(e / 80).alias("month"), ((e * 31) % 40).alias("page"), e.alias("pos"),
            F.concat(F.lit("https://news.example/a/"), ((e * 37) % 700).cast("string"), F.lit("?p="), e.cast("string"))
            .alias("url"),
        )
    )


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("p"))


def dated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages given a date and a publisher logo by page_id, one way per case."""
    pages = dealt(spark, sf_dir, "pages")
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"))
    case = F.col("page_id") % 5
    extra = (
        F.when(case == 0, F.concat(F.lit('<span data-date-time="'), day, F.lit(' 08:00:00"></span>')))
        .when(case == 1, F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('T09:00:00">')))
        .when(case == 2, F.concat(F.lit("<time> "), day, F.lit(" 10:00 </time>")))
        .when(case == 3, F.lit('<div class="top_logo"><img src="x.png" alt=" Daily Example "></div>'))
        .otherwise(F.lit(""))
    )
    return pages.select(
        "page_id", "url", F.concat("html", extra).alias("html"),
        F.when(case == 3, F.concat(day, F.lit("."))).alias("list_date"),
    )


# --- The same views as SQL --------------------------------------------------

NEWS_SQL = """news AS (
  SELECT doc_id,
         substr(split_part(text, chr(10), 1), 1, 80) AS title,
         text AS content,
         strftime(d, '%Y-%m-%d') || ' 09:00:00' AS date,
         source AS press,
         'https://news.example/' || source || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '/?utm=x' ELSE '' END AS url,
         d AS date_only,
         CASE n_chars % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS sentiment,
         (50 + (doc_id * 37) % 50) / 100.0::DOUBLE AS confidence,
         CASE n_chars % 3 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE 1 END AS sentiment_num
  FROM (SELECT *, DATE '2024-01-01' + CAST(floor(sqrt(doc_id)) AS INTEGER) AS d FROM documents))"""

TOKENS_SQL = NEWS_SQL + r""", token_docs AS (
  SELECT doc_id, sentiment, regexp_extract_all(lower(content), '\p{L}{2,}') AS tokens FROM news),
  words AS (SELECT doc_id, sentiment, unnest(tokens) AS word FROM token_docs)"""

HAND_SQL = """hand AS (
  SELECT doc_id, CASE WHEN toxic = 1 OR quality = 0 THEN 'negative' ELSE 'positive' END AS hand_label FROM labels)"""

SIGNAL_SQL = """signal AS (
  SELECT CAST(l_shipdate AS DATE) AS date_only,
         CASE l_returnflag WHEN 'R' THEN -1 WHEN 'A' THEN 1 ELSE 0 END AS sentiment_num
  FROM lineitem)"""

PRICE_SQL = """price AS (
  SELECT CAST(o_orderdate AS DATE) AS date_only, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS close FROM orders GROUP BY 1)"""

LISTING_SQL = """listing AS (
  SELECT event_id // 80 AS month, (event_id * 31) % 40 AS page, event_id AS pos,
         'https://news.example/a/' || (event_id * 37) % 700 || '?p=' || event_id AS url
  FROM events)"""

DATED_PAGES_SQL = """dated AS (
  SELECT page_id, url, page_id % 5 AS c, '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS day, html
  FROM pages)"""


def daily_sql(source: str, min_count: int = 5) -> str:
    """Daily mean, count, previous day and change as CTE text."""
    return f"""kept AS (
  SELECT date_only, avg(sentiment_num) AS sentiment_mean, count(sentiment_num) AS article_count
  FROM {source} WHERE date_only IS NOT NULL GROUP BY 1 HAVING count(sentiment_num) >= {min_count}),
 changes AS (
  SELECT *, lag(sentiment_mean) OVER (ORDER BY date_only) AS prev,
         sentiment_mean - lag(sentiment_mean) OVER (ORDER BY date_only) AS change FROM kept)"""


def present(df: DataFrame) -> DataFrame:
    """Results as they are compared: doubles at 6 places, dates as text."""
    shown = {
        "double": lambda c: F.round(c, 6),
        "float": lambda c: F.round(c.cast("double"), 6),
        "date": lambda c: F.date_format(c, "yyyy-MM-dd"),
        "int": lambda c: c.cast("long"),
    }
    return df.select(*[shown.get(kind, lambda c: c)(F.col(name)).alias(name) for name, kind in df.dtypes])
