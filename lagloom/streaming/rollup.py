"""Articles and events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lagloom.functions import fixed
from lagloom.functions.text import any_keyword


def topic_stream(articles: DataFrame, topics: dict[str, list[str]] | None = None, at: str = "ts", late: str = "2 days") -> DataFrame:
    """Topic counts per day; days close when the watermark has passed them."""
    w = articles.withWatermark(at, late).groupBy(F.window(at, "1 day"))
    counted = w.agg(*[F.count_if(any_keyword(F.col("text"), words)).cast("int").alias(name) for name, words in (topics or fixed.TOPICS).items()])
    return counted.select(F.col("window.start").cast("date").alias("news_date"), *(topics or fixed.TOPICS))


def first_articles(articles: DataFrame, key: str = "url", at: str = "ts", late: str = "7 days") -> DataFrame:
    """The first article of each key, with state bounded by the watermark."""
    return articles.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def load(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, since: str = "2021-01-01", date: str = "date") -> StreamingQuery:
    """Load all files that are there, once each; the checkpoint replaces a table of progress."""
    rows = spark.readStream.schema(schema).parquet(path).filter(F.substring(F.col(date).cast("string"), 1, 10).try_cast("date") >= F.lit(since).cast("date"))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(spark: SparkSession, path: str, out: str, checkpoint: str, late: str = "1 day") -> None:
    """Events per day and type from Parquet files into the table ``out``, by appends: a day is written once, when the
    watermark has passed it, and its state is dropped. Days that are still open lie in ``out``/open after each run.

    A run takes the files that are new since the last one with this checkpoint, and ends.
    """
    schema = spark.read.parquet(path).schema
    # As a pattern, for a stream's plain path must be a folder; the pattern matches a file and a folder alike.
    events = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    days = counted.select(F.col("window.start").cast("date").alias("day"), "event_type", "n")
    days.writeStream.format("parquet").option("path", f"{out}/closed").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    # The watermark never passes the last days of what is there: the state store holds them.
    state = spark.read.format("statestore").load(checkpoint).select(F.col("key.window.start").cast("date").alias("day"), F.col("key.event_type").alias("event_type"), F.col("value.count").alias("n"))
    state.write.mode("overwrite").parquet(f"{out}/open")


def counted(spark: SparkSession, out: str) -> DataFrame:
    """The table of ``event_counts``: closed days and those still open."""
    schema = "day date, event_type string, n bigint"
    return spark.read.schema(schema).parquet(f"{out}/closed").unionByName(spark.read.schema(schema).parquet(f"{out}/open"))
