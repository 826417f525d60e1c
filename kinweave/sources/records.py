"""Scans and sinks: tab-separated records, truth lists, id-list results, caches, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RECORD_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
MATCHING_HEADER = ["source1_entity_id", "matched_entity_ids"]
CANDIDATE_HEADER = ["source1_entity_id", "candidate_entity_ids"]


def strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def read_tsv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Tab-separated text with a header: all strings, no quoting, missing values empty."""
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("inferSchema", False)
    return (reader.schema(strings(*columns)) if columns else reader).csv(path).na.fill("")


def with_source(df: DataFrame, source: str | None = None) -> DataFrame:
    """Adds ``source``: the given tag, or the first two characters of the id."""
    return df.withColumn("source", F.lit(source) if source else F.substring("entity_id", 1, 2))


def pool_of(*sources: DataFrame) -> DataFrame:
    """All noisy sources as one table, tagged by id prefix."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return with_source(out)


def load_split(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(S1, pool) of a split's three files."""
    read = lambda n: read_tsv(spark, f"{folder}/{split}_source{n}.tsv", RECORD_COLUMNS)
    return with_source(read(1), "S1"), pool_of(read(2), read(3))


def truth_lists(df: DataFrame) -> DataFrame:
    """(s1, ids array): comma lists as arrays, an empty list as an empty array."""
    text = F.coalesce("matched_entity_ids", F.lit(""))
    return df.select(F.col("source1_entity_id").alias("s1"), F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ",")).alias("ids"))


def truth_pairs(lists: DataFrame) -> DataFrame:
    """(s1, p): one row per true pair."""
    return lists.select("s1", F.explode("ids").alias("p")).distinct()


def load_truth(spark: SparkSession, folder: str, split: str = "train") -> DataFrame:
    return truth_lists(read_tsv(spark, f"{folder}/{split}_ground_truth.tsv", MATCHING_HEADER))


def id_lists(s1: DataFrame, pairs: DataFrame, header: list[str], order: str | None = None) -> DataFrame:
    """One row per S1 record, even without a match: ids comma-joined, each once, in order.

    ``pairs`` is (s1, p) with an optional column to order by (descending), then by id.
    """
    key = F.col(order) if order else F.lit(0)
    got = pairs.groupBy("s1", "p").agg(F.max(key).alias("k"))
    got = got.groupBy("s1").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), F.col("p").alias("p")))).alias("x"))
    ids = F.coalesce(F.array_join("x.p", ","), F.lit(""))
    return s1.select(F.col("entity_id").alias("s1")).join(got, "s1", "left").select(F.col("s1").alias(header[0]), ids.alias(header[1]))


def write_tsv(df: DataFrame, path: str) -> None:
    """Unquoted tab-separated text with a header; one file per partition."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("nullValue", "").csv(path)


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """(rows, sum of row hashes): does not depend on row order."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1] or 0)


def cached(spark: SparkSession, path: str, source: DataFrame, build) -> DataFrame:
    """``build(source)`` as parquet at ``path``, made anew when the source's content has changed."""
    now = fingerprint(source)
    try:
        mark = spark.read.json(f"{path}/source").first()
        if (mark["rows"], int(mark["hash"])) == now:
            return spark.read.parquet(f"{path}/rows")
    except Exception as e:  # noqa: BLE001  no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build(source).write.mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame([(now[0], str(now[1]))], "rows long, hash string").coalesce(1).write.mode("overwrite").json(f"{path}/source")
    return spark.read.parquet(f"{path}/rows")


def write_chunked(df: DataFrame, path: str, rows: int = 5_000_000) -> None:
    """Parquet files of at most ``rows`` rows each."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def attach(pairs: DataFrame, extra: DataFrame, name: str) -> DataFrame:
    """Adds an extra score column by pair key; every pair must have one (checked)."""
    out = pairs.join(extra.select("s1", "p", F.col("value").alias(name)), ["s1", "p"], "left")
    missing = F.raise_error(F.concat(F.lit(f"no {name} for "), F.col("s1").cast("string"), F.lit(" "), F.col("p").cast("string")))
    return out.withColumn(name, F.when(F.col(name).isNotNull(), F.col(name)).otherwise(missing.cast("double")))


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A small report as one JSON line."""
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def embedding_cache(spark: SparkSession, path: str, texts: DataFrame, encode) -> DataFrame:
    """(id, v array<float>) of ``texts`` (id, text): vectors are made once for each content."""
    return cached(spark, path, texts, encode)
