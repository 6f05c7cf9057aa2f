"""File sources and sinks: delimited text, JSON lines, literals, XML, key-value records, metric bundles, manifests."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkmill.operators.staging import scratch

REVIEWS = "reviewerID string, asin string, unixReviewTime bigint"
META = "asin string, title string, brand string, description string, categories array<array<string>>, related map<string,array<string>>, salesRank map<string,bigint>"


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", quote: str | None = '"', strict: bool = True) -> DataFrame:
    """Delimited text with a header; not strict: bad lines are dropped. Columns are pruned at the scan."""
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return reader.option("quote", quote or "").csv(path)


def through_csv(df: DataFrame, schema: str, sep: str = ",") -> DataFrame:
    """df written as delimited text and scanned again."""
    path = scratch(df.sparkSession, "csv")
    df.write.option("header", True).option("sep", sep).csv(path)
    return delimited(df.sparkSession, path, schema, sep)


def write_csv_bom(df: DataFrame, path: str) -> None:
    """Delimited text whose header starts with a byte-order mark, as spreadsheet programs want."""
    names = df.columns
    df.withColumnRenamed(names[0], "﻿" + names[0]).write.option("header", True).csv(path)


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (also gzip) of reviews, with file, the name, and orig_order, the row's 0-based line in it."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__id"), "value")
    # a file's blocks are read in pieces; within one, the ids rise with the lines
    numbered = lines.withColumn("orig_order", F.row_number().over(Window.partitionBy("file").orderBy("__at", "__id")) - 1)
    return numbered.select(F.from_json("value", REVIEWS).alias("r"), "file", F.col("orig_order").cast("bigint").alias("orig_order")).select("r.*", "file", "orig_order")


def literals(spark: SparkSession, path: str) -> DataFrame:
    """Python-literal lines of item metadata, with empty defaults; lines that don't parse raise an error."""

    @F.pandas_udf(META)
    def parse(lines: pd.Series) -> pd.DataFrame:
        found = [ast.literal_eval(x) for x in lines]
        one = lambda d, k: d.get(k) or ""
        return pd.DataFrame({
            **{k: [one(d, k) for d in found] for k in ("asin", "title", "brand", "description")},
            "categories": [d.get("categories") or [] for d in found], "related": [d.get("related") or {} for d in found], "salesRank": [d.get("salesRank") or {} for d in found],
        })

    return spark.read.text(path).where(F.trim("value") != "").select(parse("value").alias("m")).select("m.*")


def movies(spark: SparkSession, path: str) -> DataFrame:
    """(movie_id, title, genres) of '::'-separated lines; genres are split at |."""
    x = F.split("value", "::")
    return spark.read.text(path).where(F.size(x) >= 3).select(x[0].cast("bigint").alias("movie_id"), x[1].alias("title"), F.split(x[2], r"\|").alias("genres"))


def metric_log(spark: SparkSession, path: str, prefix: str = "val/") -> DataFrame:
    """(run, step, metric, value) of training logs {run}/metrics.csv: a row for each logged value of the metrics with a prefix.

    Logs name their own columns, so that each is read by its header; steps without such a value give no row.
    """
    lines = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="metrics.csv").select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("run"), F.split("value", r"\r?\n").alias("lines"))
    lines = lines.select("run", F.split(F.col("lines")[0], ",").alias("names"), F.explode(F.slice("lines", 2, F.size("lines"))).alias("line")).where("line <> ''")
    cells = lines.select("run", F.map_from_arrays("names", F.transform(F.sequence(F.lit(0), F.size("names") - 1), lambda i: F.get(F.split("line", ","), i))).alias("m"))
    rows = cells.select("run", F.col("m")["step"].try_cast("bigint").alias("step"), F.explode("m").alias("metric", "value"))
    return rows.where(F.startswith("metric", F.lit(prefix))).select("run", "step", "metric", F.col("value").try_cast("double").alias("value")).where("value is not null")


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, movie_id, rating, timestamp) of '::'-separated lines."""
    x = F.split("value", "::")
    return spark.read.text(path).select(x[0].cast("bigint").alias("user_id"), x[1].cast("bigint").alias("movie_id"), x[2].cast("double").alias("rating"), x[3].cast("bigint").alias("timestamp"))


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements of one tag as rows."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def listing(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, length) of all files below a folder whose names end with suffix."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path).select("path", "length")


def metric_bundles(spark: SparkSession, path: str, needed: str) -> DataFrame:
    """(label, metric, value) of JSON files {label: {metric: number}} or {"points": {label: {metric: number}}}; labels that start
    with an underscore or lack the needed metric are left out."""
    raw = spark.read.option("wholetext", True).text(path)
    top = F.from_json("value", "map<string,string>")
    points = F.from_json(F.get_json_object("value", "$.points"), "map<string,string>")
    labels = raw.select(F.explode(F.coalesce(points, top)).alias("label", "bundle")).where("not startswith(label, '_')")
    rows = labels.select("label", F.from_json("bundle", "map<string,string>").alias("m")).where(F.map_contains_key("m", F.lit(needed)))
    return rows.select("label", F.explode("m").alias("metric", "value")).select("label", "metric", F.col("value").try_cast("double").alias("value")).where("value IS NOT NULL")


def item_text(s: Column, key: Column) -> Column:
    """s, or 'item {key}' where it is blank."""
    return F.when(F.trim(F.coalesce(s, F.lit(""))) == "", F.concat(F.lit("item "), key.cast("string"))).otherwise(s)


def manifest(spark: SparkSession, path: str, parameters: dict[str, str] | None = None) -> DataFrame:
    """(path, length, sha256, rows, parameters) of the files below a folder; rows of table files, null of others."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
    tables = files.where(F.endswith("path", F.lit(".parquet")))
    if tables.isEmpty():
        counted = files.select("path", F.lit(None).cast("bigint").alias("rows"))
    else:
        read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)
        counted = tables.select("path").join(read.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows")), "path", "left").na.fill(0, ["rows"])
    return files.join(counted, "path", "left").withColumn("parameters", F.lit(json.dumps(parameters or {}, sort_keys=True)))


def write_split(rows: DataFrame, path: str, by: tuple[str, ...] = ("window", "split")) -> None:
    """Split artefacts as one table in folders by window and split, so that a reader of one split lists only its files."""
    rows.repartition(*by).write.partitionBy(*by).parquet(path)


def merged(spark: SparkSession, path: str, key: str, out: str) -> DataFrame:
    """The files that workers wrote below a folder as one table, sorted by key; equal keys must have equal rows, which count once.

    The parts stay where they are: what reads them again after a lost executor finds them.
    """
    rows = spark.read.option("recursiveFileLookup", True).parquet(path).distinct()
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError(f"{key} {twice.first()[0]} has different rows")
    rows.repartitionByRange(key).sortWithinPartitions(key).write.parquet(out)
    return spark.read.parquet(out)


def write_results(metrics: DataFrame, path: str, source: dict[str, str]) -> None:
    """(label, metric, value) as JSON lines {label: {metric: value, "_source": {..}}}, a line for each label; source tells where the
    numbers come from."""
    held = metrics.groupBy("label").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.to_json(F.struct("value")).alias("v"))))).alias("m"))
    plain = F.transform_values("m", lambda _, v: F.get_json_object(v, "$.value"))
    body = F.concat_ws(", ", F.transform(F.map_entries(plain), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), F.coalesce(e["value"], F.lit("null")))), F.lit('"_source": ' + json.dumps(source, sort_keys=True, ensure_ascii=False)))
    held.select(F.concat(F.lit('{"'), F.col("label"), F.lit('": {'), body, F.lit("}}")).alias("value")).write.text(path)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; more than limit rows are an error, not a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
