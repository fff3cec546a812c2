"""Result files of runs: JSON documents, trade CSVs, stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC_FIELDS = (
    "trades_per_year double, sharpe_ratio_equity_based double, sharpe_equity double, calmar_ratio double, "
    "calmar double, max_drawdown double, max_drawdown_pct double, win_rate double, sortino_ratio double, "
    "profit_factor double, total_pnl_pct double, trades bigint, expectancy double"
)
PIPELINE_SCHEMA = (
    "tag string, timestamp string, symbols array<string>, hours int, "
    f"stage1_results map<string, struct<{METRIC_FIELDS.replace(' ', ':').replace(',:', ', ')}>>"
)
STAGE2_SCHEMA = (
    "portfolio_params map<string, double>, n_trials int, pareto_front_size int, "
    "objectives struct<portfolio_calmar:double, worst_pair_calmar:double, neg_overfit_penalty:double>"
)
PORTFOLIO_SCHEMA = METRIC_FIELDS
PER_PAIR_SCHEMA = f"map<string, struct<{METRIC_FIELDS.replace(' ', ':').replace(',:', ', ')}>>"


def _run_id():
    # .../<run>/<file> or .../<run>/<folder>/<file>
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/(?:evaluation/|stage1/)?[^/]+$", 1)


def read_documents(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One row per JSON file with its run id; unreadable files give NULL fields."""
    raw = spark.read.text(glob, wholetext=True)
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return raw.select(_run_id().alias("run"), F.col("_metadata.file_name").alias("file"), parsed.alias("doc"))


def read_pipeline_results(spark: SparkSession, root: str) -> DataFrame:
    return read_documents(spark, f"{root}/*/pipeline_result.json", PIPELINE_SCHEMA).select("run", "file", "doc.*")


def read_stage2_results(spark: SparkSession, root: str) -> DataFrame:
    return read_documents(spark, f"{root}/*/stage2_result.json", STAGE2_SCHEMA).select("run", "file", "doc.*")


def read_portfolio_metrics(spark: SparkSession, root: str) -> DataFrame:
    return read_documents(spark, f"{root}/*/evaluation/portfolio_metrics.json", PORTFOLIO_SCHEMA).select("run", "file", "doc.*")


def read_per_pair_metrics(spark: SparkSession, root: str) -> DataFrame:
    """One row per (run, symbol) from ``evaluation/per_pair_metrics.json``."""
    docs = read_documents(spark, f"{root}/*/evaluation/per_pair_metrics.json", PER_PAIR_SCHEMA)
    return docs.select("run", F.explode("doc").alias("symbol", "m")).select("run", "symbol", "m.*")


def list_artefacts(spark: SparkSession, root: str) -> DataFrame:
    """``run, file`` of every JSON artefact below the results folder (names only)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.json").load(root).select("path")
    part = F.regexp_extract("path", r"([^/]+)/((?:stage1/)?)(?:evaluation/)?([^/]+)\.json$", 1)
    name = F.concat(
        F.regexp_extract("path", r"((?:stage1/)?)(?:evaluation/)?([^/]+)\.json$", 1),
        F.regexp_extract("path", r"([^/]+)\.json$", 1))
    return files.select(part.alias("run"), name.alias("file"))


def write_documents(df: DataFrame, path: str, by: str = "run") -> None:
    """One JSON line per row, one folder per entity."""
    df.write.partitionBy(by).json(path)


def write_trades_csv(trades: DataFrame, path: str) -> None:
    """Trades with a header, one folder per symbol; an empty table is allowed."""
    trades.write.partitionBy("symbol").option("header", True).csv(path)


def write_stage_table(df: DataFrame, root: str, name: str) -> None:
    """Stage artefacts (``top_trials, trial_history, pareto_front, corr_edges``)."""
    df.write.parquet(f"{root}/{name}")


def write_results(documents: DataFrame, root: str) -> None:
    """``run, file, value`` as one file for each document below ``root``; ``/`` in a file's name
    becomes ``__``."""
    named = documents.select("run", F.replace("file", F.lit("/"), F.lit("__")).alias("artefact"), "value")
    named.repartition("run", "artefact").write.partitionBy("run", "artefact").text(root)


def scan_artefacts(spark: SparkSession, root: str) -> DataFrame:
    """``run, file, modified, value, damaged`` of every document below ``root`` in one scan; files without
    a byte are not seen.

    Takes the layout of ``write_results`` and ``<run>/[stage1/|evaluation/]<file>.json``."""
    raw = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))
    ours, theirs = r"run=([^/]+)/artefact=([^/]+)/[^/]+$", r"([^/]+)/(stage1/)?(?:evaluation/)?([^/]+)\.json$"
    spark_made = F.col("path").rlike(ours)
    run = F.when(spark_made, F.regexp_extract("path", ours, 1)).otherwise(F.regexp_extract("path", theirs, 1))
    file = F.when(spark_made, F.replace(F.regexp_extract("path", ours, 2), F.lit("__"), F.lit("/"))).otherwise(
        F.concat(F.regexp_extract("path", theirs, 2), F.regexp_extract("path", theirs, 3)))
    rows = raw.select(run.alias("run"), file.alias("file"), "modified", "value")
    return rows.filter("run <> '' AND file <> ''").withColumn("damaged", F.try_parse_json("value").isNull())


def scan_results(spark: SparkSession, root: str) -> DataFrame:
    """The results folder as a table of runs: documents of several schemas, read once.

    ``n_files, n_damaged, modified`` (of the newest file), the parsed documents ``pipeline, stage2,
    portfolio, pairs`` (NULL where missing or damaged), and the names seen in ``files``."""
    rows = scan_artefacts(spark, root)
    kinds = {"pipeline": ("pipeline_result", PIPELINE_SCHEMA), "stage2": ("stage2_result", STAGE2_SCHEMA),
             "portfolio": ("portfolio_metrics", PORTFOLIO_SCHEMA), "pairs": ("per_pair_metrics", PER_PAIR_SCHEMA)}
    # a document is found by its name and parsed by the schema of that name only
    found = [F.from_json(F.max_by(F.when(~F.col("damaged"), F.col("value")), F.when(F.col("file") == file, F.col("modified"))), schema).alias(name)
             for name, (file, schema) in kinds.items()]
    return rows.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if("damaged").alias("n_damaged"), F.max("modified").alias("modified"),
        F.array_sort(F.collect_set("file")).alias("files"), *found)
