"""Reading and writing of metadata documents, datasets, task groups, logs and score tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.merge import merge_checked, merge_override

#: How the tables of a dataset are laid out. Edges lie by source, so that neighbour look-ups of neighbours are local.
LAYOUT = {
    "tasks": {"partition": ["split"], "sort": ["task"]},
    "edges": {"partition": ["relation", "direction"], "sort": ["row_id"]},
    "entities": {"partition": ["entity"], "sort": ["row_id"]},
    "dictionaries": {"partition": ["entity"], "sort": ["code"]},
}
#: Tables of names and vectors, which must agree where two datasets both have a name.
VECTOR_TABLES = {"relation_names", "column_names", "task_names"}


def read_document(path: str) -> dict:
    """A YAML or JSON document. YAML needs the yaml package, JSON nothing."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def named_array(entries: list[dict], name: str, optional: bool = False) -> dict | None:
    """The entry of a split's list with that name; an error if it isn't there and isn't optional."""
    for entry in entries:
        if entry["name"] == name:
            return entry
    if optional:
        return None
    raise KeyError(f"no array named {name}; there are {[e['name'] for e in entries]}")


def write_table(df: DataFrame, root: str, name: str, mode: str = "errorifexists") -> None:
    """Writes a table in its layout. A partition column's rows are spread over tasks, so a hot value has many files."""
    layout = LAYOUT.get(name, {"partition": [], "sort": []})
    keys = [c for c in layout["partition"] if c in df.columns]
    sort = [c for c in layout["sort"] if c in df.columns]
    placed = df.repartition(*keys, *sort) if keys and sort else df
    placed = placed.sortWithinPartitions(*keys, *sort) if keys or sort else placed
    writer = placed.write.mode(mode)
    (writer.partitionBy(*keys) if keys else writer).parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def rows_by_id(rows: DataFrame, ids: DataFrame, key: str = "row_id") -> DataFrame:
    """The rows with the given ids, as often as these are given."""
    return ids.join(rows, key)


def task_groups(spark: SparkSession, document: dict[str, list[str]]) -> DataFrame:
    """task_group, position, task."""
    rows = [(g, i, t) for g, tasks in document.items() for i, t in enumerate(tasks or [])]
    return spark.createDataFrame(rows, "task_group string, position int, task string")


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """file, text of log files; a file is one row, so that its lines keep their order."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def append_scores(scores: DataFrame, path: str, run: str, step: int) -> None:
    """Appends metric rows of a run's step to a table of scores."""
    scores.withColumns({"run": F.lit(run), "step": F.lit(step)}).write.mode("append").partitionBy("run").parquet(path)


def append_trial(spark: SparkSession, path: str, trial: int, params: dict, value: float | None) -> None:
    """Appends a trial of a study, which can be resumed from the table."""
    spark.createDataFrame([(trial, json.dumps(params, sort_keys=True), value)], "trial int, params string, value double").write.mode("append").parquet(path)


def top_trials(trials: DataFrame, n: int = 5) -> DataFrame:
    """The best n trials; those without a value come last, ties by the number of the trial."""
    return trials.orderBy(F.desc_nulls_last("value"), "trial").limit(n)


def merge_datasets(spark: SparkSession, first: str, second: str, out: str, tables: dict[str, list[str]]) -> None:
    """Merges two datasets' tables by their keys into a new one, which must not exist; the second wins.

    Tables of names and vectors must agree on the names that both have.
    """
    for name, keys in tables.items():
        a, b = read_table(spark, first, name), read_table(spark, second, name)
        merged = merge_checked(a, b, keys, [c for c in a.columns if c not in keys]) if name in VECTOR_TABLES else merge_override(a, b, keys)
        write_table(merged, out, name)
