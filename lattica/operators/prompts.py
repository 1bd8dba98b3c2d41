"""Prompts: descriptions of a schema in words, their audit, and the places of their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import text as T

FIRST_COLUMNS = 6


def column_list(names: Column, limit: int = FIRST_COLUMNS) -> Column:
    """The first names, and how many there are if there are more."""
    more = F.format_string(", ... (%d total)", F.size(names))
    return F.concat(F.array_join(F.slice(names, 1, limit), ", "), F.when(F.size(names) > limit, more).otherwise(""))


def entity_columns(columns: DataFrame) -> DataFrame:
    """entity and the sorted clean names of its columns. Metadata: an entity has a table's number of columns."""
    return columns.groupBy("entity").agg(F.array_sort(F.collect_set(T.clean_column_name(F.col("name")))).alias("names"))


def schema_prompts(tasks: DataFrame, columns: DataFrame, relations: DataFrame) -> DataFrame:
    """task and prompt: the task, the columns of its root entity, its relations and the tables one and two hops away.

    tasks: task, task_type, num_class, root, metric, masked. columns: entity, name. relations: relation, direction,
    entity, dst_entity, fk (as relation_registry gives them). Masked columns aren't shown. All three are metadata.
    """
    visible = columns.join(tasks.select("task", F.col("root").alias("entity"), "masked"), "entity").filter(~F.array_contains("masked", F.col("name")))
    own = visible.groupBy("task").agg(F.array_sort(F.collect_set(T.clean_column_name(F.col("name")))).alias("own"))
    links = relations.select(
        F.col("entity").alias("root"),
        "dst_entity",
        F.concat(F.when(F.col("direction") == "head of", "  - leads to ").otherwise("  - is named by "), T.clean_entity_name(F.col("dst_entity")), F.lit(" by "), F.translate("fk", "_", " ")).alias("line"),
    )
    linked = links.groupBy("root").agg(F.array_sort(F.collect_set("line")).alias("links"))
    named = entity_columns(columns)
    one = relations.filter(F.col("entity") != F.col("dst_entity")).select(F.col("entity").alias("root"), F.col("dst_entity").alias("near")).distinct()
    two = one.join(one.select(F.col("root").alias("near"), F.col("near").alias("far")), "near").filter(F.col("far") != F.col("root")).select("root", F.col("far").alias("near")).distinct()
    two = two.join(one, ["root", "near"], "left_anti")

    def listed(hop: DataFrame, name: str, all_: bool) -> DataFrame:
        line = F.concat(F.lit("  - "), T.clean_entity_name(F.col("near")), F.when(F.col("names").isNull(), "").otherwise(F.concat(F.lit(": ["), column_list(F.col("names")), F.lit("]"))))
        rows = hop.join(named.withColumnRenamed("entity", "near"), "near", "left" if all_ else "inner")
        return rows.groupBy("root").agg(F.array_sort(F.collect_set(line)).alias(name))

    kind = F.when(F.col("task_type") == "regression", F.concat(F.lit("The answer is a number, scored by "), "metric", F.lit("."))).otherwise(
        F.concat(F.lit("The answer is one of "), F.col("num_class").cast("string"), F.lit(" classes, scored by "), "metric", F.lit("."))
    )
    section = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.lit("\n\n"), title, F.lit("\n"), F.array_join(lines, "\n")))
    root = T.clean_entity_name(F.col("root"))
    every = tasks.join(own, "task", "left").join(linked, "root", "left").join(listed(one, "near_lines", True), "root", "left").join(listed(two, "far_lines", False), "root", "left")
    prompt = F.concat(
        F.lit("Task: "), T.fallback_description(F.col("task")), F.lit("\nRecord: "), root, F.lit("\n"), kind,
        F.coalesce(section(F.concat(root, F.lit(" has")), F.transform("own", lambda c: F.concat(F.lit("  - "), c))), F.lit("")),
        F.coalesce(section(F.concat(root, F.lit(" is connected")), F.col("links")), F.lit("")),
        F.coalesce(section(F.lit("Connected tables"), F.col("near_lines")), F.lit("")),
        F.coalesce(section(F.lit("Tables behind them"), F.col("far_lines")), F.lit("")),
    )
    return every.select("task", prompt.alias("prompt"))


def audit(tasks: DataFrame, question: Column) -> DataFrame:
    """task, expected, question of the tasks whose question lacks the phrase that its kind of answer needs."""
    rows = tasks.select("task", T.expected_phrase(F.col("task_type"), F.col("num_class")).alias("expected"), question.alias("question"))
    return rows.filter(~F.contains(F.lower("question"), F.col("expected")))


def part_positions(parts: DataFrame, keys: list[str], order: str, length: str) -> DataFrame:
    """parts with start and end: where each part of a prompt lies if they follow each other."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(length).over(w)
    return parts.withColumns({"start": end - F.col(length), "end": end})


def left_pads(rows: DataFrame, batch: list[str], length: str) -> DataFrame:
    """rows with pad: the places to fill on the left, so that all of a batch end at the same place."""
    top = rows.groupBy(*batch).agg(F.max(length).alias("__top"))
    return rows.join(top, batch).withColumn("pad", F.col("__top") - F.col(length)).drop("__top")


def assemble(system: Column, question: Column, context: Column | None = None, answer: Column | None = None, entity_first: bool = False) -> Column:
    """The text of a prompt from its parts; the answer only in training. Parts that are NULL are left out."""
    middle = [context, question] if entity_first else [question, context]
    parts = [system, *[p for p in middle if p is not None], *([answer] if answer is not None else [])]
    return F.concat_ws("\n", *parts)
