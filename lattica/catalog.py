"""Metadata of a dataset: entities, columns, relations and tasks as DataFrames, checked as they are read.

Metadata is small and comes from one document, so it is checked on the driver; the tables that it describes are not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.text import FORWARD, LOOP_ENDING, NAME_JOINT, REVERSE, REVERSE_BEGINNING, TEXT_PREFIX

TIMESTAMP_NAME = "__timestamp__"
#: Fixed value: the time that static rows carry in stored arrays.
STATIC_TIME = -(2**63)
REGRESSION, RETRIEVAL = "regression", "retrieval"


class MetadataError(ValueError):
    pass


def need(condition: bool, message: str) -> None:
    if not condition:
        raise MetadataError(message)


@dataclass
class Catalog:
    entities: DataFrame  # entity, num, is_target, timestamp_path
    columns: DataFrame  # entity, name, ordinal, dtype, num_categories, is_target, path
    relations: DataFrame  # relation, direction, entity, dst_entity, fk, path
    tasks: DataFrame  # task, task_type, seed_entity, target_entity, metric, masked


def read_catalog(spark: SparkSession, config: dict) -> Catalog:
    """From a parsed metadata document with the keys graph (nodes, edges, feature_data), feature_data and tasks."""
    entities: dict[str, dict] = {}
    for node in config["graph"]["nodes"]:
        need(node["type"] not in entities, f"entity {node['type']} is declared twice")
        entities[node["type"]] = {"num": int(node["num"]), "path": None, "columns": []}
    for stamp in config["graph"]["feature_data"]:
        need(stamp["name"] == TIMESTAMP_NAME and stamp["type"] in entities, f"unexpected graph data {stamp['name']} of {stamp['type']}")
        need(entities[stamp["type"]]["path"] is None, f"entity {stamp['type']} has two timestamps")
        entities[stamp["type"]]["path"] = stamp["path"]
    missing = [k for k, v in entities.items() if v["path"] is None]
    need(not missing, f"no timestamp for {', '.join(missing)}")

    for c in config["feature_data"]:
        need(c["type"] in entities, f"column {c['name']} of an unknown entity {c['type']}")
        extra = c.get("extra_fields", {})
        name = f"{c['type']}{NAME_JOINT}{c['name']}"
        held = entities[c["type"]]["columns"]
        need(name not in {x[0] for x in held}, f"column {name} is declared twice")
        held.append((name, extra.get("dtype"), int(extra.get("num_categories", 0)), bool(extra.get("is_target_column", False)), c["path"]))
    for name, e in entities.items():
        texts = {x[0].replace(TEXT_PREFIX, "") for x in e["columns"] if TEXT_PREFIX in x[0]}
        e["columns"] = [x for x in e["columns"] if TEXT_PREFIX in x[0] or x[0] not in texts]
        e["target"] = any(x[3] for x in e["columns"])
        need(not e["target"] or len(e["columns"]) == 1, f"target entity {name} has more than one column")

    relations = []
    for edge in config["graph"]["edges"]:
        parts = edge["type"].split(":")
        need(len(parts) == 3, f"relation {edge['type']} isn't head:key:tail")
        head, fk, tail = parts
        if fk.endswith(LOOP_ENDING) or fk.startswith(REVERSE_BEGINNING):
            continue
        need(head in entities and tail in entities, f"relation {edge['type']} of unknown entities")
        relations.append((edge["type"], FORWARD.strip(), head, tail, fk, edge["path"]))
        if head != tail:
            relations.append((edge["type"], REVERSE.strip(), tail, head, fk, edge["path"]))

    tasks = [t for t in (parse_task(task["extra_fields"], entities) for task in config.get("tasks", [])) if t]
    return Catalog(
        spark.createDataFrame([(k, v["num"], v["target"], v["path"]) for k, v in entities.items()], "entity string, num bigint, is_target boolean, timestamp_path string"),
        spark.createDataFrame(
            [(k, x[0], i, *x[1:]) for k, v in entities.items() for i, x in enumerate(v["columns"])],
            "entity string, name string, ordinal int, dtype string, num_categories int, is_target boolean, path string",
        ),
        spark.createDataFrame(relations, "relation string, direction string, entity string, dst_entity string, fk string, path string"),
        spark.createDataFrame(tasks, "task string, task_type string, seed_entity string, target_entity string, metric string, masked array<string>"),
    )


def parse_task(extra: dict, entities: dict[str, dict]) -> tuple | None:
    """A task's row; None for a regression whose seed and target entities differ, which isn't supported."""
    kind, target, seed = extra["task_type"], extra["target_type"], extra["seed_type"].split(":")[-1]
    need(kind in (REGRESSION, RETRIEVAL), f"unknown task type {kind}")
    if kind == REGRESSION:
        target, seed = seed, target
        if target != seed:
            return None
        column = f"{target}{NAME_JOINT}{extra['name'].split('-')[-1]}"
    else:
        need(seed.startswith(target), f"the class entity {seed} isn't named after {target}")
        need(len(entities[seed]["columns"]) == 1 and entities[seed]["target"], f"{seed} isn't a target entity with one column")
        column = f"{target}{NAME_JOINT}{TEXT_PREFIX}{seed[len(target) + 1 :]}"
    masked = [column] if column in {x[0] for x in entities[target]["columns"]} else []
    return extra["name"], kind, target, seed, extra["evaluation_metric"], masked


def without_shadowed(columns: DataFrame, name: str = "name") -> DataFrame:
    """Columns, less those that also exist as text under the prefixed name."""
    texts = columns.filter(F.contains(name, F.lit(TEXT_PREFIX))).select(F.replace(name, F.lit(TEXT_PREFIX), F.lit("")).alias(name)).distinct()
    return columns.join(texts, name, "left_anti")


def static_time(ts: Column) -> Column:
    """A stored time, NULL where it stands for a static row."""
    return F.when(ts != F.lit(STATIC_TIME), ts)


def normalize_times(rows: DataFrame, ts: str, is_target: bool) -> DataFrame:
    """A whole table of zeros is static and gets NULL times; a target entity must be one."""
    low, high = rows.agg(F.min(ts), F.max(ts)).first()
    zero = low in (0, None) and high in (0, None)
    need(zero or not is_target, "a target entity has times")
    return rows.withColumn(ts, F.lit(None).cast("bigint")) if zero else rows.withColumn(ts, static_time(F.col(ts)))


def relation_registry(relations: DataFrame, name: str = "relation") -> DataFrame:
    """relation, direction, entity, dst_entity, fk from names head:key:tail: forwards, and backwards unless head = tail.

    Self-loops and relations that are marked as reversed are left out.
    """
    p = F.split(name, ":")
    usable = relations.select(name).distinct().filter((F.size(p) == 3) & ~F.endswith(p[1], F.lit(LOOP_ENDING)) & ~F.startswith(p[1], F.lit(REVERSE_BEGINNING)))
    ends = lambda d, a, b: F.struct(F.lit(d.strip()).alias("direction"), a.alias("entity"), b.alias("dst_entity"))
    both = F.filter(F.array(ends(FORWARD, p[0], p[2]), F.when(p[0] != p[2], ends(REVERSE, p[2], p[0]))), lambda x: x.isNotNull())
    return usable.select(name, F.regexp_replace(p[1], "^[^-]*-", "").alias("fk"), F.explode(both).alias("e")).select(name, "e.*", "fk")


def resolve_tasks(words: list[str], tasks: list[tuple[str, str]], groups: dict[str, list[str]] | None = None) -> list[str]:
    """Task names from words: ALLTASK, RETTASK, REGTASK, EXCEPT__<task or group>, a group's or a task's name.

    In the order of first mention, each once. An EXCEPT__ without anything before it takes from all tasks.
    """
    groups = groups or {}
    names = [t for t, _ in tasks]
    chosen: list[str] = []
    for word in words:
        if word.startswith("EXCEPT__"):
            out = word.removeprefix("EXCEPT__")
            lost = set(groups.get(out, [out]))
            chosen = [t for t in (chosen or names) if t not in lost]
            continue
        if word == "ALLTASK":
            more = names
        elif word in ("RETTASK", "REGTASK"):
            more = [t for t, kind in tasks if kind == (RETRIEVAL if word == "RETTASK" else REGRESSION)]
        else:
            more = groups.get(word, [word])
        for t in more:
            need(t in names, f"unknown task {t}")
        chosen += [t for t in more if t not in chosen]
    return chosen
