"""Column expressions on names, prompts, predictions and log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Conventions of the names in a relational-graph dataset.
NAME_JOINT = "___"
TEXT_PREFIX = "Griffin_text_"
FORWARD, REVERSE = "head of ", "tail of "
FEWSHOT_RELATION = "few-shot example of"
LOOP_ENDING, REVERSE_BEGINNING = "-self_loop", "reverse_"

#: The lines of experiment logs that count.
MARKER = r"=== (.+?) ==="
METRIC = r"test_metric/([A-Za-z0-9_\-]+)(?:/([A-Za-z0-9_]+))?:\s*([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"
AVERAGE = r"Average test metric:\s*([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"


def last_token(s: Column) -> Column:
    return F.element_at(F.split(F.trim(s), r"\s+"), -1)


def last_number(s: Column) -> Column:
    """The last word of a text as a number; 0 if there is none, or no text."""
    return F.coalesce(last_token(s).try_cast("double"), F.lit(0.0))


def last_integer(s: Column) -> Column:
    return F.coalesce(F.when(last_token(s).rlike(r"^[-+]?\d+$"), last_token(s).try_cast("bigint")), F.lit(0).cast("bigint"))


def four_digits(x: Column) -> Column:
    return F.format_string("%.4f", x)


def clean_column_name(name: Column) -> Column:
    """A column's name in words: without its entity, with the kinds (text) and (timestamp) set behind."""
    bare = F.when(F.contains(name, F.lit(NAME_JOINT)), F.regexp_replace(name, f"^.*?{NAME_JOINT}", "")).otherwise(name)
    words = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    inner = F.regexp_extract(bare, r"^TIMESTAMP\((.*)\)$", 1)
    return (
        F.when(F.startswith(bare, F.lit(TEXT_PREFIX)), F.concat(words(F.substr(bare, F.lit(len(TEXT_PREFIX) + 1))), F.lit(" (text)")))
        .when(F.startswith(bare, F.lit("TIMESTAMP(")) & F.endswith(bare, F.lit(")")), F.concat(words(inner), F.lit(" (timestamp)")))
        .otherwise(words(bare))
    )


def clean_entity_name(name: Column) -> Column:
    """From the last part, between hyphens, that begins with a capital; the whole name in words if none does."""
    parts = F.split(name, "-")
    places = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.regexp_like(F.element_at(parts, i), F.lit(r"^\p{Lu}")))
    last = F.array_max(places)
    tail = F.array_join(F.slice(parts, F.coalesce(last, F.lit(1)), F.size(parts)), "-")
    return F.when(last.isNotNull(), F.replace(tail, F.lit("_"), F.lit(" "))).otherwise(F.translate(name, "_-", "  "))


def relation_parts(name: Column) -> dict[str, Column]:
    """direction, source, fk and target of a directed relation; without the two colons all of it is the source."""
    body = F.regexp_replace(name, f"^({FORWARD}|{REVERSE})", "")
    parts = F.split(body, ":")
    three = F.size(parts) == 3
    middle = F.get(parts, F.lit(1))
    return {
        "direction": F.when(F.startswith(name, F.lit(FORWARD)), "outgoing").otherwise("incoming"),
        "source": F.when(three, F.get(parts, F.lit(0))).otherwise(body),
        "fk": F.when(three, F.regexp_replace(middle, "^[^-]*-", "")).otherwise(""),
        "target": F.when(three, F.get(parts, F.lit(2))).otherwise(""),
    }


def fallback_description(task: Column) -> Column:
    return F.concat(F.lit("Predict the value asked for by '"), F.translate(task, "-_", "  "), F.lit("' from this record and the records connected to it."))


def expected_phrase(task_type: Column, classes: Column) -> Column:
    """The words that a question must hold, by the kind of its answer."""
    return F.when((task_type == "regression") | (classes == 1), "single number").when(classes == 2, "yes or no").otherwise("class index")


def fallback_question(task: Column, task_type: Column) -> Column:
    words = F.translate(task, "-_", "  ")
    ask = F.when(task_type == "regression", "what is the value? Output a single number.").otherwise("which class is it? Output the class index.")
    return F.concat(F.lit("Given the data for '"), words, F.lit("', "), ask)


def log_marker(line: Column) -> Column:
    """The text of a marker line, without a remark in parentheses at its end; NULL for other lines."""
    found = F.regexp_extract(line, MARKER, 1)
    return F.when(F.regexp_like(line, F.lit(MARKER)), F.trim(F.regexp_replace(F.trim(found), r"\s*\(.*?\)\s*$", "")))
