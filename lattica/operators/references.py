"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.skew import SALT, HeavyKeys


def orphan_references(refs: DataFrame, parents: DataFrame, carry: tuple[str, ...] = ("ref_id",), rows_per_part: int = 20_000) -> DataFrame:
    """The rows of refs that point to no parent living at their time.

    refs: ref_id, entity, id, at and the columns `carry`; a NULL `id` refers to nothing. `at` NULL asks for any time.
    parents: entity, id, born, died; born NULL = always there, died NULL = still there. A parent lives at t if
    born <= t < died.

    A left anti-join of the distinct keys (entity, id, at) against the parents finds the orphaned keys, which are
    joined back to the references. Both joins salt keys that own very many rows. Repeated references give repeated
    rows; NULL entities match no parent; an empty parents table makes every reference an orphan.
    """
    refs = refs.filter(F.col("id").isNotNull()).select(*carry, "entity", "id", "at")
    heavy = HeavyKeys(refs, ["entity", "id"], rows_per_part)
    wanted = heavy.spread(refs.select("entity", "id", "at").distinct(), ["at"]).alias("w")
    held = heavy.replicate(parents.select("entity", "id", "born", "died").distinct()).alias("p")
    w, p = (lambda n: F.col(f"w.{n}")), (lambda n: F.col(f"p.{n}"))
    lives = w("at").isNull() | ((p("born").isNull() | (p("born") <= w("at"))) & (p("died").isNull() | (p("died") > w("at"))))
    orphans = wanted.join(held, (w("entity") == p("entity")) & (w("id") == p("id")) & (w(SALT) == p(SALT)) & lives, "left_anti").select("w.entity", "w.id", "w.at")
    left, right = heavy.spread(refs, list(carry)).alias("r"), heavy.replicate(orphans).alias("o")
    on = F.col("r.entity").eqNullSafe(F.col("o.entity")) & (F.col("r.id") == F.col("o.id")) & F.col("r.at").eqNullSafe(F.col("o.at")) & (F.col(f"r.{SALT}") == F.col(f"o.{SALT}"))
    return left.join(right, on, "left_semi").drop(SALT)


def orphan_counts(orphans: DataFrame, row_id: str = "ref_id") -> DataFrame:
    """Orphaned references per entity and month of `at` (NULL = no time): number of references and of missing rows."""
    month = F.date_format("at", "yyyy-MM")
    return (
        orphans.select(row_id, "entity", "id", month.alias("period"))
        .distinct()
        .groupBy("entity", "period")
        .agg(F.count(F.lit(1)).alias("orphan_refs"), F.count_distinct("id").alias("missing_ids"))
    )
