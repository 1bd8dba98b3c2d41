"""Who meets whom: keys that share a place or time, counted without listing the pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.session import materialize

#: Rows of a cell of the grid: those that are met, and those that meet them. A part has a 16th, or a quarter, of all
#: rows between these bounds, so the copies that the grid makes stay few.
MET_ROWS = (2_000_000, 8_000_000)
MEETING_ROWS = (1_000_000, 4_000_000)


def _met(cell: pa.Table) -> pa.Table:
    """For each key that meets others the number of the cell's seeds and others that it meets, itself among them."""
    cell = cell.combine_chunks()
    asks = cell.column("asks").combine_chunks().to_numpy(zero_copy_only=False)
    seed = cell.column("seed").combine_chunks().to_numpy(zero_copy_only=False)

    def rows(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = cell.column("at").combine_chunks().take(pa.array(chosen))
        return at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), at.flatten().to_numpy(zero_copy_only=False)

    met = np.flatnonzero(~asks)
    met = met[np.argsort(~seed[met], kind="stable")]  # seeds first
    n, at = rows(met)
    places, code = np.unique(at, return_inverse=True)
    who = np.repeat(np.arange(len(met)), n)[np.argsort(code, kind="stable")]
    end = np.cumsum(np.bincount(code, minlength=len(places)))
    lists = [who[i:j] for i, j in zip([0, *end[:-1].tolist()], end.tolist())]

    asking = np.flatnonzero(asks)
    n, at = rows(asking)
    place = np.searchsorted(places, at)
    known = place < len(places)
    known[known] = places[place[known]] == at[known]
    place, end = np.where(known, place, -1).tolist(), np.cumsum(n).tolist()
    flags, seeds, begin = np.zeros(len(met), bool), int(seed[met].sum()), 0
    counts = np.zeros((2, len(asking)), np.int64)
    for i, stop in enumerate(end):
        for p in place[begin:stop]:
            if p >= 0:
                flags[lists[p]] = True
        counts[:, i] = np.count_nonzero(flags[:seeds]), np.count_nonzero(flags[seeds:])
        flags.fill(False)
        begin = stop
    some = np.flatnonzero(counts.sum(0))
    ids = cell.column("id").take(pa.array(asking[some]))
    return pa.table([ids, pa.array(counts[0, some]), pa.array(counts[1, some])], names=["id", "n_seeds", "n_others"])


def seeds_and_others(rows: DataFrame, seeds: DataFrame, key: str, place: str) -> DataFrame:
    """For each seed the number of other seeds, and of other keys, that share a value of `place` with it.

    rows: key and place, each any number of times; seeds: key. Seeds that meet nobody, and NULLs, are left out.
    Result: (key, n_seeds, n_others).

    Where many keys meet at a place the pairs are by far more than the rows. So they are neither shuffled nor listed:
    keys are laid out as a grid, each part of the seeds with each part of all keys in a cell, where the keys met are
    flagged seed by seed. A key is in one part only, so the cells' counts are summed up.
    """
    all_rows = rows.select(F.col(key).alias("id"), F.col(place).alias("at"), F.lit(False).alias("seed")).filter(F.col("at").isNotNull())
    named = seeds.select(F.col(key).alias("id"), F.lit(None).cast(rows.schema[place].dataType).alias("at"), F.lit(True).alias("seed"))
    people = all_rows.unionByName(named).filter(F.col("id").isNotNull()).groupBy("id").agg(F.collect_set("at").alias("at"), F.bool_or("seed").alias("seed"))
    people = materialize(people.filter(F.size("at") > 0), "meetings")
    sizes = people.agg(F.sum(F.size("at")), F.sum(F.when(F.col("seed"), F.size("at")))).first()
    n_met, n_asking = (int(n or 0) for n in sizes)
    parts = max(1, -(-n_met // min(max(MET_ROWS[0], n_met // 16), MET_ROWS[1])))
    askers = max(1, -(-n_asking // min(max(MEETING_ROWS[0], n_asking // 4), MEETING_ROWS[1])))
    hashed = F.xxhash64("id")
    met = people.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(askers - 1)), lambda i: F.pmod(hashed, F.lit(parts)) * askers + i)).alias("cell"), F.lit(False).alias("asks"), "id", "seed", "at")
    asking = people.filter("seed").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.pmod(hashed, F.lit(askers)) + i * askers)).alias("cell"), F.lit(True).alias("asks"), "id", "seed", "at")
    schema = rows.select(F.col(key).alias("id")).schema.add("n_seeds", T.LongType()).add("n_others", T.LongType())
    counts = met.unionByName(asking).groupBy("cell").applyInArrow(_met, schema)
    total = counts.groupBy("id").agg((F.sum("n_seeds") - 1).alias("n_seeds"), F.sum("n_others").alias("n_others"))  # not itself
    return total.filter(F.col("n_seeds") + F.col("n_others") > 0).select(F.col("id").alias(key), "n_seeds", "n_others")
