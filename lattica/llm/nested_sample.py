"""A reproducible sample that only grows as records are added: nested hash buckets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_BUCKETS = 4_096


def bucket_order(n_buckets: int = N_BUCKETS) -> list[int]:
    """The fixed permutation of the buckets: by the MD5 of their number."""
    return sorted(range(n_buckets), key=lambda b: hashlib.md5(f"order:{b}".encode()).hexdigest())


def nested_sample(df: DataFrame, keys: Sequence[str], batch: str, share: float, n_buckets: int = N_BUCKETS) -> DataFrame:
    """A sample of about `share` of the distinct keys: keys, bucket, and the batch since which a key is in the sample.

    Every key belongs for good to one of many fine buckets, by its MD5. The sample is all keys of a list of buckets,
    the first ones of a fixed permutation. Batch by batch the list is made longer where it no longer covers `share` of
    the keys seen so far, and it is never made shorter. So the result for a table and for the same table with rows of
    higher batches is nested, and it depends neither on the order nor on the partitioning of the rows.

    Keys with a NULL part are left out. Rows with a NULL batch count as the last batch. Repeated rows have no effect,
    an empty table gives an empty sample. What comes to the driver is a count per bucket and batch.
    """
    keys = list(keys)
    last = 2**31 - 1
    rows = df.select(*keys, F.coalesce(F.col(batch).cast("int"), F.lit(last)).alias("__batch"))
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    bucket = (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint") % n_buckets).cast("int")
    seen = rows.groupBy(*keys).agg(F.min("__batch").alias("__batch")).withColumn("bucket", bucket)

    counts = seen.groupBy("bucket", "__batch").count().collect()
    batches = sorted({r["__batch"] for r in counts})
    rank = {b: i for i, b in enumerate(bucket_order(n_buckets))}
    new = np.zeros((len(batches), n_buckets), np.int64)
    for r in counts:
        new[batches.index(r["__batch"]), rank[r["bucket"]]] = r["count"]
    listed: list[tuple[int, int, int]] = []  # bucket, its place in the order, the batch at which it was listed
    order = bucket_order(n_buckets)
    total = np.zeros(n_buckets, np.int64)
    for i, b in enumerate(batches):
        total += new[i]
        covered = np.cumsum(total)
        need = int(np.searchsorted(covered, math.ceil(share * covered[-1]))) + 1 if covered[-1] else 0
        listed += [(order[j], j, b) for j in range(len(listed), min(need, n_buckets))]
    spark = df.sparkSession
    chosen = F.broadcast(spark.createDataFrame(listed, "bucket int, place int, listed int"))  # at most n_buckets rows
    since = F.greatest("listed", "__batch")
    return seen.join(chosen, "bucket").select(*keys, "bucket", F.when(since < last, since).alias("since_batch"))
