"""Mixing sources to target weights: entropy balancing with capped repeats.

Every document d of a source gets a rate r_d, its expected number of copies. Among all rates that give the source its
wanted number of tokens, those closest to one copy of each document (in relative entropy) are an exponential tilt of
the document's size, r_d = exp(lambda * tokens_d / mean), cut off at max_repeats. lambda solves the convex dual, whose
gradient is the tokens reached less the tokens wanted. Newton's method finds it for all sources at once; each step is
one distributed aggregation over the counts of documents per source and size, so nothing but two sums per source
comes to the driver.

The rates are rounded down and the rest is decided by a hash of the document's id, with the threshold of each source
moved so that its tokens are met: by a histogram of the tokens at each threshold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.session import broadcast_if_small, materialize

STEPS = 60
CLOSE = 1e-6
BINS = 4_096
#: At most so many sources have a weight; they and their sums come to the driver.
MAX_SOURCES = 10_000


def source_name(source: Column) -> Column:
    """One spelling of a source: lower case, without blanks around it, words joined by underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")


@dataclass
class Source:
    share: float
    repeats: int
    docs: int = 0
    tokens: int = 0
    wanted: float = 0.0
    tilt: float = 0.0

    @property
    def most(self) -> float:
        return float(self.repeats) * self.tokens

    @property
    def full(self) -> bool:
        return self.wanted >= self.most * (1 - 1e-12)


def token_budgets(sources: dict[str, Source], total: float) -> None:
    """Sets what each source is to give: its share of the total, or all that its repeats allow.

    What sources lack that are too small goes to the others in proportion to their shares, as far as these reach.
    """
    total = min(total, sum(s.most for s in sources.values()))
    open_, left = {k for k, s in sources.items() if s.most > 0 and s.share > 0}, total
    for s in sources.values():
        s.wanted = 0.0
    while open_ and left > 0:
        scale = left / sum(sources[k].share for k in open_)
        short = {k for k in open_ if sources[k].most <= scale * sources[k].share}
        if not short:
            for k in open_:
                sources[k].wanted = scale * sources[k].share
            break
        for k in short:
            sources[k].wanted = sources[k].most
            left -= sources[k].most
        open_ -= short


def _rate(tilt: Column, size: Column, cap: Column) -> Column:
    return F.least(cap.cast("double"), F.exp(F.least(tilt * size, F.lit(700.0))))


def _solve(sizes: DataFrame, sources: dict[str, Source]) -> None:
    """Newton's method, kept inside a bracket that is halved whenever a step would leave it."""
    spark = sizes.sparkSession
    low, high = {}, {}
    todo = {k for k, s in sources.items() if 0 < s.wanted and not s.full}
    for k in todo:
        sources[k].tilt, low[k], high[k] = 0.0, -math.inf, math.inf
    for _ in range(STEPS):
        if not todo:
            break
        rows = [(k, sources[k].tilt, sources[k].tokens / sources[k].docs, sources[k].repeats) for k in sorted(todo)]
        now = F.broadcast(spark.createDataFrame(rows, "source string, tilt double, mean double, cap int"))
        x = F.col("n_tokens") / F.col("mean")
        r = _rate(F.col("tilt"), x, F.col("cap"))
        mass = F.col("docs") * F.col("n_tokens") * r
        sums = sizes.join(now, "source").groupBy("source").agg(F.sum(mass).alias("g"), F.sum(F.when(r < F.col("cap"), mass * x).otherwise(0.0)).alias("h"))
        for row in sums.collect():
            s, k = sources[row["source"]], row["source"]
            miss = row["g"] - s.wanted
            if abs(miss) <= CLOSE * s.wanted:
                todo.discard(k)
                continue
            if miss > 0:
                high[k] = s.tilt
            else:
                low[k] = s.tilt
            step = s.tilt - miss / row["h"] if row["h"] > 0 else math.inf
            if not low[k] < step < high[k] or abs(step - s.tilt) > 8:
                if math.isinf(low[k]):
                    step = s.tilt - 2
                elif math.isinf(high[k]):
                    step = s.tilt + 2
                else:
                    step = (low[k] + high[k]) / 2
            s.tilt = step


def mix(docs: DataFrame, weights: DataFrame, id_col: str, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, source, n_tokens, rate, copies) of the chosen documents, and a report per source of the weights.

    docs: id_col, source, n_tokens. weights: source, target_share, max_repeats, one row per source; of repeated ones
    the larger counts. total_tokens: the size of the mixture, by default the tokens of all documents of the sources
    named; it is cut to what all repeats allow. A source without documents, or too small, gives what it can, and the
    others keep their proportions. Documents with a NULL or unnamed source, or without tokens, are not chosen;
    a NULL share or repeat counts as 0. Copies are never more than max_repeats.
    """
    spark = docs.sparkSession
    w = weights.select(source_name(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).cast("int").alias("repeats"))
    w = w.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max("share").alias("share"), F.max("repeats").alias("repeats"))
    named = w.limit(MAX_SOURCES + 1).collect()
    if len(named) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have a weight")
    sources = {r["source"]: Source(max(0.0, r["share"]), max(0, r["repeats"])) for r in named}
    table = spark.createDataFrame([(k,) for k in sources], "source string")
    usable = docs.select(id_col, source_name(F.col("source")).alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens")).filter(F.col("n_tokens") > 0)
    sized = materialize(usable.join(broadcast_if_small(table), "source"), "mix-documents")
    sizes = materialize(sized.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("docs")), "mix-sizes")
    for r in sizes.groupBy("source").agg(F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("n_tokens")).alias("tokens")).collect():
        sources[r["source"]].docs, sources[r["source"]].tokens = r["docs"], r["tokens"]
    token_budgets(sources, total_tokens if total_tokens is not None else sum(s.tokens for s in sources.values()))
    _solve(sizes, sources)

    rows = [(k, s.tilt, s.tokens / s.docs, s.repeats, s.full) for k, s in sources.items() if s.wanted > 0]
    tilts = F.broadcast(spark.createDataFrame(rows, "source string, tilt double, mean double, cap int, full boolean"))
    rate = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(_rate(F.col("tilt"), F.col("n_tokens") / F.col("mean"), F.col("cap")))
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.lit(29)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rated = sized.join(tilts, "source").withColumn("rate", rate).withColumn("base", F.floor("rate").cast("int"))
    rated = rated.withColumn("bin", F.when(F.col("base") < F.col("cap"), F.floor((F.col("rate") - F.col("base") - drawn) * BINS).cast("int")))
    first: dict[str, float] = {}
    bins: dict[str, list[tuple[int, int]]] = {}
    for r in rated.groupBy("source", "bin").agg(F.sum("n_tokens").alias("more"), F.sum(F.col("n_tokens") * F.col("base")).alias("held")).collect():
        first[r["source"]] = first.get(r["source"], 0) + r["held"]
        if r["bin"] is not None:
            bins.setdefault(r["source"], []).append((r["bin"], r["more"]))
    cuts = []
    for k, held in first.items():
        cut, miss = BINS + 1, abs(sources[k].wanted - held)
        for b, more in sorted(bins.get(k, []), reverse=True):
            held += more
            if abs(sources[k].wanted - held) > miss:
                break
            cut, miss = b, abs(sources[k].wanted - held)
        cuts.append((k, cut))
    edges = F.broadcast(spark.createDataFrame(cuts, "source string, cut int"))
    copies = F.col("base") + F.when(F.col("bin") >= F.col("cut"), 1).otherwise(0)
    chosen = rated.join(edges, "source").select(id_col, "source", "n_tokens", "rate", copies.alias("copies")).filter(F.col("copies") > 0)

    total = sum(s.wanted for s in sources.values())
    known = spark.createDataFrame(
        [(k, s.share, s.repeats, s.docs, s.tokens, s.wanted) for k, s in sources.items()],
        "source string, target_share double, max_repeats int, n_docs bigint, n_tokens bigint, wanted_tokens double",
    )
    reached = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("reached_tokens"), F.sum("copies").cast("bigint").alias("n_copies"), F.max("copies").alias("most_copies"))
    report = known.join(broadcast_if_small(reached), "source", "left").select(
        *known.columns,
        F.coalesce("reached_tokens", F.lit(0)).alias("reached_tokens"),
        F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    return chosen, report.withColumn("reached_share", F.col("reached_tokens") / F.lit(max(total, 1e-300)))
