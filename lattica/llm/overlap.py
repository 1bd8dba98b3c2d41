"""Same or near-same records across splits: content-defined chunks.

A record is normalised to the letters and digits of its fields, so that markup, case, accents, spacing and punctuation
play no role. It is cut between fields and, inside a field, where a rolling hash of the last characters says so. Equal
passages give equal chunks wherever they stand, so the order of fields plays no role either. Two records overlap by
the summed length of the chunks that they share, as a fraction of the longer one.

Rows are brought together by task and by coarse buckets of label and time, text and all, so candidates are found and
compared where they lie and no list of candidates is ever written. Within such a cell candidates share a chunk, which is
exact for its threshold t: all chunks are put in one order, rarest first; two records that share t of their length share
a chunk within the rarest chunks that make up 1 - t of either. Only these are looked up, so passages that stand in very
many records are never paired by themselves, and nothing is capped. What counts in the end is an exact comparison of
trigrams, since one changed letter costs a whole chunk: records that agree by 85 % may share a quarter of their length
in chunks only.

A bucket with very many rows, as of a task without times and with few labels, is laid out as a grid: each part of the
one side meets each part of the other in a cell of its own, so tasks stay small whatever the buckets' sizes.

Records with the same task, split side, label, time and letters form one class of copies, told by 128 bits of hash,
which is compared once; pairs of rows are only made from pairs of classes that have passed the exact check.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.skew import HeavyKeys
from lattica.session import broadcast_if_small, materialize

WINDOW = 3
#: A cut is where the rolling hash has its peak among so many places on either side, so chunks have more characters.
RADIUS = 4
#: Pairs with at least this part of the longer text in shared chunks are sure to be candidates; what counts in the end is SIMILAR.
SHARED = 0.25
SIMILAR = 0.8
#: A text whose fields have fewer letters on average is cut without regard to its fields as well, as marks between all words
#: may be a way of writing.
SHORT_FIELDS = 10
BINS = 509
#: Bits of a text's trigrams, by which most candidates are told apart.
BITS = 512
ROWS_AT_ONCE = 1_000
BYTES_AT_ONCE = 4 << 20
#: Small cells are compared together, up to so many rows, and so many candidates at a time.
ROWS_TOGETHER = 20_000
PAIRS_AT_ONCE = 1 << 17
#: Buckets with more rows are laid out as a grid of cells with about a quarter of the bucket's classes on a side, between these bounds.
BUCKET_ROWS = 100_000
CELL_CLASSES = (25_000, 100_000)
LABEL_WIDTH = 0.1
DAY = 86_400 * 1_000_000
NO_TIME = -(1 << 40)
#: Lists of classes up to this length are broadcast.
MOST_BROADCAST = 200_000

_TAG = re.compile(r"<[^<>]{1,80}>")
_DAMAGED = re.compile("[ÃÂâ]")
_U = np.uint64

#: What stands between the fields of a record, besides a comma before a blank and tags.
_BETWEEN = ";|\n\r\t"
_FIELDS = bytes(10 if chr(b) in _BETWEEN else b for b in range(256)).lower()
_OTHER = bytes(b for b in range(128) if not chr(b).isalnum() and chr(b) not in _BETWEEN)
_TO_BREAKS = {ord(c): "\n" for c in _BETWEEN}


def normal(text: str) -> str:
    """The fields of a text, one per line, as letters and digits only: lower case, without markup, accents and doubly
    encoded characters. Fields without any letter or digit are left out."""
    if "<" in text:
        text = _TAG.sub("\n", text)
    if "&" in text:
        text = html.unescape(text)
    if "," in text:
        text = text.replace(", ", "\n")
    if text.isascii():
        text = text.encode().translate(_FIELDS, _OTHER).decode()
    else:
        if _DAMAGED.search(text):
            try:
                text = text.encode("cp1252").decode("utf-8")
            except UnicodeError:
                pass
        text = unicodedata.normalize("NFKD", text.translate(_TO_BREAKS))
        text = "".join(c for c in text.lower() if c.isalnum() or c == "\n")
    return "\n".join(filter(None, text.split("\n"))) if "\n" in text else text


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(1, 1 << 63, 1 << 16, dtype=_U) | _U(1), rng.integers(1, 1 << 63, 1 << 16, dtype=_U) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(29))
    x = x * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


@lru_cache(2)
def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, _U)
    factors[0] = 1
    return np.cumprod(factors, dtype=_U)


def chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: row, digest and length of each chunk. No chunk goes beyond a field."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), sizes)
    inside = codes != 10
    field = (np.cumsum(~inside) + row)[inside]  # a new number after each line break and for each text
    codes, row = codes[inside], row[inside]
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    code = ((codes ^ (codes >> 16)) & 0xFFFF).astype(np.int64)
    roll, value = _tables()
    edge = np.concatenate([[True], field[1:] != field[:-1]])
    first = np.flatnonzero(edge)
    at = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    g, h = roll[code], np.zeros(n, _U)
    for k in range(WINDOW):
        part = g[: n - k] * _U(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
        h[k:] += part if k == 0 else np.where(at[k:] >= k, part, _U(0))
    h = mix(h)
    peak = np.ones(n, bool)
    for k in range(1, RADIUS + 1):
        peak[k:] &= (h[k:] > h[:-k]) | (at[k:] < k)
        peak[:-k] &= (h[:-k] >= h[k:]) | (at[k:] < k)
    begin = np.flatnonzero(np.concatenate([[True], peak[:-1]]) | edge)
    length = np.diff(np.append(begin, n))
    place = np.arange(n) - np.repeat(begin, length)
    power = _powers(0xD6E8FEB86659FD93, 1 << (int(length.max()) - 1).bit_length())
    digest = mix(np.add.reduceat(value[code] * power[place], begin) + length.astype(_U))
    return row[begin], digest, length


def all_cuts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The row and version of each chunk, its digest and its length. Version 1 is the text without its fields, for texts
    with short ones. Equal chunks of a version are one with the summed length."""
    short = [i for i, t in enumerate(texts) if "\n" in t and len(t) < (t.count("\n") + 1) * (SHORT_FIELDS + 1)]
    version, digest, length = combined(*chunks(texts + [texts[i].replace("\n", "") for i in short]))
    of = np.concatenate([np.arange(len(texts)), np.array(short, np.int64)])
    return of[version], version, digest, length


def combined(row: np.ndarray, digest: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal chunks of a row become one with the summed length; ordered by row and digest."""
    o = np.lexsort((digest, row))
    row, digest, length = row[o], digest[o], length[o]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[new], digest[new], np.add.reduceat(length, new) if len(new) else length


def rarest(cuts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Row and digest of the rarest chunks that make up more than 1 - SHARED of each version of a text.

    cuts: what all_cuts gives for some texts at a time. They are put in order one by one, which saves memory.
    """
    known, times = np.unique(np.concatenate([c[2] for c in cuts]), return_counts=True)
    kept = []
    for row, version, digest, length in cuts:
        o = np.lexsort((digest, times[np.searchsorted(known, digest)], version))
        row, version, digest, length = row[o], version[o], digest[o], length[o]
        summed = np.cumsum(length)
        edge = np.flatnonzero(np.diff(version, prepend=-1))
        counts = np.diff(np.append(edge, len(row)))
        base = np.repeat(summed[edge] - length[edge], counts)
        whole = np.repeat(np.add.reduceat(length, edge), counts) if len(edge) else length
        keep = summed - length - base <= (1 - SHARED) * whole
        kept.append((row[keep], digest[keep]))
    row, digest = (np.concatenate(x) for x in zip(*kept))
    return row, digest


def overlap_fractions(a: list[str], b: list[str]) -> np.ndarray:
    """Per pair of normalised texts the shared chunk length as a fraction of the longer text; with fields or without."""
    out = np.zeros(len(a))
    for x, y in ((a, b), ([t.replace("\n", "") for t in a], [t.replace("\n", "") for t in b])):
        ra, da, la = combined(*chunks(x))
        rb, db, lb = combined(*chunks(y))
        row, digest, length = np.concatenate([ra, rb]), np.concatenate([da, db]), np.concatenate([la, lb])
        o = np.lexsort((digest, row))
        row, digest, length = row[o], digest[o], length[o]
        both = np.flatnonzero((row[1:] == row[:-1]) & (digest[1:] == digest[:-1]))
        shared = np.bincount(row[both], np.minimum(length[both], length[both + 1]), len(a))
        longer = np.array([max(len(s) - s.count("\n"), len(t) - t.count("\n"), 1) for s, t in zip(x, y)])
        out = np.maximum(out, shared / longer)
    return out


def trigrams(text: str) -> Counter:
    """The multiset of three characters within fields; a shorter field counts as it is."""
    return Counter(s[i : i + 3] for s in text.split("\n") for i in range(max(1, len(s) - 2)))


def trigram_similarity(a: str, b: str) -> float:
    """Dice coefficient of the trigrams of two normalised texts. The order of fields plays no role.

    Texts of unlike numbers of fields are compared without them as well, and the larger value counts."""
    x, y = trigrams(a), trigrams(b)
    same = 2 * sum((x & y).values()) / (x.total() + y.total())
    return same if a.count("\n") == b.count("\n") else max(same, trigram_similarity(a.replace("\n", ""), b.replace("\n", "")))


def trigram_bounds(a: list[str], b: list[str]) -> np.ndarray:
    """Per pair what trigram_similarity is at most: trigrams that fall into the same of BINS count as equal, and so do
    all fields of less than three characters."""

    def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.frombuffer(("\n\n".join(texts) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)) + 2)
        letter = codes != 10
        inside = letter[:-2] & letter[1:-1] & letter[2:]
        at = (row[:-2] * BINS + ((codes[:-2] * 131 + codes[1:-1]) * 131 + codes[2:]) % BINS)[inside]
        begins = letter & ~np.concatenate([[False], letter[:-1]])
        fields = np.bincount(row[begins], minlength=len(texts))
        longer = np.bincount(row[:-2][begins[:-2] & inside], minlength=len(texts))
        grams = np.bincount(row[:-2][inside], minlength=len(texts))
        return np.bincount(at, minlength=len(texts) * BINS).reshape(-1, BINS), fields - longer, grams

    (x, short_x, n), (y, short_y, m) = counted(a), counted(b)
    equal = np.minimum(x, y).sum(1) + np.minimum(short_x, short_y)
    return 2 * equal / np.maximum(1, n + m + short_x + short_y)


def _alike(a: list[str], b: list[str]) -> list[int]:
    """Which pairs are similar: those whose bound allows it are compared."""
    possible = trigram_bounds(a, b) >= SIMILAR - 1e-9
    unlike = [i for i in np.flatnonzero(~possible).tolist() if a[i].count("\n") != b[i].count("\n")]
    if unlike:
        possible[unlike] = trigram_bounds([a[i].replace("\n", "") for i in unlike], [b[i].replace("\n", "") for i in unlike]) >= SIMILAR - 1e-9
    return [i for i in np.flatnonzero(possible).tolist() if trigram_similarity(a[i], b[i]) >= SIMILAR]


def _steps(sizes: np.ndarray) -> Iterator[range]:
    """Ranges of at most ROWS_AT_ONCE texts of these lengths, and of BYTES_AT_ONCE letters unless a single text has more."""
    begin = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and (i - begin >= ROWS_AT_ONCE or total + n > BYTES_AT_ONCE):
            yield range(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield range(begin, len(sizes))


def trigram_bits(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the set of the trigrams of its fields as BITS bits, and the number of what `trigrams` counts. What is
    shorter than a trigram has no bit."""
    bits, n = np.zeros((len(texts), BITS // 64), _U), np.zeros(len(texts), np.int64)
    for part in _steps(np.fromiter(map(len, texts), np.int64, len(texts))):
        codes = np.frombuffer(("\n\n".join(texts[part.start : part.stop]) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(part)), np.fromiter((len(texts[i]) + 2 for i in part), np.int64, len(part)))
        letter = codes != 10
        inside = letter[:-2] & letter[1:-1] & letter[2:]
        begins = letter[:-2] & ~np.concatenate([[False], letter[:-3]])
        flags = np.zeros((len(part), BITS), bool)
        flags.reshape(-1)[(row[:-2] * BITS + ((codes[:-2] * 131 + codes[1:-1]) * 131 + codes[2:]) % BITS)[inside]] = True
        bits[part.start : part.stop] = np.packbits(flags, axis=1).view(_U)
        n[part.start : part.stop] = np.bincount(row[:-2][inside | begins], minlength=len(part))
    return bits, n


def _may_be_alike(bits: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each bit that only one of two texts has stands for a trigram that the other one lacks."""
    equal_a, equal_b = n[a], n[b]
    total = equal_a + equal_b
    for word in bits.T:
        x, y = word[a], word[b]
        equal_a -= np.bitwise_count(x & ~y)
        equal_b -= np.bitwise_count(y & ~x)
    return 2 * np.minimum(equal_a, equal_b) >= (SIMILAR - 1e-9) * total


def _meetings(key: np.ndarray, row: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of side 0 and of side 1 with equal keys, about PAIRS_AT_ONCE at a time; all those of a row of side 1 come at once."""
    left = side[row] == 0
    o = np.argsort(key[left])
    left_key, left_row = key[left][o], row[left][o]
    o = np.argsort(row[~left], kind="stable")
    right_key, right_row = key[~left][o], row[~left][o]
    begin = np.searchsorted(left_key, right_key, "left")
    n = np.searchsorted(left_key, right_key, "right") - begin
    begin, n, right_row = begin[n > 0], n[n > 0], right_row[n > 0]
    if not len(n):
        return
    before = np.cumsum(n) - n
    edge = np.flatnonzero(np.diff(right_row, prepend=-1))
    cuts = edge[np.flatnonzero(np.diff(before[edge] // PAIRS_AT_ONCE, prepend=-1))]
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(n)]):
        at = np.repeat(begin[i:j] - before[i:j] + before[i], n[i:j]) + np.arange(n[i:j].sum())
        yield left_row[at], np.repeat(right_row[i:j], n[i:j])


PAIR = "class_a struct<class: bigint, mark: bigint>, class_b struct<class: bigint, mark: bigint>, overlap double"


def _compared(rows: pa.Table, days: int) -> Iterator[pa.RecordBatch]:
    """The similar pairs of whole cells. rows: cell, class, mark, id, task, side, label, at, text."""
    numbers = lambda c, empty: rows.column(c).combine_chunks().fill_null(empty).to_numpy(zero_copy_only=False)
    cell, klass, mark = (numbers(c, 0) for c in ("cell", "class", "mark"))
    o = np.lexsort((numbers("id", -(1 << 63)), mark, klass, cell))
    same = (cell[o][1:] == cell[o][:-1]) & (klass[o][1:] == klass[o][:-1]) & (mark[o][1:] == mark[o][:-1])
    one = o[np.concatenate([[True], ~same])]
    texts = [normal(t) for t in rows.column("text").take(pa.array(one)).to_pylist()]
    full = [i for i, t in enumerate(texts) if t]
    texts, one = [texts[i] for i in full], one[full]
    if not texts:
        return
    rows = rows.drop_columns("text").take(pa.array(one))
    cell, klass, mark = cell[one], klass[one], mark[one]
    task = rows.column("task").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    side, label = (rows.column(c).to_numpy() for c in ("side", "label"))
    timed = rows.column("at").is_valid().to_numpy()
    at = rows.column("at").cast(pa.int64()).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
    size, lines = (np.fromiter(map(f, texts), np.int64, len(texts)) for f in (len, lambda t: t.count("\n")))

    cuts: list[tuple[np.ndarray, ...]] = []
    for part in _steps(size):
        row, version, digest, length = all_cuts(texts[part.start : part.stop])
        cuts.append((row + part.start, version, digest, length))
    row, digest = rarest(cuts)
    del cuts
    bits, n = trigram_bits(texts)
    bits = np.asfortranarray(bits)  # by word
    for a, b in _meetings(mix(digest ^ mix(cell.view(_U))[row]), row, side):
        apart = np.abs(label[a] - label[b])
        near = apart <= np.maximum(0.01, 0.01 * np.maximum(np.abs(label[a]), np.abs(label[b]))) + 1e-9
        timely = (timed[a] == timed[b]) & (np.abs(at[a] - at[b]) <= days * DAY)
        met = near & timely & (task[a] == task[b]) & (cell[a] == cell[b])
        a, b = a[met], b[met]
        possible = _may_be_alike(bits, n, a, b)
        unlike = np.flatnonzero(~possible & (lines[a] != lines[b]))
        if len(unlike):
            of, place = np.unique(np.concatenate([a[unlike], b[unlike]]), return_inverse=True)
            possible[unlike] = _may_be_alike(*trigram_bits([texts[i].replace("\n", "") for i in of.tolist()]), *np.split(place, 2))
        a, b = np.divmod(np.unique(a[possible] * len(texts) + b[possible]), len(texts))
        for part in _steps(size[a] + size[b]):
            x, y = a[part.start : part.stop], b[part.start : part.stop]
            s, t = [texts[k] for k in x.tolist()], [texts[k] for k in y.tolist()]
            sure = _alike(s, t)
            if sure:
                share = overlap_fractions([s[k] for k in sure], [t[k] for k in sure])
                kinds = [pa.StructArray.from_arrays([pa.array(klass[z[sure]]), pa.array(mark[z[sure]])], names=["class", "mark"]) for z in (x, y)]
                yield pa.RecordBatch.from_arrays([*kinds, pa.array(share)], names=["class_a", "class_b", "overlap"])


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by cell as tables of whole cells: one with many rows, or several together."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column(0).to_numpy()
        begins = np.flatnonzero(np.diff(cell, prepend=held[-1].column(0)[-1].as_py() if held else cell[0])).tolist()
        at = 0
        for i in begins:
            if n + i - at >= ROWS_TOGETHER:
                yield pa.Table.from_batches([*held, batch.slice(at, i - at)])
                held, n, at = [], 0, i
        held.append(batch.slice(at))
        n += batch.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def _buckets(days: int):
    """The hashed buckets of task, label and time of a row. Rows of side 1 have all that may match."""
    scaled = F.signum("label") * F.log1p(F.abs("label"))
    day, span = F.unix_date(F.to_date("at")), (days + 1) * 8
    hashes = []
    for dl, dt in ((-0.0102, -days), (-0.0102, days), (0.0102, -days), (0.0102, days)):
        label = F.floor((scaled + F.col("side") * dl) / LABEL_WIDTH)
        hashes.append(F.xxhash64("task", label, F.coalesce(F.floor((day + F.col("side") * dt) / span), F.lit(NO_TIME))))
    return F.array_distinct(F.array(*hashes))


def _gridded(rows: DataFrame) -> DataFrame:
    """The classes of large buckets, once for each part of the other side that they are to meet."""
    classes = lambda side: F.approx_count_distinct(F.when(F.col("side") == side, F.col("class")))
    sizes = rows.groupBy("bucket").agg(classes(0).alias("n_0"), classes(1).alias("n_1")).collect()
    parts = []
    for bucket, *n in sizes:
        cell = min(max(CELL_CLASSES[0], sum(n) // 4), CELL_CLASSES[1])
        parts.append((bucket, *(max(1, -(-k // cell)) for k in n)))
    grid = F.broadcast(rows.sparkSession.createDataFrame(parts, "bucket bigint, parts_0 int, parts_1 int"))
    v = F.struct("id", "task", "side", "label", "at", "text")
    one = rows.groupBy("bucket", "class", "mark").agg(F.min(v).alias("v")).select("bucket", "class", "mark", "v.*").join(grid, "bucket")
    own = F.pmod("class", F.when(F.col("side") == 0, F.col("parts_0")).otherwise(F.col("parts_1"))).cast("int")
    met = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("parts_1")).otherwise(F.col("parts_0")) - 1))
    laid = one.select("*", own.alias("own"), met.alias("met"))
    place = F.when(F.col("side") == 0, F.xxhash64("bucket", "own", "met")).otherwise(F.xxhash64("bucket", "met", "own"))
    return laid.select(place.alias("cell"), "class", "mark", "id", "task", "side", "label", "at", "text")


def near_copies(rows: DataFrame, days: int = 3) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes of copies across the two sides, and the members of these classes.

    rows: id BIGINT, task STRING, side INT (0 and 1), label DOUBLE, at TIMESTAMP_NTZ, text STRING. A pair needs the
    same task, labels at most 1 % (of the larger) or 0.01 apart, times at most `days` apart or both NULL, and texts
    whose trigrams agree by SIMILAR; such pairs are sure to be found if chunks overlap by SHARED. Rows without task,
    text or numeric label, and texts without any letter or digit, are no case. Redelivered rows are members of the
    same class.

    Result: (class_a, class_b, overlap) with class_a of side 0, and (class, id, side). A class is named by two numbers.
    Copies are compared once per class, so their number has no effect on the work.
    """
    usable = rows.filter(F.col("text").isNotNull() & F.col("task").isNotNull() & F.col("label").isNotNull() & ~F.isnan("label") & F.col("side").isNotNull())
    what = ["task", "side", "label", "at", F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]+", ""))]
    usable = usable.select("id", "task", "side", "label", "at", "text", F.xxhash64(*what).alias("class"), F.xxhash64(F.lit(1), *what).alias("mark"))
    bucketed = usable.select("*", F.explode(_buckets(days)).alias("bucket"))
    large = HeavyKeys(bucketed, ["bucket"], BUCKET_ROWS)
    cells = bucketed.withColumnRenamed("bucket", "cell").select("cell", "class", "mark", "id", "task", "side", "label", "at", "text")
    if large.rows:
        names = F.broadcast(large.frame().select("bucket"))
        small = cells.join(names.withColumnRenamed("bucket", "cell"), "cell", "left_anti")
        cells = small.unionByName(_gridded(bucketed.join(names, "bucket", "left_semi")))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            yield from _compared(table, days)

    pairs = materialize(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(compared, PAIR), "overlap-pairs")
    kind = F.struct("class", "mark").alias("class")
    wanted = broadcast_if_small(pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct(), MOST_BROADCAST)
    return pairs, materialize(usable.select(kind, "id", "side").join(wanted, "class", "left_semi").distinct(), "overlap-members")
