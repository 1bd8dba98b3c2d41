"""Languages of documents and of the segments of mixed documents: multinomial naive Bayes over hashed character n-grams.

A document is cut into lines and sentences. Markup, damaged encodings, identifiers, numbers and log lines are cleaned
away first, since they have no language. n-grams are taken inside words with a blank on either side, so each distinct
word of a block is scored once and a sentence is the sum of its words. The log-probabilities of all n-gram slots for
all languages are a matrix of fixed size that is broadcast. Cutting, cleaning and scoring work on whole blocks of
texts in numpy; Python sees single sentences only where an encoding is to be repaired or a log line is suspected.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.session import materialize

#: The languages, each with its code, its three-letter codes, its English and its own names.
SPELLINGS = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "castilian"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "sv": ("sv", "swe", "swedish", "svenska"),
    "pl": ("pl", "pol", "polish", "polski"),
    "ru": ("ru", "rus", "russian", "русский"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "mandarin", "中文", "汉语", "漢語", "普通话"),
}
LANGUAGES = tuple(SPELLINGS)

#: The classifier is trained on about this many labelled documents of each language, drawn by the hash of id and text.
TRAIN_PER_LANGUAGE = 1_500
#: Tasks that the training documents are spread over at most.
TRAIN_PARTS = 64
SLOTS = 1 << 16
LONGEST_GRAM = 4
#: Every letter is part of LONGEST_GRAM n-grams, so the sum of their log-probabilities counts it so many times.
TEMPER = 1.0 / LONGEST_GRAM
#: Cost of another language than that of the sentence before, in the tempered log scale.
SWITCH = 2.5
#: A sentence counts with at least so many letters (Chinese: characters) and words.
LETTERS, WORDS, HAN = 14, 3, 5
#: Sentences that make a language one of those of a mixed document, and the confidence that each needs.
MIXED_SENTENCES, SURE = 2, 0.9

#: Characters that are worked on at once; a longer text is cut at a line or sentence.
WINDOW_CHARACTERS = 1 << 22
SLOT_BLOCK = 1 << 12

_TAG = re.compile(r"<[^<>\n]{1,80}>")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_RUN = re.compile("[\u0080-˿ -™Œ-ƒ]{2,}")
_LOG_LINE = re.compile(r"\s*+(===.*===\s*$|([\w/.@-]++)\s*+([:=])(\s*+-?[\d.eE+-]++\s*+$)?)")
_PATH = re.compile(r".+/[\w.@-]")
_BRACKETS = re.compile(r"\[[^\]\n]{0,60}\]|\([^)\s]{1,20}\)")

_BYTES = {}
for _b in range(256):
    try:
        _BYTES[bytes([_b]).decode("cp1252")] = _b
    except UnicodeDecodeError:
        _BYTES[chr(_b)] = _b

# What a character is, as bits
SPACE, BREAK, STOP, CLOSER, WIDE_STOP, HAN_LETTER, LETTER, WORD, BAD, CAPITAL, HYPHEN, MARKED, DAMAGED, SIGN = (1 << i for i in range(14))


def _kinds(c: str) -> int:
    kinds = 0
    for bit, holds in (
        (SPACE, c.isspace()),
        (BREAK, c in "\r\n"),
        (STOP, c in ".!?"),
        (CLOSER, c in "\"'”»)"),
        (WIDE_STOP, c in "。！？"),
        (HAN_LETTER, "㐀" <= c <= "鿿"),
        (LETTER, c.isalpha() or c in "'’"),
        (WORD, c.isalnum() or c == "_"),
        (BAD, c.isdecimal() or c in "_=/\\@#<>{}|"),
        (CAPITAL, "A" <= c <= "Z"),
        (HYPHEN, c == "-"),
        (MARKED, c == "&" or bool(_HIDDEN.match(c)) or unicodedata.combining(c) > 0),
        (DAMAGED, bool(_RUN.match(c + c))),
        (SIGN, c in ":="),
    ):
        kinds |= bit if holds else 0
    return kinds


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each character below 65,536 what it is, and its lower case where that is one character."""
    kinds = np.fromiter((_kinds(chr(i)) for i in range(1 << 16)), np.uint16, 1 << 16)
    lower = np.fromiter((ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(1 << 16)), np.uint32, 1 << 16)
    return kinds, lower


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _kinds_of(codes: np.ndarray) -> np.ndarray:
    kinds = _tables()[0]
    if not len(codes) or codes.max() < 1 << 16:
        return kinds[codes]
    out = kinds[np.minimum(codes, 0xFFFF)]
    for c in np.unique(codes[codes > 0xFFFF]):
        out[codes == c] = _kinds(chr(c))
    return out


def _among(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many places of the mask are in each range."""
    n = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return n[end] - n[start]


def _ranges(codes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each sentence and line: cut at white space that has a line break or follows a full stop, and after
    full stops of Chinese texts."""
    n = len(codes)
    space = (kinds & SPACE) > 0
    first = np.flatnonzero(space & ~np.concatenate([[False], space[:-1]]))
    last = np.flatnonzero(space & ~np.concatenate([space[1:], [False]])) + 1
    bare = np.maximum.accumulate(np.where((kinds & CLOSER) > 0, -1, np.arange(n)))  # the last place before that is no closing mark
    before = bare[first - 1]
    stopped = (first > 0) & (before >= 0) & ((kinds[before] & STOP) > 0)
    cut = stopped | (_among((kinds & BREAK) > 0, first, last) > 0)
    wide = (kinds & WIDE_STOP) > 0
    wide[1:] |= ((kinds[1:] & STOP) > 0) & ((kinds[:-1] & HAN_LETTER) > 0)
    after = np.flatnonzero(wide) + 1
    ends = np.concatenate([np.where(stopped, before + 1, first)[cut], after])
    nexts = np.concatenate([last[cut], after])
    order = np.lexsort((nexts, ends))
    start, end = np.concatenate([[0], nexts[order]]), np.concatenate([ends[order], [n]])
    some = end - start >= min(HAN, LETTERS)
    return start[some], end[some]


def _repaired(run: re.Match) -> str:
    try:
        return bytes(_BYTES[c] for c in run[0]).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return run[0]


def _mended(s: str) -> str:
    """A sentence without entities of HTML, hidden characters, doubly encoded characters and loose accents."""
    s = _HIDDEN.sub("", html.unescape(s) if "&" in s else s)
    return unicodedata.normalize("NFC", _RUN.sub(_repaired, s)).replace("\n", " ").replace("\r", " ")


def _is_log(s: str) -> bool:
    m = _LOG_LINE.match(s)
    return bool(m) and (m[2] is None or m[4] is not None or (m[3] == ":" and bool(_PATH.match(m[2]))))


def _words(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all words in lower case, where each word starts in them, and the piece that it is of."""
    text = "\n".join(pieces)
    codes = _codes(text)
    kinds = _kinds_of(codes)
    n = len(codes)
    space = (kinds & SPACE) > 0
    for pattern, sign in ((_TAG, "<"), (_BRACKETS, "["), (_BRACKETS, "(")):
        if sign in text and not (sign == "(" and "[" in text):
            for m in pattern.finditer(text):
                space[m.start() : m.end()] = True
    token = np.cumsum(space)
    bad = np.zeros(int(token[-1]) + 1 if n else 1, bool)
    bad[token[((kinds & BAD) > 0) & ~space]] = True
    keep = ((kinds & LETTER) > 0) & ~space & ~bad[token]
    hit = np.flatnonzero((kinds[1:-1] & HYPHEN) > 0) + 1
    hit = hit[((kinds[hit - 1] & WORD) > 0) & ((kinds[hit + 1] & CAPITAL) > 0)]
    if len(hit):  # names of entities: words joined by a hyphen before a capital
        outside = (kinds & (WORD | HYPHEN)) == 0
        name = np.cumsum(outside)
        named = np.zeros(int(name[-1]) + 1, bool)
        named[name[hit]] = True
        keep &= ~(named[name] & ~outside)
    at = np.flatnonzero(keep)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)[:-1]]) if pieces else np.zeros(0, np.int64)
    letters = codes[at]
    lower = _tables()[1]
    small = letters < 1 << 16
    letters = np.where(small, lower[np.where(small, letters, 0)], letters)
    return letters, first, np.searchsorted(edges, at[first], side="right") - 1


def _name(word: np.ndarray, inside: np.ndarray) -> np.ndarray:
    x = (word.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) * (_powers(1 << max(4, int(inside.max(initial=0)).bit_length()))[inside])


@lru_cache(4)
def _powers(n: int) -> np.ndarray:
    factors = np.full(n, 0xD6E8FEB86659FD93, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


@dataclass
class Sentences:
    """The sentences of a block that have enough words to have a language, and their words."""

    doc: np.ndarray  # of each sentence
    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    edges: np.ndarray  # where each sentence's words start in `word`
    word: np.ndarray  # numbers of distinct words, one sentence after the other
    spelled: np.ndarray  # letters of the distinct words
    sizes: np.ndarray  # their lengths


def find_sentences(texts: list[str], base: list[int] | None = None) -> Sentences:
    """Cuts, cleans and splits texts into words. base: what to add to the places in each text."""
    text = "\n".join(texts)
    codes = _codes(text)
    kinds = _kinds_of(codes)
    start, end = _ranges(codes, kinds) if len(codes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    pieces = [text[a:b] for a, b in zip(start.tolist(), end.tolist())]
    damaged = (kinds & DAMAGED) > 0
    damaged[1:] &= damaged[:-1].copy()
    damaged[:1] = False
    for i in np.flatnonzero(_among(damaged | ((kinds & MARKED) > 0), start, end)).tolist():
        pieces[i] = _mended(pieces[i])
    for i in np.flatnonzero(_among((kinds & SIGN) > 0, start, end)).tolist():
        if _is_log(pieces[i]):
            pieces[i] = ""
    letters, first, piece = _words(pieces)
    size = np.diff(np.append(first, len(letters)))
    han = np.add.reduceat(((letters >= 0x3400) & (letters <= 0x9FFF)).astype(np.int64), first) if len(first) else size
    count, long, wide = (np.bincount(piece, w, len(pieces)) for w in (None, size, han))
    whole = (wide >= HAN) | ((long >= LETTERS) & (count >= WORDS))
    used = whole[piece]
    inside = np.arange(len(letters)) - np.repeat(first, size)
    names = np.add.reduceat(_name(letters, inside), first)[used] if len(first) else np.zeros(0, np.uint64)
    _, once, word = np.unique(names, return_index=True, return_inverse=True)
    taken, lengths = first[used][once], size[used][once]
    at = np.repeat(taken - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(taken) else taken, lengths) + np.arange(int(lengths.sum()))
    chosen = np.flatnonzero(whole)
    edges = np.searchsorted(piece[used], chosen)
    begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)[:-1]]) if texts else np.zeros(0, np.int64)
    doc = np.searchsorted(begins, start[chosen], side="right") - 1
    shift = (np.array(base, np.int64) if base is not None else np.zeros(len(texts), np.int64))[doc] - begins[doc]
    return Sentences(doc, start[chosen] + shift, end[chosen] + shift, long[chosen].astype(np.int64), edges, word, letters[at], lengths)


def plain(s: str) -> str:
    """Without accents, as texts that have lost them."""
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)) if not s.isascii() else s


def grams(letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of 1 to LONGEST_GRAM characters of words with a blank on either side, and each one's word."""
    size = sizes + 2
    codes = np.full(int(size.sum()), 32, np.uint64)
    first = np.cumsum(size) - size
    codes[np.repeat(first + 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(letters))] = letters
    row = np.repeat(np.arange(len(sizes)), size)
    slots, of = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST_GRAM + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint64(0x100000001B3)) ^ (codes[n - 1 :] + np.uint64(n << 40))
        x = h * np.uint64(0x9E3779B97F4A7C15)
        keep = row[:m] == row[n - 1 :]
        slots.append((x >> np.uint64(48)).astype(np.int32)[keep])
        of.append(row[:m][keep])
    if not slots:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    slots, of = np.concatenate(slots), np.concatenate(of)
    o = np.argsort(of, kind="stable")
    return slots[o], of[o]


@dataclass
class Model:
    weights: np.ndarray  # slots x languages, log-probabilities

    def scores(self, found: Sentences) -> np.ndarray:
        """Tempered log-likelihoods, sentences x languages."""
        if not len(found.edges):
            return np.zeros((0, len(LANGUAGES)))
        words = np.empty((len(found.sizes), len(LANGUAGES)), np.float32)
        ends = np.cumsum(found.sizes)
        for i in range(0, len(words), 8_192):
            part = found.sizes[i : i + 8_192]
            slots, of = grams(found.spelled[ends[i] - part[0] : ends[i + len(part) - 1]], part)
            words[i : i + len(part)] = np.add.reduceat(self.weights[slots], np.searchsorted(of, np.arange(len(part))), axis=0)
        return np.add.reduceat(words[found.word].astype(np.float64), found.edges, axis=0) * TEMPER


def _windows(texts: list[str | None]) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Groups of texts of at most WINDOW_CHARACTERS, with the number of each and the place where it begins."""
    doc, part, base, held = [], [], [], 0
    for d, text in enumerate(texts):
        at = 0
        while text is not None and at < len(text):
            end = at + WINDOW_CHARACTERS
            if end < len(text):
                cut = max(text.rfind("\n", at, end), text.rfind(". ", at, end) + 1)
                end = cut + 1 if cut > at else end
            piece = text if at == 0 and end >= len(text) else text[at:end]
            if held and held + len(piece) > WINDOW_CHARACTERS:
                yield doc, part, base
                doc, part, base, held = [], [], [], 0
            doc.append(d)
            part.append(piece)
            base.append(at)
            held += len(piece)
            at = end
    if part:
        yield doc, part, base


def _slot_counts(found: Sentences, label: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Counts of the n-grams, languages x slots, in the kept sentences; words with accents count without them too."""
    out = np.zeros((len(LANGUAGES), SLOTS), np.int64)
    if not len(found.edges):
        return out
    sentence = np.repeat(np.arange(len(found.edges)), np.diff(np.append(found.edges, len(found.word))))
    used = kept[sentence]
    n = np.bincount(label[sentence[used]] * len(found.sizes) + found.word[used], minlength=len(LANGUAGES) * len(found.sizes)).reshape(len(LANGUAGES), -1)
    ends = np.cumsum(found.sizes)
    accented = np.flatnonzero(np.maximum.reduceat(found.spelled, ends - found.sizes) > 127)
    spelled = [found.spelled[ends[i] - found.sizes[i] : ends[i]].tobytes().decode("utf-32-le") for i in accented.tolist()]
    bare = [(i, p) for i, s in zip(accented.tolist(), spelled) if (p := plain(s)) != s and p]
    n = np.hstack([n, n[:, [i for i, _ in bare]]])
    letters = np.concatenate([found.spelled, _codes("".join(p for _, p in bare))])
    sizes = np.concatenate([found.sizes, np.array([len(p) for _, p in bare], np.int64)])
    slots, of = grams(letters, sizes)
    for k in range(len(LANGUAGES)):
        out[k] = np.bincount(slots, n[k][of], SLOTS).astype(np.int64)
    return out


def label_language(lang: Column) -> Column:
    """The language that a label names in any spelling; NULL if it names none."""
    word = F.lower(F.trim(F.coalesce(lang, F.lit(""))))
    first = F.regexp_extract(word, r"^(\p{L}*)", 1)
    known = F.create_map(*[F.lit(x) for code, names in SPELLINGS.items() for name in names for x in (name, code)])
    return F.coalesce(F.try_element_at(known, word), F.try_element_at(known, first))


def fit_languages(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    """Trains on the whole texts of a bounded sample of labelled documents: about per_language of each language.

    Drawn by the hash of id and text, equal rows once. Trained twice: sentences that the first model gives to another
    language than the document's label are left out of the second, since labels are wrong at times and documents
    mixed. The n-grams are counted where the sample lies and summed up per block of slots; what comes to the driver is
    the matrix. Without any labelled document all languages are equally likely.
    """
    labelled = docs.select(id_col, text_col, label_language(F.col(lang_col)).alias("label")).filter(F.col("label").isNotNull() & F.col(text_col).isNotNull())
    have = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if not have:
        return Model(np.zeros((SLOTS, len(LANGUAGES)), np.float32))
    space = 1 << 30
    share = F.create_map(*[F.lit(x) for k in LANGUAGES for x in (k, int(min(1.0, per_language / max(have.get(k, 0), 1)) * space))])
    number = F.create_map(*[F.lit(x) for i, k in enumerate(LANGUAGES) for x in (k, i)])
    drawn = labelled.filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(space)) < F.element_at(share, F.col("label")))
    parts = min(TRAIN_PARTS, 1 + sum(min(n, per_language) for n in have.values()) // 1_000)
    rows = drawn.select(id_col, F.element_at(number, F.col("label")).alias("label"), F.col(text_col).alias("text")).repartition(parts, id_col, "text").dropDuplicates()
    sample = materialize(rows.select("label", "text"), "language-sample")
    first = _trained(sample, None)
    return _trained(sample, first)


def _trained(sample: DataFrame, model: Model | None) -> Model:
    """Multinomial naive Bayes with add-half smoothing and equal priors; with a model, from sentences where it agrees."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(LANGUAGES), SLOTS), np.int64)
        for batch in _blocks(batches):
            labels = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for doc, texts, base in _windows(batch.column(1).to_pylist()):
                found = find_sentences(texts, base)
                label = labels[np.array(doc)[found.doc]]
                kept = np.ones(len(label), bool) if shared.value is None else shared.value.scores(found).argmax(axis=1) == label
                total += _slot_counts(found, label, kept)
        block = total.reshape(-1, SLOT_BLOCK)
        some = np.flatnonzero(block.any(axis=1))
        yield _counters(some, [block[i] for i in some])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[block] = total.get(block, 0) + np.frombuffer(raw, np.int64)
        yield _counters(np.array(sorted(total)), [total[k] for k in sorted(total)])

    out = np.zeros((len(LANGUAGES) * SLOTS // SLOT_BLOCK, SLOT_BLOCK))
    kind = "block int, counters binary"
    for r in sample.mapInArrow(counted, kind).repartition("block").mapInArrow(summed, kind).collect():  # of a fixed size
        out[r["block"]] = np.frombuffer(r["counters"], np.int64)
    counts = out.reshape(len(LANGUAGES), SLOTS) + 0.5
    return Model(np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32).copy())


def _counters(blocks: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([v.tobytes() for v in values], pa.binary())], names=["block", "counters"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of about 4 MB, or of one row."""
    for batch in batches:
        step = max(1, int(batch.num_rows * (4 << 20) / max(batch.nbytes, 1)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def best_paths(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best language of each sentence, where another one than that before costs SWITCH. first: starts of documents.

    Worked off by the sentences' places in their documents: the first ones of all documents, the second ones and so on,
    each a slice of rows that were sorted once. So the work is in proportion to the sentences.
    """
    n = len(scores)
    if not n:
        return np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    by_size = np.argsort(-size, kind="stable")
    place = np.arange(n) - np.repeat(first, size)
    rank = np.empty(len(first), np.int64)
    rank[by_size] = np.arange(len(first))
    order = np.lexsort((np.repeat(rank, size), place))
    s = scores[order]
    width = np.bincount(place)
    at = np.concatenate([[0], np.cumsum(width)])
    stay, top = np.ones(s.shape, bool), np.zeros(n, np.int64)
    best = s[: width[0]] - s[: width[0]].max(axis=1, keepdims=True)
    final = np.zeros(len(first), np.int64)
    for i, (a, m) in enumerate(zip(at[1:-1].tolist(), width[1:].tolist())):
        final[m : len(best)] = best[m:].argmax(axis=1)
        before = best[:m]
        top[a : a + m] = before.argmax(axis=1)
        bound = before.max(axis=1, keepdims=True) - SWITCH
        stay[a : a + m] = before >= bound
        best = s[a : a + m] + np.maximum(before, bound)
        best -= best.max(axis=1, keepdims=True)
    final[: len(best)] = best.argmax(axis=1)
    path = np.zeros(n, np.int64)
    now = final
    for a, m in zip(at[-2::-1].tolist(), width[::-1].tolist()):
        path[a : a + m] = now[:m]
        if a:
            kept = stay[np.arange(a, a + m), now[:m]]
            now[:m] = np.where(kept, now[:m], top[a : a + m])
    out = np.empty(n, np.int64)
    out[order] = path
    return out


def segments(docs: DataFrame, id_col: str, text_col: str, model: Model, carry: Sequence[str] = ()) -> DataFrame:
    """id, the columns `carry`, segment, lang, confidence, start, length, sentences: the stretches of one language.

    A segment is a run of sentences of the same language; `sentences` counts those with enough words to have one, and
    the confidence is the mean of their probabilities. start and length are places in the text. Documents that are
    NULL, blank, or of identifiers, numbers, log lines and single words only have no segment.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = [id_col, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            parts = []
            for number, texts, base in _windows(batch.column(0).to_pylist()):
                found = find_sentences(texts, base)
                parts.append((np.array(number)[found.doc], found.start, found.end, found.letters, shared.value.scores(found)))
            doc, start, end, letters, scores = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0)] * 5
            if not len(doc):
                continue
            path = best_paths(scores, np.flatnonzero(np.diff(doc, prepend=-1)))
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            p = (p / p.sum(axis=1, keepdims=True))[np.arange(len(p)), path]
            new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(path, prepend=-1) != 0))
            count = np.diff(np.append(new, len(doc)))
            last = np.append(new[1:], len(doc)) - 1
            number = np.arange(len(new)) - np.searchsorted(doc[new], doc[new])
            rows = pa.array(doc[new])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(1 + i).take(rows) for i in range(len(held))),
                    pa.array(number.astype(np.int32)),
                    pa.array([LANGUAGES[k] for k in path[new]]),
                    pa.array(np.add.reduceat(p, new) / count),
                    pa.array(start[new].astype(np.int32)),
                    pa.array((end[last] - start[new]).astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                    pa.array(np.add.reduceat(p >= SURE, new, dtype=np.int32)),
                    pa.array(np.add.reduceat(letters, new)),
                ],
                names=[*held, "segment", "lang", "confidence", "start", "length", "sentences", "sure", "letters"],
            )

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in held)
    schema = f"{kinds}segment int, lang string, confidence double, start int, length int, sentences int, sure int, letters bigint"
    return docs.select(F.col(text_col).alias("__text"), *held).mapInArrow(run, schema)


def document_languages(found: DataFrame, id_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """id, `carry`, lang, confidence, share, sentences, main, mixed, several: the languages of each document.

    One row per language. `share` is the language's part of the letters; main marks the one with most of them (ties:
    the first by its code). `several` says that the document has MIXED_SENTENCES sure sentences in each of several
    languages, and mixed marks these languages.
    """
    held = [id_col, *carry]
    per = found.groupBy(*held, "lang").agg(
        F.sum("letters").alias("letters"),
        F.sum("sentences").alias("sentences"),
        F.sum("sure").alias("sure"),
        (F.sum(F.col("confidence") * F.col("sentences")) / F.sum("sentences")).alias("confidence"),
    )
    languages = F.collect_list(F.struct((-F.col("letters")).alias("less"), "lang", "sentences", "sure", "confidence"))  # at most one per language
    docs = per.groupBy(*held).agg(F.array_sort(languages).alias("all"))
    strong = F.size(F.filter("all", lambda x: x["sure"] >= MIXED_SENTENCES))
    total = F.aggregate("all", F.lit(0).cast("bigint"), lambda s, x: s - x["less"])
    rows = docs.select(*held, F.col("all")[0]["lang"].alias("__main"), (strong >= 2).alias("several"), total.alias("__total"), F.explode("all").alias("x"))
    return rows.select(
        *held,
        "x.lang",
        "x.confidence",
        (-F.col("x.less") / F.col("__total")).alias("share"),
        "x.sentences",
        (F.col("x.lang") == F.col("__main")).alias("main"),
        (F.col("several") & (F.col("x.sure") >= MIXED_SENTENCES)).alias("mixed"),
        "several",
    )
