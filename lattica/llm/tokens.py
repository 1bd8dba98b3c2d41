"""Encoding of texts with a public byte-level BPE tokenizer by forced-boundary splitting.

A pair of bytes (a, b) that occurs inside no token of the vocabulary can never be merged, so a text may be cut between
a and b. Most places between two words are such cuts. The fragments are encoded independently, each distinct one once
per worker as long as the cache holds it, and their ids are concatenated. A long text costs as much per byte as a
short one.

The splitting pattern looks one character ahead at the end of white space and treats an apostrophe at the start of a
match in its own way. Hence a cut is certain only if, besides, a isn't the last byte of a white-space character and b
is neither an apostrophe nor the middle of a character. What follows a then starts a match in the whole text or goes
on with one of the same class, so the fragments split just as the text does.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.session import tokenizer_dir

#: Fixed value: the pattern by which this vocabulary splits text, as its README gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Last bytes of the white-space characters beyond ASCII in UTF-8.
SPACE_ENDS = (*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF)

CACHE_ENTRIES = 400_000
CACHED_LENGTH = 64
BLOCK_BYTES = 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def certain_cuts(vocabulary: Iterable[bytes]) -> np.ndarray:
    """A table of 65,536 flags: may a text be cut between the bytes a and b, at a * 256 + b?"""
    cut = np.ones((256, 256), bool)
    for token in vocabulary:
        t = np.frombuffer(token, np.uint8)
        cut[t[:-1], t[1:]] = False
    cut[: 0x21] = False
    cut[0x7F] = False
    cut[list(SPACE_ENDS)] = False
    cut[:, 0x80:0xC0] = False
    cut[:, ord("'")] = False
    return cut.reshape(-1)


class FragmentEncoder:
    def __init__(self, path: str):
        import tiktoken

        ranks = read_ranks(path)
        self.plain = tiktoken.Encoding("lattica", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = certain_cuts(ranks)
        self.cache: dict[bytes, list[int]] = {}

    def fragment(self, piece: bytes) -> list[int]:
        ids = self.plain.encode_ordinary(piece.decode("utf-8", "replace"))
        if len(piece) <= CACHED_LENGTH:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode(self, text: bytes) -> list[int]:
        """The ids of one text; [] for an empty one."""
        if not text:
            return []
        b = np.frombuffer(text, np.uint8)
        at = (np.flatnonzero(self.cut[b[:-1].astype(np.int32) * 256 + b[1:]]) + 1).tolist()
        held = self.cache.get
        out = []
        for piece in map(text.__getitem__, map(slice, chain((0,), at), chain(at, (len(text),)))):
            ids = held(piece)
            out.append(self.fragment(piece) if ids is None else ids)
        return list(chain.from_iterable(out))


@lru_cache(2)
def encoder(path: str) -> FragmentEncoder:
    return FragmentEncoder(path)


def _bytes(column: pa.Array) -> Iterator[bytes]:
    """The values of a string column as bytes; NULL as an empty text."""
    for v in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield v.as_py() or b""


def encode_documents(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """id and `ids` (list of integers) of each row, without special tokens; their strings in a text are ordinary text.

    NULL and empty texts give an empty list. Every row gives one row, repeated ids included; a NULL id stays NULL.
    No shuffle: a text is encoded where it lies. Only the two columns are read, so extra ones do no harm.
    """
    return _over_texts(df, id_col, text_col, path, False)


def count_tokens(df: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """id, the columns `carry` and `n_tokens` (0 for NULL and empty texts) of each row."""
    return _over_texts(df, id_col, text_col, path, True, tuple(carry))


def _over_texts(df: DataFrame, id_col: str, text_col: str, path: str | None, counts: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    path = path or f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for whole in batches:
            step = max(1, int(whole.num_rows * BLOCK_BYTES / max(whole.nbytes, 1)))
            for k in range(0, whole.num_rows, step):
                batch = whole.slice(k, step)
                ids = [encode(t) for t in _bytes(batch.column(1))]
                lengths = np.fromiter(map(len, ids), np.int64, len(ids))
                if counts:
                    result = pa.array(lengths)
                else:
                    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                    result = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                kept = [batch.column(0), *(batch.column(2 + i) for i in range(len(carry)))]
                yield pa.RecordBatch.from_arrays([*kept, result], names=[id_col, *carry, "n_tokens" if counts else "ids"])

    kept = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in (id_col, *carry))
    return df.select(id_col, text_col, *carry).mapInArrow(run, kept + ("n_tokens bigint" if counts else "ids array<int>"))
