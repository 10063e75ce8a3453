"""Encoding of whole texts with a public byte-level BPE vocabulary (problem 7).

Forced-boundary splitting. A pair of bytes that never occurs inside any vocabulary token
can never be crossed by a token, so a text may be cut there. A cut must also be invisible
to the splitting pattern that runs before the merges, hence the left character must not
be white space (the pattern looks ahead behind white space only) and the right one not an
apostrophe (which may begin a contraction). Between such cuts fragments are encoded
independently, each distinct one once per worker, and their ids are concatenated.

Cuts are found by array lookups on the UTF-8 buffer of a whole Arrow batch; nothing is
shuffled.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files of public tokenizers are; a parameter of every function here.
FOLDER = "/opt/tokenizers"
#: Fixed value: the splitting pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fragments kept per worker, and the longest that is kept, in bytes.
KEPT, KEPT_BYTES = 200_000, 48
#: Bytes of text worked on at once.
CHUNK = 1 << 21


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def uncrossable_pairs(ranks: Iterable[bytes]) -> np.ndarray:
    """A table of 65,536 truths: does the pair of bytes occur in no token?"""
    free = np.ones(65_536, dtype=bool)
    for token in ranks:
        for a, b in zip(token, token[1:]):
            free[a << 8 | b] = False
    return free


def forced_cuts(data: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Marks the bytes before which tokens certainly end and splitting is unaffected."""
    cut = np.zeros(len(data) + 1, dtype=bool)
    if len(data) < 2:
        return cut
    left, right = data[:-1], data[1:]
    here = free[left.astype(np.uint16) << 8 | right]
    here &= (right & 0xC0) != 0x80  # not inside a character
    here &= (left > 0x20) & (left != 0x7F) & (right != 0x27)
    cut[1:-1] = here
    wide = np.flatnonzero(here & (left >= 0x80)) + 1
    if len(wide):  # white space of two or three bytes on the left
        one, two, three = data[wide - 1], data[wide - 2], data[np.maximum(wide - 3, 0)]
        blank = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
        blank |= (three == 0xE1) & (two == 0x9A)
        blank |= (three == 0xE2) & ((two == 0x80) | (two == 0x81))
        blank |= (three == 0xE3) & (two == 0x80) & (one == 0x80)
        cut[wide[blank]] = False
    return cut


def chosen_cuts(data: np.ndarray, free: np.ndarray, ends: np.ndarray, longest: int = 24) -> np.ndarray:
    """Ends of the fragments to encode: every text end, forced cuts before white space, and
    all forced cuts in stretches of more than ``longest`` bytes without one of those."""
    forced = forced_cuts(data, free)
    main = forced.copy()
    main[1:-1] &= data[1:] <= 0x20
    main[ends] = True
    main[0] = False
    at = np.flatnonzero(main)
    gaps = np.diff(at, prepend=0)
    if (gaps > longest).any():
        wide = np.repeat(gaps > longest, gaps)  # for each byte, whether its stretch is long
        extra = forced[: len(wide)] & wide
        main[: len(wide)] |= extra
        main[0] = False
        at = np.flatnonzero(main)
    return at


class Encoder:
    """A vocabulary with its table of uncrossable pairs and the fragments met so far."""

    def __init__(self, path: str):
        import tiktoken

        ranks = read_ranks(path)
        self.free = uncrossable_pairs(ranks)
        self.base = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kept: dict[bytes, tuple[int, ...]] = {}

    def _fragment(self, fragment: bytes) -> tuple[int, ...]:
        ids = tuple(self.base.encode_ordinary(fragment.decode("utf-8")))
        if len(fragment) <= KEPT_BYTES and len(self.kept) < KEPT:
            self.kept[fragment] = ids
        return ids

    def encode_buffer(self, data: bytes, ends: np.ndarray) -> tuple[list[tuple[int, ...]], np.ndarray]:
        """Id tuples of all fragments, and how many fragments precede each text's end."""
        cuts = chosen_cuts(np.frombuffer(data, dtype=np.uint8), self.free, ends)
        bounds = cuts.tolist()
        fragments = [data[a:b] for a, b in zip([0, *bounds], bounds)]
        out = list(map(self.kept.get, fragments))
        if None in out:
            get, make = self.kept.get, self._fragment
            for i, ids in enumerate(out):
                if ids is None:
                    ids = get(fragments[i])
                    out[i] = make(fragments[i]) if ids is None else ids
        return out, np.searchsorted(cuts, ends, side="right")

    def encode(self, text: str | None) -> list[int]:
        data = (text or "").encode("utf-8")
        out, _ = self.encode_buffer(data, np.array([len(data)]))
        return list(chain.from_iterable(out))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_path(name: str, folder: str = FOLDER) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def _chunks(column) -> Iterator[tuple[bytes, np.ndarray]]:
    """(bytes, ends of the texts in them) of a string column, about ``CHUNK`` bytes at a time."""
    import pyarrow as pa

    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = memoryview(column.buffers()[2]) if column.buffers()[2] is not None else memoryview(b"")
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        last = min(last, n)
        yield bytes(data[offsets[first] : offsets[last]]), offsets[first + 1 : last + 1] - offsets[first]
        first = last


def encode_column(column, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each text's ids end) of an Arrow string column; nulls have none."""
    own = encoder(path)
    ids, ends, total = [], [], 0
    for data, text_ends in _chunks(column):
        fragments, upto = own.encode_buffer(data, text_ends)
        flat = np.fromiter(chain.from_iterable(fragments), dtype=np.int32)
        sizes = np.concatenate(([0], np.cumsum(np.fromiter(map(len, fragments), dtype=np.int64, count=len(fragments)))))
        ids.append(flat)
        ends.append(sizes[upto] + total)
        total += len(flat)
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate(ids or [empty.astype(np.int32)]), np.concatenate(ends or [empty])


def count_column(column, path: str) -> np.ndarray:
    """The number of ids of each text; nulls have none."""
    own = encoder(path)
    counts = []
    for data, text_ends in _chunks(column):
        fragments, upto = own.encode_buffer(data, text_ends)
        sizes = np.concatenate(([0], np.cumsum(np.fromiter(map(len, fragments), dtype=np.int64, count=len(fragments)))))
        counts.append(np.diff(sizes[upto], prepend=0))
    return np.concatenate(counts or [np.zeros(0, dtype=np.int64)])


def token_ids(documents: DataFrame, vocabulary: str = "byte_bpe_50k", key: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row, without special tokens.

    A null and an empty text both give an empty list; text that looks like a special token
    is ordinary text; repeated rows are kept; other columns are ignored.
    """
    path = vocabulary_path(vocabulary, folder)

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ids, ends = encode_column(b.column(1), path)
            offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=[key, "ids"])

    rows = documents.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: str = "byte_bpe_50k", key: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """``key`` and ``n_tokens`` (bigint) of every row; 0 for null and empty texts."""
    path = vocabulary_path(vocabulary, folder)

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count_column(b.column(1), path))], names=[key, "n_tokens"])

    rows = documents.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, n_tokens bigint")


def token_texts(encoded: DataFrame, vocabulary: str = "byte_bpe_50k", key: str = "doc_id", ids: str = "ids", folder: str = FOLDER) -> DataFrame:
    """``key`` and ``text``: the texts that lists of ids stand for; an empty list is an empty text, null stays null."""
    path = vocabulary_path(vocabulary, folder)

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        base = encoder(path).base
        for b in batches:
            texts = [None if x is None else base.decode_bytes(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    rows = encoded.select(F.col(key), F.col(ids))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, text string")
