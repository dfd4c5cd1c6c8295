"""Encoding with a public byte-level BPE tokenizer as a monoid tree reduction.

A text is halved down to leaves, leaves are encoded, and neighbours are joined up the tree. A join re-encodes
a window around the seam that grows until it ends on both sides at a certain cut: a place where the
tokenizer's pre-splitting pattern has a border whatever stands before or after it. Tokens outside such a
window cannot change, so the result equals the encoding of the whole text. Without a certain cut on one side
the window grows to the end of that side. Decoding concatenates bytes up the same tree.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF_CHARS = 1024
WINDOW_CHARS = 32

# Fixed value: the published pre-splitting pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# No alternative of PATTERN runs across these places, and none looks across them in a way that matters.
_W = r"\p{White_Space}"
_CUT = regex.compile(
    rf"(?<=[^{_W}])(?=[{_W}])|(?<=\p{{L}})(?=[^{_W}\p{{L}}])|(?<=\p{{N}})(?=[^{_W}\p{{N}}])|(?<=[^{_W}\p{{L}}\p{{N}}'])(?=[\p{{L}}\p{{N}}])"
)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file; special tokens are unknown to it, so their strings are ordinary text."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("folioscope", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _shipped(spark: SparkSession, path: str) -> str:
    """Sends the driver's rank file along with the job; the name to find it by on an executor."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def _last_cut(text: str, low: int, high: int) -> int | None:
    """The last certain cut in text[low:high], both neighbours inside the text."""
    found = None
    for m in _CUT.finditer(text, max(low, 1), high):
        found = m.start()
    return found


def _first_cut(text: str, low: int, high: int) -> int | None:
    m = _CUT.search(text, max(low, 1), high)
    return m.start() if m else None


def _split_tokens(enc: tiktoken.Encoding, ids: list[int], n_bytes: int, from_end: bool) -> int | None:
    """Index of the token border that lies ``n_bytes`` from the end (or start), None if there is none."""
    seen = 0
    for k in range(len(ids) + 1):
        if seen == n_bytes:
            return len(ids) - k if from_end else k
        if seen > n_bytes or k == len(ids):
            return None
        seen += len(enc.decode_single_token_bytes(ids[-1 - k] if from_end else ids[k]))
    return None


def join(enc: tiktoken.Encoding, text: str, low: int, seam: int, high: int, left: list[int], right: list[int]) -> list[int]:
    """Encoding of text[low:high] from those of text[low:seam] and text[seam:high]."""
    width = WINDOW_CHARS
    while True:
        a, b = max(low, seam - width), min(high, seam + width)
        # a cut must lie strictly inside its side, so that the characters on both its sides belong to it
        start = low if a == low else _last_cut(text, a, seam - 1)
        stop = high if b == high else _first_cut(text, seam + 1, b - 1)
        if start is not None and stop is not None:
            break
        width *= 2
    keep = _split_tokens(enc, left, len(text[start:seam].encode()), True) if start > low else 0
    skip = _split_tokens(enc, right, len(text[seam:stop].encode()), False) if stop < high else len(right)
    if keep is None or skip is None:  # never for a certain cut; kept so that a wrong border cannot pass silently
        return enc.encode_ordinary(text[low:high])
    return left[:keep] + enc.encode_ordinary(text[start:stop]) + right[skip:]


def encode(enc: tiktoken.Encoding, text: str, leaf: int = LEAF_CHARS) -> list[int]:
    """Ids of ``text``; the tree is walked level by level, so its depth costs no recursion."""
    if len(text) <= leaf:
        return enc.encode_ordinary(text)
    parts = 1
    while len(text) > leaf * parts:
        parts *= 2
    borders = [len(text) * i // parts for i in range(parts + 1)]
    nodes = [enc.encode_ordinary(text[x:y]) for x, y in zip(borders, borders[1:])]
    while len(nodes) > 1:
        nodes = [
            join(enc, text, borders[i], borders[i + 1], borders[i + 2], nodes[i], nodes[i + 1])
            for i in range(0, len(nodes), 2)
        ]
        borders = borders[::2]
    return nodes[0]


def decode(enc: tiktoken.Encoding, ids: list[int]) -> str:
    """Text of ``ids``: token bytes joined pairwise up the tree, decoded once at the root."""
    nodes = [enc.decode_single_token_bytes(i) for i in ids] or [b""]
    while len(nodes) > 1:
        nodes = [b"".join(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0].decode("utf-8")


def token_ids(df: DataFrame, text: str, keep: list[str], tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``keep`` and ``ids`` (ARRAY<INT>): the ids of the column ``text``, without special tokens.

    Null and empty texts give an empty list, blank ones their tokens. Nothing is shuffled; ``tokenizer`` is the
    rank file's path on the driver, which sends it to the executors. Columns named as the results cannot be kept.
    """
    name = _shipped(df.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for batch in batches:
            ids = [encode(enc, t) if t else [] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(ids, pa.list_(pa.int32()))], [*keep, "ids"]
            )

    chosen = df.select(F.col(text).cast("string").alias("__text"), *keep)
    schema = T.StructType([*chosen.select(*keep).schema, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return chosen.mapInArrow(run, schema)


def token_counts(df: DataFrame, text: str, keep: list[str], tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``keep`` and ``n_tokens`` (BIGINT) of the column ``text``; 0 for null and empty texts."""
    name = _shipped(df.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for batch in batches:
            n = [len(encode(enc, t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    chosen = df.select(F.col(text).cast("string").alias("__text"), *keep)
    return chosen.mapInArrow(run, T.StructType([*chosen.select(*keep).schema, T.StructField("n_tokens", T.LongType())]))
