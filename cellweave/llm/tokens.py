"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
import sys
import types
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabulary files; a parameter, as they are no part of the repository.
FOLDER = os.environ.get("CELLWEAVE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Splits text into the pieces that are encoded one by one. Fixed by the vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for pure ASCII, in the syntax of the faster standard module.
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Entries a worker's memory of counted words may have, and the longest word remembered.
MEMORY, LONGEST = 1 << 19, 80


class Counter(dict):
    """Words, each with the white space before it, and their numbers of tokens.

    A piece never goes on from a character into white space that follows it, so the sizes of the
    words add up to that of the text. Words and pieces met before are looked up.
    """

    def __init__(self, vocabulary: bytes):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        self.encode = tiktoken.Encoding("public", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.any, self.ascii, self.word = regex.compile(PIECES), re.compile(ASCII_PIECES), re.compile(r"\s*\S+|\s+")
        self.pieces: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        n, pieces = 0, self.pieces
        if len(word) > LONGEST:
            return len(self.encode(word))
        for piece in (self.ascii if word.isascii() else self.any).findall(word):
            k = pieces.get(piece)
            if k is None:
                if len(pieces) >= MEMORY:
                    pieces.clear()
                k = pieces[piece] = len(self.encode(piece))
            n += k
        if len(self) >= MEMORY:
            self.clear()
        self[word] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.word.findall(text)))


def counter(vocabulary: bytes) -> Counter:
    """The counter of this Python worker; it outlives the task."""
    kept = sys.modules.setdefault("_cellweave_kept", types.ModuleType("_cellweave_kept"))
    key = hash(vocabulary)
    if getattr(kept, "key", None) != key:
        kept.key, kept.counter = key, Counter(vocabulary)
    return kept.counter


def token_counts(df: DataFrame, keep: Sequence[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(keep..., n_tokens, n_text_chars): sizes of each row's text, in its scan's partitions.

    A null text has 0 tokens and a null n_text_chars, an empty one 0 and 0. ``vocabulary`` is the
    path of a tiktoken file on the driver; its content (under 1 MB) is sent to the executors.
    """
    with open(vocabulary or f"{FOLDER}/{VOCABULARY}", "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(content.value)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            n = pa.array([0 if t is None else c.count(t) for t in (x.as_py() for x in texts)], pa.int64())
            chars = pa.compute.utf8_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n, chars], names=[*b.schema.names[:-1], "n_tokens", "n_text_chars"])

    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("n_text_chars", T.LongType())])
    return rows.mapInArrow(sizes, schema)
