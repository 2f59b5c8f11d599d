"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank file (one base64 token and its rank a line) used unless another is given.
VOCABULARY = os.environ.get("ENGRAM_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the pattern that the public byte-level vocabularies split text by.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points encoded at once, about. A longer text is encoded in parts, split before a space or line feed with a letter or
#: digit behind it. The pattern always starts a new piece there, and no token goes beyond a piece, so the parts have as many
#: tokens as the whole. A text without such a place is one part.
PART = 65_536
SPLIT = re.compile(r"[ \n](?=[^\W_])")


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("engram", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def text_parts(text: str, part: int = PART) -> Iterator[str]:
    start = 0
    while len(text) - start > part:
        found = SPLIT.search(text, start + part)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    enc = encoder(path)
    return sum(len(enc.encode_ordinary(p)) for p in text_parts(text)) if text else 0


def with_tokens(df: DataFrame, path: str = VOCABULARY, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """Replaces the text by its number of tokens (0 for null and empty texts)."""
    keep = [c for c in df.columns if c not in (text_col, name)]
    source = df.select(*keep, text_col)
    schema = source.drop(text_col).withColumn(name, F.lit(0).cast("long")).schema

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [count_tokens(t, path) if t else 0 for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(counts, pa.int64())], names=[*keep, name])

    return source.mapInArrow(step, schema)
