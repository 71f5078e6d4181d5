"""Token counts with the library of a tokenizer file, lengths only.

Tokens never span white space for a tokenizer that drops it, so blanks and line
ends are safe boundaries: a long text is counted as the sum over its segments.  An
Arrow batch is reduced to its distinct segments, these are packed into batches of
about equal bytes for the library, and only lengths go back to Spark.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from refweave.llm.common import Remembered, bounded_batches, text_of, tidy

_BATCH = 1 << 18  # bytes handed to the library at once


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    probe = ["a b", " a", "a ", "a\nb", "a  b"]
    apart = [sum(len(tokenizer.encode(p, add_special_tokens=False)) for p in segments(t)) for t in probe]
    if apart != [len(tokenizer.encode(t, add_special_tokens=False)) for t in probe]:
        raise ValueError(f"{path}: the tokenizer keeps white space, so texts cannot be cut at it")
    return tokenizer


def segments(text: str) -> list[str]:
    """The text cut at blanks and line ends, which the tokenizer drops."""
    return text.replace("\n", " ").split(" ")


def balanced(parts: list[str], size: int = _BATCH) -> Iterator[list[str]]:
    """Batches of at most ``size`` bytes in UTF-8; one longer part is a batch of its own."""
    batch, n = [], 0
    for part in parts:
        more = len(part) if part.isascii() else len(part.encode("utf-8", "surrogatepass"))
        if batch and n + more > size:
            yield batch
            batch, n = [], 0
        batch.append(part)
        n += more
    if batch:
        yield batch


def count_texts(texts: list[str], path: str, known: Remembered | None = None) -> list[int]:
    """Tokens of each text; ``known`` are segments from before."""
    tokenizer, known = _tokenizer(path), Remembered() if known is None else known
    cut = [segments(t) for t in texts]
    new = known.missing(set().union(*cut))
    # Sorted by length: each batch has texts of about the same size.
    for batch in balanced(sorted(new, key=len)):
        found = tokenizer.encode_batch_fast(batch, add_special_tokens=False)
        known.learn(batch, list(map(len, found)))
    return [sum(map(known.__getitem__, parts)) for parts in cut]


def token_counts(df: DataFrame, key: str, text: str, path: str, limit: int = 2048) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` per row; other columns are not carried.

    ``path`` names a tokenizer file that drops white space.  Special strings inside
    texts are handled as the library does by default, no special tokens are added.
    Null and empty texts count 0 bytes and 0 tokens; repeated rows stay repeated.
    """
    bounded_batches(df.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered()
        for batch in batches:
            counts = count_texts(batch.column(2).to_pylist(), path, known)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=[key, "n_bytes", "n_tokens"]
            )

    source = df.select(
        F.col(key), F.octet_length(text_of(text)).cast("bigint").alias("_n_bytes"), text_of(text).alias("_text")
    )
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"
    return source.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
