import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from refweave.llm import bpe, tokens

PATH = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


def texts():
    rng = random.Random(1)
    noise = [chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), 10, 32])) for _ in range(9000)]
    return [
        None, "", " ", "a" * 5000, "x" * 300 + "é" * 400, " " * 700, "́e <|endoftext|> it's We'll", "日本語テキスト" * 80,
        "".join(noise), "\x1c\x85\xa0 Σας ΟΔΟΣ é", "a\tb\r\nc  d", "same", "same", "the quick fox " * 20_000,
    ]


def test_ids_equal_the_library(spark):
    ranks = bpe.vocabulary(PATH).ids
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id bigint, text string, ids int")
    encoded = {r.doc_id: r for r in bpe.encode(df, "doc_id", "text", PATH, P.PATTERN).collect()}
    digests = {r.doc_id: r for r in bpe.digests(df, "doc_id", "text", PATH, P.PATTERN).collect()}
    for i, t in rows:
        want = library.encode_ordinary(t or "")
        raw = np.array(want, "<u4").tobytes()
        assert np.frombuffer(bytes(encoded[i].ids), "<u4").tolist() == want
        assert tuple(digests[i])[1:] == (len(want), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


@pytest.mark.parametrize("piece", ["abcabcabd" * 90, "é" * 500, "aaaa" * 300])
def test_long_pieces_take_the_same_merges(piece):
    vocab = bpe.vocabulary(PATH)
    raw = piece.encode()
    in_matrix = vocab._merge([raw], np.array([len(raw)]), len(raw))[0]
    assert vocab._merge_long(raw) == in_matrix


def test_token_counts_equal_the_library(spark):
    library = Tokenizer.from_file(WORDS)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id bigint, text string, n_tokens int")
    got = {r.doc_id: tuple(r)[1:] for r in tokens.token_counts(df, "doc_id", "text", WORDS).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048)


def test_balanced_batches_keep_all():
    parts = ["a" * n for n in (1, 5, 300, 2, 2, 90)]
    found = list(tokens.balanced(parts, 100))
    assert sum(found, []) == parts
    assert all(sum(map(len, b)) <= 100 or len(b) == 1 for b in found)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.digests(df, "doc_id", "text", PATH, P.PATTERN).count() == 0
    assert tokens.token_counts(df, "doc_id", "text", WORDS).count() == 0
