"""Removal of repeated passages against every window in a dictionary, and suffix arrays against sorting."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from refweave.llm import repeats
from refweave.llm.suffixes import suffix_arrays

W = repeats.WINDOW


def expected(rows):
    """``(key, n_bytes, n_removed, n_spans, kept_sha256)``; rows come in order."""
    seen, out = set(), []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - W + 1):
            if data[p : p + W] in seen:
                gone[p : p + W] = b"\1" * W
            seen.add(data[p : p + W])
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(data)))
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted((tuple(r) for r in repeats.without_repeats(df, "doc_id", "text").collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=30) | st.lists(st.integers(1, 400), max_size=30), min_size=1, max_size=8))
def test_suffix_arrays(strings):
    strings = [[*s, 0] for s in strings]
    ends = np.cumsum([len(s) for s in strings])
    found = suffix_arrays(np.concatenate(strings), ends)
    want = [end - len(s) + i for s, end in zip(strings, ends, strict=True) for i in sorted(range(len(s)), key=lambda i: s[i:])]
    assert found.tolist() == want


def test_suffix_array_of_many_equal_strings():
    strings = [[7] * 300 + [0]] * 50 + [[1, 2] * 150 + [0]] * 50
    found = suffix_arrays(np.concatenate(strings), np.cumsum([301] * 100))
    assert (found[:301] == np.arange(300, -1, -1)).all()
    assert (found[-301:] - 99 * 301).tolist() == sorted(range(301), key=lambda i: strings[-1][i:])


def _words(draw, n):
    return " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randint(2, 7))) for _ in range(n))


def test_passages(spark):
    draw = random.Random(2)
    passages = [_words(draw, n) for n in (8, 30, 60, 25)]
    rows = []
    for i in range(120):
        parts = [_words(draw, draw.randint(1, 30))] + draw.choices([*passages, _words(draw, 12), passages[2][13:170]], k=draw.randint(0, 4))
        draw.shuffle(parts)
        rows.append((i * 3, draw.choice(["", " ", "x"]).join(parts)))
    rows += [(1000 + i, rows[5][1]) for i in range(20)]
    want = expected(rows)
    draw.shuffle(rows)
    assert run(spark, rows) == want
    assert sum(w[2] for w in want) > 10_000


def test_more_contexts_than_are_compared_at_once(spark):
    """One short passage in very many texts, all around it different, some of the neighbourhoods shared."""
    draw = random.Random(4)
    common = _words(draw, 8)
    around = [_words(draw, 20) for _ in range(12)]
    rows = [(i, _words(draw, 9) + draw.choice(around)[-draw.randint(1, 60):] + common + draw.choice(around)[: draw.randint(1, 60)] + _words(draw, 9))
            for i in range(400)]
    assert run(spark, rows) == expected(rows)


def test_periodic_and_long_texts(spark):
    draw = random.Random(6)
    long = _words(draw, 60_000)
    rows = [
        (1, "ab" * 400), (2, "ba" * 90), (3, "a" * 1000), (4, "a" * 99), (5, "a" * 100), (6, long), (7, long[5:100_000] + "#" + long[90_000:]),
        (8, "ab" * 30 + "c" + "ab" * 300), (9, long[200_001:200_101]), (10, " " * 70_000),
    ]
    assert run(spark, rows) == expected(rows)


def test_odd_rows(spark):
    text = _words(random.Random(8), 60)
    # A null key is the last; null and short texts have no windows.
    rows = [(1, None), (2, ""), (3, "short"), (4, text), (5, text + "x"), (None, "y" + text)]
    assert run(spark, rows) == expected(rows)
    assert run(spark, []) == []
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as d", "2 as t", "3 as first", "4 as anchor", "5 as key")
    found = repeats.without_repeats(df, "doc_id", "text")
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected(rows)


def test_rows_that_share_a_key(spark):
    draw = random.Random(9)
    a, b = _words(draw, 50), _words(draw, 40)
    found = run(spark, [(1, a), (1, a), (1, b + a), (2, a)])
    whole = len(a.encode())
    assert found == sorted(found, key=str) and len(found) == 4
    assert found[0][:2] == found[1][:2] or found[1][:2] == found[2][:2]  # the two equal rows have equal results
    of_a = [f for f in found if f[0] == 1 and f[1] == whole]
    assert len(of_a) == 2 and of_a[0] == of_a[1]
    (of_ba,) = [f for f in found if f[0] == 1 and f[1] != whole]
    assert {of_a[0][2], of_ba[2]} == {0, whole}  # the later one loses it, in the order of a hash
    assert [f[2] for f in found if f[0] == 2] == [whole]
