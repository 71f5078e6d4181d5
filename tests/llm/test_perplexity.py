import collections
import math
import random
import re

from refweave.llm import perplexity as px

SCHEMA = "doc_id bigint, text string, lang string, n_words int"


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = collections.Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(inside),
    )


def discounts(counts):
    """Of n-grams seen once, twice and more, from the numbers of n-grams seen 1, 2, 3 and 4 times."""
    n = [counts.get(i, 0) for i in (1, 2, 3, 4)]
    if not (n[0] and n[1]):
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.1), i) if n[i - 1] else 0.5 for i in (1, 2, 3)]


def brute_logp(corpus, text, order):
    """Interpolated Kneser-Ney over strings, with padding, straight from the definition."""
    pad = "\0" * (order - 1)
    level = collections.Counter((pad + t)[i : i + order] for t in corpus for i in range(len(t)))
    levels = {}
    for n in range(order, 0, -1):
        levels[n] = level
        level = collections.Counter(g[1:] for g in level)
    total = 0.0
    for i in range(len(text)):
        gram, p = (pad + text)[i : i + order], 2.0**-21
        for n in range(1, order + 1):
            counts = levels[n]
            d = [0, *discounts(collections.Counter(min(c, 5) for c in counts.values()))]
            own = {g: c for g, c in counts.items() if g[:-1] == gram[order - n : -1]}
            if not own:
                continue
            t = sum(own.values())
            weight = 1 - sum(c - d[min(c, 3)] for c in own.values()) / t
            c = own.get(gram[order - n :], 0)
            p = (c - d[min(c, 3)]) / t + weight * p
        total -= math.log(p)
    return total / len(text)


def texts():
    rng = random.Random(1)
    words = ["".join(rng.choices("abdeilnorst", k=rng.randrange(2, 7))) for _ in range(80)]
    out = [" ".join(rng.choices(words, k=70)) + ".\nEé" for _ in range(60)]
    junk = "".join(rng.choices("abdeilnorst ", k=1500))  # the same letters, no words
    return out, junk


def test_base_counts_equal_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        text = "".join(rng.choices(["a", "b", "é", " ", "\n", " ", "#", "|", "\t", "😀"], k=rng.randrange(0, 80)))
        assert px.counts(text) == brute_counts(text)
    long = ("x y " * 40_000) + "\nz"
    assert px.counts(long)[4] == 80_000


def test_model_is_kneser_ney(spark):
    """For every text, whichever of its n-grams are looked up in arrays and which by the join."""
    good, junk = texts()
    corpus = [*good, junk, "z", "Zz\n", "\U0001f600\U00020000\U0001f600\uf600", "\U0002f600"]
    df = spark.createDataFrame([(i, t, "en", 0) for i, t in enumerate(corpus)], SCHEMA)
    for frequent in (1e-9, 0.001, 2.0):
        got = {r.doc_id: r.log_perplexity for r in px.rules(df, "doc_id", "text", "lang", frequent=frequent).collect()}
        for i in (0, 7, *range(len(good), len(corpus))):
            assert abs(got[i] - brute_logp(corpus, corpus[i], 3)) < 2e-9


def test_characters_beyond_16_bits_are_told_apart():
    a, b = (next(px.ngrams(t)) for t in ("\U0001f600ab", "\uf600ab"))
    assert (a >= 0).all() and not set(a.tolist()) & set(b.tolist())


def test_a_small_language_does_not_depend_on_the_others(spark):
    good, junk = texts()
    own = [(i, t, "en", 0) for i, t in enumerate([*good, junk])]
    rng = random.Random(3)
    other = [(1000 + i, "".join(rng.choices("qwxyz ", k=20_000)), "xx", 0) for i in range(20)]

    def run(rows):
        found = px.rules(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "lang", frequent=1e-3)
        return {r.doc_id: (r.log_perplexity, r.kept) for r in found.where("doc_id < 1000").collect()}

    assert run(own) == run(own + other)


def test_verdicts(spark):
    good, junk = texts()
    rows = [(i, t, "en", 0) for i, t in enumerate(good)]
    rows += [(100, junk, "en", 0), (101, None, "en", 0), (102, "", None, 0), (103, "a b c " * 60, "en", 0), (None, good[3], "en", 0)]
    rows += [(104, good[5], None, 0), (104, good[5], None, 0), (105, good[0] + "é" * 100_000, "de", 0)]
    got = px.rules(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "lang").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        if i is not None:
            assert tuple(by[i][1:6]) == brute_counts(t)
    assert all(by[i].kept for i in range(60))
    assert not any(by[i].kept for i in (100, 101, 102, 103))
    assert by[103].base_failed and not by[100].base_failed


def test_empty_table(spark):
    assert px.rules(spark.createDataFrame([], SCHEMA), "doc_id", "text", "lang").count() == 0
