import random
import re

import pytest

from refweave.llm import licenses

SCHEMA = "doc_id bigint, text string, labels string"


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    hits = [(i, x) for p, x in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def notice(label, sep=" "):
    return licenses.TEMPLATES[label][0].replace(" ", sep)


def texts():
    rng = random.Random(1)
    parts = ["Under", "the", "MIT", "license", "Apache", "License,", "Version", "2.0", "2", "CC", "BY-NC", "cc by nc", "Kelvin K", "é", "İ", "\n", "--", "_", "under the mit license"]
    out = [rng.choice([" ", "-", "\t", ", "]).join(rng.choices(parts, k=rng.randrange(0, 30))) for _ in range(300)]
    out += [None, "", " .,", "cc by nc " * 30_000, "license " * 50_000, "x" * 100_000]
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    return licenses.scan(df, "doc_id", "text").collect()


def test_base_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in run(spark, rows)}
    for i, t in rows:
        assert tuple(got[i])[1:6] == brute(t), t
        assert 0 <= got[i].score <= 1 and set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(","))


def test_whole_notices_are_aligned(spark):
    rows = [(n, f"Some words first.\n{notice(x, chr(10)).upper()} and more") for n, x in enumerate(licenses.TEMPLATES)]
    got = {r.doc_id: r for r in run(spark, rows)}
    for n, label in enumerate(licenses.TEMPLATES):
        assert label in got[n].labels.split(","), label
        assert got[n].score >= licenses.ALIGNED
    # Half-finished notices, words out of order and key phrases alone are none.
    words = notice("gpl").split()
    loose = [notice("gpl")[:60], " ".join(sorted(words)) + " gnu general public license", "all rights reserved"]
    assert [r.labels for r in run(spark, list(enumerate(loose)))] == [""] * 3


def test_every_key_phrase_stands_in_its_template():
    for text, phrase in licenses.TEMPLATES.values():
        assert f" {phrase} " in f" {text} "
    with pytest.raises(ValueError):
        licenses.index({"x": ("some words", "other words")})


def test_words_put_in_or_left_out(spark):
    """One word more or less anywhere outside the key phrase, and comment signs at the begin of lines."""
    rows, want = [], []
    for label, (text, phrase) in licenses.TEMPLATES.items():
        words = text.split()
        must = licenses._phrase_places(words, phrase.split())
        for at in range(1, len(words), 3):
            if at not in must[1:]:
                rows.append(" ".join([*words[:at], "really", *words[at:]]))
                want.append(label)
            if at not in must:
                rows.append(" ".join(words[:at] + words[at + 1 :]))
                want.append(label)
        outside = [n for n in range(0, len(words), 9) if n not in must[1:]]
        rows.append(" ".join(w if n not in outside else f"rem {w}" for n, w in enumerate(words)))
        want.append(label)
    got = {r.doc_id: r.labels.split(",") for r in run(spark, list(enumerate(rows)))}
    assert all(label in got[n] for n, label in enumerate(want))


def test_other_templates(spark):
    """Hints come from the key phrases, and a template may have more than 62 rare words."""
    long = " ".join(f"word{n}" for n in range(150))
    own = {"a": (f"alpha beta gamma {long}", "alpha beta gamma"), "b": ("one two three four five six", "two three")}
    df = spark.createDataFrame([(1, f"x alpha beta gamma {long}", ""), (2, "alpha beta gamma word1", ""), (3, "one two three four five six", "")], SCHEMA)
    got = {r.doc_id: r.labels for r in licenses.scan(df, "doc_id", "text", templates=own).collect()}
    assert got == {1: "a", 2: "", 3: "b"}


def test_repeated_rows_and_null_keys(spark):
    rows = [(1, notice("bsd-3")), (1, notice("bsd-3")), (1, "other"), (None, notice("isc")), (None, None)]
    got = sorted((str(r.doc_id), r.labels) for r in run(spark, rows))
    assert got == [("1", ""), ("1", "bsd-3"), ("1", "bsd-3"), ("None", ""), ("None", "isc")]
    assert run(spark, []) == []


def test_only_jvm_operators(spark):
    df = spark.createDataFrame([(1, "x", "")], SCHEMA)
    plan = licenses.scan(df, "doc_id", "text")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
