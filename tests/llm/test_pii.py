import hashlib
import random
import re

import pytest

from refweave.llm import pii

SCHEMA = "doc_id bigint, text string, _t string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, x):
    digits = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def texts():
    rng = random.Random(5)
    alphabet = ["1", "0", "255", "4", ".", ".", "@", "a", "Z-", "+", " ", "-", "(", ")", "é", "😀", "x@y.z", "1.2.3.4", "4111 1111 1111 1111", "+1 (743) 555-3824"]
    out = ["".join(rng.choices(alphabet, k=rng.randrange(0, 40))) for _ in range(400)]
    out += [None, "", "a" * 60_000, "1" * 60_000, "a@b" + ".c" * 20_000, "1-" * 20_000, "+1" + " " * 30_000, "mail x@y.zz " * 3000]
    out += ["a@b.c%x@d.e", "1.2.3.4.5.6.7.8", "1.2.3.256 00001.2.3.004", "4111-1111-1111-1111", "é😀 x@y.zz", 'the token = "%s" ok' % ("0f" * 20)]
    out += ["call John Smith at 415 555 1234", "Mr. John Smith", "page 1234567", 'key: "%s"' % ("9ab4" * 10), "The Green House"] * 3
    return out


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    f = pii.find(df)
    return pii.decide(f, pii.learn(f))


def test_base_spans_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in pii.report(found(spark, rows), "doc_id").collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = brute(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(k == w[0] for w in want) for k in PATTERNS], t
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got[i].spans.startswith(text)


def test_the_method_adds_spans(spark):
    rows = list(enumerate(texts()))
    spans = {r.doc_id: r.spans for r in pii.report(found(spark, rows), "doc_id").collect()}
    by = {t: spans[i] for i, t in rows}
    assert by['the token = "%s" ok' % ("0f" * 20)] == "secret:13:53"
    assert by['key: "%s"' % ("9ab4" * 10)] == "secret:6:46"
    assert by["page 1234567"] == ""


def test_whole_secrets_are_candidates(spark):
    """However late their first digit comes, and without one if something announces them."""
    late, never = "a" * 45 + "0123456789", "QwErTyUiOpAsDfGhJkLzXcVbNm"
    rows = [(1, late), (2, f"password: {never}"), (3, never), (4, "-" * 70), (5, "x=" + "Zz9/" * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: [(c.span.kind, c.span.start, c.span.end) for c in r._candidates] for r in pii.find(df).collect()}
    assert got == {1: [("secret", 0, 55)], 2: [("secret", 10, 36)], 3: [], 4: [], 5: [("secret", 0, 20_002)]}


def test_recall_of_added_spans(spark):
    """Planted names, numbers and secrets among ordinary words, and look-alikes that are none."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abdeilnorst", k=rng.randrange(2, 9))) for _ in range(300)]
    cues = {"name": "signed by ", "number": "phone ", "secret": "token: "}
    rows, planted, clean = [], {}, set()
    for i in range(400):
        text = " ".join(rng.choices(words, k=40)) + " "
        kind = rng.choice([*cues, "none", "none"])
        value = {
            "name": f"{rng.choice(['John', 'Maria', 'Peter', 'Anna'])} {rng.choice(['Keller', 'Novak', 'Doyle'])}",
            "number": f"{rng.randrange(100, 999)}-{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}",
            "secret": "".join(rng.choices("0123456789abcdef", k=32)),
            "none": rng.choice([f"page {rng.randrange(10**7, 10**8)}", f"isbn {rng.randrange(10**9, 10**10)}"]),
        }[kind]
        begin = text + cues.get(kind, "")
        rows.append((i, f"{begin}{value} " + " ".join(rng.choices(words, k=20))))
        if kind == "none":
            clean.add(i)
        else:
            planted[i] = f"{kind}:{len(begin)}:{len(begin) + len(value)}"
    spans = {r.doc_id: r.spans.split(",") for r in pii.report(found(spark, rows), "doc_id").collect()}
    caught = [span in spans[i] for i, span in planted.items()]
    assert sum(caught) >= 0.9 * len(caught)
    assert sum(spans[i] == [""] for i in clean) >= 0.9 * len(clean)


def test_only_jvm_operators(spark):
    df = spark.createDataFrame([(1, "x@y.zz", "")], SCHEMA)
    plan = pii.report(pii.decide(pii.find(df), [0.0] * 9), "doc_id")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan.split("Physical Plan")[-1].replace("ExistingRDD", ""))


def test_redaction(spark):
    rows = [(1, "x@y.zz é +1 (743) 555-3824!"), (2, None), (3, ""), (4, "none"), (5, "a" * 600 + " 1.2.3.4"), (6, "+4111 1111 1111 1111")]
    df = found(spark, rows)
    got = {r[0]: r[1] for r in pii.redact(df).select("doc_id", "text").collect()}
    assert got == {1: "[EMAIL] é [PHONE]!", 2: None, 3: "", 4: "none", 5: "a" * 600 + " [IP]", 6: got[6]}
    assert "4111" not in got[6]


def test_reliable_labelers_are_found():
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.4
        votes = tuple(int(y if rng.random() < a else not y) for a in (0.95, 0.9, 0.85, 0.5))
        counts[votes, y] = counts.get((votes, y), 0) + 1
    patterns = sorted({v for v, _ in counts})
    p = pii.reliabilities([("k", v, sum(counts.get((v, y), 0) for y in (True, False))) for v in patterns])
    right = sum(counts.get((v, x > 0.5), 0) for v, x in zip(patterns, p))
    assert right / 4000 > 0.94


@pytest.mark.parametrize("rows", [[], [(None, None), (None, "x@y.zz"), (7, "x@y.zz"), (7, "x@y.zz")]])
def test_odd_tables(spark, rows):
    got = pii.report(found(spark, rows), "doc_id").collect()
    assert sorted((r.doc_id, r.n_email) for r in got if r.doc_id) == [(7, 1)] * (2 if rows else 0) and len(got) == len(rows)
