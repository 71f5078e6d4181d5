"""Quality rules with an n-gram language model: perplexity bands per language.

Spark counts the character n-grams of all texts; lower orders of the Kneser-Ney
model take continuation counts, which are group sizes of the order above, and the
three discounts of each order come from counts of counts.  The model is a table of all n-grams of the
highest order with their log-probabilities.

Texts are scored by looking up all their n-grams.  Frequent ones, those with at least the share ``FREQUENT`` of all
characters, are at most ``1 / FREQUENT`` however large the corpus is; every task has them as sorted arrays of 63-bit keys per
language, searched by bisection.  The others are added up per text and joined with the table.  So where an n-gram is
looked up depends on the size of the corpus, what it counts does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from refweave.llm.common import bounded_batches, text_of, tidy, written
from refweave.operators.joins import join_unique

ORDER = 3
CHAR_BITS = 21  # a code point; three fit into a key
FREQUENT = 2.0**-22
WIDTH = 7.0  # half a band, in median absolute deviations
LEAST_WIDTH = 0.05  # and at least so many nats
_CHARS = 1 << 20  # counted or scored at a time
_CELLS = 10_000  # to a nat, in which medians are found
_HELD = 1 << 20  # counts a task holds before it passes them on
_BLANKS, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


def ngrams(text: str, order: int = ORDER) -> Iterator[np.ndarray]:
    """Keys of all n-grams, one per character: the text begins after ``order - 1`` zeros."""
    if order * CHAR_BITS > 63:
        raise ValueError("a key has room for three characters")
    for start in range(0, len(text), _CHARS):
        part = text[max(0, start - order + 1) : start + _CHARS]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        if start == 0:
            codes = np.concatenate([np.zeros(order - 1, np.int64), codes])
        n = len(codes) - order + 1
        keys = codes[order - 1 :].copy()
        for back in range(1, order):
            keys |= codes[order - 1 - back : order - 1 - back + n] << (CHAR_BITS * back)
        yield keys


def count_ngrams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``(lang, key, n)`` over all ``docs(lang, text)``; tasks pass on sums, Spark adds them up."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts):
            keys = np.concatenate([k for k, _ in parts])
            found, place = np.unique(keys, return_inverse=True)
            return found, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)

        def release():
            for lang, parts in held.items():
                keys, n = merged(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "key", "n"]
                )
            held.clear()

        for batch in batches:
            texts: dict[str | None, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for keys in ngrams(text, order):
                    texts.setdefault(lang, []).append(keys)
            for lang, arrays in texts.items():
                keys, n = np.unique(np.concatenate(arrays), return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((keys, n))
                if len(parts) > 8:
                    parts[:] = [merged(parts)]
            size = sum(len(k) for parts in held.values() for k, _ in parts)
            if size > _HELD:
                yield from release()
        yield from release()

    return docs.mapInArrow(run, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> DataFrame:
    """``(lang, d1, d2, d3)``: what n-grams seen once, twice and more give to the lower order."""
    seen = counts.groupBy("lang").agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    out = {}
    for i in (1, 2, 3):
        own, above = F.col(f"n{i}"), F.col(f"n{i + 1}")
        found = F.least(F.greatest(i - (i + 1) * y * above / own, F.lit(0.1)), F.lit(float(i)))
        out[f"d{i}"] = F.when((F.col("n1") > 0) & (F.col("n2") > 0) & (own > 0), found).otherwise(0.5)
    return seen.withColumns(out).select("lang", "d1", "d2", "d3")


def model(ngrams: DataFrame, order: int = ORDER) -> DataFrame:
    """``(lang, key, n, logp)``: log-probability of the last character of each n-gram of ``ngrams(lang, key, n)``."""
    levels = [ngrams]
    for n in range(order - 1, 0, -1):
        lower = F.expr(f"key & {(1 << CHAR_BITS * n) - 1}L").alias("key")
        levels.insert(0, written(levels[0].groupBy("lang", lower).agg(F.count("*").alias("n")), "ngrams"))
    known = None
    for n, level in enumerate(levels, 1):
        rows = join_unique(level, _discounts(level), ["lang"])
        taken = F.least(F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")), F.col("n"))
        rows = rows.select("lang", "key", "n", taken.alias("taken"), F.expr(f"shiftright(key, {CHAR_BITS})").alias("context"))
        contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("taken").alias("given"))
        rows = join_unique(rows, contexts, ["lang", "context"])
        if known is None:
            rows = rows.withColumn("lower", F.lit(2.0**-CHAR_BITS))
        else:
            rows = rows.withColumn("_key", F.expr(f"key & {(1 << CHAR_BITS * (n - 1)) - 1}L"))
            rows = join_unique(rows, known.select("lang", F.col("key").alias("_key"), F.col("p").alias("lower")), ["lang", "_key"])
        p = (F.col("n") - F.col("taken") + F.greatest("given", F.lit(1e-6)) * F.col("lower")) / F.col("total")
        known = written(rows.select("lang", "key", "n", p.alias("p")), "model")
    return known.select("lang", "key", "n", F.ln("p").alias("logp"))


class Arrays:
    """Sorted keys of frequent n-grams per language, with their log-probabilities."""

    def __init__(self, table: pa.Table):
        self.of: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        langs = np.asarray(table.column("lang").to_pylist(), object)
        keys, logp = table.column("key").to_numpy(), table.column("logp").to_numpy()
        for lang in set(langs):
            own = np.flatnonzero(langs == lang)
            own = own[np.argsort(keys[own])]
            self.of[lang] = keys[own], logp[own]

    def score(self, lang: str, text: str, order: int) -> tuple[float, np.ndarray, np.ndarray]:
        """Sum over the n-grams that are here, and the others with their numbers."""
        total, rest = 0.0, [np.zeros(0, np.int64)]
        own, logp = self.of.get(lang, (rest[0], np.zeros(0)))
        for keys in ngrams(text, order):
            found = np.zeros(len(keys), bool)
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                found = own[at] == keys
                total += float(logp[at[found]].sum())
            rest.append(keys[~found])
        return total, *np.unique(np.concatenate(rest), return_counts=True)


def _middle(values: DataFrame, name: str) -> DataFrame:
    """``(lang, name)``: the median of ``values(lang, x)``, to one of ``_CELLS`` to a nat.

    Values are counted by cell, and there are few of these for a language at any number of values.
    """
    cells = values.groupBy("lang", F.round(F.col("x") * _CELLS).cast("bigint").alias("cell")).agg(F.count("*").alias("n"))
    same = Window.partitionBy("lang")
    below = F.sum("n").over(same.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    found = cells.withColumns({"below": below, "all": F.sum("n").over(same)}).where(2 * F.col("below") >= F.col("all"))
    return found.groupBy("lang").agg((F.min("cell") / _CELLS).alias(name))


def counts(text: str) -> tuple[int, int, int, int, int]:
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)`` of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(text.count(c) for c in _BLANKS)
    symbols = sum(text.count(c) for c in _SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words in windows of three that the text has at least twice."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    pairs = ids[:-2] * len(known) + ids[1:-1]
    if len(known) > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs * len(known) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = np.diff(windows[order]) == 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift : len(windows) + shift] |= twice
    return int(inside.sum())


def rules(
    df: DataFrame, key: str, text: str, lang: str, order: int = ORDER, frequent: float = FREQUENT, width: float = WIDTH
) -> DataFrame:
    """Base counts, perplexity and verdict per row.

    ``(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_perplexity,
    low, high, kept)``.  The band of a language is its median log-perplexity (nats per character) plus and minus ``width``
    median absolute deviations; copies, which have the same perplexity, count once for it.
    A null or empty text has no words and fails; a null language is one of its own.  Repeated
    rows stay repeated; other columns are not carried.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    # Names of languages begin with a sign, so that null has one as well.
    name = F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit("")).alias("lang")
    grams = written(count_ngrams(df.select(name, text_of(text).alias("text")), order), "ngrams")
    table = written(model(grams, order), "model")
    total = grams.agg(F.sum("n")).first()[0] or 0
    shared = spark.sparkContext.broadcast(Arrays(table.where(F.col("n") >= frequent * total).drop("n").toArrow()))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = shared.value
        for batch in batches:
            texts, langs = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            found = list(zip(*map(counts, texts), strict=True)) or [()] * 5
            sums, keys, numbers = zip(*(arrays.score(x, t, order) for x, t in zip(langs, texts, strict=True)), strict=True) if texts else [()] * 3
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(c, pa.int64()) for c in found), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(sums, pa.float64()), pa.array(keys, longs), pa.array(numbers, longs)],
                names=["_row", "_key", "lang", *names, "_chars", "_sum", "_keys", "_numbers"],
            )

    source = df.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), name, text_of(text).alias("_text"))
    schema = ", ".join(
        ["_row bigint", f"_key {df.schema[key].dataType.simpleString()}", "lang string", *(f"{c} bigint" for c in names),
         "_chars bigint, _sum double, _keys array<bigint>, _numbers array<bigint>"]
    )
    begun = written(source.mapInArrow(run, schema), "begun")
    rest = begun.select("_row", "lang", F.explode(F.arrays_zip(F.col("_keys").alias("key"), F.col("_numbers").alias("k"))).alias("z"))
    rest = join_unique(rest.select("_row", "lang", "z.key", "z.k"), table.select("lang", "key", "logp"), ["lang", "key"])
    rest = rest.groupBy("_row").agg(F.sum(F.col("k") * F.col("logp")).alias("_rest"))
    # Rounded, as sums may be taken in any order.
    score = F.when(F.col("_chars") > 0, F.round(-(F.col("_sum") + F.coalesce("_rest", F.lit(0.0))) / F.col("_chars"), 9))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = join_unique(begun.drop("_keys", "_numbers"), rest, ["_row"], "left").withColumn("log_perplexity", score)
    scored = written(scored.select("_key", "lang", *names, "log_perplexity").withColumn("base_failed", failed), "scored")

    usable = scored.where(~F.col("base_failed")).select("lang", F.col("log_perplexity").alias("x")).distinct()
    middle = _middle(usable, "middle")
    apart = join_unique(usable, middle, ["lang"]).select("lang", F.abs(F.col("x") - F.col("middle")).alias("x"))
    half = F.greatest(width * F.col("mad"), F.lit(LEAST_WIDTH))
    bands = middle.join(_middle(apart, "mad"), "lang").select(
        "lang", (F.col("middle") - half).alias("low"), (F.col("middle") + half).alias("high")
    )
    inside: Column = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    return (
        join_unique(scored, bands, ["lang"], "left")
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
        .select(F.col("_key").alias(key), *names, "base_failed", "log_perplexity", "low", "high", "kept")
    )
