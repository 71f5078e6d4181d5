"""Quality classifier by co-training.

Two logistic regressions see different sides of a document: the text view its
hashed character trigrams, the page view its metadata and layout.  Both begin with
the labelled sample.  In each round each one scores all unlabelled documents, and labels those it is most confident of for the
other to learn from: ``EXCHANGED`` per round and view, dealt to languages and sources by their share of documents.
Scores of held-out labelled rows calibrate the views, whose log-odds are then averaged for all documents.

Fitted on bounded samples: ``LABELLED`` labelled rows with the smallest hash of their key, and what is exchanged.
Everything else is over all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from refweave.llm.common import bounded_batches, text_of, tidy, written

LABELLED = 6000  # rows
ROUNDS, EXCHANGED = 3, 300  # documents per round and view
HELD_OUT = 0.25
LOST = 0.005  # share of held-out good documents that the threshold may reject
ADDED = ["text_score", "page_score", "score", "kept"]
_TRIGRAMS, _NAMES = 1024, 32
_CHARS = 1 << 20
_ROWS = 512  # that a step of the fit turns to double precision at a time


def text_view(text: str) -> np.ndarray:
    """Square roots of the shares of hashed character trigrams."""
    counts = np.zeros(_TRIGRAMS)
    for start in range(0, len(text), _CHARS):
        part = text[max(0, start - 2) : start + _CHARS]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
        if len(codes) > 2:
            hashed = (codes[:-2] * np.uint32(0x9E3779B1)) ^ (codes[1:-1] * np.uint32(0x85EBCA6B)) ^ (codes[2:] * np.uint32(0xC2B2AE35))
            counts += np.bincount((hashed * np.uint32(0x27D4EB2F)) >> np.uint32(22), minlength=_TRIGRAMS)
    return np.sqrt(counts / max(1.0, counts.sum()))


def page_view(text: str, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Metadata (language and source, hashed; size) and layout of the page."""
    words, lines = text.split(), text.split("\n")
    n, length = max(1, len(words)), max(1, len(text))
    out = np.zeros(2 * _NAMES + 12)
    out[zlib.crc32(repr(lang).encode()) % _NAMES] = 1
    out[_NAMES + zlib.crc32(repr(source).encode()) % _NAMES] = 1
    shares = [sum(text.count(c) for c in some) / length for some in ("#*$%&", "|<>", "!?", ".,;:", "0123456789")]
    out[2 * _NAMES :] = [
        np.log1p(len(text) if n_chars is None else n_chars), np.log1p(len(lines)), np.log1p(length / len(lines)),
        1 - len(set(lines)) / len(lines), len(set(words)) / n, sum(map(str.isupper, words)) / n,
        length / n / 10, *(np.sqrt(x) for x in shares),
    ]
    return out


@dataclass
class View:
    """Logistic regression on standardised features, with a calibration of its log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.shift, -30, 30)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(x: np.ndarray, y: np.ndarray, sample: np.ndarray, penalty: float, steps: int) -> np.ndarray:
    """Weighted logistic regression by accelerated gradient descent; the last weight is the constant.

    Double precision takes ``_ROWS`` rows at a time, so that beside ``x`` next to nothing is held.
    """
    sample = sample / sample.sum()
    blocks = [slice(n, n + _ROWS) for n in range(0, len(x), _ROWS)]
    size = 0.0
    for b in blocks:
        part = np.column_stack([x[b], np.ones(len(x[b]), x.dtype)])
        size += float((sample[b] * (part * part).sum(axis=1)).sum())
    rate = 4.0 / max(1e-9, size)
    w = before = np.zeros(x.shape[1] + 1)
    part = np.ones((min(len(x), _ROWS), len(w)))
    for step in range(steps):
        ahead = w + step / (step + 3) * (w - before)
        slope = penalty * np.append(ahead[:-1], 0)
        for b in blocks:
            some = part[: len(y[b])]
            some[:, :-1] = x[b]
            slope += some.T @ (sample[b] * (_sigmoid(some @ ahead) - y[b]))
        before, w = w, ahead - rate * slope
    return w


def fit(x: np.ndarray, y: np.ndarray, sample: np.ndarray | None = None) -> View:
    """Both classes weigh the same."""
    sample = np.ones(len(y)) if sample is None else sample
    sample = np.where(y == 1, sample / max(1e-9, sample[y == 1].sum()), sample / max(1e-9, sample[y == 0].sum()))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = x - mean
    x /= scale
    return View(mean, scale, _descend(x, y, sample, 1e-3, 150))


@dataclass
class Classifier:
    text: View
    page: View
    threshold: float

    def scores(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        """Columns: text view, page view, both combined."""
        a, b = self.text.logit(text), self.page.logit(page)
        return np.column_stack([_sigmoid(a), _sigmoid(b), _sigmoid((a + b) / 2)])


#: From the views' models, and which documents each view was told about, to new ones for each view: names, features, labels.
Exchange = Callable[[list[View], list[set]], list[tuple[list, np.ndarray, np.ndarray]]]


def cotrain(
    text: np.ndarray, page: np.ndarray, y: np.ndarray, exchange: Exchange | None = None,
    rounds: int = ROUNDS, lost: float = LOST, seed: int = 0,
) -> Classifier | None:
    """None if the held-in or held-out labels are all of one class."""
    held = np.random.default_rng(seed).random(len(y)) < HELD_OUT
    if min(len(set(y[held])), len(set(y[~held]))) < 2:
        return None
    views = [text, page]
    known: list[set] = [set(), set()]
    told = [(v[:0], y[:0]) for v in views]
    models = [fit(v[~held], y[~held]) for v in views]
    for _ in range(rounds if exchange else 0):
        for i, (names, x, labels) in enumerate(exchange(models, known)):
            known[i] |= set(names)
            told[i] = np.concatenate([told[i][0], x]), np.concatenate([told[i][1], labels])
        for i, (x, labels) in enumerate(told):
            # A pseudo-label counts half.
            sample = np.concatenate([np.ones((~held).sum()), np.full(len(labels), 0.5)])
            models[i] = fit(np.concatenate([views[i][~held], x]), np.concatenate([y[~held], labels]), sample)
    for model, view in zip(models, views, strict=True):
        z, target = model.raw(view[held])[:, None], y[held]
        size = max(1e-6, float(np.abs(z).mean()))
        slope, shift = _descend(z / size, target, np.ones(len(target)), 1e-4, 500)
        model.slope, model.shift = max(0.0, slope / size), shift
    model = Classifier(*models, 0.5)
    combined = model.scores(text[held], page[held])[y[held] == 1, 2]
    model.threshold = float(min(0.5, np.quantile(combined, lost)))
    return model


_FIELDS = ["_text", "_lang", "_source", "_n_chars"]


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both views of rows with ``_FIELDS``."""
    rows = list(zip(*(batch.column(c).to_pylist() for c in _FIELDS), strict=True))
    text = np.array([text_view(r[0]) for r in rows], np.float32).reshape(-1, _TRIGRAMS)
    return text, np.array([page_view(*r) for r in rows], np.float32).reshape(-1, 2 * _NAMES + 12)


def _features(docs: DataFrame, wanted: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """Both views of the documents with the ``_id`` of ``wanted``, on the driver: a bounded number of rows of some 4 KB.

    Equal documents have the same ``_id`` and are one row, however many there are.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate(_views(batch), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["_id", "x"]
            )

    found = docs.join(F.broadcast(wanted.select("_id")), "_id", "left_semi").select("_id", *_FIELDS)
    found = found.mapInArrow(run, "_id bigint, x binary").dropDuplicates(["_id"]).toArrow()
    ids = found.column("_id").to_numpy()
    order = np.argsort(ids)
    place = np.empty(len(ids), int)
    place[order] = np.arange(len(ids))
    x, at = np.empty((len(ids), _TRIGRAMS + 2 * _NAMES + 12), "<f4"), 0
    for chunk in found.column("x").chunks:  # row by row: the driver holds the features once, besides what came in
        for n, row in enumerate(chunk, at):
            x[place[n]] = np.frombuffer(row.as_buffer(), "<f4")
        at += len(chunk)
    return ids[order].tolist(), x[:, :_TRIGRAMS], x[:, _TRIGRAMS:]


def _most_confident(scores: DataFrame, z: str, told: list, good: float, number: int) -> DataFrame:
    """``(_id, y)``: the documents of ``scores`` that a view is surest of, dealt to languages and sources by their share.

    A stratum gives up to its share of the number, at least one; of these the first ones of all strata come first.
    """
    spark = scores.sparkSession
    before = spark.createDataFrame([(n,) for n in told], "_id bigint")  # bounded: rounds times number
    rows = scores.join(F.broadcast(before), "_id", "left_anti").select("_id", "_lang", "_source", F.col(z).alias("z"))
    total = scores.count()
    out = None
    for label, some, sure in ((1.0, round(number * good), F.col("z")), (0.0, number - round(number * good), -F.col("z"))):
        size = scores.groupBy("_lang", "_source").agg(F.ceil(F.count("*") * some / max(1, total)).alias("quota"))
        order: list[Column] = [sure.desc(), F.col("_id").asc()]
        rank = F.row_number().over(Window.partitionBy("_lang", "_source").orderBy(*order))
        first = rows.where(sure > 0).withColumn("rank", rank).where(F.col("rank") <= max(1, some))
        same = F.col("a._lang").eqNullSafe(F.col("b._lang")) & F.col("a._source").eqNullSafe(F.col("b._source"))
        first = first.alias("a").join(size.alias("b"), same).select("a._id", "a.rank", "a.z", "b.quota")
        first = first.where("rank <= quota").orderBy(F.ceil(F.col("rank") / F.col("quota")), *order).limit(some)
        found = first.select("_id", F.lit(label).alias("y"))
        out = found if out is None else out.unionByName(found)
    return out


def train(
    docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str, source: str, n_chars: str,
    target: str = "quality", labelled: int = LABELLED, exchanged: int = EXCHANGED, rounds: int = ROUNDS,
) -> Classifier | None:
    """Null labels count as none; of several labels of a document the mean is rounded, half to good.

    Of rows that share a labelled key the one with the smallest hash of its contents is taken.
    """
    known = (
        labels.where(F.col(target).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key")).agg((F.avg(target) >= 0.5).cast("double").alias("_y"))
    )
    named = [text_of(text).alias("_text"), F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.col(n_chars).alias("_n_chars")]
    docs = docs.select(F.xxhash64(key, text, lang, source, n_chars).alias("_id"), F.col(key).alias("_key"), *named)
    ids = docs.select("_id", "_key")
    some = ids.join(known, "_key").groupBy("_key").agg(F.min("_id").alias("_id"), F.min("_y").alias("_y"))
    some = some.orderBy(F.xxhash64("_key"), "_key").limit(labelled).toPandas().drop_duplicates("_id")
    if some["_y"].nunique() < 2:
        return None
    spark = docs.sparkSession
    ids_, text_x, page_x = _features(docs, spark.createDataFrame(some[["_id"]]))
    y = some.set_index("_id").loc[ids_, "_y"].to_numpy()
    good = float(y.mean())

    def exchange(models: list[View], told: list[set]) -> list[tuple[list, np.ndarray, np.ndarray]]:
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = [pa.array(m.raw(x).astype(float)) for m, x in zip(models, _views(batch), strict=True)]
                own = [batch.column(c) for c in ("_id", "_key", "_lang", "_source")]
                yield pa.RecordBatch.from_arrays([*own, *raw], names=["_id", "_key", "_lang", "_source", "z0", "z1"])

        kept = docs.select("_id", "_key", "_lang", "_source", "_text", "_n_chars")
        schema = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in kept.columns[:4]) + ", z0 double, z1 double"
        scores = kept.mapInArrow(run, schema)
        # Copies count once; documents with a label teach by that.
        scores = scores.join(known, "_key", "left_anti").dropDuplicates(["_id"])
        scores = written(scores, "scores")
        out = []
        for view, z in ((0, "z1"), (1, "z0")):
            picked = _most_confident(scores, z, sorted(told[view]), good, exchanged).toPandas()
            found, *x = _features(docs, spark.createDataFrame(picked[["_id"]], "_id bigint"))
            out.append((found, x[view], picked.set_index("_id").loc[found, "y"].to_numpy()))
        return out

    return cotrain(text_x, page_x, y, exchange, rounds)


def classify(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    source: str = "source", n_chars: str = "n_chars", target: str = "quality",
) -> DataFrame:
    """``docs`` with ``text_score``, ``page_score``, ``score`` (0 to 1) and ``kept`` for every row.

    Columns of these names are replaced, all others stay.  A null text is empty; null
    metadata is a value of its own.  If labels are missing or all of one kind, nothing
    is known: scores are 0.5 and all is kept.
    """
    bounded_batches(docs.sparkSession)
    model = train(docs, labels, key, text, lang, source, n_chars, target)
    names = ADDED
    kept = [c for c in docs.columns if c not in names]
    if model is None:
        return docs.select(*kept, *(F.lit(0.5).alias(c) for c in names[:3]), F.lit(True).alias("kept"))
    at = [kept.index(c) for c in (text, lang, source, n_chars)]
    schema = docs.select(*kept).schema
    for c, t in zip(names, ["double", "double", "double", "boolean"], strict=True):
        schema = schema.add(c, t)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t or "", *rest) for t, *rest in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            scores = model.scores(
                np.array([text_view(r[0]) for r in rows]).reshape(-1, _TRIGRAMS),
                np.array([page_view(*r) for r in rows]).reshape(-1, 2 * _NAMES + 12),
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(scores[:, i]) for i in range(3)), pa.array(scores[:, 2] >= model.threshold)],
                names=[*kept, *names],
            )

    return docs.select(*kept).mapInArrow(run, schema)
