"""Quality classifier by co-training of two views.

The text view sees hashed character trigrams, the page view what is known about a page
without reading it: source, language and length. Each is a logistic model. In every
round both are calibrated on labelled documents kept apart, all unlabelled documents are
scored, each view names those of each class that it is surest of in the whole corpus,
and the other view learns from them. At the end the calibrated log-odds are added, less
the prior's, and score all documents.

Only features of a bounded number of labelled and named documents meet in one task,
never their texts.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, give_back, read, stored
from .words import as_strings, blocks

#: Labelled documents that are learned from, about, by a hash limit.
LABELLED = 4000
ROUNDS = 2
#: Documents of each class that each view names in a round, and how sure it is of them.
NAMED = 100
SURE = 0.9
BUCKETS = 2048
TAGS = 64
#: Classes of length, two for each doubling.
LENGTHS = 40
KEEP_FROM = 0.5
BLOCK_BYTES = 1_000_000
BLOCK_ROWS = 1000


def text_features(texts: list[str | None], buckets: int = BUCKETS) -> np.ndarray:
    """Square roots of the shares of hashed character trigrams; rows of texts with
    under three characters are zero."""
    said = [t or "" for t in texts]
    sizes = np.fromiter(map(len, said), np.int64, len(said))
    c = np.frombuffer("".join(said).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(said) * buckets)
    if len(c) >= 3:
        doc = np.repeat(np.arange(len(said)), sizes)
        h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA6B)) ^ (c[2:] * np.uint32(0xC2B2AE35))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        h = (h ^ (h >> np.uint32(13))) & np.uint32(buckets - 1)
        inside = doc[:-2] == doc[2:]
        out = np.bincount(doc[:-2][inside] * buckets + h[inside], minlength=len(out)).astype(float)
    out = out.reshape(len(said), buckets)
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def page_features(sources: list[str | None], langs: list[str | None], n_chars: list[int | None], tags: int = TAGS) -> np.ndarray:
    """Hashed tags for source and language, and the class of the length."""
    out = np.zeros((len(sources), 1 + LENGTHS + tags), np.float32)
    for i, (source, lang, n) in enumerate(zip(sources, langs, n_chars, strict=True)):
        out[i, 0] = math.log1p(max(0, n or 0))
        out[i, 1 + min(LENGTHS - 1, int(2 * math.log2(1 + max(0, n or 0))))] = 1
        for tag in (f"s:{source}", f"l:{lang}"):
            out[i, 1 + LENGTHS + zlib.crc32(tag.encode()) % tags] = 1
    return out


@dataclass
class View:
    """Standardised logistic model with a calibrated output."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return self.slope * z + self.shift


@dataclass
class Model:
    prior: float
    views: list[View] = field(default_factory=list)

    def scores(self, *features: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        each = [v.logits(x) for v, x in zip(self.views, features, strict=False)]
        base = math.log(self.prior / (1 - self.prior))
        z = sum(each) - (len(each) - 1) * base if each else np.full(len(features[0]), base)
        return sigmoid(z), [sigmoid(x) for x in each] or [sigmoid(z), sigmoid(z)]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 200) -> np.ndarray:
    """Weights and, last, intercept, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    before = w
    v = np.ones(x.shape[1]) / math.sqrt(x.shape[1])
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    rate = 1 / (0.25 * np.linalg.norm(x @ v) ** 2 / len(x) + ridge + 1e-9)
    for k in range(steps):
        ahead = w + (k / (k + 3)) * (w - before)
        grad = x.T @ (sigmoid(x @ ahead) - y) / len(x) + ridge * np.append(ahead[:-1], 0)
        before, w = w, ahead - rate * grad
    return w


def fit_view(x: np.ndarray, y: np.ndarray, ridge: float, standard: bool) -> View:
    mean = x.mean(axis=0) if standard else np.zeros(x.shape[1])
    scale = np.maximum(x.std(axis=0), 1e-3) if standard else np.full(x.shape[1], 1 / math.sqrt(x.shape[1]))
    return View(mean, scale, logistic(((x - mean) / scale).astype(np.float64), y, ridge))


def train(features: list[np.ndarray], label: np.ndarray, calibrate: np.ndarray, named_for: np.ndarray) -> Model:
    """``features``: one matrix per view; ``label``: 1 or 0; ``calibrate``: labelled rows
    that are kept for calibration; ``named_for``: -1 for labelled rows, else the view that
    learns from the row."""
    known = named_for < 0
    prior = float(np.clip(label[known].mean(), 0.01, 0.99)) if known.any() else 0.5
    test = known & calibrate
    if len(set(label[known & ~calibrate])) < 2 or len(set(label[test])) < 2:
        return Model(prior)
    views = []
    for k, (x, ridge, standard) in enumerate(zip(features, (1e-3, 1e-2), (False, True), strict=True)):
        mine = (known & ~calibrate) | (named_for == k)
        v = fit_view(x[mine], label[mine].astype(float), ridge, standard)
        z = v.logits(x[test])
        spread = max(z.std(), 1e-6)
        w = logistic((z / spread)[:, None], label[test].astype(float), 1e-2)
        v.slope, v.shift = float(w[0] / spread), float(w[1])
        views.append(v)
    return Model(prior, views)


def _at(id_col: str, salt: str) -> Column:
    """Uniform in [0, 1) by id."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)


def is_held_out(id_col: str = "doc_id") -> Column:
    """Documents from which the classifier never learns."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


_META = ("text", "source", "lang", "n_chars")
_FEATURES = "text_view binary, page_view binary"


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with both views' features, bounded by bytes and by rows."""
    for start, end in blocks(as_strings(batch.column("text")), BLOCK_BYTES):
        for at in range(start, end, BLOCK_ROWS):
            part = batch.slice(at, min(BLOCK_ROWS, end - at))
            source, lang, n_chars = (part.column(c).to_pylist() for c in _META[1:])
            yield part, text_features(part.column("text").to_pylist()), page_features(source, lang, n_chars)


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.astype(np.float32).tobytes() for row in x], pa.binary())


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float32) for x in column.to_pylist()])


def labelled_sample(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, id_col: str = "doc_id", label_col: str = "quality") -> tuple[DataFrame, DataFrame]:
    """``at, label, named_for, text_view, page_view`` of about ``labelled`` labelled
    documents, and ``id`` of all labelled ones. Of several labels of one document the
    smallest counts; null labels are none."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    known = stored(known.where(~is_held_out("id")), "labels")
    chosen = stored(known.withColumn("at", _at("id", "labelled")).where(F.col("at") * known.count() < labelled), "chosen-labels")
    mine = docs.select(F.col(id_col).alias("id"), *_META).join(broadcast_if_small(chosen), "id").select("at", "label", *_META)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, f, g in _blocks(batch):
                none = pa.array(np.full(part.num_rows, -1, np.int32))
                yield pa.RecordBatch.from_arrays([part.column("at"), part.column("label"), none, _packed(f), _packed(g)], names=["at", "label", "named_for", "text_view", "page_view"])

    return mine.mapInArrow(run, f"at double, label int, named_for int, {_FEATURES}"), known.select("id")


def fit(sample: DataFrame) -> Model:
    """Trains in one task, on the bounded sample, and returns the model."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("named_for", "ascending"), ("at", "ascending")])
        label, named_for = (group.column(c).to_numpy() for c in ("label", "named_for"))
        calibrate = np.arange(len(label)) % 4 == 0
        model = train([_unpacked(group.column("text_view")), _unpacked(group.column("page_view"))], label, calibrate, named_for)
        give_back()
        return pa.table({"model": [pickle.dumps(model)]})

    found = sample.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else Model(0.5)


def surest(pool: DataFrame, model: Model, named: int = NAMED, sure: float = SURE) -> DataFrame:
    """``at, label, named_for, id, text_view, page_view`` of the ``named`` documents of each
    class of which each view is surest, and by ``sure`` at least, in the whole pool
    (``id`` and what the views read). Every task keeps its own best, of which the best of
    all are among; ties go by a hash of the id."""
    shared = pool.sparkSession.sparkContext.broadcast(model)
    ids = dict(pool.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            for part, f, g in _blocks(batch):
                _, each = shared.value.scores(f, g)
                tie, found = part.column("tie").to_numpy(), []
                for k, p in enumerate(each):
                    for label, q in ((1, p), (0, 1 - p)):
                        best = np.lexsort((tie, -q))[:named]
                        best = best[q[best] >= sure]
                        found.append(pa.table({"at": q[best], "tie": tie[best], "label": pa.array(np.full(len(best), label, np.int32)), "named_for": pa.array(np.full(len(best), 1 - k, np.int32)), "id": part.column("id").take(pa.array(best)), "text_view": _packed(f[best]), "page_view": _packed(g[best])}))
                kept = pa.concat_tables([kept, *found] if kept is not None else found).sort_by([("at", "descending"), ("tie", "ascending")])
                label, view = kept.column("label").to_numpy(), kept.column("named_for").to_numpy()
                kept = kept.take(np.sort(np.concatenate([np.flatnonzero((label == c) & (view == k))[:named] for c in (0, 1) for k in (0, 1)])))
        if kept is not None:
            yield from kept.combine_chunks().to_batches()
        give_back()

    best = stored(pool.withColumn("tie", F.xxhash64("id", F.lit("tie"))).mapInArrow(run, f"at double, tie long, label int, named_for int, id {ids}, {_FEATURES}"), "named")
    out = []
    for view in (0, 1):
        for label in (0, 1):
            mine = best.where((F.col("named_for") == view) & (F.col("label") == label))
            last = mine.select((-F.col("at")).alias("at"), "tie").orderBy("at", "tie").limit(named).agg(F.max(F.struct("at", "tie")).alias("m")).first()["m"]
            if last is not None:
                out.append(mine.where((-F.col("at") < last["at"]) | ((-F.col("at") == last["at"]) & (F.col("tie") <= last["tie"]))))
    return (out[0] if len(out) == 1 else reduce(DataFrame.unionByName, out)) if out else best.limit(0)


def co_train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, named: int = NAMED, id_col: str = "doc_id") -> Model:
    """The model after ``rounds`` exchanges of pseudo-labels over all unlabelled
    documents that are not held out."""
    sample, known = labelled_sample(docs, labels, labelled, id_col)
    sample = stored(sample, "classifier-sample")
    model = fit(sample)
    pool = docs.where(F.col(id_col).isNotNull() & ~is_held_out(id_col)).select(F.col(id_col).alias("id"), *_META).join(broadcast_if_small(known), "id", "left_anti")
    for _ in range(rounds if model.views else 0):
        # At most four times ``named`` documents a round.
        more = stored(surest(pool, model, named), "pseudo-labels")
        pool = pool.join(F.broadcast(more.select("id").distinct()), "id", "left_anti")
        sample = sample.unionByName(more.select(*sample.columns))
        model = fit(sample)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, text_score, page_score, score`` of every row; a null or empty text
    scores 0."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    ids = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, f, g in _blocks(batch):
                both, each = shared.value.scores(f, g)
                has = np.array([bool(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.where(has, x, 0.0)) for x in (*each, both))], names=["doc_id", "text_score", "page_score", "score"])
        give_back()

    return docs.select(F.col(id_col).alias("doc_id"), *_META).mapInArrow(run, f"doc_id {ids}, text_score double, page_score double, score double")


def classify(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, id_col: str = "doc_id", **options) -> DataFrame:
    """``doc_id, held_out, text_score, page_score, score, kept`` of every row.

    ``docs`` has ``text, source, lang, n_chars``, each of which may be null; a null
    or empty text scores 0 and is not kept. Without labels of both classes the
    share of good labels (0.5 without any) is every document's score. Repeated rows
    get equal scores. Other columns are ignored. An empty table gives no rows.
    """
    out = score(docs, co_train(docs, labels, id_col=id_col, **options), id_col)
    return out.select("doc_id", is_held_out("doc_id").alias("held_out"), "text_score", "page_score", "score", (F.col("score") >= keep_from).alias("kept"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


SQL: dict[str, str] = {}
QUERIES = {"op8_quality_classifier": op8_quality_classifier}
