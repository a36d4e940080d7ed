"""Quality classifier by co-training.

Two views see each document: its content (shape statistics and hashed words) and its page metadata (source, language,
length). Each view's logistic regression is fitted on labelled documents. Then, over several rounds, both views score
all unlabelled documents in one map; the share of them that a view is surest of, by quantiles over all, is labelled by
it and handed to the other view, which is fitted anew. Both views are calibrated (Platt) and combined by a last logistic
on one half of the held-back labelled documents; the other half sets the threshold. Scoring is a map over all documents.

Fitting uses bounded samples of labelled rows: at most max_labelled that came with labels, and of those that the views
have labelled at most max_guessed for each view, side and round. Both are the rows with the lowest hash of their id, so
the choice is the same at every run. Everything else covers all documents. What reaches the driver is the features of
the sampled rows (a few thousand short vectors).

Defined results: null and empty texts have the features of an empty text and are scored; rows of null doc_id are
scored, never fitted; a document labelled twice counts with its mean label, and of rows that share an id one is fitted;
with labels of one class only, or none, every document gets the rate of good labels (1 without labels), so nothing is
rejected for lack of labels; an empty table gives no rows; extra columns are ignored, and kept by keep_good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, materialise, mix, pieces, slices, word_hashes

MAX_LABELLED, MAX_GUESSED = 8000, 500
#: Hashed dimensions of words, sources and languages.
WORDS, SOURCES, LANGS = 512, 64, 16
#: Rounds of exchange, share of the unlabelled documents that a view labels in each, and the odds that they must reach.
ROUNDS, SHARE, SURE = 3, 0.1, 2.0
#: Bytes of text whose words a task hashes at once; the arrays on the way take many times as much.
HASHED = 1 << 18
#: Good documents that may fall under the threshold when it is chosen, as a share.
LOST = 0.005


def content_features(texts: pa.Array) -> np.ndarray:
    """float32 rows: nine shape statistics, then square-rooted frequencies of hashed words with their ends kept."""
    out = np.zeros((len(texts), 9 + WORDS), np.float32)
    for at, part in slices(texts, HASHED):
        n = len(part)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + n + 1]
        raw = np.frombuffer(part.buffers()[2], np.uint8)[int(offsets[0]) : int(offsets[-1])] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        total = lambda mask, o=offsets: np.diff(np.concatenate([[0], np.cumsum(mask)])[o])
        size = np.maximum(1, np.diff(offsets))
        upper, digit, newline = total((raw >= 65) & (raw <= 90)), total((raw >= 48) & (raw <= 57)), total(raw == 10)
        punct = total(((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64)) | ((raw >= 91) & (raw <= 96)) | ((raw >= 123) & (raw <= 126)))
        space, high = total(SPACE[raw]), total(raw >= 128)
        words, counts = word_hashes(part)
        doc = np.repeat(np.arange(n), counts)
        key = mix(words + np.uint64(1)) ^ mix(doc.astype(np.uint64))
        unique = np.bincount(doc[np.unique(key, return_index=True)[1]], minlength=n) if len(key) else np.zeros(n)
        rows = out[at : at + n]
        w = np.maximum(1, counts)
        for j, v in enumerate((upper / size, digit / size, newline / size, punct / size, space / size, high / size, (np.diff(offsets) - space) / w / 10, unique / w, np.log1p(counts) / 10)):
            rows[:, j] = v
        slot = (words >> np.uint64(40)).astype(np.int64) % WORDS
        rows[:, 9:] = np.sqrt(np.bincount(doc * WORDS + slot, minlength=n * WORDS).reshape(n, WORDS) / w[:, None])
    return out


def metadata_features(source: pd.Series, lang: pd.Series, chars: pd.Series) -> np.ndarray:
    """float32 rows: hashed source, hashed language, and the length by powers of two."""
    out = np.zeros((len(source), SOURCES + LANGS + 24), np.float32)
    row = np.arange(len(source))
    out[row, pd.util.hash_array(source.fillna("").astype(str).to_numpy(object)).astype(np.uint64) % SOURCES] = 1
    out[row, SOURCES + pd.util.hash_array(lang.fillna("").astype(str).to_numpy(object)).astype(np.uint64) % LANGS] = 1
    out[row, SOURCES + LANGS + np.minimum(23, np.log2(1 + chars.fillna(0).clip(lower=0).to_numpy(float)).astype(int))] = 1
    return out


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1].astype(np.float32) + np.float32(w[-1]), -30, 30)


class CoTrained:
    """Both views, their calibration and combination, and the threshold of rejection."""

    def __init__(self, content: np.ndarray, meta: np.ndarray, label: np.ndarray):
        """The first fit, on labelled documents; rows in an order that has nothing to do with their labels."""
        good = label > 0.5
        rate = float(label.mean()) if len(label) else 1.0
        self.rate, self.threshold = rate, -1.0
        self.constant = rate if len(label) < 20 or min(good.sum(), (~good).sum()) < 5 else None
        if self.constant is not None:
            return
        back = np.arange(len(label)) % 4 == 0
        self.known = [(x[~back], good[~back].astype(float), np.ones((~back).sum())) for x in (content, meta)]
        self.held = (content[back], meta[back], good[back].astype(float))
        self.weights = [_fit(*known) for known in self.known]

    def take(self, view: int, x: np.ndarray, guess: np.ndarray) -> None:
        """Documents that the other view has labelled; they count half."""
        known = self.known[view]
        self.known[view] = (np.vstack([known[0], x]), np.append(known[1], guess), np.append(known[2], np.full(len(x), 0.5)))
        self.weights[view] = _fit(*self.known[view])

    def odds(self, content: np.ndarray, meta: np.ndarray) -> list[np.ndarray]:
        return [_odds(x, w) for x, w in zip((content, meta), self.weights, strict=True)]

    def calibrate(self, lost: float = LOST) -> None:
        content, meta, y = self.held
        half = np.arange(len(y)) % 2 == 0
        odds, one = self.odds(content[half], meta[half]), np.ones(half.sum())
        self.platt = [_fit(o[:, None], y[half], one, 0.01) for o in odds]
        both = np.stack([_odds(o[:, None], c) for o, c in zip(odds, self.platt, strict=True)], axis=1)
        self.combine = _fit(both, y[half], one, 0.01)
        good = np.sort(self.score(content[~half], meta[~half])[y[~half] > 0.5])
        self.threshold = min(0.5, float(good[int(len(good) * lost)])) if len(good) else 0.5
        self.known = self.held = None

    def score(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Calibrated probability that each document is good."""
        if self.constant is not None:
            return np.full(len(content), self.constant)
        both = np.stack([_odds(o[:, None], c) for o, c in zip(self.odds(content, meta), self.platt, strict=True)], axis=1)
        return 1 / (1 + np.exp(-_odds(both, self.combine).astype(float)))


def _columns(docs: DataFrame) -> DataFrame:
    col = lambda c, kind: F.col(c).cast(kind).alias(c) if c in docs.columns else F.lit(None).cast(kind).alias(c)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), col("source", "string"), col("lang", "string"))


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow.compute as pc

    chars = pc.utf8_length(batch.column("text")).to_pandas()
    return content_features(batch.column("text")), metadata_features(batch.column("source").to_pandas(), batch.column("lang").to_pandas(), chars)


def _sampled(docs: DataFrame, chosen: DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """doc_id and label of the chosen rows (a bounded number, which is broadcast), in order of id, and both views' features."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            content, meta = _views(batch)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "x": pa.array([r.tobytes() for r in np.hstack([content, meta]).astype(np.float16)], pa.binary())})

    rows = _columns(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(features, "doc_id long, label double, x binary").toPandas()
    rows = rows.sort_values(["doc_id", "x"]).drop_duplicates("doc_id")
    width = 9 + WORDS
    x = np.array([np.frombuffer(v, np.float16) for v in rows["x"]], np.float32).reshape(len(rows), width + SOURCES + LANGS + 24)
    return rows[["doc_id", "label"]], x[:, :width], x[:, width:]


def view_odds(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, content, meta: the log-odds that each view gives each document."""
    # Tasks get the weights alone, not the rows that they were fitted on.
    weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            content, meta = (_odds(x, w) for x, w in zip(_views(batch), weights, strict=True))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "content": pa.array(content, pa.float64()), "meta": pa.array(meta, pa.float64())})

    return _columns(docs).mapInArrow(run, "doc_id long, content double, meta double")


def surest(odds: DataFrame, rate: float, share: float = SHARE, most: int = MAX_GUESSED) -> DataFrame:
    """doc_id, view (that is to learn), label: of the documents that each view is surest of, most for each side.

    A view labels share * rate of all documents good and share * (1 - rate) poor, those beyond these quantiles of its
    odds, if they also reach SURE.
    """
    cuts = [share * (1 - rate), 1 - share * rate]
    low_c, high_c, low_m, high_m = (v for c in ("content", "meta") for v in odds.agg(F.percentile_approx(c, cuts, 100_000)).first()[0])
    order, out = F.xxhash64(F.col("doc_id").cast("string")), None
    for view, (c, low, high) in ((1, ("content", low_c, high_c)), (0, ("meta", low_m, high_m))):
        for label, sure in ((1.0, F.col(c) >= max(high, SURE)), (0.0, F.col(c) <= min(low, -SURE))):
            one = odds.filter(sure).select("doc_id").orderBy(order, "doc_id").limit(most).select("doc_id", F.lit(view).alias("view"), F.lit(label).alias("label"))
            out = one if out is None else out.unionByName(one)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED, max_guessed: int = MAX_GUESSED, rounds: int = ROUNDS) -> CoTrained:
    """Fits on the bounded samples, after rounds of scoring all unlabelled documents."""
    order = F.xxhash64(F.col("doc_id").cast("string"))
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("label"))
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull())
    labelled = ids.join(known, "doc_id").dropDuplicates(["doc_id"]).orderBy(order, "doc_id").limit(max_labelled)
    rows, content, meta = _sampled(docs, labelled)
    model = CoTrained(content, meta, rows["label"].to_numpy(float))
    if model.constant is not None:
        return model
    seen: tuple[set, set] = (set(), set())
    for _ in range(rounds):
        odds = materialise(view_odds(docs, model).filter("doc_id IS NOT NULL").join(known.select("doc_id"), "doc_id", "left_anti"), "odds")
        if odds.isEmpty():
            break
        guessed = [r for r in surest(odds, model.rate, most=max_guessed).collect() if r["doc_id"] not in seen[r["view"]]]
        for view in (0, 1):
            chosen = {r["doc_id"]: r["label"] for r in guessed if r["view"] == view}
            seen[view].update(chosen)
            if chosen:
                # As an Arrow table: a list of rows would start a second set of Python workers on every executor.
                table = pa.table({"doc_id": pa.array(list(chosen), pa.int64()), "label": pa.array(list(chosen.values()), pa.float64())})
                rows, *views = _sampled(docs, docs.sparkSession.createDataFrame(table))
                model.take(view, views[view], rows["label"].to_numpy(float))
    model.calibrate()
    return model


def score_documents(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, score (probability of good), keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            score = model.score(*_views(batch))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(score, pa.float64()), "keep": pa.array(score >= model.threshold)})

    return _columns(docs).mapInArrow(run, "doc_id long, score double, keep boolean")


def keep_good(docs: DataFrame, model: CoTrained) -> DataFrame:
    """docs that the classifier keeps, whole rows, in one map."""
    from pyspark.sql.types import StructType

    fields = StructType(list(docs.schema.fields))
    views = [f for f in ("source", "lang") if f not in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            view = pa.RecordBatch.from_pydict({"text": batch.column("text").fill_null("")} | {c: batch.column(c) if c not in views else pa.nulls(len(batch), pa.string()) for c in ("source", "lang")})
            yield batch.filter(pa.array(model.score(*_views(view)) >= model.threshold))

    return docs.mapInArrow(run, fields)
