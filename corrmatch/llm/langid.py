"""Language identification: sparse multinomial logistic regression.

Features are hashed character n-grams of one to three letters with TF-IDF weights.
The classifier learns by follow-the-regularised-leader (proximal) with elastic-net
penalties; a temperature fitted on rows kept apart calibrates its probabilities.

Document frequencies and label counts cover every learnable row, and every label is
learned.  Only the fit takes a sample: about ``SAMPLE`` rows in all, dealt evenly over
the labels by a hash of the row, but some ``LEAST`` rows of each label at least, so that
it grows with the labels and not with the table.  Of a label's rows one at least is
learned from.  Prediction sees the whole text and nothing else; the weights that are
not 0 are broadcast to the workers in parts of at most ``PART`` bytes.

Defined cases: a null text or one without a letter is ``und`` with score 0; a null or
empty label is never learned; a null doc_id counts as held out; a table without
learnable rows predicts ``und`` throughout, and ``accept`` then keeps each text that
has a letter; copies get equal predictions; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import copy
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, documents, per_batch, release, texts_of

DIM = 1 << 15
ORDERS = (1, 2, 3)
#: Rows of the fit, and those of a label at least, about.
SAMPLE = 6_000
LEAST = 16
#: Bytes of weights that are broadcast at a time.
PART = 64 << 20
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.0005
#: Share of the sample kept apart for the temperature.
CALIBRATE = 0.2
#: Characters of a text that are held as numbers at a time.
CHUNK = 1 << 20
UND = "und"

_LETTER = np.array([c if chr(c).isalpha() else 32 for c in range(0x300)], np.uint32)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of the lower-cased text; all but letters count as a space."""
    counts = np.zeros(DIM, np.int64)
    tail = np.array([32], np.uint32)
    for at in range(0, len(text), CHUNK):
        c = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        low = c < len(_LETTER)
        c = np.concatenate((tail, np.where(low, _LETTER[np.where(low, c, 0)], c)))
        c = np.append(c, np.uint32(32)) if at + CHUNK >= len(text) else c
        for n in ORDERS:
            # of the characters seen before, only those that a new run needs
            x = c[max(0, len(tail) - n + 1) :] if at else c
            h = np.full(max(0, len(x) - n + 1), n, np.uint32)
            for i in range(n):
                h = (h ^ x[i : i + len(h)]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            counts += np.bincount(h & np.uint32(DIM - 1), minlength=DIM)
        tail = c[-(max(ORDERS) - 1) :]
    found = np.flatnonzero(counts)
    return found, counts[found]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _fold(df: DataFrame, folds: int) -> DataFrame:
    return df.withColumn("held_out", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0)


def _document_frequencies(docs: DataFrame) -> np.ndarray:
    def rows(batch):
        df = np.zeros(DIM, np.int64)
        for t in texts_of(batch):
            df[grams(t)[0]] += 1
        found = np.flatnonzero(df)
        return {"feature": found, "df": df[found]}

    got = per_batch(docs.select("text"), rows, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(DIM)
    out[got.column("feature").to_numpy()] = got.column("df").to_numpy()
    return out


def _sample(docs: DataFrame, counts: list[tuple[str, int]]) -> list[tuple[str, np.ndarray, np.ndarray]]:
    share = max(SAMPLE / len(counts), LEAST)
    rates = docs.sparkSession.createDataFrame([(lang, min(1.0, share / n)) for lang, n in counts], "lang string, rate double")
    u = F.expr("pmod(xxhash64(doc_id, text), 1000003) / 1000003D")
    some = docs.join(F.broadcast(rates), "lang").where(u < F.col("rate"))

    def rows(batch):
        found = [grams(t) for t in texts_of(batch)]
        return {"lang": column(batch, "lang"), "features": [f.astype("<i4").tobytes() for f, _ in found], "counts": [c.astype("<i4").tobytes() for _, c in found]}

    got = per_batch(some.select("lang", "text"), rows, "lang string, features binary, counts binary").toArrow()
    got = sorted(zip(*(got.column(c).to_pylist() for c in ("lang", "features", "counts"))))
    return [(lang, np.frombuffer(f, "<i4"), np.frombuffer(c, "<i4")) for lang, f, c in got]


class Model:
    """Weights, inverse document frequencies and temperature."""

    def __init__(self, labels: list[str], idf: np.ndarray):
        self.labels, self.idf = labels, idf
        self.weights = np.zeros((len(idf), len(labels)))
        self.temperature = 1.0

    def values(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[features]
        return x / (math.sqrt(float(x @ x)) or 1.0)

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> None:
        z, n = np.zeros_like(self.weights), np.zeros_like(self.weights)
        rng = np.random.default_rng(0)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                label, f, x = rows[i]
                zf, nf = z[f], n[f]
                w = -np.sign(zf) * np.maximum(np.abs(zf) - L1, 0) / ((BETA + np.sqrt(nf)) / ALPHA + L2)
                p = _softmax(x @ w)
                p[label] -= 1
                g = x[:, None] * p
                more = nf + g * g
                z[f] = zf + g - (np.sqrt(more) - np.sqrt(nf)) / ALPHA * w
                n[f] = more
        for at in range(0, len(z), 1024):  # in place: with many labels these are large
            zf, nf = z[at : at + 1024], n[at : at + 1024]
            z[at : at + 1024] = -np.sign(zf) * np.maximum(np.abs(zf) - L1, 0) / ((BETA + np.sqrt(nf)) / ALPHA + L2)
        self.weights = z

    def calibrate(self, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """The temperature of least log loss, by golden-section search."""
        if not rows:
            return
        logits = np.array([x @ self.weights[f] for _, f, x in rows])
        truth = np.array([label for label, _, _ in rows])

        def loss(log_t: float) -> float:
            s = logits / math.exp(log_t)
            s -= s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]).mean())

        a, b, r = -1.0, 3.0, (math.sqrt(5) - 1) / 2
        for _ in range(40):
            c, d = b - r * (b - a), a + r * (b - a)
            a, b = (a, d) if loss(c) < loss(d) else (c, b)
        self.temperature = math.exp((a + b) / 2)


class _Part:
    """The weights of some labels that are not 0, by feature."""

    def __init__(self, weights: np.ndarray):
        feature, label = np.nonzero(weights)
        self.labels, self.values, self.label = weights.shape[1], weights[feature, label].astype(np.float32), label.astype(np.int32)
        self.start = np.searchsorted(feature, np.arange(len(weights) + 1))

    def logits(self, f: np.ndarray, x: np.ndarray) -> np.ndarray:
        n = self.start[f + 1] - self.start[f]
        at = np.repeat(self.start[f] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.label[at], np.repeat(x, n) * self.values[at], self.labels)


class Shared:
    """A model as the workers hold it."""

    def __init__(self, spark: SparkSession, model: Model):
        slim = copy.copy(model)
        slim.weights = None
        self.model = spark.sparkContext.broadcast(slim)
        each = max(1, PART // (8 * max(1, len(model.weights))))
        self.parts = [spark.sparkContext.broadcast(_Part(model.weights[:, at : at + each])) for at in range(0, len(model.labels), each)]

    def predict(self, text: str) -> tuple[str, float]:
        model = self.model.value
        if not model.labels or not has_letter(text):
            return UND, 0.0
        f, c = grams(text)
        x = model.values(f, c)
        p = _softmax(np.concatenate([part.value.logits(f, x) for part in self.parts]) / model.temperature)
        best = int(p.argmax())
        return model.labels[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def train(docs: DataFrame) -> Model:
    """Learn from ``text`` and ``lang`` of all rows of ``docs`` (with doc_id)."""
    known = docs.where("text is not null and length(lang) > 0").select("doc_id", "text", "lang")
    counts = [(r.lang, r.n) for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()]
    df = _document_frequencies(known)
    total = sum(n for _, n in counts)
    model = Model(sorted(lang for lang, _ in counts), (np.log((1 + total) / (1 + df)) + 1).astype(np.float32))
    if counts:
        number = {lang: i for i, lang in enumerate(model.labels)}
        rows = [(number[lang], f, model.values(f, c).astype(np.float32)) for lang, f, c in _sample(known, counts)]
        order = np.random.default_rng(1).permutation(len(rows))
        apart = int(len(rows) * CALIBRATE)
        seen = {rows[i][0] for i in order[apart:]}
        only = {*{rows[i][0]: int(i) for i in order[:apart] if rows[i][0] not in seen}.values()}  # rare labels
        model.fit([rows[i] for i in [*order[apart:], *sorted(only)]])
        model.calibrate([rows[i] for i in order[:apart] if i not in only])
        del rows
        release()
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = Shared(docs.sparkSession, model)

    def rows(batch):
        got = [shared.predict(t) for t in texts_of(batch)]
        return {"doc_id": column(batch, "doc_id"), "held_out": column(batch, "held_out"), "lang_pred": [x for x, _ in got], "score": [min(1.0, s) for _, s in got]}

    return per_batch(docs.select("doc_id", "held_out", "text"), rows, "doc_id long, held_out boolean, lang_pred string, score double")


def accept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, as they are, whose language is known with some certainty.

    Rows that are ``und`` or have a score below ``least`` go; without a model, those
    whose text has no letter.
    """
    shared, learned = Shared(docs.sparkSession, model), bool(model.labels)

    def keep(text: str) -> bool:
        if not learned:
            return has_letter(text)
        lang, score = shared.predict(text)
        return lang != UND and score >= least

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2_500):
                batch = whole.slice(at, 2_500)
                yield batch.filter(pa.array([keep(t) for t in texts_of(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learn from the rows whose fold is not 0 and predict all rows."""
    docs = _fold(docs.select("doc_id", "text", "lang"), folds)
    return predict(docs, train(docs.where("not held_out")))


def trained(docs: DataFrame, folds: int = 5) -> Model:
    """The model that ``identify`` learns."""
    return train(_fold(docs.select("doc_id", "text", "lang"), folds).where("not held_out"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir, "doc_id", "text", "lang"))
