"""Language of a text: multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased, everything but letters becomes a space, and n-grams of one to three characters are
hashed to a fixed number of slots. Document frequencies are counted over all documents that may be learned
from. The weights are learned by follow-the-regularised-leader with an elastic-net penalty, which leaves
most of them zero, on a sample of at most about ROWS different documents in equal shares for each label. One
temperature is calibrated on predictions for documents that the predicting weights have not seen (FOLDS parts of the
sample take turns), of whole texts and of a few words out of each, with a prior of one miss and one hit, so that a
sample without an error does not make every score 1. Prediction is one pass over whole texts.

Defined results: a null text or one without a letter is `und` with score 0, as is every text when there is
nothing to learn from; of equal probabilities the first label in order wins; repeated rows are predicted
alike and learned from once; rows without an id are not learned from and count as held out; a very long text is
counted in parts, whole; a table of more than ROWS labels teaches the ROWS most frequent, since a label needs a row of
the sample; an empty table gives no rows. Columns beside those named are not looked at, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_field

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Slots of the hashed n-grams, the longest n-gram, characters that are hashed at once.
SLOTS_LOG2, LONGEST, BLOCK = 15, 3, 1 << 20
SLOTS = 1 << SLOTS_LOG2
#: Documents that weights and temperature are learned from, about, and parts that take turns in the calibration.
ROWS, FOLDS = 2000, 4
#: Words of the short text that is calibrated on beside the whole one.
SHORT = 6
#: Learning rate, its start, penalties by size and by square, passes.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.1, 4
LOW = np.array([ord(chr(c).lower()) if chr(c).isalpha() and len(chr(c).lower()) == 1 else 32 for c in range(0x3000)], np.uint32)


def counts(text: str) -> np.ndarray:
    """Occurrences in each slot."""
    total = np.zeros(SLOTS, np.int64)
    for at in range(0, len(text), BLOCK):
        part = np.frombuffer(text[max(0, at - LONGEST + 1) : at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        known = min(at, LONGEST - 1)
        code = np.where(part < len(LOW), LOW[np.minimum(part, len(LOW) - 1)], part)
        gram, slots = np.zeros(len(code), np.uint32), []
        for n in range(1, LONGEST + 1):
            gram = gram[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :] + np.uint32(n)
            new = gram[max(0, known - n + 1) :]
            slots.append(new * np.uint32(2654435761) >> np.uint32(32 - SLOTS_LOG2))
        total += np.bincount(np.concatenate(slots), minlength=SLOTS)
    return total


def _vector(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(found)
    value = (1 + np.log(found[at])) * idf[at]
    norm = np.sqrt((value**2).sum())
    return at, value / norm if norm else value


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max())
    return e / e.sum()


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], labels: int) -> np.ndarray:
    """Weights (slot, label) by per-coordinate FTRL-proximal over (slots, values, label)."""
    z, n = np.zeros((SLOTS, labels)), np.zeros((SLOTS, labels))
    weight = lambda z, n: np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, value, label = rows[i]
            own_z, own_n = z[at], n[at]
            w = weight(own_z, own_n)
            error = _softmax(value @ w)
            error[label] -= 1
            g = value[:, None] * error[None, :]
            z[at] = own_z + g - (np.sqrt(own_n + g**2) - np.sqrt(own_n)) / ALPHA * w
            n[at] = own_n + g**2
    return weight(z, n)


def temperature(logits: list[np.ndarray], truth: list[int]) -> float:
    """The temperature of the least mean log loss, by golden section over its logarithm; 1 without rows.

    The truth has the weight (n + 1) / (n + 2) that a frequency of n hits in n trials would be given, the rest is shared
    by the other labels, so there is a best temperature even if no prediction is wrong."""
    if not logits or len(logits[0]) < 2:
        return 1.0
    x, rows = np.array(logits), np.arange(len(truth))
    target = np.full(x.shape, 1 / (len(truth) + 2) / (x.shape[1] - 1))
    target[rows, truth] = (len(truth) + 1) / (len(truth) + 2)

    def loss(t: float) -> float:
        y = x / np.exp(t)
        y = y - y.max(axis=1, keepdims=True)
        return float((np.log(np.exp(y).sum(axis=1)) - (target * y).sum(axis=1)).mean())

    low, high, ratio = -5.0, 5.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def short(text: str, key: int) -> str:
    """A few words of the text, from a place that the key decides; a long text is looked at around that place only."""
    at = key % max(1, len(text) - 400)
    words = text[at : at + 400].split(" ")
    return " ".join(words[1 : SHORT + 1] if len(words) > SHORT + 1 else words[:SHORT])


class Model:
    def __init__(self, labels: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.labels, self.idf, self.weights, self.heat = labels, idf, weights, heat

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not text or not LETTER.search(text):
            return UNKNOWN, 0.0
        at, value = _vector(counts(text), self.idf)
        p = _softmax(value @ self.weights[at] / self.heat)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from rows that are not held out and have a text and a label."""
    known = docs.where(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("label"), F.xxhash64(F.col(doc_id), F.col(text).cast("string")).alias("key"), F.col(text).cast("string").alias("body")
    )
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(ROWS).collect()}
    labels = sorted(sizes)
    if not labels:
        return Model([], np.zeros(SLOTS), np.zeros((SLOTS, 0)), 1.0)

    def tally(batches):
        seen, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for body in batch.column(0).to_pylist():
                seen += counts(body) > 0
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *seen[at].tolist()], pa.int64())], ["slot", "n"])

    frequency = known.select("body").mapInArrow(tally, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(SLOTS, np.int64)
    total = 0
    for r in frequency:  # at most SLOTS + 1 rows
        if r.slot < 0:
            total = r.n
        else:
            seen[r.slot] = r.n
    idf = np.log((1 + total) / (1 + seen)) + 1

    share = max(1, ROWS // len(labels))
    chosen = F.lit(False)
    for label in labels:
        part = min(1.0, 1.2 * share / sizes[label])
        chosen = chosen | ((F.col("label") == label) & (F.pmod("key", F.lit(1 << 20)) < int(part * (1 << 20)) + 1))

    def packed(text: str) -> tuple[bytes, bytes]:
        own = counts(text)
        at = np.flatnonzero(own).astype(np.int32)
        return at.tobytes(), own[at].astype(np.int32).tobytes()

    def sample(batches):
        for batch in batches:
            for i, (key, body) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                text = body.as_py()
                both = [*packed(text), *packed(short(text, key))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *(pa.array([x], pa.binary()) for x in both)], ["label", "key", "at", "n", "short_at", "short_n"])

    def unpacked(at: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
        found = np.zeros(SLOTS, np.int64)
        found[np.frombuffer(at, np.int32)] = np.frombuffer(n, np.int32)
        return _vector(found, idf)

    rows = known.where(chosen).mapInArrow(sample, "label string, key long, at binary, n binary, short_at binary, short_n binary").dropDuplicates(["label", "key"]).collect()
    taken, train, brief = dict.fromkeys(labels, 0), [], []
    for r in sorted(rows, key=lambda r: (r.key & 0xFFFFF, r.key, r.label)):
        if taken[r.label] < share:
            taken[r.label] += 1
            train.append((*unpacked(r.at, r.n), labels.index(r.label)))
            brief.append(unpacked(r.short_at, r.short_n))
    logits, truth = [], []
    for fold in range(FOLDS if len(train) >= 2 * FOLDS else 0):
        unseen = learn([x for i, x in enumerate(train) if i % FOLDS != fold], len(labels))
        for i in range(fold, len(train), FOLDS):
            for at, value in (train[i][:2], brief[i]):
                logits.append(value @ unseen[at])
                truth.append(train[i][2])
    return Model(labels, idf, learn(train, len(labels)), temperature(logits, truth))


def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not text or not LETTER.search(text):
            return UNKNOWN, 0.0
        at, value = _vector(counts(text), self.idf)
        p = _softmax(value @ self.weights[at] / self.heat)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from rows that are not held out and have a text and a label."""
    known = docs.where(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("label"), F.xxhash64(F.col(doc_id), F.col(text).cast("string")).alias("key"), F.col(text).cast("string").alias("body")
    )
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(ROWS).collect()}
    labels = sorted(sizes)
    if not labels:
        return Model([], np.zeros(SLOTS), np.zeros((SLOTS, 0)), 1.0)

    def tally(batches):
        seen, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for body in batch.column(0).to_pylist():
                seen += counts(body) > 0
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *seen[at].tolist()], pa.int64())], ["slot", "n"])

    frequency = known.select("body").mapInArrow(tally, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(SLOTS, np.int64)
    total = 0
    for r in frequency:  # at most SLOTS + 1 rows
        if r.slot < 0:
            total = r.n
        else:
            seen[r.slot] = r.n
    idf = np.log((1 + total) / (1 + seen)) + 1

    share = max(1, ROWS // len(labels))
    chosen = F.lit(False)
    for label in labels:
        part = min(1.0, 1.2 * share / sizes[label])
        chosen = chosen | ((F.col("label") == label) & (F.pmod("key", F.lit(1 << 20)) < int(part * (1 << 20)) + 1))

    def sample(batches):
        for batch in batches:
            found, n = [], []
            for body in batch.column(2):
                own = counts(body.as_py())
                found.append(np.flatnonzero(own).astype(np.int32))
                n.append(own[found[-1]].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a in found], pa.binary()), pa.array(n, pa.binary())], ["label", "key", "at", "n"])

    rows = known.where(chosen).limit(2 * max(ROWS, len(labels))).mapInArrow(sample, "label string, key long, at binary, n binary").collect()
    taken, train, logits, truth, aside = dict.fromkeys(labels, 0), [], [], [], []
    for r in sorted(rows, key=lambda r: (r.key & 0xFFFFF, r.key, r.label)):
        if taken[r.label] < share:
            taken[r.label] += 1
            found = np.zeros(SLOTS, np.int64)
            found[np.frombuffer(r.at, np.int32)] = np.frombuffer(r.n, np.int32)
            (aside if taken[r.label] % 5 == 0 else train).append((*_vector(found, idf), labels.index(r.label)))
    weights = learn(train, len(labels))
    for at, value, label in aside:
        logits.append(value @ weights[at])
        truth.append(label)
    return Model(labels, idf, weights, temperature(logits, truth))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score); the model is SLOTS numbers for each label."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([id_field(docs, doc_id), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            if len(batch):
                label, score = zip(*map(sent.value.predict, batch.column(2).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(label, pa.string()), pa.array(score, pa.float64())], schema.names)

    return docs.select(F.col(doc_id), held_out(doc_id).alias("_held"), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, least: float = 0.35, text: str = "text") -> DataFrame:
    """docs whose language is known with a probability of at least `least`; rejects texts without letters and those that no label fits."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches):
        for batch in batches:
            found = map(sent.value.predict, batch.column(at).to_pylist())
            yield batch.filter(pa.array([label != UNKNOWN and score >= least for label, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
