"""Scores of texts under a probabilistic suffix tree over words.

Tokens are words and one end for each text. The root holds the smoothed unigram distribution of all training
tokens. Every context of one or two words that training holds at least twice is a candidate state and all its
followers are held explicitly; `suffix_states` counts and tests them all, with no machine holding the tree. With
CONTEXT or FOLLOWER above zero, a smaller tree that can be broadcast is learned instead: a context is a candidate
state if it makes up at least CONTEXT of the training tokens, and one of its followers is held explicitly if the
pair makes up at least FOLLOWER of them. The distribution of a state is its explicit counts smoothed by its parent's:

    P(w|s) = (c(s,w) + l * P(w|parent)) / (S + l),  S explicit count, l the other followers' count plus the
    number of explicit followers

A state stays if the log-likelihood it gains over its parent, its count times the divergence, exceeds GAIN
nats for each explicit follower and DIVERGENCE nats for each occurrence. A token is scored in the state of the
longest suffix that stayed. Counts of all words, rare ones included, are gathered over the whole corpus; rare
words of the scored texts are joined with them.

Defined results: null and empty texts are one end; a token that training lacks has count 0; without training
documents all unigram probabilities are 1; rows without an id are not learned from and count as held out;
repeated rows are learned from and scored each; an empty table gives no rows. Only id and text are used.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import suffix_states
from .common import cut, id_field
from .simhash import word_blocks

CONTEXT, FOLLOWER, GAIN, DIVERGENCE = 0.0, 0.0, 2.0, 0.01
#: Distinct entries and codes that a task gathers before it sends them on; longest word that can be part of a context.
HELD, CODES, LONGEST = 400_000, 4_000_000, 64
END, RARE = 1, 0


class Model:
    """Unigrams, and for depth 1 and 2 the states and their explicit followers, in sorted arrays."""

    def __init__(self, words: dict[bytes, int], counts: np.ndarray, total: int, distinct: int):
        self.words, self.counts, self.total, self.distinct = words, counts, total, distinct
        self.p0 = (counts + 0.5) / (total + 0.5 * (distinct + 1))
        self.p0[RARE] = 1.0  # a rare word's own probability is multiplied in later
        self.size = len(counts)
        none = np.zeros(0, np.int64)
        self.states, self.followers = [none, none], [(none, none), (none, none)]  # codes of states; codes and counts of (state, word)
        self.sums, self.rests = [np.zeros(0), np.zeros(0)], [np.zeros(0), np.zeros(0)]

    def ids(self, raw: bytes | None) -> tuple[np.ndarray, list[bytes]]:
        """Word numbers with the end, and the rare words."""
        parts, rare, get = [], [], self.words.get
        for words in word_blocks(raw or b""):
            own = np.array([get(w, RARE) for w in words], np.int64)
            rare += [words[i] for i in np.flatnonzero(own == RARE)]
            parts.append(own)
        return np.concatenate([*parts, np.array([END], np.int64)]), rare

    def places(self, ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, index of the state of that depth before them) where there is such a state."""
        states = self.states[depth]
        at = np.arange(depth + 1, len(ids))
        if not len(states) or not len(at):
            return at[:0], at[:0]
        code = ids[at - 1] if depth == 0 else ids[at - 2] * self.size + ids[at - 1]
        spot = np.minimum(np.searchsorted(states, code), len(states) - 1)
        known = (states[spot] == code) & (ids[at - 1] != RARE) & (ids[at - depth - 1] != RARE)
        return at[known], spot[known]

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        """Of each token in its longest state; for rare words without their own probability."""
        p = self.p0[ids]
        for depth in (0, 1):
            at, state = self.places(ids, depth)
            if not len(at):
                continue
            codes, counts = self.followers[depth]
            found = np.zeros(len(at))
            if len(codes):
                code = state * self.size + ids[at]
                spot = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                found = np.where((codes[spot] == code) & (ids[at] != RARE), counts[spot], 0)
            rest = self.rests[depth][state]
            p[at] = (found + rest * p[at]) / (self.sums[depth][state] + rest)
        return p

    def grow(self, depth: int, states: np.ndarray, totals: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> None:
        """Tests candidate states (sorted codes, occurrences) with explicit followers (sorted candidate * size + word, counts) and keeps those that diverge."""
        if not len(states) or not len(codes):
            return
        owner, word = codes // self.size, codes % self.size
        explicit = np.bincount(owner, counts, minlength=len(states))
        kinds = np.bincount(owner, minlength=len(states))
        rest = np.maximum(totals - explicit, 0) + kinds
        parent = self._parent(depth, states[owner], word)
        own = (counts + rest[owner] * parent) / (explicit[owner] + rest[owner])
        gain = np.bincount(owner, counts * np.log(own / parent), minlength=len(states))
        gain = gain + np.maximum(totals - explicit, 0) * np.log(np.where(kinds > 0, rest / np.maximum(explicit + rest, 1), 1))
        keep = (kinds > 0) & (gain > GAIN * kinds) & (gain > DIVERGENCE * totals)
        if depth == 1:
            keep &= np.isin(states % self.size, self.states[0])
        number = np.cumsum(keep) - 1
        stay = keep[owner]
        self.states[depth], self.sums[depth], self.rests[depth] = states[keep], explicit[keep], rest[keep].astype(float)
        self.followers[depth] = number[owner[stay]] * self.size + word[stay], counts[stay]

    def _parent(self, depth: int, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        p = self.p0[word]
        if depth == 1 and len(self.states[0]):
            last = state % self.size
            spot = np.minimum(np.searchsorted(self.states[0], last), len(self.states[0]) - 1)
            known = self.states[0][spot] == last
            code = spot * self.size + word
            codes, counts = self.followers[0]
            place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            found = np.where(codes[place] == code, counts[place], 0)
            rest = self.rests[0][spot]
            p = np.where(known, (found + rest * p) / (self.sums[0][spot] + rest), p)
        return p


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(True))


def vocabulary(train: DataFrame) -> DataFrame:
    """(word, c) of all training tokens from a column of texts; the end is the empty word."""

    def run(batches):
        held: Counter[bytes] = Counter()

        def send():
            yield pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
            held.clear()

        for batch in batches:
            for raw in batch.column(0):
                for words in word_blocks(raw.as_py() or b""):
                    held.update(words)
                    if len(held) > HELD:
                        yield from send()
                held[b""] += 1
        yield from send()

    return train.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _gathered(train: DataFrame, sent, codes_of, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes that all training texts hold at least `least` times, and their counts; `least` bounds their number."""

    def run(batches):
        parts, n = [], 0

        def send():
            code, count = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(count)], ["code", "n"])

        for batch in batches:
            for raw in batch.column(0):
                parts.append(codes_of(sent.value, sent.value.ids(raw.as_py())[0]))
                n += len(parts[-1])
                if n > CODES:
                    yield from send()
                    parts, n = [], 0
        yield from send()

    found = train.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    code, n = found.column("code").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(code)
    return code[order], n[order].astype(np.int64)


def _pairs(model: Model, ids: np.ndarray) -> np.ndarray:
    both = (ids[:-1] != RARE) & (ids[1:] != RARE)
    return ids[:-1][both] * model.size + ids[1:][both]


def _triples(model: Model, ids: np.ndarray) -> np.ndarray:
    at, state = model.places(ids, 1)
    own = ids[at] != RARE
    return state[own] * model.size + ids[at][own]


def fit(train: DataFrame, words: DataFrame) -> Model:
    """The tree from a column of training texts and their vocabulary()."""
    spark = train.sparkSession
    row = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = row.n or 0, row.v
    frequent = words.where((F.col("c") >= CONTEXT * total) & (F.length("word") <= LONGEST) & (F.length("word") > 0)).toArrow()
    ends = words.where(F.length("word") == 0).first()
    order = sorted(zip(frequent.column("word").to_pylist(), frequent.column("c").to_pylist(), strict=True))
    counts = np.array([0, ends.c if ends else 0, *(c for _, c in order)], np.int64)
    model = Model({w: i + 2 for i, (w, _) in enumerate(order)}, counts, total, distinct)
    if not order:
        return model
    codes, n = _gathered(train, spark.sparkContext.broadcast(model), _pairs, max(1.0, FOLLOWER * total))
    states = np.arange(2, model.size)
    model.grow(0, states, counts[2:], codes - 2 * model.size, n)
    wide = (n >= CONTEXT * total) & np.isin(codes % model.size, model.states[0])
    if wide.any():
        probe = Model(model.words, counts, total, distinct)
        probe.states[1] = codes[wide]
        triples, m = _gathered(train, spark.sparkContext.broadcast(probe), _triples, max(1.0, FOLLOWER * total))
        model.grow(1, codes[wide], n[wide], triples, m)
    return model


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learns from the documents that are not held out and scores all."""
    rows = docs.select(F.col(doc_id), held_out(doc_id).alias("held_out"), F.col(text).cast("binary").alias("raw"))
    if not (CONTEXT or FOLLOWER):
        return suffix_states.score(rows, doc_id)
    train = rows.where(~F.col("held_out")).select("raw")
    words = cut(vocabulary(train), "suffix-tree")
    model = fit(train, words)
    return scored(rows, doc_id, words, model)


def scored(rows: DataFrame, doc_id: str, words: DataFrame, model: Model) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(model)
    whole = model.total + 0.5 * (model.distinct + 1)
    key = T.StructField("row", T.LongType())
    sums = [T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("tree", T.DoubleType()), ("rare", T.ArrayType(T.BinaryType())), ("times", T.ArrayType(T.LongType())))]
    schema = T.StructType([key, id_field(rows, doc_id), T.StructField("held_out", T.BooleanType()), *sums])

    def run(batches):
        model = sent.value
        log0, known = np.log10(model.p0), np.append(model.counts > 0, False)
        for batch in batches:
            out = []
            for raw in batch.column(3):
                ids, rare = model.ids(raw.as_py())
                times = Counter(rare)
                out.append((len(ids), int(known[ids].sum()), float(log0[ids].sum()), float(np.log10(model.probabilities(ids)).sum()), list(times.keys()), list(times.values())))
            if out:
                arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *arrays], schema.names)

    first = cut(rows.select(F.monotonically_increasing_id().alias("row"), doc_id, "held_out", "raw").mapInArrow(run, schema), "suffix-tree")
    rare = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    named = rare.join(words, "word", "left").select("row", "times", F.coalesce("c", F.lit(0)).alias("c"))
    by_row = named.groupBy("row").agg(F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / whole)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("also"))
    both = first.drop("rare", "times").join(by_row, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return both.select(
        doc_id, "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("tree") + more).alias("score"),
    )
