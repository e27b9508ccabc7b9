"""Near copies by fingerprints and by the similarity of five-word shingles.

Documents are linked if their fingerprints are (simhash.py), or if the sets of their five-word shingles have a
Jaccard similarity of at least LEAST. Candidates for the second share a key. Sets of up to LARGE shingles give their
prefixes: shingles are put in one order for the whole corpus, rare ones first, and two sets of n shingles can only be
that similar if they share one of the first n - ceil(LEAST * n) + 1, at places that leave room for the rest. This loses
no pair, and a passage that many documents share does not make candidates of them, for it stands at the end of every
order. Rareness is read from a table of SLOTS counts; it decides the number of candidates, not the result. A prefix
grows with its text, so sets of at least LEAST * LARGE shingles give BANDS bands of ROWS min-hashes each as well, and
larger ones these alone: a pair at exactly 0.8 shares one with probability 0.999997. Two similar sets are either both of
LARGE shingles at most or both of LEAST * LARGE at least, so they always meet by keys of one sort.

Of every candidate pair whose documents are not linked yet the parities of the shingles in PARITIES parts are compared
first: each parity that differs is a shingle that one of the sets lacks, and similar sets lack at most
(1 - LEAST) / (1 + LEAST) of their shingles. What is left is compared by whole sets; none is taken by estimate, and
no bucket is cut. In TURNS turns one document of each bucket, another in each turn, is compared with the others, so that
a crowd of near copies becomes few components by as many pairs as it has documents; then the most alike two documents
of each two components; then all pairs of a bucket that still lie in different components.

Defined results: texts of the same words are one text; fewer words than a shingle are one shingle; null and empty
texts, and texts without words, are linked by fingerprint zero alone; a very long text has as many keys as a long one.
Rows of one id are one document and one of them stays; rows without an id stay; an empty table stays empty. Columns
besides id and text are not looked at.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import cut, id_field
from .components import stars

#: Words of a shingle, least similarity, counts by which shingles are ordered.
WORDS, LEAST, SLOTS = 5, 0.8, 1 << 20
#: Shingles of a set that gives its prefix, min-hashes of a band, bands, shingles that are hashed at once.
LARGE, ROWS, BANDS, HASHED = 400, 5, 32, 512
PARITIES = 512
MARKS = [f"p{i}" for i in range(PARITIES // 64)]
FACTORS = np.random.default_rng(11).integers(1, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Turns in which a bucket's documents are compared with one of them; rows whose results are held at once.
TURNS, STEP = 5, 256


def shingles(raw: bytes | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the word shingles, sorted: hashes of words, summed up in their order and mixed."""
    digest = xxhash.xxh64_intdigest
    blocks = [np.array([digest(w) for w in block], np.uint64) for block in simhash.word_blocks(raw or b"")]
    own = np.concatenate(blocks) if blocks else np.zeros(0, np.uint64)
    if not len(own):
        return own
    size = min(words, len(own))
    total = np.zeros(len(own) - size + 1, np.uint64)
    for j in range(size):
        total = total * POWER + own[j : j + len(total)]
    total = (total ^ (total >> np.uint64(29))) * MIX
    return np.unique(total ^ (total >> np.uint64(32)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes."""
    least = np.full(len(FACTORS), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), HASHED):
        np.minimum(least, (FACTORS[:, None] * hashes[None, at : at + HASHED]).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], np.uint64)


def keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The keys of a set: its prefix, its bands, or both."""
    parts = [prefix(hashes, counts)] if len(hashes) <= LARGE else []
    if len(hashes) >= math.floor(LEAST * LARGE):
        parts.append(bands(hashes))
    return np.concatenate(parts)


def needed(n: int) -> int:
    """The least number of shingles that a set of n shares with one that is similar enough."""
    return math.ceil(LEAST * n - 1e-9)


def prefix(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which a similar set must share one, rare ones first."""
    if not len(hashes):
        return hashes
    rank = counts[(hashes % np.uint64(SLOTS)).astype(np.int64)]
    return hashes[np.lexsort((hashes, rank))[: len(hashes) - needed(len(hashes)) + 1]]


def parities(hashes: np.ndarray) -> list[int]:
    """PARITIES bits, in longs: whether a part of all hashes holds an odd number of these."""
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def rareness(docs: DataFrame, text: str) -> np.ndarray:
    """How often the shingles of each slot occur; SLOTS numbers, whatever the corpus. A task sends on what it saw twice."""

    def run(batches):
        seen = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                seen += np.bincount((shingles(x.as_py()) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(seen > 1)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["slot", "n"])

    found = docs.select(F.col(text).cast("binary").alias("_text")).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.uint32)
    counts[found.column("slot").to_numpy()] = np.minimum(found.column("n").to_numpy(), 2**32 - 1)
    return counts


def word_key(raw: bytes | None) -> int:
    """A hash of the words in their order, as a signed long."""
    digest = xxhash.xxh3_64()
    for block in simhash.word_blocks(raw or b""):
        digest.update(b" ".join(block) + b" ")
    return digest.intdigest() - 2**63


def signatures(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(doc_id, fp, key of the words, number of distinct shingles, keys for candidates, parities)."""
    schema = T.StructType([id_field(docs, doc_id), T.StructField("fp", T.LongType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), *(T.StructField(c, T.LongType()) for c in MARKS)])
    sent = docs.sparkSession.sparkContext.broadcast(rareness(docs, text))

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), STEP):
                part, out = batch.slice(at, STEP), []
                for x in part.column(1):
                    raw = x.as_py()
                    own = shingles(raw)
                    out.append((np.uint64(simhash.fingerprint(raw, words)).view(np.int64).item(), word_key(raw), len(own), keys(own, sent.value).view(np.int64), *parities(own)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *(pa.int64() for _ in MARKS)), strict=True))], schema.names)

    return docs.select(F.col(doc_id), F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)


def _sets(docs: DataFrame, text: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), STEP):
                raws = [x.as_py() for x in batch.column(0).slice(at, STEP)]
                yield pa.RecordBatch.from_arrays([pa.array([word_key(r) for r in raws], pa.int64()), pa.array([shingles(r).tobytes() for r in raws], pa.binary())], ["key", "own"])

    return docs.select(F.col(text).cast("binary").alias("_text")).mapInArrow(run, "key long, own binary").dropDuplicates(["key"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) of the pairs (a, b, u, v) whose sets are similar enough."""
    schema = T.StructType([T.StructField("u", pairs.schema["u"].dataType), T.StructField("v", pairs.schema["v"].dataType)])
    both = pairs.join(sets.toDF("b", "second"), "b").join(sets.toDF("a", "first"), "a").select("u", "v", "first", "second")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(common >= LEAST * (len(one) + len(two) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, schema)


def _apart(live: DataFrame) -> DataFrame:
    """The entries of buckets that hold more than one component."""
    mixed = live.groupBy("shared").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("shared")
    return cut(live.join(mixed, "shared"), "resemblance")


def labels(docs: DataFrame, doc_id: str, text: str, words: int, radius: int) -> DataFrame:
    """(doc_id, component_id) of rows with an id: the smallest id that links reach."""
    signed = cut(signatures(docs, doc_id, text, words), "resemblance")
    named = cut(simhash.labels(signed.select(doc_id, "fp"), doc_id, radius), "resemblance")
    texts = signed.where("n > 0").groupBy("key").agg(F.min(doc_id).alias("rep"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys"), *(F.first(c).alias(c) for c in MARKS))
    nodes = cut(texts.join(named.withColumnRenamed("component_id", "root"), "fp").drop("fp"), "resemblance")
    live = _apart(nodes.select("key", "root", "n", F.posexplode("keys").alias("at", "shared")))
    if live.isEmpty():
        return simhash.by_fingerprint(signed.select(doc_id, "fp"), named)
    live = cut(live.join(nodes.select("key", *MARKS), "key"), "resemblance")
    reps = live.select("key").distinct().join(nodes.select("key", "rep"), "key").select(F.col("rep").alias(doc_id)).distinct()
    sets = cut(_sets(docs.join(reps, doc_id, "left_semi"), text), "resemblance")
    # what two sets share is at most what follows the first shared shingle of their prefixes in either, itself included
    in_prefix = (F.col("at") <= F.col("n") - F.ceil(F.col("n") * LEAST - 1e-9)) & (F.col("place") <= F.col("m") - F.ceil(F.col("m") * LEAST - 1e-9))
    room = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("place")) * (1 + LEAST) + 1e-6 >= LEAST * (F.col("n") + F.col("m"))
    room = (F.greatest("n", "m") > LARGE) | (in_prefix & room)
    lacking = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"q{c}"))) for c in MARKS), F.lit(0))
    near = room & (lacking * (1 + LEAST) <= (1 - LEAST) * (F.col("n") + F.col("m")) + 1e-6) & (F.least("n", "m") >= LEAST * F.greatest("n", "m")) & (F.col("u") != F.col("v"))
    moves = []
    for turn in [*range(TURNS), TURNS, None]:
        second = live.select("shared", F.col("key").alias("b"), F.col("root").alias("v"), F.col("n").alias("m"), F.col("at").alias("place"), *(F.col(c).alias(f"q{c}") for c in MARKS))
        if turn is None or turn == TURNS:
            first = live.select("shared", F.col("key").alias("a"), F.col("root").alias("u"), "n", "at", *MARKS)
            pairs = first.join(second, "shared").where(near & (F.col("u") < F.col("v")))
            if turn is not None:  # of each two components first the two documents that differ in the fewest parities
                best = F.min_by(F.struct("a", "b"), F.struct(lacking.alias("x"), "a", "b"))
                pairs = pairs.groupBy("u", "v").agg(best.alias("x")).select("x.a", "x.b", "u", "v")
        else:
            first = live.groupBy("shared").agg(F.min_by(F.struct("key", "root", "n", "at", *MARKS), F.xxhash64("key", F.lit(turn))).alias("x")).select("shared", F.col("x.key").alias("a"), F.col("x.root").alias("u"), F.col("x.n").alias("n"), F.col("x.at").alias("at"), *(F.col(f"x.{c}").alias(c) for c in MARKS))
            pairs = second.join(first, "shared").where(near)
        star = stars(_similar(pairs.select("a", "b", "u", "v").distinct(), sets), "resemblance")
        if star.isEmpty():
            continue
        moves.append(star)
        if turn is not None:
            moved = star.toDF("old", "new")
            live = _apart(live.join(moved, F.col("root") == F.col("old"), "left").select("key", F.coalesce("new", "root").alias("root"), "n", "at", "shared", *MARKS))
    if moves:  # a root that moves in one turn can be moved on in a later one
        moved = stars(functools.reduce(DataFrame.unionByName, moves), "resemblance").toDF("old", "new")
        named = cut(named.join(moved, F.col("component_id") == F.col("old"), "left").select("fp", F.coalesce("new", "component_id").alias("component_id")), "resemblance")
    return simhash.by_fingerprint(signed.select(doc_id, "fp"), named)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """docs with the row of the smallest id of each component."""
    return simhash.kept(docs, cut(labels(docs.where(F.col(doc_id).isNotNull()), doc_id, text, words, radius), "resemblance"), doc_id)
