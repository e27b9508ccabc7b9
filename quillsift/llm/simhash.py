"""Near copies by 64-bit SimHash, linked through vantage-point trees.

Distinct fingerprints are dealt to shards by a vantage-point tree whose nodes hold a vantage point and a
radius in Hamming distance. Two fingerprints that differ in at most `radius` bits differ in at most
radius // blocks bits of one of `blocks` equal parts, so there is one tree for each part and its triangle
bounds use that smaller radius: a fingerprint is at home in one shard and asks in every shard whose region
its ball touches. A shard goes on in the same way in memory, compares whole fingerprints exactly at the end
of a branch, and gives a spanning forest of its links, never all pairs. The trees are built on a bounded
sample of distinct fingerprints, which decides the balance of the shards and not the result. Because they
follow the density of the fingerprints, a crowd of near copies is cut as finely as any other region.

Defined results: null and empty texts, and texts without words, have fingerprint zero and are linked like
any other; fewer words than a shingle are one shingle; repeated rows link at distance zero; ties cannot
occur, the smallest id stands for a component (null ids are ignored there); an empty table gives no rows.
Only the id and text columns are used.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, id_field
from .components import stars

#: Distinct fingerprints that a shard should hold, the least and greatest depth of the tree over shards, the sample for it.
LEAF, LEAST_DEPTH, MOST_DEPTH, SAMPLE = 200_000, 4, 18, 32_768
#: A fingerprint of more than a CROWD-th of the rows is a crowd.
CROWD = 1000
#: Comparisons made at once at the end of a branch, and bytes of a text that are split into words at once.
COMPARE, BLOCK = 1 << 20, 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0d]")
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
OFFSETS = (np.arange(8) * 256).astype(np.int64)


def word_blocks(raw: bytes):
    """The words of raw, A-Z in lower case, in lists of bounded size."""
    at = 0
    while at < len(raw):
        end = len(raw)
        if at + BLOCK < end and (gap := SPACE.search(raw, at + BLOCK)):
            end = gap.start()
        yield raw[at:end].lower().split()
        at = end


def _votes(hashes: list[int]) -> np.ndarray:
    octets = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    return (np.bincount((octets + OFFSETS).ravel(), minlength=2048).reshape(8, 256) @ BITS).ravel()


def fingerprint(raw: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash over XXH64 of word shingles, repeats included."""
    votes, n, tail = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for block in word_blocks(raw or b""):
        own = tail + block
        if len(own) >= words:
            joined = b" ".join(own)
            ends = list(itertools.accumulate(map(len, own), lambda a, b: a + b + 1))
            starts = [0, *(e + 1 for e in ends)]
            hashes = [digest(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :], strict=False)]
            votes += _votes(hashes)
            n += len(hashes)
            tail = own[len(own) - words + 1 :] if words > 1 else []
        else:
            tail = own
    if not n:
        if not tail:
            return 0
        votes, n = _votes([digest(b" ".join(tail), seed)]), 1
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, out: str = "fp") -> DataFrame:
    """(doc_id, fp), the fingerprint as a signed long."""
    schema = T.StructType([id_field(docs, doc_id), T.StructField(out, T.LongType())])

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], schema.names)

    return docs.select(F.col(doc_id), F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)


def _part(fps: np.ndarray, block: int, blocks: int) -> np.ndarray:
    width = 64 // blocks
    return (fps >> np.uint64(block * width)) & np.uint64((1 << width) - 1)


def _distance(a, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int16)


def plant(sample: np.ndarray, depth: int, reach: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a whole tree in heap order: node i has its inner half at 2i+1, its outer half at 2i+2.
    Of a few vantage points that with the fewest fingerprints in both halves' reach is taken."""
    points, radii = np.zeros(2**depth - 1, np.uint64), np.full(2**depth - 1, 64, np.int16)
    members = {0: sample}
    for node in range(2**depth - 1):
        own = members.pop(node, np.array([], np.uint64))
        inner, outer = own, own[:0]
        if len(own) > 1:
            best = None
            for point in rng.choice(own, min(8, len(own)), replace=False):
                d = _distance(own, point)
                for radius in {int(np.median(d)) + shift for shift in (-1, 0)}:
                    inside = int((d <= radius).sum())
                    if 0 < inside < len(own):
                        cost = int((d <= radius + reach).sum()) * inside + int((d > radius - reach).sum()) * (len(own) - inside)
                        if best is None or cost < best[0]:
                            best = (cost, point, radius, d)
            if best:
                _, points[node], radii[node], d = best
                inner, outer = own[d <= best[2]], own[d > best[2]]
        members[2 * node + 1], members[2 * node + 2] = inner, outer
    return points, radii


def deal(parts: np.ndarray, tree: tuple[np.ndarray, np.ndarray], reach: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, indices that ask there, whether each is at home there)."""
    points, radii = tree
    found, stack = [], [(0, np.arange(len(parts)), np.ones(len(parts), bool))]
    while stack:
        node, own, home = stack.pop()
        if not len(own):
            continue
        if node >= len(points):
            found.append((node - len(points), own, home))
            continue
        d = _distance(parts[own], points[node])
        inner, outer = d <= radii[node] + reach, d > radii[node] - reach
        stack.append((2 * node + 1, own[inner], home[inner] & (d[inner] <= radii[node])))
        stack.append((2 * node + 2, own[outer], home[outer] & (d[outer] > radii[node])))
    return found


class Forest:
    """Labels of local components; the label is the smallest index."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up


def link_shard(fps: np.ndarray, home: np.ndarray, block: int, blocks: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The spanning forest, as (fp, least fp of its local component), of all links between a fingerprint at home and one that asks."""
    order = np.argsort(fps)
    fps, home = fps[order], home[order]
    parts, reach, forest, rng = _part(fps, block, blocks), radius // blocks, Forest(len(fps)), np.random.default_rng(len(fps))
    stack = [(np.flatnonzero(home), np.arange(len(fps)))]
    while stack:
        mine, asking = stack.pop()
        if not len(mine) or not len(asking):
            continue
        split = None
        if len(mine) * len(asking) > COMPARE and len(mine) > 32:
            for point in rng.choice(parts[mine], 4):
                d = _distance(parts[mine], point)
                r = int(np.median(d))
                r -= r == d.max()
                if (d <= r).any() and (split is None or abs((d <= r).mean() - 0.5) < split[0]):
                    split = (abs((d <= r).mean() - 0.5), point, r, d)
        if split:
            _, point, r, d = split
            q = _distance(parts[asking], point)
            stack.append((mine[d <= r], asking[q <= r + reach]))
            stack.append((mine[d > r], asking[q > r - reach]))
            continue
        step = max(1, COMPARE // len(mine))
        for at in range(0, len(asking), step):
            some = asking[at : at + step]
            q, m = np.nonzero(np.bitwise_count(fps[some][:, None] ^ fps[mine][None, :]) <= radius)
            forest.link(some[q], mine[m])
    moved = np.flatnonzero(forest.label != np.arange(len(fps)))
    return fps[moved], fps[forest.label[moved]]


def links(distinct: DataFrame, radius: int = 3, blocks: int = 2, leaf: int = LEAF, least_depth: int = LEAST_DEPTH) -> DataFrame:
    """Edges (u, v) between the distinct longs in column fp, enough to connect all that differ in at most radius bits."""
    n = distinct.count()
    depth = min(MOST_DEPTH, max(least_depth, math.ceil(math.log2(max(n, 1) / leaf)) if n > leaf else 0))
    rows = distinct.select("fp").sample(fraction=min(1.0, 1.1 * SAMPLE / max(n, 1)), seed=7).limit(SAMPLE).collect()
    sample = np.array(sorted(r.fp for r in rows), dtype=np.int64).view(np.uint64)
    rng, reach = np.random.default_rng(7), radius // blocks
    trees = distinct.sparkSession.sparkContext.broadcast([plant(_part(sample, b, blocks), depth, reach, rng) for b in range(blocks)])

    def send(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for b, tree in enumerate(trees.value):
                for at, own, home in deal(_part(fps, b, blocks), tree, reach):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), at * blocks + b, np.int32)), pa.array(fps[own].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    def join(key, table):
        fps = table.column("fp").to_numpy().view(np.uint64)
        u, v = link_shard(fps, table.column("home").to_numpy(zero_copy_only=False), key[0].as_py() % blocks, blocks, radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return distinct.select("fp").mapInArrow(send, "shard int, fp long, home boolean").groupBy("shard").applyInArrow(join, "u long, v long")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3, blocks: int = 2) -> DataFrame:
    """(doc_id, fingerprint as 16 hexadecimal digits, component_id: the smallest id that links reach)."""
    return of_fingerprints(cut(fingerprints(docs, doc_id, text, words), "simhash"), doc_id, radius, blocks)


def labels(fps: DataFrame, doc_id: str, radius: int = 3, blocks: int = 2) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of a table (doc_id, fp)."""
    least = cut(fps.groupBy("fp").agg(F.min(doc_id).alias("rep")), "simhash")
    star = stars(links(least, radius, blocks).select("u", "v"), "simhash")
    members = star.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(star.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    named = members.join(least, "fp")
    moved = named.join(named.groupBy("root").agg(F.min("rep").alias("moved")), "root").select("fp", "moved")
    return least.join(moved, "fp", "left").select("fp", F.coalesce("moved", "rep").alias("component_id"))


def of_fingerprints(fps: DataFrame, doc_id: str, radius: int = 3, blocks: int = 2) -> DataFrame:
    """components() over a table (doc_id, fp)."""
    return by_fingerprint(fps, labels(fps, doc_id, radius, blocks), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"))


def by_fingerprint(fps: DataFrame, named: DataFrame, *more) -> DataFrame:
    """(doc_id, more, component_id) of rows (doc_id, fp), by a table (fp, component_id) of distinct fingerprints.

    Fingerprints that more than a CROWD-th of the rows share, of which there are fewer than CROWD, are looked up in a
    broadcast, so that a crowd of copies is not one key of a shuffle."""
    doc_id = fps.columns[0]
    total = fps.count()
    crowds = fps.groupBy("fp").count().where(F.col("count") * CROWD > total).select("fp")
    crowds = F.broadcast(cut(named.join(F.broadcast(crowds), "fp"), "simhash"))
    rest = fps.join(crowds, "fp", "left_anti").join(named, "fp")
    return fps.join(crowds, "fp").unionByName(rest).select(doc_id, *more, "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """docs with the row of the smallest id of each component. Rows of one id are one document and one of them stays;
    a row without an id cannot stand for a group or be named by one, and stays."""
    return kept(docs, cut(components(docs.where(F.col(doc_id).isNotNull()), doc_id, text, words, radius), "simhash"), doc_id)


def kept(docs: DataFrame, found: DataFrame, doc_id: str) -> DataFrame:
    """docs without the rows whose id is not its component's (found: doc_id, component_id), one row for each id, and rows without an id."""
    first = found.where(F.col(doc_id) == F.col("component_id")).groupBy(doc_id).count()
    stay = docs.join(first.select(doc_id), doc_id, "left_semi")
    repeated = found.groupBy(doc_id).count().where("count > 1").select(doc_id)
    if not repeated.isEmpty():
        again = stay.join(repeated, doc_id, "left_semi").dropDuplicates([doc_id])
        stay = stay.join(repeated, doc_id, "left_anti").unionByName(again)
    return stay.unionByName(docs.where(F.col(doc_id).isNull()))
