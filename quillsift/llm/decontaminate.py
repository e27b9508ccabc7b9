"""Benchmark passages in documents, found through suffix arrays of the documents.

A shard of documents becomes one array of word numbers; its suffix array holds every suffix that begins with a word of
the benchmark, sorted by as many words as a window has. Every suffix of every benchmark item that is as long as a window
is searched there by bisection, which gives all its places; from place to place the test positions that go on verbatim
are followed, so a run that none of them goes on with is a longest match with its place. Shards are bounded in words,
so memory does not follow the size of a partition.

The benchmark is sent to the executors in blocks of at most ITEM_BYTES, one at a time; where it needs several, documents
are searched once for each, what was found is written, the block is dropped, and the covers of a document are united.

Defined results: null texts, and texts or items without words, have no words and no hits; an item of fewer words than a
window is one window; repeated items count once by id, items without an id hit words but are not named; of equally long
matches the first is reported; repeated documents are judged alike; a very long document is a shard of its own and is
searched whole; an empty benchmark contaminates nothing, and an empty table gives no rows. Only the named columns are
used, whatever else a table has; clean() keeps all columns.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, id_field

#: Bytes of benchmark text that one broadcast may hold; words of a shard; bytes of a text that are split at once.
ITEM_BYTES, SHARD, BLOCK = 32 << 20, 1_000_000, 1 << 20
#: Rows whose results are held at once.
STEP = 512
#: ASCII letters to lower case, digits and all bytes of other scripts as they are, the rest to spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(FOLD).split()


class Finder:
    """The windows of benchmark items, ready to be searched in shards of documents."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = 10):
        number: dict[bytes, int] = {}
        own = [np.fromiter((number.setdefault(w, len(number) + 1) for w in words_of(raw)), np.int64) for _, raw in items]
        self.number, self.window, self.names = number, window, [name for name, _ in items]
        sizes = np.array([len(x) for x in own], np.int64)
        starts = np.cumsum(sizes + window) - sizes - window  # items are parted by a window of zeros
        whole = np.concatenate([y for x in own for y in (x, np.zeros(window, np.int64))]) if own else np.zeros(0, np.int64)
        count = np.where(sizes > 0, np.maximum(sizes - window, 0) + 1, 0)
        owner = np.repeat(np.arange(len(own)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
        self.bits = max(1, len(number).bit_length())
        self.per = 64 // self.bits
        words = whole[place[:, None] + np.arange(window)] if len(place) else np.zeros((0, window), np.int64)
        keys = self._keys(self._packed(words.T))
        self.low, first, which = np.unique(keys, return_index=True, return_inverse=True)
        self.sizes = np.minimum(sizes, window)[owner[first]]
        filled = np.where(np.arange(window) < self.sizes[:, None], words[first], (1 << self.bits) - 1)
        self.high = self._keys(self._packed(filled.T))
        order = np.argsort(which, kind="stable")
        self.spots, self.owner = place[order], owner[order]
        self.at = np.searchsorted(which[order], np.arange(len(self.low) + 1))

    def owners(self, window: int) -> set[str]:
        found = self.owner[self.at[window] : self.at[window + 1]].tolist()
        return {self.names[i] for i in found} - {None}

    def _packed(self, columns) -> list[np.ndarray]:
        """Word numbers packed so that their order is the order of the words; the first column weighs most."""
        packed = []
        for at in range(0, self.window, self.per):
            key = np.zeros(len(columns[0]), np.uint64)
            for j in range(at, at + self.per):
                key = key << np.uint64(self.bits)
                if j < self.window:
                    key |= columns[j].astype(np.uint64)
            packed.append(key)
        return packed

    @staticmethod
    def _keys(packed: list[np.ndarray]) -> np.ndarray:
        """Packed words whose byte order is their order."""
        wide = np.ascontiguousarray(np.stack(packed, axis=1).astype(">u8"))
        return wide.view(f"S{8 * len(packed)}").ravel()

    def numbers(self, raw: bytes | None) -> np.ndarray:
        """The document's words as benchmark word numbers, 0 for words that the benchmark lacks."""
        raw, at, parts = raw or b"", 0, []
        while at < len(raw):
            end = len(raw)
            if at + BLOCK < end and (gap := GAP.search(raw, at + BLOCK)):
                end = gap.start()
            own = words_of(raw[at:end])
            parts.append(np.fromiter(map(self.number.get, own, itertools.repeat(0)), np.int64, len(own)))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every occurrence in the words of a shard, whose documents are parted by zeros."""
        suffixes = np.flatnonzero(ids)
        if not len(self.low) or not len(suffixes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        padded = np.append(ids, np.zeros(self.window, np.int64))
        packed = self._packed([padded[j : j + len(ids)][suffixes] for j in range(self.window)])
        order = np.lexsort(packed[::-1])
        keys = self._keys([x[order] for x in packed])
        suffixes = suffixes[order]
        low, high = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        count = high - low
        window = np.repeat(np.arange(len(count)), count)
        rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return suffixes[rank], window

    def judge(self, raws: list[bytes | None]):
        """For each document (words, boolean cover of its words, sorted ids of its items, longest matches), in order."""
        ids, n = [], 0
        for raw in raws:
            own = self.numbers(raw)
            if ids and n + len(own) > SHARD:
                yield from self._shard(ids)
                ids, n = [], 0
            ids.append(own)
            n += len(own)
        yield from self._shard(ids)

    def _shard(self, ids: list[np.ndarray]):
        zero = np.zeros(1, np.int64)
        sizes = np.array([len(x) + 1 for x in ids], np.int64)
        ends = np.cumsum(sizes)
        place, window = self.occurrences(np.concatenate([y for x in ids for y in (x, zero)]) if ids else zero)
        order = np.argsort(place, kind="stable")
        place, window = place[order], window[order]
        edge = np.zeros(int(ends[-1]) + 1 if ids else 1, np.int64)
        np.add.at(edge, place, 1)
        np.subtract.at(edge, place + self.sizes[window], 1)
        cover = np.cumsum(edge) > 0
        bounds = np.searchsorted(place, [0, *ends.tolist()])
        for i, (size, end) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True)):
            own = slice(bounds[i], bounds[i + 1])
            names = set().union(*(self.owners(w) for w in np.unique(window[own]).tolist()))
            yield size - 1, cover[end - size : end - 1], sorted(names), self.longest(place[own] - (end - size), window[own])

    def longest(self, place: np.ndarray, window: np.ndarray) -> list[tuple[str | None, int, int]]:
        """(item, first word in the document, words) of the longest verbatim matches, from a document's occurrences by place."""
        found, runs, before = set(), {}, -1  # runs: test position that must come next to (its item, first word)
        close = lambda: found.update((self.names[item], first, before + self.window - first) for item, first in runs.values())
        for p, w in zip(place.tolist(), window.tolist(), strict=True):
            spots, owner = self.spots[self.at[w] : self.at[w + 1]].tolist(), self.owner[self.at[w] : self.at[w + 1]].tolist()
            if self.sizes[w] < self.window:
                found.update((self.names[item], p, int(self.sizes[w])) for item in owner)
                continue
            if p != before + 1:
                close()
                runs = {}
            going = {spot + 1: (item, runs.pop(spot, (item, p))[1]) for spot, item in zip(spots, owner, strict=True)}
            close()
            runs, before = going, p
        close()
        return sorted(found, key=lambda x: (x[1], -x[2], x[0] or ""))


def blocks_of(items: DataFrame, item_id: str, text: str):
    """The distinct items, in blocks that may be broadcast, collected one at a time; at least one block."""
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).where("t is not null").distinct()
    total = rows.agg(F.sum(F.length("t") + 64)).first()[0] or 0
    n = 1 if total <= ITEM_BYTES else -(-3 * total // (2 * ITEM_BYTES))
    for k in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield k + 1 == n, [(r.i, bytes(r.t)) for r in own.collect()]


FOUND = "n long, cover binary, own array<string>, longest array<struct<item_id:string,first_word:long,n_words:long>>"
_KINDS = [pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.struct([("item_id", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))]


def searched(rows: DataFrame, items: DataFrame, window: int, item_id: str, text: str) -> tuple[list[DataFrame], bool]:
    """For each block of items a table of key (the first column of rows), words, packed cover, items and longest matches
    of rows (key, binary text); whether there is one block, whose table is not computed yet."""
    key, parts = rows.columns[0], []
    for last, block in blocks_of(items, item_id, text):
        finder = rows.sparkSession.sparkContext.broadcast(Finder(block, window))

        def run(batches, finder=finder):
            for batch in batches:
                found = finder.value.judge([x.as_py() for x in batch.column(1)])
                for at in range(0, len(batch), STEP):
                    own = [(n, np.packbits(cover).tobytes(), names, [dict(zip(("item_id", "first_word", "n_words"), x, strict=True)) for x in longest]) for n, cover, names, longest in itertools.islice(found, STEP)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, STEP), *(pa.array(c, t) for c, t in zip(zip(*own, strict=True), _KINDS, strict=True))], [key, "n", "cover", "own", "longest"])

        part = rows.mapInArrow(run, T.StructType([id_field(rows, key), *T._parse_datatype_string(FOUND).fields]))
        if last and not parts:
            return [part], True
        parts.append(cut(part, "decontaminate"))
        finder.destroy()
    return parts, False


def report(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document its words, hit words and items, and its longest verbatim match with its first word, as the columns of the query."""
    rows = docs.select(F.col(doc_id), F.col(text).cast("binary").alias("_text"))
    names = [doc_id, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_longest", "longest_at"]
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType(), T.LongType(), T.LongType()]

    def summed(key, n, cover, own, longest):
        bits = [np.unpackbits(np.frombuffer(c, np.uint8), count=k) for c, k in zip(cover, n, strict=True)]
        hit = [int(b.sum()) for b in bits]
        best = [min(((-x["n_words"], x["first_word"]) for x in own_), default=(0, -1)) for own_ in longest]
        sha = [hashlib.sha256(",".join(sorted(set(x))).encode()).hexdigest() for x in own]
        return pa.RecordBatch.from_arrays([key, pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(set(x)) for x in own], pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_()), pa.array([-b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.int64())], names)

    found, single = searched(rows, items, window, item_id, item_text)
    schema = T.StructType([id_field(docs, doc_id), *map(T.StructField, names[1:], kinds)])
    if single:
        return found[0].mapInArrow(lambda batches: (summed(b.column(0), *(b.column(i).to_pylist() for i in range(1, 5))) for b in batches), schema)
    # several blocks: a distinct text is searched in each, and its covers meet by text
    texts = rows.select(F.sha2("_text", 256).alias(doc_id), "_text").where("_text IS NOT NULL").dropDuplicates([doc_id])
    parts, _ = searched(cut(texts, "decontaminate"), items, window, item_id, item_text)

    def unite(table):
        covers = [np.frombuffer(x.as_py(), np.uint8) for x in table.column("cover")]
        own = [i for x in table.column("own").to_pylist() for i in x]
        longest = [x for y in table.column("longest").to_pylist() for x in y]
        return pa.Table.from_batches([summed(table.column(doc_id).combine_chunks()[:1], table.column("n").to_pylist()[:1], [np.bitwise_or.reduce(covers).tobytes()], [own], [longest])])

    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    judged = every.groupBy(doc_id).applyInArrow(unite, T.StructType([T.StructField(doc_id, T.StringType()), *schema.fields[1:]])).withColumnRenamed(doc_id, "_sha")
    keyed = rows.select(doc_id, F.sha2("_text", 256).alias("_sha")).join(judged, "_sha", "left")
    return keyed.select(doc_id, *(F.coalesce(F.col(n), F.lit(z)).alias(n) for n, z in zip(names[1:], (0, 0, 0, hashlib.sha256().hexdigest(), False, 0, -1), strict=True)))


def matches(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id as string, first_word, n_words) of the longest verbatim matches."""
    rows, every = docs.select(F.col(doc_id), F.col(text).cast("binary").alias("_text")), None
    for part in searched(rows, items, window, item_id, item_text)[0]:
        own = part.select(doc_id, F.inline("longest"))
        every = own if every is None else every.unionByName(own)
    return every


def clean(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the documents that hold a longest match of a window or more; one pass over the rows for each block."""
    at = docs.columns.index(text)
    for last, block in blocks_of(items, item_id, item_text):
        finder = docs.sparkSession.sparkContext.broadcast(Finder(block, window))

        def run(batches, finder=finder):
            for batch in batches:
                raws = (None if x is None else x.encode("utf-8", "surrogatepass") for x in batch.column(at).to_pylist())
                keep = [not longest for *_, longest in finder.value.judge(raws)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = cut(docs, "decontaminate")
            finder.destroy()
    return docs


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS t FROM s),
k AS (SELECT DISTINCT k FROM i),
e AS (SELECT doc_id, w, k, unnest(range(1, greatest(1, len(w) - k + 2))) AS p FROM d, k),
m AS (SELECT e.doc_id, e.p, e.k, i.item_id FROM e JOIN i ON e.k = i.k AND array_to_string(e.w[e.p:e.p + e.k - 1], ' ') = i.t),
h AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY doc_id),
j AS (SELECT doc_id, count(*) AS n, string_agg(t, ',' ORDER BY t) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM m) GROUP BY doc_id),
r AS (SELECT DISTINCT m.doc_id, m.p, m.k, m.item_id, s.p AS q FROM m JOIN s ON m.item_id IS NOT DISTINCT FROM s.item_id AND m.k = s.k JOIN d USING (doc_id) WHERE s.w[s.p:s.p + s.k - 1] = d.w[m.p:m.p + m.k - 1]),
u AS (SELECT doc_id, k, p, p - row_number() OVER (PARTITION BY doc_id, k, item_id, p - q ORDER BY p) AS island, item_id, p - q AS diagonal FROM r),
v AS (SELECT doc_id, min(p) AS p, count(*) + k - 1 AS n FROM u GROUP BY doc_id, k, item_id, diagonal, island),
x AS (SELECT doc_id, max(n) AS n, arg_min(p - 1, (-n, p)) AS p FROM v GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(j.n, 0) AS n_items, sha256(coalesce(j.l, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated,
  CAST(coalesce(x.n, 0) AS BIGINT) AS n_longest, CAST(coalesce(x.p, -1) AS BIGINT) AS longest_at
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN j USING (doc_id) LEFT JOIN x USING (doc_id)
"""
