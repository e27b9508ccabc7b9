"""The whole suffix tree: every context of one or two words that occurs at least twice, with every follower.

The distributions, smoothing and test of the states are those of `suffix_tree`, where nothing is left out. No machine
holds the tree. Documents are gathered in batches that name words by numbers of their own; a batch sends each
distinct key (64 bits of a word, pair or triple) once, with its sum in the batch, to the part that owns the key, and
is sent the sum over all batches. Five such rounds give the counts of words; of pairs; of triples and the numbers of
followers of words; the gains of words and the numbers of followers of pairs; the gains of pairs. Parts are ranges
of hashed keys, so that neither a frequent word nor a frequent context is one task's. Only the batches and the answers are kept;
each round reads all answers so far and works out again what follows from them.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files
from .common import delete, id_field, shared_dir
from .simhash import word_blocks

LEAST = 2
#: Tokens of a batch and bytes of text for each part; a gain counts in steps of 1 / STEP nats.
TOKENS, PART, STEP = 600_000, 16_000_000, 1 << 12
SCHEMA, STATE = "batch long, part int, data binary", -1
WORDS, PAIRS, TRIPLES, WORD_KINDS, PAIR_KINDS, WORD_GAINS, PAIR_GAINS = range(7)
COUNTS, GAINS = (WORDS, PAIRS, TRIPLES), (WORD_GAINS, PAIR_GAINS)


CODEC = "zstd"


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers by compressed planes of bytes, those that are zero in all left out."""
    a = np.ascontiguousarray(a, "<u8")
    size = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
    planes = a.view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()
    return bytes([size]) + len(a).to_bytes(8, "little") + pa.Codec(CODEC, 1).compress(planes, asbytes=True)


def _unpack(raw: bytes) -> np.ndarray:
    size, n = raw[0], int.from_bytes(raw[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(pa.Codec(CODEC).decompress(raw[9:], size * n), np.uint8).reshape(size, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _signed(a: np.ndarray) -> np.ndarray:
    return ((a << 1) ^ (a >> 63)).view(np.uint64)


def _unsigned(a: np.ndarray) -> np.ndarray:
    return (a >> np.uint64(1)).astype(np.int64) ^ -(a & np.uint64(1)).astype(np.int64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of sequences from the key of all but the last and the last's."""
    k = a * np.uint64(0x9E3779B97F4A7C15) + b
    for factor in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F):
        k ^= k >> np.uint64(32)
        k *= np.uint64(factor)
    return k ^ (k >> np.uint64(29))


def _hash(word: bytes | None) -> int:
    """64 bits; None is the end, which no word equals."""
    return xxhash.xxh64_intdigest(word or b"")


def _request(kind: int, keys: np.ndarray, sums: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """(part, data) for sorted distinct keys and their sums in the batch."""
    edges = np.searchsorted(keys, np.array([(n << 64) // parts for n in range(1, parts)], np.uint64))
    out = []
    for n, (k, s) in enumerate(zip(np.split(keys, edges), np.split(sums.astype(np.int64), edges), strict=True)):
        if len(k):
            out.append((kind * parts + n, pickle.dumps((_pack(np.diff(k, prepend=np.uint64(0))), _pack(_signed(s))))))
    return out


def _answer(table: pa.Table, parts: int) -> pa.Table:
    """For each batch that asks this part: the sums over all batches, of gains only whether they are above zero, and of counts
    which keys the batch is the first to have learned."""
    part = table.column("part")[0].as_py()
    kind = part // parts
    batch = np.array(table.column("batch"), np.int64)
    order = np.argsort(batch)
    data = table.column("data")
    keys, sums = [], []
    for i in order.tolist():
        k, s = pickle.loads(data[i].as_py())
        keys.append(np.cumsum(_unpack(k), dtype=np.uint64))
        sums.append(_unsigned(_unpack(s)))
    edges = np.cumsum([len(k) for k in keys])[:-1]
    every, own = np.concatenate(keys), np.concatenate(sums)
    distinct, at = np.unique(every, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, own)
    if kind in GAINS:
        total = (total > 0).astype(np.int64)
    learned = np.flatnonzero(own > 0) if kind in COUNTS else np.zeros(0, np.int64)
    first = np.zeros(len(every), bool)
    first[learned[np.unique(at[learned], return_index=True)[1]]] = True
    answers = zip(np.split(total[at], edges), np.split(first, edges), strict=True)
    rows = [(int(batch[i]), part, pickle.dumps((_pack(_signed(t)), np.packbits(f).tobytes() if kind in COUNTS else b""))) for i, (t, f) in zip(order, answers, strict=True)]
    return _table([*rows, (STATE, part, pickle.dumps((int(total.sum()), int((total > 0).sum()))))])


def _table(rows) -> pa.Table:
    batch, part, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"batch": pa.array(batch, pa.int64()), "part": pa.array(part, pa.int32()), "data": pa.array(data, pa.binary())})


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, one place of each, and the number of its key for each place."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


class Batch:
    """A batch and what the answers so far say of it. Words have its own numbers; pairs and triples are those at its positions
    whose context occurs LEAST times, numbered by their keys."""

    def __init__(self, folder: str, table: pa.Table, parts: int, total: int, distinct: int):
        self.parts, self.answers = parts, defaultdict(list)
        for part, data in zip(table.column("part").to_pylist(), table.column("data").to_pylist(), strict=True):
            if part == STATE:
                self.state = pickle.loads(files.get(folder, data.decode()))
            else:
                self.answers[part // parts].append((part, data))
        self.ids, self.lens = (_unpack(self.state[n]).astype(np.int64) for n in ("ids", "lens"))
        self.hashes, self.held = _unpack(self.state["hashes"]), _unpack(self.state["held"]) == 1
        self.keys, _, self.number = _distinct(self.hashes)
        self.train = np.repeat(~self.held, self.lens)
        self.at = np.arange(len(self.ids)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        self.whole = total + 0.5 * (distinct + 1)

    def answer(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums and, for counts, firsts in the order of the keys asked for."""
        sums, firsts = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for _, data in sorted(self.answers[kind]):
            s, f = pickle.loads(data)
            sums.append(_unsigned(_unpack(s)))
            if f:
                firsts.append(np.unpackbits(np.frombuffer(f, np.uint8), count=len(sums[-1])).astype(bool))
        return np.concatenate(sums), np.concatenate(firsts)

    def of_words(self, kind: int) -> np.ndarray:
        return self.answer(kind)[0][self.number]

    def of_pairs(self, kind: int) -> np.ndarray:
        """Of the pairs that can be states; zero for others."""
        out = np.zeros(len(self.pairs), np.int64)
        out[self.wide] = self.answer(kind)[0]
        return out

    def ask_words(self, kind: int, sums: np.ndarray):
        return _request(kind, self.keys, np.rint(np.bincount(self.number, sums, len(self.keys))), self.parts)

    def ask_pairs(self, kind: int, sums: np.ndarray):
        return _request(kind, self.pairs[self.wide], np.rint(sums[self.wide]), self.parts)

    # ------------------------------------------------------------ what each round asks, and what its answers add

    def ask0(self):
        return self.ask_words(WORDS, np.bincount(self.ids, self.train, len(self.hashes)))

    def take0(self):
        sums, first = self.answer(WORDS)
        self.c1, self.first1 = sums[self.number], first[self.number]
        self.base = ((self.c1 + 0.5) / self.whole)[self.ids]
        self.at2 = np.flatnonzero(self.at >= 1)
        self.at2 = self.at2[self.c1[self.ids[self.at2 - 1]] >= LEAST]
        self.word_state, h = self.ids[self.at2 - 1], self.hashes
        self.pairs, self.index2, self.pair = _distinct(_mix(h[self.word_state], h[self.ids[self.at2]]))

    def ask1(self):
        return _request(PAIRS, self.pairs, np.bincount(self.pair, self.train[self.at2], len(self.pairs)), self.parts)

    def take1(self):
        self.c2, self.first2 = self.answer(PAIRS)
        self.wide = self.c2 >= LEAST
        there = np.full(len(self.ids), -1)
        there[self.at2] = self.pair
        self.at3 = np.flatnonzero(self.at >= 2)
        state = there[self.at3 - 1]
        known = state >= 0
        known[known] = self.wide[state[known]]
        self.at3, self.pair_state = self.at3[known], state[known]
        self.triples, self.index3, self.triple = _distinct(_mix(self.pairs[self.pair_state], self.hashes[self.ids[self.at3]]))
        # a pair with the end is asked for too, but no state
        self.wide = np.zeros(len(self.pairs), bool)
        self.wide[self.pair_state] = True

    def ask2(self):
        kinds = np.bincount(self.word_state[self.index2[self.first2]], minlength=len(self.hashes))
        count = np.bincount(self.triple, self.train[self.at3], len(self.triples))
        return self.ask_words(WORD_KINDS, kinds) + _request(TRIPLES, self.triples, count, self.parts)

    def take2(self):
        self.kinds1 = self.of_words(WORD_KINDS)
        self.c3, self.first3 = self.answer(TRIPLES)
        self.p1 = self.smoothed(self.c2[self.pair], self.c1[self.word_state], self.kinds1[self.word_state], self.base[self.at2])

    def ask3(self):
        kinds = np.bincount(self.pair_state[self.index3[self.first3]], minlength=len(self.pairs))
        gains = np.bincount(self.word_state, self.steps(self.at2, self.p1, self.base[self.at2]), len(self.hashes))
        return self.ask_words(WORD_GAINS, gains - self.first1 * self.needed(self.kinds1, self.c1)) + self.ask_pairs(PAIR_KINDS, kinds)

    def take3(self):
        self.kinds2 = self.of_pairs(PAIR_KINDS)
        self.stay1 = self.of_words(WORD_GAINS) > 0
        self.tree, own = self.base.copy(), self.stay1[self.word_state]
        self.tree[self.at2[own]] = self.p1[own]
        s = self.pair_state
        self.p2 = self.smoothed(self.c3[self.triple], self.c2[s], self.kinds2[s], self.tree[self.at3])

    def ask4(self):
        gains = np.bincount(self.pair_state, self.steps(self.at3, self.p2, self.tree[self.at3]), len(self.pairs))
        return self.ask_pairs(PAIR_GAINS, gains - self.first2 * self.needed(self.kinds2, self.c2))

    def take4(self):
        stay2 = self.of_pairs(PAIR_GAINS) > 0
        own = stay2[self.pair_state] & self.stay1[self.ids[self.at3 - 1]]
        self.tree[self.at3[own]] = self.p2[own]

    @staticmethod
    def smoothed(found: np.ndarray, total: np.ndarray, kinds: np.ndarray, parent: np.ndarray) -> np.ndarray:
        return (found + kinds * parent) / (total + kinds)

    def steps(self, at: np.ndarray, p: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """What the learned tokens at these positions gain, in whole steps so that sums do not depend on their order."""
        return np.where(self.train[at], np.rint(np.log(p / parent) * STEP), 0.0)

    @staticmethod
    def needed(kinds: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Steps that a state must gain more than; the batch that learned it first takes them off."""
        from .suffix_tree import DIVERGENCE, GAIN

        return np.floor(np.maximum(GAIN * kinds, DIVERGENCE * total) * STEP)

    def scores(self) -> tuple:
        """(tokens, known tokens, base, tree) of each document."""
        starts = np.cumsum(self.lens) - self.lens
        add = lambda a: np.add.reduceat(a, starts)
        return self.lens, add((self.c1 > 0).astype(np.int64)[self.ids]), add(np.log10(self.base)), add(np.log10(self.tree))


ROUNDS = 5


def _batches(folder: str, tokens: int):
    """Files of batches of documents of (id, held_out, raw), and rows that name them."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), count()

        def gathered():
            ids, docs, held, numbers = [], [], [], defaultdict(count(1).__next__)
            n = 0
            for batch in batches:
                for doc, out, raw in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    own = [np.fromiter(map(numbers.__getitem__, words), np.int64) for words in word_blocks(raw.as_py() or b"")]
                    ids.append(np.concatenate([*own, np.zeros(1, np.int64)]))
                    docs.append(doc)
                    held.append(out)
                    n += len(ids[-1])
                    if n >= tokens:
                        yield ids, docs, held, numbers
                        ids, docs, held, numbers = [], [], [], defaultdict(count(1).__next__)
                        n = 0
            if ids:
                yield ids, docs, held, numbers

        for ids, docs, held, numbers in gathered():
            name = (task << 32) + next(number)
            lens = np.array([len(x) for x in ids])
            ids, held = np.concatenate(ids), np.array(held)
            hashes = np.array([_hash(None), *map(_hash, numbers)], np.uint64)
            state = {"ids": _pack(ids), "hashes": _pack(hashes), "lens": _pack(lens), "held": _pack(held), "docs": pa.array([d.as_py() for d in docs], docs[0].type)}
            written, out = files.create(folder, "batch")
            with out:
                out.write(pickle.dumps(state))
            yield from _table([(name, STATE, written.encode())]).to_batches()

    return run


#: Shuffles of a round are of no use once it is written.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame) -> tuple[str, DataFrame]:
    """The rows in the shared folder, and where."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, "suffix-states")
    was = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if was is None:
            spark.conf.unset(CLEAN)
        else:
            spark.conf.set(CLEAN, was)
    return path, spark.read.schema(df.schema).parquet(path)


def score(rows: DataFrame, doc_id: str) -> DataFrame:
    """From (id, held_out, raw): the columns that `suffix_tree.score` returns."""
    size = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    parts = max(8, -(-size // PART))
    total = distinct = 0
    folder = shared_dir(rows.sparkSession, "suffix-batches")
    fields = [T.StructField(n, t) for n, t in (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))]

    def grouped(df: DataFrame, key: str):
        """Tasks grow in number with the input, not in size."""
        return df.repartition(parts, key).groupBy(key)

    def taken(table: pa.Table, rounds: int, total: int, distinct: int) -> Batch:
        b = Batch(folder, table, parts, total, distinct)
        for n in range(rounds):
            getattr(b, f"take{n}")()
        return b

    def asked(rounds: int, total: int, distinct: int):
        def run(table: pa.Table) -> pa.Table:
            batch = table.column("batch")[0].as_py()
            out = _table([(batch, p, d) for p, d in getattr(taken(table, rounds, total, distinct), f"ask{rounds}")()])
            pa.default_memory_pool().release_unused()
            return out

        return run

    def last(table: pa.Table) -> pa.Table:
        b = taken(table, ROUNDS, total, distinct)
        n, known, base, tree = b.scores()
        columns = [b.state["docs"], pa.array(b.held), n, known, np.full(len(n), total), base, tree]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [doc_id, *(f.name for f in fields)])

    path, known = _written(rows.mapInArrow(_batches(folder, TOKENS), SCHEMA))
    paths = [folder, path]
    for n in range(ROUNDS):
        requests = grouped(known, "batch").applyInArrow(asked(n, total, distinct), SCHEMA)
        path, answers = _written(grouped(requests, "part").applyInArrow(lambda table: _answer(table, parts), SCHEMA))
        if n == 0:
            sums = [pickle.loads(r.data) for r in answers.where(f"batch = {STATE}").select("data").collect()]
            total, distinct = sum(s for s, _ in sums), sum(v for _, v in sums)
        known = known.unionByName(answers.where(f"batch <> {STATE}"))
        paths.append(path)
    path, scored = _written(grouped(known, "batch").applyInArrow(last, T.StructType([id_field(rows, doc_id), *fields])))
    for old in paths:
        delete(rows.sparkSession, old)
    return scored
