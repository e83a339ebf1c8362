"""Language-model scores by prediction by partial matching over bytes.

A document is read as its words (lower-case A-Z, one space between) and one end symbol. The
trie holds every context of up to ``ORDER`` symbols of the training documents. A symbol is
coded in the longest context that was seen; if it never followed there, an escape is coded
and the next shorter context is asked, without the symbols that the longer one had
(exclusion). Counts give (2c - 1) / 2n to a symbol and d / 2n to the escape, n and d being
counts and distinct symbols that are not excluded; below all contexts symbols are uniform.

The trie is never in one place. Chunks of documents send their distinct strings of
``ORDER`` + 1 symbols, with training counts, to shards dealt by the last three symbols of
the context. A shard has all of such a context's subtree from order three on; orders 0 to 2
are one table of at most 257^3 counts (some ten thousand in practice), which is gathered
first (and broadcast). The shard codes each distinct string once and sends the log-probabilities back; a
chunk adds them up over its documents. Word counts for the base score travel with them, as
128-bit hashes. Messages are packed arrays, and the model grows with the corpus while no
task holds more than a chunk or a shard.

``adaptive_scores`` codes each document alone, learning from what it has read of it.

Null and empty texts are the end symbol alone. Repeated rows are learned and scored each.
A null doc_id counts as crc32 0. With no training rows all symbols are uniform, and N and V
are 0. Extra columns are ignored. Texts are whole, however long. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from math import log10

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .common import chunked, n_chunks, n_shards, text_bytes

ORDER = 5
#: Orders below this are one gathered table; a context's last LOW symbols choose its shard.
LOW = 3
BITS = 9
MARK = 256  # ends a document and stands before its first symbol
ALPHABET = 257
_U = np.uint64


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def streams(texts: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of each symbol with its context, over all documents; each one's first and length."""
    size = np.array([sum(map(len, w)) + max(0, len(w) - 1) + 1 for w in texts], np.int64)
    start = np.cumsum(size + order) - size
    joined = np.full(int((size + order).sum()), MARK, np.uint16)
    for w, a, n in zip(texts, start.tolist(), size.tolist()):
        joined[a : a + n - 1] = np.frombuffer(b" ".join(w), np.uint8)
    code = np.zeros(len(joined) - order if len(joined) else 0, _U)
    for k in range(order, -1, -1):
        code = (code << _U(BITS)) | joined[order - k : len(joined) - k]
    return code, start - order, size


def _kept(first: np.ndarray, size: np.ndarray, total: int) -> np.ndarray:
    """Places that are symbols of a document, not marks before it."""
    edge = np.zeros(total + 1, np.int8)
    edge[first] += 1
    np.add.at(edge, first + size, -1)
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def low_counts(docs: DataFrame) -> dict[str, np.ndarray]:
    """Counts of training strings of LOW symbols; no more than 257 ** LOW entries."""

    def f(batches):
        for b in batches:
            texts, at = text_bytes(pa.Table.from_batches([b])), 0
            while at < len(texts):
                to, total = at, 0
                while to < len(texts) and total < 1 << 22:
                    total += len(texts[to])
                    to += 1
                code, first, size = streams([words_of(bytes(t)) for t in texts[at:to]], LOW - 1)
                code, n = np.unique(code[_kept(first, size, len(code))].astype(np.uint32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], names=["code", "n"])
                at = to

    got = docs.filter("train").select("text").mapInArrow(f, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(got["code"].to_numpy())
    return {"code": got["code"].to_numpy()[order].astype(_U), "n": got["n"].to_numpy()[order].astype(np.int64)}


class Level:
    """Contexts of one order: sorted strings with counts, and totals of each context."""

    def __init__(self, code: np.ndarray, n: np.ndarray, below: Level | None, order: int):
        self.code, self.n, self.order = code, n, order
        context = code >> _U(BITS)
        self.first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(code) else np.zeros(0, np.int64)
        self.context = context[self.first]
        self.total = np.add.reduceat(n, self.first) if len(code) else n
        self.distinct = np.diff(np.append(self.first, len(code)))
        # What the symbols seen here count for in the context that is one symbol shorter.
        if below is None or not len(code):
            self.excluded = np.zeros(len(self.first), np.int64)
        else:
            short = code & _U((1 << BITS * order) - 1)
            self.excluded = np.add.reduceat(below.n[np.searchsorted(below.code, short)], self.first)


def levels(code: np.ndarray, n: np.ndarray, low: dict[str, np.ndarray], order: int) -> list[Level]:
    """All orders, from the full strings of a shard and the gathered low orders."""
    out: list[Level] = []
    for k in range(order + 1):
        c, m = (low["code"], low["n"]) if k < LOW else (code, n)
        c = c & _U((1 << BITS * (k + 1)) - 1)
        by = np.argsort(c, kind="stable")
        c, m = c[by], m[by]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
        out.append(Level(c[first], np.add.reduceat(m, first) if len(c) else m, out[-1] if out else None, k))
    return out


def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    i = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return i, table[i] == x


def code_lengths(asked: np.ndarray, trie: list[Level]) -> np.ndarray:
    """log10 probability of each asked string's last symbol after its others."""
    out = np.zeros(len(asked))
    alive = np.arange(len(asked))
    ex_n, ex_d = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    for level in reversed(trie):
        x = asked[alive] & _U((1 << BITS * (level.order + 1)) - 1)
        c, seen = _find(level.context, x >> _U(BITS))
        if not len(level.context):
            continue
        total, distinct = level.total[c] - ex_n, level.distinct[c] - ex_d
        i, hit = _find(level.code, x)
        hit &= seen
        out[alive[hit]] += np.log10((2 * level.n[i[hit]] - 1) / (2 * total[hit]))
        escape = seen & ~hit & (distinct > 0)
        out[alive[escape]] += np.log10(distinct[escape] / (2 * total[escape]))
        rest = ~hit
        ex_n = np.where(seen, level.excluded[c], 0)[rest]
        ex_d = np.where(seen, level.distinct[c], 0)[rest]
        alive = alive[rest]
    out[alive] -= np.log10(ALPHABET - ex_d)
    return out


class Chunk:
    """A chunk's words, strings and their order, the same whenever it is read."""

    def __init__(self, table: pa.Table, order: int, shards: int):
        self.words = [words_of(bytes(t)) for t in text_bytes(table)]
        self.train = table["train"].to_numpy(zero_copy_only=False).astype(bool)
        self.code, self.first, self.size = streams(self.words, order)
        kept = _kept(self.first, self.size, len(self.code))
        owner = np.repeat(self.train, self.size)
        both = np.sort((self.code[kept] << _U(1)) | owner)
        code, train = both >> _U(1), (both & _U(1)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        code, n = code[start], np.add.reduceat(train, start)
        shard = self._shard(code, shards)
        by = np.argsort(shard, kind="stable")
        self.asked, self.seen = code[by], n[by]
        self.cut = np.searchsorted(shard[by], np.arange(shards + 1))
        learned: Counter = Counter()
        for w, t in zip(self.words, self.train.tolist()):
            if t:
                learned.update(w)
        learned[b""] = int(self.train.sum())  # the end
        every = sorted(set().union(*self.words, [b""]))
        digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in every), ">u8").reshape(-1, 2).astype(_U)
        shard = (digest[:, 0] % _U(shards)).astype(np.int64)
        by = np.lexsort((digest[:, 1], shard))
        self.word = [every[i] for i in by.tolist()]
        self.key = np.ascontiguousarray(digest[by])  # both halves
        self.learned = np.array([learned.get(w, 0) for w in self.word], np.int64)
        self.word_cut = np.searchsorted(shard[by], np.arange(shards + 1))

    @staticmethod
    def _shard(code: np.ndarray, shards: int) -> np.ndarray:
        last = (code >> _U(BITS)) & _U((1 << BITS * LOW) - 1)
        return (((last * _U(0x9E3779B97F4A7C15)) >> _U(40)) % _U(shards)).astype(np.int64)


def _binary(x: np.ndarray, cut: np.ndarray) -> pa.Array:
    return pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())


def _ask(order: int, shards: int):
    def f(table: pa.Table) -> pa.Table:
        c = Chunk(table, order, shards)
        return pa.table({
            "shard": pa.array(range(shards), pa.int32()),
            "chunk": pa.array([table["chunk"][0].as_py()] * shards, pa.int32()),
            "codes": _binary(c.asked, c.cut),
            "seen": _binary(c.seen.astype(np.uint32), c.cut),
            "words": _binary(c.key, c.word_cut),
            "learned": _binary(c.learned.astype(np.uint32), c.word_cut),
        })

    return f


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (rows of one or two numbers), their summed counts, and where each given
    key is among them."""
    k, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    by = np.argsort(k, kind="stable") if k.ndim == 1 else np.lexsort((k[:, 1], k[:, 0]))
    s = k[by]
    differs = s[1:] != s[:-1]
    new = np.concatenate([[True], differs if k.ndim == 1 else differs.any(1)]) if len(s) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    at = np.empty(len(k), np.int64)
    at[by] = np.cumsum(new) - 1
    return s[first], np.add.reduceat(n[by], first) if len(s) else n, at


def _answer(order: int, gathered: Broadcast):
    def f(table: pa.Table) -> pa.Table:
        read = lambda name, kind: [np.frombuffer(x, kind) for x in table[name].to_pylist()]
        low, codes, words = gathered.value, read("codes", _U), [x.reshape(-1, 2) for x in read("words", _U)]
        asked, n, at = _merge(codes, read("seen", np.uint32))
        trie = levels(asked[n > 0], n[n > 0], low, order)
        score = code_lengths(asked, trie).astype(np.float32)[at]
        _, m, word_at = _merge(words, read("learned", np.uint32))
        cuts = [np.concatenate([[0], np.cumsum([len(x) for x in y])]) for y in (codes, words)]
        return pa.table({
            "chunk": table["chunk"], "shard": table["shard"],
            "scores": _binary(score, cuts[0]), "counts": _binary(m[word_at], cuts[1]),
            "total": pa.array([int(m.sum())] * table.num_rows, pa.int64()), "distinct": pa.array([int((m > 0).sum())] * table.num_rows, pa.int64()),
        })

    return f


def _finish(order: int, shards: int):
    def f(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _OUT.empty_table()
        c = Chunk(docs, order, shards)
        answers = answers.sort_by("shard")
        scores = np.concatenate([np.frombuffer(x, np.float32) for x in answers["scores"].to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in answers["counts"].to_pylist()])
        total, distinct = sum(answers["total"].to_pylist()), sum(answers["distinct"].to_pylist())
        lookup = Lookup(c.asked, scores)
        value = dict(zip(c.word, np.log10(counts + 0.5).tolist()))
        never, norm = log10(0.5), log10(total + 0.5 * (distinct + 1))
        end = value[b""]
        n, known, base, score = [], [], [], []
        for w, a, k in zip(c.words, c.first.tolist(), c.size.tolist()):
            v = np.fromiter(map(value.__getitem__, w), float, len(w))
            n.append(len(w) + 1)
            known.append(int((v > never).sum()) + (end > never))
            base.append(float(v.sum()) + end - (len(w) + 1) * norm)
            score.append(float(lookup(c.code[a : a + k]).sum(dtype=np.float64)))
        return pa.table({
            "doc_id": docs["doc_id"].combine_chunks().cast(pa.int64()), "held_out": pa.array(~c.train), "n_tokens": n, "n_known": known,
            "train_tokens": [total] * len(n), "base_score": base, "score": score,
        }, schema=_OUT)

    return f


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


class Lookup:
    """Open addressing over a chunk's strings: filled and read whole arrays at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.mask = (1 << self.bits) - 1
        self.key = np.full(self.mask + 1, _U(0xFFFFFFFFFFFFFFFF))
        self.value = np.zeros(self.mask + 1, np.float32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.key[at] == _U(0xFFFFFFFFFFFFFFFF)
            self.key[at[free]] = keys[todo[free]]
            won = self.key[at] == keys[todo]
            self.value[at[won]] = values[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & self.mask

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return ((x * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Values of keys that are all present."""
        at = self._slot(x)
        out = self.value[at]
        todo = np.flatnonzero(self.key[at] != x)
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            hit = self.key[at] == x[todo]
            out[todo[hit]] = self.value[at[hit]]
            todo, at = todo[~hit], at[~hit]
        return out


def score_documents(docs: DataFrame, train: Column | None = None, order: int = ORDER) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` says which rows the model learns from (all but the held-out fifth)."""
    train = ~held_out(F.col("doc_id")) if train is None else train
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), train.alias("train"))
    low = low_counts(docs)
    chunks = n_chunks(docs, size=5 << 20, message=64)  # a chunk's words are Python objects
    shards = n_shards(chunks)
    by_chunk = lambda df: df.groupBy("chunk")
    dealt = chunked(docs, chunks)
    asked = by_chunk(dealt).applyInArrow(_ask(order, shards), "shard int, chunk int, codes binary, seen binary, words binary, learned binary")
    answers = asked.groupBy("shard").applyInArrow(_answer(order, docs.sparkSession.sparkContext.broadcast(low)), "chunk int, shard int, scores binary, counts binary, total long, distinct long")
    return by_chunk(dealt).cogroup(by_chunk(answers)).applyInArrow(_finish(order, shards), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


class Trie:
    """The same model one symbol at a time, as nested counts: for adaptive scores."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.node: dict[tuple[int, ...], Counter] = defaultdict(Counter)

    def learn(self, past: list[int], symbol: int) -> None:
        for k in range(self.order + 1):
            self.node[tuple(past[len(past) - k :])][symbol] += 1

    def log_probability(self, past: list[int], symbol: int) -> float:
        out, gone = 0.0, set()
        for k in range(self.order, -1, -1):
            has = self.node.get(tuple(past[len(past) - k :]))
            if not has:
                continue
            n = {s: c for s, c in has.items() if s not in gone}
            if symbol in n:
                return out + log10((2 * n[symbol] - 1) / (2 * sum(n.values())))
            if n:
                out += log10(len(n) / (2 * sum(n.values())))
            gone |= has.keys()
        return out - log10(ALPHABET - len(gone))

    def read(self, text: bytes, score: bool = True, learn: bool = True) -> float:
        past, total = [MARK] * self.order, 0.0
        for symbol in [*b" ".join(words_of(text)), MARK]:
            total += self.log_probability(past, symbol) if score else 0.0
            if learn:
                self.learn(past, symbol)
            past = (past + [symbol])[1:]
        return total


def adaptive_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, score): each document coded alone by a trie that starts empty."""

    def f(batches):
        for b in batches:
            scores = [Trie(order).read((t or "").encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(f, "doc_id long, score double")
