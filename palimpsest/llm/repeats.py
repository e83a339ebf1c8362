"""Removal of byte windows that an earlier document has already (repeated windows).

A window is ``WINDOW`` bytes of UTF-8 within one document. A byte goes if some window over
it also starts in a document with a smaller doc_id. Suffixes are ordered by a radix sort,
most significant digit first, that ends at the window's length: after it, equal groups are
exactly the repeated windows. What makes this affordable is that almost no window repeats:

1. In each window at least one ``GRAM``-byte string is selected by its hash (the smallest
   of the window's ``SPAN``; the choice depends on the window's bytes alone, so equal
   windows select equal strings at equal places). Chunks of documents send the selected
   strings' fingerprints to shards, which say which of them two documents share.
2. For shared strings only, chunks send the bytes that all windows over the string can
   cover (a *unit*). A shard sorts the units' windows: passes of one byte to the left and
   to the right of the shared string split groups until windows end. Per window the
   smallest document is kept, and one bit per window goes back.
3. Chunks turn bits into removed bytes.

False sharing of fingerprints costs work, never a wrong result: units are told apart by
their bytes. An answer comes back to the places of its unit within one chunk, by 80 bits of hash.
Messages between chunks and shards are packed arrays: one row per chunk and shard. Within a
chunk, equal units are sent once, so a passage that every document has costs one unit a
chunk.

Null and empty texts, and texts shorter than the window, lose nothing. Rows that share a
doc_id are not smaller than one another, so they keep what only they share; each is cut by
its own text. A null id counts as larger than all others. Extra columns may have any names:
``remove_repeats`` ignores them, ``without_repeats`` gives them back. Very long texts are
whole. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunked, free_name, ids_of, mix, n_chunks, n_shards, text_bytes, tidy_group, tidy_pair, with_text

WINDOW, GRAM = 50, 24
SPAN = WINDOW - GRAM + 1
UNIT = 2 * WINDOW - GRAM
PAD = 0xFF  # never a byte of UTF-8
BLOCK = 1 << 18
_U = np.uint64


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each place, by doubling: 1, 2, 4, 8, 16, 16 + 8."""

    def step(x, y, n, k):
        z = x[: len(x) - n] * _U(k) + y[n:][: len(x) - n]
        return z ^ (z >> _U(29))

    h1 = b.astype(_U) * _U(0x9E3779B97F4A7C15)
    h2 = step(h1, h1, 1, 0xBF58476D1CE4E5B9)
    h4 = step(h2, h2, 2, 0x94D049BB133111EB)
    h8 = step(h4, h4, 4, 0xD6E8FEB86659FD93)
    h16 = step(h8, h8, 8, 0xA0761D6478BD642F)
    n = len(b) - GRAM + 1
    z = h16[:n] * _U(0xE7037ED1A0B428DB) + h8[16 : 16 + n]
    return (z ^ (z >> _U(31))) | _U(1)


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    done, y = 1, x
    while done * 2 <= width:
        y = f(y[: len(y) - done], y[done:])
        done *= 2
    if done < width:
        y = f(y[: len(y) - (width - done)], y[width - done :])
    return y


class Chunk:
    """A chunk's documents in one padded buffer, with the places of selected strings."""

    def __init__(self, table: pa.Table):
        ids = ids_of(table)
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        texts = text_bytes(table)
        self.texts = [texts[i] for i in self.order]
        size = np.array([len(t) for t in self.texts], np.int64)
        self.start = WINDOW + np.concatenate([[0], np.cumsum(size + WINDOW)])[:-1].astype(np.int64)
        self.size = size
        self.buf = np.full(int(size.sum()) + WINDOW * (len(size) + 1), PAD, np.uint8)
        for t, s in zip(self.texts, self.start.tolist()):
            self.buf[s : s + len(t)] = np.frombuffer(t, np.uint8)
        self._select()

    def _select(self):
        at, hashes, i, n = [], [], 0, len(self.size)
        while i < n:
            j, total = i, 0
            while j < n and (j == i or total + self.size[j] < BLOCK):
                total += self.size[j]
                j += 1
            lo, hi = int(self.start[i]) - WINDOW, int(self.start[j - 1] + self.size[j - 1]) + WINDOW
            p, h = self._block(i, j, lo, hi)
            at.append(p + lo)
            hashes.append(h)
            i = j
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.hash = mix(np.concatenate(hashes)) if hashes else np.zeros(0, _U)
        self.doc = np.searchsorted(self.start, self.at, "right") - 1

    def _block(self, i, j, lo, hi):
        b = self.buf[lo:hi]
        h = gram_hashes(b)
        low = _sliding(h, SPAN, np.minimum)  # of the window from each place
        mark = np.zeros(len(low) + 1, np.int8)
        long = self.size[i:j] >= WINDOW
        first = self.start[i:j][long] - lo
        mark[first] += 1
        mark[first + self.size[i:j][long] - WINDOW + 1] -= 1
        low = np.where(np.cumsum(mark[:-1], dtype=np.int8) > 0, low, _U(0))
        edge = np.zeros(SPAN - 1, _U)
        high = _sliding(np.concatenate([edge, low, edge]), SPAN, np.maximum)
        p = np.flatnonzero(high[: len(h)] == h)
        return p, h[p]

    def keys(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Each selected string's shard and 32-bit fingerprint."""
        return ((self.hash >> _U(33)) % _U(shards)).astype(np.int64), (self.hash & _U(0xFFFFFFFF)).astype(np.int64)

    def distinct(self, shards: int):
        """Sorted distinct (shard, fingerprint); whether two ids have it; inverse order."""
        shard, fp = self.keys(shards)
        key = (shard << 32) | fp
        order = np.argsort(key, kind="stable")
        k = key[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(k)) - 1 if len(k) else first
        owner = self.ids[self.doc[order]]
        return k[first], owner[first] != owner[last], order, first

    def units(self, at: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(self.buf, UNIT)
        return view[at - (WINDOW - GRAM)]


def unit_hashes(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of hash, and 16 bits of another."""
    n = len(units)
    wide = np.zeros((n, -(-UNIT // 8) * 8), np.uint8)
    wide[:, :UNIT] = units
    h, g = np.full(n, _U(0x243F6A8885A308D3)), np.full(n, _U(0x13198A2E03707344))
    for c in wide.view(_U).T:
        h = (h ^ c) * _U(0x9FB21C651E98DF25)
        h ^= h >> _U(35)
        g = (g + c) * _U(0xC2B2AE3D27D4EB4F)
        g ^= g >> _U(31)
    return mix(h), (mix(g) >> _U(48)).astype(np.uint16)


def _split(sorted_shard: np.ndarray, shards: int) -> np.ndarray:
    return np.searchsorted(sorted_shard, np.arange(shards + 1))


def _ask(shards: int, name: str):
    """Chunk -> shards: the selected strings' fingerprints."""

    def f(table: pa.Table) -> pa.Table:
        c = Chunk(table)
        key, several, _, _ = c.distinct(shards)
        cut = _split(key >> 32, shards)
        fp = (key & 0xFFFFFFFF).astype(np.uint32)
        return pa.table({
            "shard": pa.array(range(shards), pa.int32()),
            "chunk": pa.array([table[name][0].as_py()] * shards, pa.int32()),
            "fps": pa.array([fp[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
            "several": pa.array([np.packbits(several[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
        })

    return f


def _shared(table: pa.Table) -> pa.Table:
    """Shard -> chunks: a bit for each fingerprint that two documents share."""
    fps = [np.frombuffer(x, np.uint32) for x in table["fps"].to_pylist()]
    size = np.array([len(x) for x in fps])
    several = [np.unpackbits(np.frombuffer(x, np.uint8))[:n] for x, n in zip(table["several"].to_pylist(), size)]
    fp, weight = np.concatenate(fps), 1 + np.concatenate(several).astype(np.int64)
    order = np.argsort(fp)
    s = fp[order]
    flags = np.zeros(len(fp), bool)
    if len(s):
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        often = np.add.reduceat(weight[order], first) >= 2
        flags[order] = np.repeat(often, np.diff(np.append(first, len(s))))
    cut = np.concatenate([[0], np.cumsum(size)])
    return pa.table({"chunk": table["chunk"], "shard": table["shard"], "bits": pa.array([np.packbits(flags[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())})


def _send(shards: int, name: str):
    """Chunk + bits -> shards: distinct units of shared strings, each with its smallest id."""

    def f(docs: pa.Table, bits: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _UNITS.empty_table()
        c = Chunk(docs)
        key, _, order, first = c.distinct(shards)
        cut = _split(key >> 32, shards)
        shared = np.zeros(len(key), bool)
        for s, x in zip(bits["shard"].to_pylist(), bits["bits"].to_pylist()):
            shared[cut[s] : cut[s + 1]] = np.unpackbits(np.frombuffer(x, np.uint8))[: cut[s + 1] - cut[s]]
        take = order[np.repeat(shared, np.diff(np.append(first, len(order))))]
        units = c.units(c.at[take])
        h, check = unit_hashes(units)
        shard, _ = c.keys(shards)
        shard, owner = shard[take], c.ids[c.doc[take]]
        best = np.lexsort((owner, check, h, shard))
        sh, hh, as_bytes = shard[best], h[best], np.ascontiguousarray(units).view(f"V{UNIT}").reshape(-1)[best]
        # Of equal units the one of the smallest id; of equal hashes with other bytes, all.
        one = best[np.concatenate([[True], (hh[1:] != hh[:-1]) | (sh[1:] != sh[:-1]) | (as_bytes[1:] != as_bytes[:-1])])] if len(best) else best
        cut = _split(shard[one], shards)
        rows = [one[a:b] for a, b in zip(cut[:-1], cut[1:])]
        full = [s for s in range(shards) if len(rows[s])]
        packed = lambda x: pa.array([x[rows[s]].tobytes() for s in full], pa.binary())
        return pa.table({
            "shard": pa.array(full, pa.int32()), "chunk": pa.array([docs[name][0].as_py()] * len(full), pa.int32()),
            "units": packed(units), "owners": packed(owner),
        }, schema=_UNITS)

    return f


_UNITS = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("units", pa.binary()), ("owners", pa.binary())])


def _classes(group: np.ndarray) -> np.ndarray:
    return np.unique(group, return_inverse=True)[1].reshape(-1).astype(np.int64)


def window_owners(units: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For each unit and window within it, the smallest owner of an equal window at the
    same place around an equal string. A radix sort by most significant digit: the shared
    string first, then one byte to the left and one to the right a pass; it ends where the
    window does, and rows that are alone in their group leave it early."""
    n = len(units)
    out = np.repeat(owners[:, None], SPAN, 1)
    if not n:
        return out
    left_edge = WINDOW - GRAM  # the string's place in a unit
    core = np.ascontiguousarray(units[:, left_edge : left_edge + GRAM]).view(">u8").astype(_U)
    group = np.zeros(n, np.int64)
    for c in core.T:
        group = _classes_of(group, c)
    live = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(live):
        return out
    u, own, group = units[live], owners[live], _classes(group[live])
    left, right = [group], [group]
    for k in range(SPAN - 1):
        left.append(_classes(left[-1] * 256 + u[:, left_edge - 1 - k]))
        right.append(_classes(right[-1] * 256 + u[:, left_edge + GRAM + k]))
    for j in range(SPAN):  # the window from byte j of the unit: j .. j + WINDOW
        pair = left[SPAN - 1 - j] * (int(right[j].max()) + 1) + right[j]
        order = np.lexsort((own, pair))
        p = pair[order]
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        least = np.repeat(own[order][first], np.diff(np.append(first, len(p))))
        col = np.empty(len(p), np.int64)
        col[order] = least
        out[live, j] = col
    return out


def _classes_of(group: np.ndarray, digit: np.ndarray) -> np.ndarray:
    order = np.lexsort((digit, group))
    g, d = group[order], digit[order]
    new = np.concatenate([[0], np.cumsum((g[1:] != g[:-1]) | (d[1:] != d[:-1]))])
    out = np.empty(len(group), np.int64)
    out[order] = new
    return out


def _sort(table: pa.Table) -> pa.Table:
    """Shard -> chunks: for each unit, a bit for each window that a smaller id has."""
    owners = [np.frombuffer(x, np.int64) for x in table["owners"].to_pylist()]
    cut = np.concatenate([[0], np.cumsum([len(x) for x in owners])])
    owners = np.concatenate(owners)
    units = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, UNIT) for x in table["units"].to_pylist()])
    # Equal units of several chunks are one, by their bytes, with the smallest owner.
    as_bytes = np.ascontiguousarray(units).view(f"V{UNIT}").reshape(-1)
    h, check = unit_hashes(units)
    order = np.lexsort((owners, h))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (as_bytes[order][1:] != as_bytes[order][:-1])]) if len(h) else np.zeros(0, bool)
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    one = order[new]
    first = window_owners(units[one], owners[one])[which] < owners[:, None]
    valid = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros((len(units), 1), np.int32), np.cumsum(units == PAD, 1, dtype=np.int32)], 1), WINDOW + 1, axis=1)
    valid = valid[:, :, -1] == valid[:, :, 0]
    weight = np.uint32(1) << np.arange(SPAN, dtype=np.uint32)
    early, valid = (first & valid) @ weight, valid @ weight  # SPAN bits each
    pack = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())
    return pa.table({"chunk": table["chunk"], "hashes": pack(h), "checks": pack(check), "owners": table["owners"], "early": pack(early), "valid": pack(valid)})


def _gone(c: Chunk, answers: pa.Table) -> np.ndarray:
    """Which bytes of a chunk's buffer go."""
    covered = np.zeros(WINDOW - 1 + len(c.buf), bool)  # from each place of a window that goes, after as many places as one can reach back
    if answers.num_rows and len(c.at):
        col = lambda n, t: np.concatenate([np.frombuffer(x, t) for x in answers[n].to_pylist()])
        h, check, owner, early, valid = col("hashes", _U), col("checks", np.uint16), col("owners", np.int64), col("early", np.uint32), col("valid", np.uint32)
        order = np.lexsort((check, h))
        h, check, owner, early, valid = h[order], check[order], owner[order], early[order], valid[order]
        step, after = 1 << 17, np.append(h[1:], ~h[-1])
        for a in range(0, len(c.at), step):
            at = c.at[a : a + step]
            own, own_check = unit_hashes(c.units(at))
            i = np.minimum(np.searchsorted(h, own), len(h) - 1)
            while len(again := np.flatnonzero((h[i] == own) & (check[i] < own_check) & (np.append(h[1:], ~h[-1])[i] == own))):
                i[again] += 1  # the same 64 bits, another unit
            hit = np.flatnonzero((h[i] == own) & (check[i] == own_check))
            i, p = i[hit], at[hit]
            bits = np.where(c.ids[c.doc[a : a + step][hit]] > owner[i], valid[i], early[i])
            for j in range(SPAN):
                covered[p[(bits >> j) & 1 == 1] + (GRAM - 1) + j] = True
    return _sliding(covered, WINDOW, np.maximum)


def _runs(gone: np.ndarray) -> list[list[int]]:
    """(start, end) of each run of removed bytes."""
    return np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2).tolist()


def _report(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Rows of ``remove_repeats``."""
    if not docs.num_rows:
        return _OUT.empty_table()
    c = Chunk(docs)
    gone = _gone(c, answers)
    spans, kept, removed = [], [], []
    for s, n in zip(c.start.tolist(), c.size.tolist()):
        g = gone[s : s + n]
        spans.append([{"start": a, "end": b} for a, b in _runs(g)])
        removed.append(int(g.sum()))
        kept.append(c.buf[s : s + n][~g].tobytes() if removed[-1] else c.buf[s : s + n].tobytes())
    ids = docs["doc_id"].combine_chunks().take(pa.array(c.order))
    return pa.table({
        "doc_id": ids.cast(pa.int64()), "n_bytes": pa.array(c.size, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
        "spans": pa.array(spans, _OUT.field("spans").type), "kept": pa.array(kept, pa.binary()),
    }, schema=_OUT)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _cut(names: list[str]):
    """The rows themselves, with texts cut and n_chars counted anew."""

    def f(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return docs.select(names)
        c = Chunk(docs)
        gone = _gone(c, answers)
        texts, sizes = docs["text"].to_pylist(), docs["n_chars"].to_pylist() if "n_chars" in names else None
        for k, s, n in zip(c.order.tolist(), c.start.tolist(), c.size.tolist()):
            if gone[s : s + n].any():
                texts[k] = _without(c.buf[s : s + n].tobytes(), _runs(gone[s : s + n]))
            if sizes is not None:
                sizes[k] = None if texts[k] is None else len(texts[k])
        new = {"text": texts} | ({} if sizes is None else {"n_chars": sizes})
        return pa.table([pa.array(new[n], docs.schema.field(n).type) if n in new else docs[n] for n in names], names=names)

    return f


def _in_chunks(docs: DataFrame, finish, schema) -> DataFrame:
    """The three rounds of messages over ``docs`` (doc_id, text and what ``finish`` needs)."""
    chunks = n_chunks(docs)
    shards, name = n_shards(chunks), free_name("chunk", docs.columns)
    by_chunk = chunked(docs, chunks, name).groupBy(name)
    asked = by_chunk.applyInArrow(tidy_group(_ask(shards, name)), "shard int, chunk int, fps binary, several binary")
    bits = asked.groupBy("shard").applyInArrow(tidy_group(_shared), "chunk int, shard int, bits binary")
    sent = by_chunk.cogroup(bits.groupBy("chunk")).applyInArrow(tidy_pair(_send(shards, name)), "shard int, chunk int, units binary, owners binary")
    answers = sent.groupBy("shard").applyInArrow(tidy_group(_sort), "chunk int, hashes binary, checks binary, owners binary, early binary, valid binary")
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(tidy_pair(finish), schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, spans (removed runs of bytes), kept (bytes left)."""
    return _in_chunks(with_text(docs), _report, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with repeated windows cut from their texts and n_chars counted
    anew (for the pipeline). A character goes if all of its bytes do, so texts stay valid
    UTF-8. Every row stays, null texts stay null, and rows with equal or no doc_id are cut by
    their own texts."""
    return _in_chunks(docs, _cut(docs.columns), docs.schema)


def _without(data: bytes, spans: list[list[int]]) -> str:
    kept, at = [], 0
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b < len(data) and b > a and data[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(data[at:a])
        at = max(a, b)
    return b"".join([*kept, data[at:]]).decode()
