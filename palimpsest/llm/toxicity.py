"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is a hashed word embedding plus the mean of hashed embeddings of its
character n-grams. Windows of ``WINDOW`` words that overlap by half run through a gated
recurrent unit in either direction; attention pools the states into one vector and a
logistic unit scores it. A document's score is that of its worst window, so a short attack
in a long text counts, and every word is in two windows (but at the ends).

Training sees a bounded number of labelled rows, each with its whole text: at most ``SAMPLE`` toxic ones and
``CLEAN`` times as many clean ones, chosen by a hash of the id. One task trains on them and keeps four bytes for each of their words. Labels are of documents, not of windows, so after a first look at
random windows, a toxic document teaches by its highest windows and a clean one by its
highest and a random one. A small sample is gone through more often. The sample's rows, the tables and so
the broadcast model are of fixed size. Scoring covers all rows and whole texts, and a word's projections are computed
once a batch, however often it occurs.

Only text goes in. Null and empty texts score 0. Where no toxic row is labelled all scores
are 0; where only toxic rows are, texts with words score 1. Repeated rows are scored each.
Rows whose id has several labels count as toxic if one says so; of several texts of one id the smallest teaches. Extra
columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices, tidy, with_text

WINDOW, STRIDE = 32, 16
DIM, HIDDEN, ATTENTION = 16, 12, 12
#: Rows of either embedding table, and the lengths of character n-grams.
ROWS, GRAMS = 1 << 16, (3, 4, 5)
#: Toxic training documents at most, and CLEAN times as many clean ones.
SAMPLE, CLEAN = 1000, 5
#: Training steps (a third of them at random windows), windows of a step, and the mean loss of a round that is small enough.
STEPS, BATCH, ENOUGH = 500, 128, 0.005
_U = np.uint64
STRIP = ".,;:!?\"'()[]"


def _blocks(items: list, size: int) -> Iterator[list]:
    for a in range(0, len(items), size):
        yield items[a : a + size]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


class Words:
    """Distinct words of some texts, with the rows of the tables that each one reads."""

    def __init__(self, texts: Iterable[str]):
        number: dict[str, int] = {}
        put = number.setdefault
        ids = []
        for t in texts:  # one text's words are objects at a time
            split = t.lower().split()
            ids.append(np.fromiter((put(w, len(number)) for w in split), np.int32, len(split)))
        self.ids = np.concatenate([np.zeros(0, np.int32), *ids])
        self.size = np.array([len(x) for x in ids], np.int64)
        parts = [self._rows(block) for block in _blocks(list(number), 1 << 14)]
        self.word = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in parts)])
        self.count = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in parts)])
        self.grams = np.concatenate([np.zeros(0, np.uint16), *(x[2] for x in parts)])
        self.first = np.cumsum(self.count) - self.count

    @staticmethod
    def _rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's row, its number of n-grams, and the n-grams' rows one after another."""
        spelled = [b"^" + (w.strip(STRIP) or w).encode() + b"$" for w in words]
        n = np.array([len(x) for x in spelled], np.int64)
        buf = np.frombuffer(b"".join(spelled) + b"\0" * max(GRAMS), np.uint8).astype(_U)
        first = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
        place = np.arange(len(owner)) - first[owner]
        rows, owners = [], []
        h = np.zeros(len(owner), _U)
        for k in range(max(GRAMS)):
            h = (h + buf[k : k + len(owner)] + _U(1)) * _U(0x9E3779B97F4A7C15)
            h ^= h >> _U(29)
            if k + 1 in GRAMS:
                fits = place + k + 1 <= n[owner]
                rows.append((((h[fits] * _U(0xD6E8FEB86659FD93)) >> _U(40)) % _U(ROWS)).astype(np.uint16))
                owners.append(owner[fits])
        power = (place.astype(_U) + _U(1)) * _U(0x9FB21C651E98DF25)
        word = np.add.reduceat((buf[: len(owner)] + _U(7)) * (power ^ (power >> _U(31))), first)
        word = (((word ^ (word >> _U(30))) * _U(0xBF58476D1CE4E5B9)) >> _U(40)).astype(np.int64) % ROWS
        owners, rows = np.concatenate(owners), np.concatenate(rows)
        return word, np.bincount(owners, minlength=len(n)), rows[np.argsort(owners, kind="stable")]

    def only(self, win: np.ndarray) -> tuple[Words, np.ndarray]:
        """These windows' words alone, and the windows in their numbers."""
        used = np.unique(win[win > 0]) - 1
        out = object.__new__(Words)
        out.word, out.count = self.word[used], self.count[used]
        out.first = np.cumsum(out.count) - out.count
        each = np.repeat(np.arange(len(used)), out.count)
        out.grams = self.grams[self.first[used][each] + np.arange(len(each)) - out.first[each]]
        return out, np.where(win > 0, np.searchsorted(used, win - 1) + 1, 0)

    def windows(self, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers plus one (0: none) by window, and each window's text."""
        n = np.where(self.size > 0, 1 + np.maximum(0, -(-(self.size - WINDOW) // stride)), 0)
        text = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        at = (nth[:, None] * stride + np.arange(WINDOW)).astype(np.int32)
        inside = at < self.size[text][:, None]
        start = (np.cumsum(self.size) - self.size)[text]
        where = np.where(inside, start[:, None] + at, 0)
        return np.where(inside, self.ids[where] + 1 if len(self.ids) else 0, 0), text


class Network:
    """Both directions are computed side by side: their arrays begin with an axis of two."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else s[0])).astype(np.float32)
        self.p = {"word": 0.1 * r.standard_normal((ROWS, DIM)).astype(np.float32), "gram": 0.3 * r.standard_normal((ROWS, DIM)).astype(np.float32)}
        self.p |= {"W": init(2, DIM, 3 * HIDDEN), "U": init(2, HIDDEN, 3 * HIDDEN), "c": np.zeros((2, 1, 3 * HIDDEN), np.float32)}
        self.p |= {"A": init(2 * HIDDEN, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": init(ATTENTION), "o": init(2 * HIDDEN), "q": np.zeros(1, np.float32)}

    def embed(self, w: Words) -> np.ndarray:
        """A row for each distinct word, after one of zeros for none."""
        out = np.zeros((1 + len(w.word), DIM), np.float32)
        for a in range(0, len(w.word), 1 << 14):
            first, count = w.first[a : a + (1 << 14)], w.count[a : a + (1 << 14)]
            x = self.p["word"][w.word[a : a + (1 << 14)]]
            some = count > 0
            if some.any():
                lo, hi = int(first[0]), int(first[-1] + count[-1])
                x[some] += np.add.reduceat(self.p["gram"][w.grams[lo:hi]], first[some] - lo, axis=0) / count[some, None].astype(np.float32)
            out[1 + a : 1 + a + len(x)] = x
        return out

    def project(self, x: np.ndarray) -> np.ndarray:
        """What each word adds to the gates, for either direction: once for all windows."""
        return x @ self.p["W"] + self.p["c"]

    def _run(self, proj: np.ndarray, win: np.ndarray, saved: list | None) -> np.ndarray:
        """States by place and window, of both directions one after the other; what the
        backward pass needs goes to ``saved``, by step."""
        b, u = len(win), self.p["U"]
        word = np.ascontiguousarray(win.T)
        live, full = (word > 0)[:, :, None], bool(win.all())
        kind = proj.dtype
        states = np.empty((WINDOW, b, 2 * HIDDEN), kind)
        x, g, h = np.empty((2, b, 3 * HIDDEN), kind), np.empty((2, b, 3 * HIDDEN), kind), np.zeros((2, b, HIDDEN), kind)
        for t in range(WINDOW):
            places = (t, WINDOW - 1 - t)
            for d in (0, 1):
                np.take(proj[d], word[places[d]], axis=0, out=x[d], mode="clip")
            np.matmul(h, u, out=g)
            zr = x[:, :, : 2 * HIDDEN] + g[:, :, : 2 * HIDDEN]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
            n = np.tanh(x[:, :, 2 * HIDDEN :] + r * g[:, :, 2 * HIDDEN :])
            new = n + z * (h - n)
            if not full:
                on = live[list(places)]
                new = np.where(on, new, h)
            if saved is not None:
                saved.append((h, z, r, n, g[:, :, 2 * HIDDEN :].copy(), None if full else on))
            h = new
            for d in (0, 1):
                states[places[d], :, d * HIDDEN : (d + 1) * HIDDEN] = h[d]
        return states

    def forward(self, proj: np.ndarray, win: np.ndarray, keep: bool = False):
        saved: list | None = [] if keep else None
        h = self._run(proj, win, saved)
        u = np.tanh(h @ self.p["A"] + self.p["a"])
        s = np.where(win.T > 0, u @ self.p["v"], np.float32(-1e9))
        s = np.exp(s - s.max(0))
        alpha = s / s.sum(0)
        pooled = np.einsum("tb,tbh->bh", alpha, h)
        y = 1 / (1 + np.exp(-(pooled @ self.p["o"] + self.p["q"])))
        return (y, (h, u, alpha, pooled, saved)) if keep else y

    def all_windows(self, w: Words, win: np.ndarray, block: int = 1024) -> np.ndarray:
        """Scores of many windows; those without a gap run together, which costs less."""
        x, out = self.embed(w), np.zeros(len(win), np.float32)
        short = (win == 0).any(1)
        for which in (np.flatnonzero(~short), np.flatnonzero(short)):
            for a in range(0, len(which), 16 * block):
                used, own = np.unique(win[which[a : a + 16 * block]], return_inverse=True)
                own, gap = own.reshape(-1, WINDOW), int(not len(used) or used[0] != 0)
                proj = self.project(x[np.concatenate([np.zeros(gap, used.dtype), used])])
                for k in range(0, len(own), block):
                    out[which[a + k : a + k + block]] = self.forward(proj, own[k : k + block] + gap)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """Each text's highest window; 0 for a text without words."""
        w = Words(texts)
        win, text = w.windows()
        out = np.zeros(len(texts))
        np.maximum.at(out, text, self.all_windows(w, win).astype(float))
        return out

    def gradients(self, w: Words, win: np.ndarray, label: np.ndarray, x: np.ndarray | None = None) -> tuple[dict, float]:
        x = self.embed(w) if x is None else x
        y, (h, u, alpha, pooled, saved) = self.forward(self.project(x), win, True)
        p, g, b = self.p, {}, len(win)
        dy = ((y - label) / b).astype(x.dtype)
        g["o"], g["q"] = pooled.T @ dy, dy.sum(keepdims=True)
        dpool = dy[:, None] * p["o"]
        dalpha = (dpool * h).sum(2)
        ds = alpha * (dalpha - (alpha * dalpha).sum(0))
        g["v"] = np.einsum("tb,tba->a", ds, u)
        du = ds[:, :, None] * p["v"] * (1 - u * u)
        g["A"], g["a"] = np.einsum("tbh,tba->ha", h, du), du.sum((0, 1))
        dh_all = alpha[:, :, None] * dpool + du @ p["A"].T
        back = np.ascontiguousarray(p["U"].transpose(0, 2, 1))
        dh, dg_all, dproj = np.zeros((2, b, HIDDEN), x.dtype), np.empty((WINDOW, 2, b, 3 * HIDDEN), x.dtype), np.empty((WINDOW, b, 2, 3 * HIDDEN), x.dtype)
        for t in range(WINDOW - 1, -1, -1):
            before, z, r, n, gn, on = saved[t]
            places = (t, WINDOW - 1 - t)
            for d in (0, 1):
                dh[d] += dh_all[places[d], :, d * HIDDEN : (d + 1) * HIDDEN]
            here = dh if on is None else np.where(on, dh, 0)
            dn = here * (1 - z) * (1 - n * n)
            dz = here * (before - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r], 2, out=dg_all[t])
            for d in (0, 1):
                dproj[places[d], :, d] = np.concatenate([dz[d], dr[d], dn[d]], 1)
            dh = (here * z if on is None else np.where(on, here * z, dh)) + dg @ back
        before = np.stack([s[0] for s in saved])
        g["U"] = np.stack([before[:, d].reshape(-1, HIDDEN).T @ dg_all[:, d].reshape(-1, 3 * HIDDEN) for d in (0, 1)])
        # Every place's share goes to its word.
        word, dproj = win.T.reshape(-1), dproj.reshape(-1, 6 * HIDDEN)
        order = np.argsort(word, kind="stable")
        first = np.flatnonzero(np.diff(word[order], prepend=-1))
        sums = np.zeros((len(x), 6 * HIDDEN), x.dtype)
        sums[word[order][first]] = np.add.reduceat(dproj[order], first, axis=0)
        sums[0] = 0
        sums = sums.reshape(-1, 2, 3 * HIDDEN).transpose(1, 0, 2)
        g["W"], g["c"] = x.T @ sums, sums.sum(1, keepdims=True)
        dx = (sums @ p["W"].transpose(0, 2, 1)).sum(0)[1:]
        share = (dx / np.maximum(w.count, 1)[:, None]).astype(x.dtype)
        each = np.repeat(np.arange(len(w.word), dtype=np.int32), w.count)
        for name, rows, d, at in (("word", w.word, dx, None), ("gram", w.grams, share, each)):
            order = np.argsort(rows, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], rows[order][1:] != rows[order][:-1]])) if len(rows) else np.zeros(0, np.int64)
            g[name] = (rows[order][first], np.add.reduceat(d[order if at is None else at[order]], first, axis=0) if len(first) else d[:0])
        loss = -np.mean(np.log(np.where(label > 0.5, y, 1 - y) + 1e-7))
        return g, float(loss)


def train(texts: Iterable[str], toxic: list[int], seed: int = 0) -> Network:
    """Fit a network to labelled texts (of both classes), whole, in windows side by side.

    Rounds go on until the loss is small, for half of ``STEPS`` at least and four times ``STEPS``
    at most; so small samples are gone through many times. ``toxic`` is read after the texts."""
    rng, net = np.random.default_rng(seed), Network(seed)
    w = Words(texts)
    win, owner = w.windows(WINDOW)
    label = np.asarray(toxic, np.int64)[owner]
    first = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]])
    docs = [np.arange(a, b) for a, b in zip(first[:-1], first[1:])]
    clean = np.flatnonzero(label == 0)
    if not len(clean):
        return net
    m = {k: np.zeros_like(v) for k, v in net.p.items() if k not in ("word", "gram")}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    while step < 4 * STEPS:
        early, chosen, losses = step < STEPS // 3, [], []
        if not early:
            y = net.all_windows(w, win)
        for d in docs:
            if early:
                chosen.append(rng.choice(d, min(4, len(d)), replace=False) if len(d) > 1 else d)
            else:
                by = d[np.argsort(-y[d], kind="stable")]
                chosen.append(by[:2] if label[d[0]] == 0 else by[:1])
                if label[d[0]] == 0 and len(d) > 2:
                    chosen.append(rng.choice(d, 1))
        # Clean words over and over: what a single word that is not toxic must not do.
        chosen = np.concatenate(chosen)
        again = win[rng.choice(clean, len(chosen) // 3), rng.integers(0, WINDOW, len(chosen) // 3)]
        again = np.repeat(again[again > 0][:, None], WINDOW, 1)
        again[:, int(rng.integers(8, WINDOW)) :] = win[rng.choice(clean, len(again)), -1][:, None]
        shown, marks = np.concatenate([win[chosen], again]), np.concatenate([label[chosen], np.zeros(len(again), np.int64)])
        order = rng.permutation(len(shown))
        rate = 0.01 if step < 2 * STEPS else 0.005
        for a in range(0, len(order), BATCH):
            i = order[a : a + BATCH]
            part, own = w.only(shown[i])
            g, loss = net.gradients(part, own, marks[i].astype(np.float32))
            losses.append(loss)
            step += 1
            for k, v in g.items():
                if isinstance(v, tuple):  # rows of a table: steps by each one's own history
                    at, v = v
                    s[k][at] += v * v
                    net.p[k][at] -= 4 * rate * v / (np.sqrt(s[k][at]) + 1e-6)
                    continue
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if not early and step >= STEPS // 2 and np.mean(losses) < ENOUGH:
            break
    return net


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(text, toxic): at most ``size`` labelled training rows of either class."""
    marked = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.filter(~held_out(F.col("doc_id"))).withColumn("at", F.xxhash64("doc_id"))
    chosen = [marked.filter(F.col("toxic") == k).orderBy("at", "doc_id").limit(n) for k, n in ((0, CLEAN * size), (1, size))]
    few = F.broadcast(chosen[0].union(chosen[1]).select(F.col("doc_id").alias("i"), "toxic"))  # a bounded number of rows
    found = with_text(docs).join(few, F.col("doc_id") == F.col("i"))
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Network | float:
    """A model of the sample, or one score for all texts where a class is missing. One task
    trains, so the driver gets the model alone, and a lost executor's work is done again."""

    def f(batches):
        toxic: list[int] = []

        def texts():
            for b in batches:
                toxic.extend(b.column("toxic").to_pylist())
                yield from (t.as_py() for t in b.column("text"))

        net = train(texts(), toxic)
        one = 0.0 if 1 not in toxic else 1.0 if 0 not in toxic else None
        yield pa.RecordBatch.from_arrays([pa.array([one], pa.float64()), pa.array([pickle.dumps(net.p)], pa.binary())], names=["one", "model"])

    rows = sample(docs, labels, size).filter(r"text rlike '(?U)\\S'").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    got = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(tidy(f), "one double, model binary").first()
    if got is None or got["one"] is not None:
        return got["one"] if got else 0.0
    net = Network()
    net.p = pickle.loads(got["model"])
    return net


def _scored(model: Network | float, texts: list[str]) -> np.ndarray:
    """Scores of texts, some megabyte at a time."""
    if isinstance(model, float):
        return np.array([model if t.split() else 0.0 for t in texts])
    at, out = 0, [np.zeros(0)]
    while at < len(texts):
        to, total = at, 0
        while to < len(texts) and total < 1 << 20:
            total += len(texts[to])
            to += 1
        out.append(model.scores(texts[at:to]))
        at = to
    return np.concatenate(out)


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """(doc_id, score) of every row."""

    def f(batches):
        for b in slices(batches, 512):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_scored(model, b.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    return with_text(docs).mapInArrow(tidy(f), "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with all their columns as they are,
    in one pass. Null and empty texts stay, repeated rows are judged each, other columns may
    have any names and nulls, and an empty table gives an empty result."""
    model = learn(docs, labels)

    def f(batches):
        for b in slices(batches, 512):
            keep = _scored(model, [t or "" for t in b.column("text").to_pylist()]) < threshold
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(f), docs.schema)
