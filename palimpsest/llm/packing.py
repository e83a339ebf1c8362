"""Packing of tokenized documents into sequences of at most ``LIMIT`` tokens.

Pieces are planned by length alone. The histogram of lengths has at most ``LIMIT`` entries
at any size of the corpus, so the plan is made on the driver: for each length, longest
first, an index of single, pair and triple sums of the lengths that are left gives the
combinations that fill its gap exactly, and each is consumed as often as its counts allow;
what remains is packed best fit, longest first, whole runs of equal lengths at a time.
Every step empties a length or a run, so a plan has a few rows for each length.

Pieces get their place by rank within their length. Ranks are counted in buckets of a hash,
so a length that a third of all pieces have is ranked in many tasks.

Null and empty texts are one piece with the end token alone. Repeated rows are packed each.
Extra columns are ignored. An empty table gives no pieces. Long texts are cut, never lost.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpoint, give_back, kept, slices, tidy, with_text

LIMIT = 4096
#: The id after each document.
END = 1
#: Entries of either generation of a worker's cache of words.
CACHE = 400_000
#: Characters whose words a worker holds as objects at a time.
AT_ONCE = 1 << 20
#: Characters that are one lower-case character each in lower case, and stable in any normal form: Latin letters up to
#: U+017F but for one that becomes two.
_SIMPLE = re.compile("[\0-\u012f\u0131-\u017f]*").fullmatch
#: Of each line: a lower-case word of letters with the marks around it (an apostrophe before letters may be a contraction),
#: or three empty strings.
_SHAPES = re.compile("^(?:([!-&(-/:-@\\[-`{-~]*+)([a-zà-öø-ÿ]++)([!-/:-@\\[-`{-~]*+)|.*)$", re.MULTILINE).findall


@contextmanager
def one_thread(name: str = "TOKENIZERS_PARALLELISM"):
    """The tokenizers library starts no threads in here: a task has one core, and threads that wait for words cost it time."""
    before = os.environ.get(name)
    os.environ[name] = "false"
    try:
        yield
    finally:
        del os.environ[name]
        if before is not None:
            os.environ[name] = before


class WordEncoder:
    """Ids of texts by a tokenizer that never looks across a space, with a cache of words.

    A text's ids are those of its space-separated words one after another: the vocabulary's
    normaliser and word pattern don't join across a space, and neither do they join letters
    with the marks around them. So lower-case words of letters go to the tokenizer's model
    in batches, runs of marks are kept by themselves, and all other words go to the tokenizer
    as they are. Texts of plain Latin characters are put in lower case at once, as the
    normaliser does with each character. The cache has two generations: when the younger is
    full it becomes the older, whose words move over when they are met again."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.full.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.cache = cache
        self.words: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _plain(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words of letters."""
        texts = [w if w.isascii() else "".join(map(self.alphabet.__getitem__, w.encode())) for w in words]
        got = self.bare.encode_batch_fast([" ".join(texts[i : i + 64]) for i in range(0, len(texts), 64)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in got])
        cut = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        if len(cut) != len(words) + 1:
            raise ValueError("the vocabulary doesn't mark the ends of words")
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cut, cut[1:])]

    def _direct(self, words: list[str]) -> None:
        """Words as they are, some hundred at a time (a long word's encoding is large)."""
        for at in range(0, len(words), 256):
            some = words[at : at + 256]
            for w, e in zip(some, self.full.encode_batch_fast(some, add_special_tokens=False)):
                self.words[w] = np.array(e.ids, "<u4").tobytes()

    def _held(self, words: list[str]) -> tuple[list[bytes | None], list[str]]:
        """Ids of distinct words, and the words that neither generation has; those that the older has move over."""
        ids, older, lacking = [*map(self.words.get, words)], self.older.get, []
        for i, x in enumerate(ids):
            if x is None:
                w = words[i]
                if (x := older(w)) is None:
                    lacking.append(w)
                else:
                    ids[i] = self.words[w] = x
        return ids, lacking

    def learn(self, words: list[str]) -> None:
        """Ids of words without white space, distinct ones that neither generation has."""
        text = "\n".join(words)
        shapes = _SHAPES(text)
        if "<|" in text:
            shapes = [("", "", "") if "<|" in w else x for w, x in zip(words, shapes)]
        letters, marked, odd = [], [], []
        for w, x in zip(words, shapes):
            if len(x[1]) == len(w):
                letters.append(w)
            elif x[1]:
                marked.append((w, x))
            else:
                odd.append(w)
        self._direct(odd)
        self._direct(self._held([*{m for _, (a, _, z) in marked for m in (a, z)}])[1])
        cores = {x[1] for _, x in marked}
        cores.difference_update(letters)
        letters += self._held([*cores])[1]
        if letters:
            self.words.update(zip(letters, self._plain(letters)))
        get = self.words
        for w, (a, c, z) in marked:
            get[w] = get[a] + get[c] + get[z]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers. Words are numbered and their ids put together by Arrow;
        only distinct ones become objects."""
        if len(self.words) > self.cache:
            self.older, self.words = self.words, {"": b""}
        # A special token's name is read as it is written, so texts with its beginning keep their case (and such words are whole).
        texts = [t.lower() if "<|" not in t and (t.isascii() or _SIMPLE(t)) else t for t in texts]
        split = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids, lacking = self._held(words)
        if lacking:
            with one_thread():
                self.learn(lacking)
            get = self.words.__getitem__
            ids = [get(w) if x is None else x for w, x in zip(words, ids)]
        flat = pa.array(ids, pa.large_binary()).take(coded.indices)
        data = memoryview(flat.buffers()[2] or b"")
        at = np.frombuffer(flat.buffers()[1], np.int64)[split.offsets.to_numpy()].tolist() if texts else [0]
        return [bytes(data[a:b]) for a, b in zip(at, at[1:])]


def encoder(path: str) -> WordEncoder:
    held = kept("packing")
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END, at_once: int = AT_ONCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, cut only where it is longer."""
    tail = np.array([end], "<u4").tobytes()

    def rows(batch):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        out, at = [], 0
        code = encoder(path)
        while at < len(ids):
            to, total = at, 0
            while to < len(ids) and total < at_once:
                total += len(texts[to])
                to += 1
            for i, x in zip(ids[at:to], code.encode(texts[at:to])):
                x += tail
                for p, a in enumerate(range(0, len(x), 4 * limit)):
                    part = x[a : a + 4 * limit]
                    out.append((i, p, a // 4, len(part) // 4, zlib.crc32(part)))
            at = to
        return out

    def f(batches):
        for b in slices(batches, 2048):
            cols = [list(c) for c in zip(*rows(b))] or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
            if at_once <= AT_ONCE:
                give_back()

    return with_text(docs).mapInArrow(tidy(f, "packing"), "doc_id long, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[int, list[tuple[int, int]]]  # how many sequences; (length, how often in each)


def exact_patterns(left: np.ndarray, limit: int) -> list[Pattern]:
    """Consume lengths whose gaps one, two or three others fill exactly; ``left`` is reduced."""
    out: list[Pattern] = []

    def consume(lengths: list[int]) -> bool:
        need = Counter(lengths)
        n = min(int(left[x]) // k for x, k in need.items())
        if n:
            for x, k in need.items():
                left[x] -= n * k
            out.append((n, sorted(need.items(), reverse=True)))
        return n > 0

    def pair(total: int, fixed: list[int]) -> bool:
        """Two lengths that sum to ``total``, the larger as large as can be."""
        here = left[:total] > 0
        both = np.flatnonzero(here[1:] & here[:0:-1]) + 1
        for b in both[both * 2 >= total][::-1].tolist():
            if consume([*fixed, b, total - b]):
                return True
        return False

    def triple(total: int, fixed: list[int]) -> bool:
        here = (left[:total] > 0).astype(np.float64)
        size = 1 << (2 * total).bit_length()
        sums = np.fft.irfft(np.fft.rfft(here, size) ** 2, size)[:total] > 0.5  # the index of pair sums
        largest = np.flatnonzero((here[1:] > 0) & sums[:0:-1]) + 1
        return any(pair(total - c, [*fixed, c]) for c in largest[::-1].tolist())

    for x in range(limit, 0, -1):
        while left[x]:
            gap = limit - x
            if not (consume([x]) if gap == 0 else consume([x, gap]) or pair(gap, [x]) or triple(gap, [x])):
                break
    return out


def best_fit(left: np.ndarray, limit: int) -> list[Pattern]:
    """Best fit, longest first, over runs of equal lengths and runs of equal sequences."""
    open_: list[list[tuple[int, dict[int, int]]]] = [[] for _ in range(limit + 1)]  # by gap
    for x in range(limit, 0, -1):
        n = int(left[x])
        for gap in range(x, limit + 1):
            if not n:
                break
            runs, open_[gap] = open_[gap], []
            each = gap // x
            for count, has in runs:
                full = min(count, n // each)
                if full:
                    open_[gap - each * x].append((full, has | {x: has.get(x, 0) + each}))
                    n -= full * each
                    count -= full
                if count and n:  # fewer than fill one sequence are left
                    open_[gap - n * x].append((1, has | {x: has.get(x, 0) + n}))
                    count, n = count - 1, 0
                if count:
                    open_[gap].append((count, has))
        if n:
            each = limit // x
            if n // each:
                open_[limit - each * x].append((n // each, {x: each}))
            if n % each:
                open_[limit - n % each * x].append((1, {x: n % each}))
    return [(count, sorted(has.items(), reverse=True)) for runs in open_ for count, has in runs]


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[Pattern]:
    """Exact complements and then best fit; or best fit alone, should that need fewer
    sequences (it can where few pieces are left to choose from)."""
    left = np.zeros(limit + 1, np.int64)
    for x, n in histogram.items():
        left[x] = n
    alone = best_fit(left, limit)
    exact = exact_patterns(left, limit)
    return min(exact + best_fit(left, limit), alone, key=lambda patterns: sum(n for n, _ in patterns))


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length the runs of ranks that go to a pattern's sequences."""
    rank: Counter = Counter()
    rows, base = [], 0
    for count, items in patterns:
        offset = 0
        for length, each in items:
            rows.append((length, rank[length], base, each, offset))
            rank[length] += count * each
            offset += length * each
        base += count
    rows.sort()
    names = ("length", "rank", "sequence", "each", "offset")
    return {k: np.array(v, np.int64) for k, v in zip(names, zip(*rows) if rows else [[]] * 5)}


def pack(parts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``parts`` with sequence_id and offset. It is read three times: give it checkpointed."""
    buckets = max(64, parts.count() // 1_000_000)
    bucket = F.pmod(F.xxhash64("doc_id", "piece", F.lit("rank")), F.lit(buckets)).cast("int")
    parts = parts.withColumn("bucket", bucket)
    sizes = parts.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``limit`` rows
    at = slots(plan(counts, limit))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")))
    ranked = ranked.join(sizes, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("r") - 1).drop("before", "r", "bucket")
    key = (at["length"] << 44) | at["rank"]

    def f(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(key, (length << 44) | rank, "right") - 1
            k = rank - at["rank"][i]
            seq, nth = at["sequence"][i] + k // at["each"][i], k % at["each"][i]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(seq), pa.array(at["offset"][i] + nth * length)], names=[*names, "sequence_id", "offset"]
            )

    names = [f.name for f in parts.schema if f.name != "bucket"]
    return ranked.select(*names, "rank").mapInArrow(tidy(f, "packing"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema if f.name != "bucket") + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END, at_once: int = AT_ONCE) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A larger ``at_once``
    takes a little less time and more of a worker's memory."""
    return pack(checkpoint(pieces(docs, path, limit, end, at_once)), limit)


def lengths_fit(lengths: list[int], limit: int = LIMIT) -> int:
    """Sequences that a plan needs for these lengths."""
    return sum(n for n, _ in plan(Counter(lengths), limit))
