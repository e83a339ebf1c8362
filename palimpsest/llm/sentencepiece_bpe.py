"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here (a few fields of its wire format), and its parts are
built anew: the normaliser (dummy prefix, white space as U+2581, the rest as the model says),
pieces with scores (unigram models) or merges ranked by the scores of what they make (BPE
models), byte fallback, and the decoder. Where no piece has U+2581 after another character, what
starts at one never joins what stands before it; then texts are encoded as runs of words, and
a chunk's distinct words are encoded once, in multithreaded batches of strings of many words,
whose ids are cut at the words again. With other models texts are encoded whole. Each whole text is also normalised by the SentencePiece library, and each
distinct word (or whole text) encoded by it; a document's ``parity`` says whether the
normalised texts are the same and all of its ids agree.

Null and empty texts have no ids. Repeated rows are encoded each. Extra columns are
ignored. Texts are whole. An empty table gives an empty result. Decoding gives the
normalised text back; ``round_trip`` compares it.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import with_text

#: Entries of a worker's cache of words; a full one starts anew.
CACHE = 300_000
#: Words that are encoded as one string.
GROUP = 128
SPACE = "▁"
# Kinds of pieces and models in the protobuf.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of each field of one protobuf message."""
    at = 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 1:
            yield key >> 3, data[at : at + 8]
            at += 8
        elif kind == 5:
            yield key >> 3, struct.unpack("<f", data[at : at + 4])[0]
            at += 4
        else:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n


class Model:
    """What a .model file holds: pieces (text, score, kind) and the settings in use."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f.get(1, b"").decode(), f.get(2, 0.0), f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unk = trainer.get(40, 0)
        self.charsmap = normaliser.get(2, b"")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.collapse = bool(normaliser.get(4, 1))
        self.escape = bool(normaliser.get(5, 1))
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p, _, k in self.pieces if k in (NORMAL, USER))


def build(model: Model):
    """A tokenizer for normalised words (with U+2581 for white space already in them)."""
    from tokenizers import Tokenizer, decoders, models

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk, byte_fallback=model.byte_fallback)
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        usable = {p: s for p, s, k in model.pieces if k in (NORMAL, USER)}
        merges = []
        for p, s in usable.items():
            own = [(p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
            merges += [(-s, vocab[p], vocab[a], vocab[b], (a, b)) for a, b in own]
        merges.sort(key=lambda m: m[:4])
        core = models.BPE(vocab, [m[4] for m in merges], unk_token=model.pieces[model.unk][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    out.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    return out


class Encoder:
    """Ids of texts, with a cache of words and the library's own ids beside them."""

    def __init__(self, path: str):
        import sentencepiece
        from tokenizers import normalizers

        with open(path, "rb") as f:
            self.model = Model(f.read())
        self.tokenizer = build(self.model)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.charsmap = normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None
        #: Ids of words, and those words whose ids aren't the library's.
        self.words: dict[str, bytes] = {}
        self.unlike: set[str] = set()
        self.blank = np.array([p != "" and not p.strip(SPACE) for p, _, _ in self.model.pieces])
        self.starts = np.array([p.startswith(SPACE) for p, _, _ in self.model.pieces])

    def normalise(self, text: str) -> str:
        m = self.model
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if m.collapse:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if m.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE) if m.escape else text

    def split(self, text: str) -> list[str]:
        """Runs of U+2581, each with the characters up to the next; or the text as a whole."""
        if not self.model.words_apart:
            return [text] if text else []
        return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text)

    def _own(self, words: list[str]) -> list[list[int]]:
        """What the library makes of normalised words (or texts)."""
        if self.model.words_apart:
            # No piece crosses into a word, so the library's ids after another word are the word's own.
            first = len(self.library.encode("a"))
            own = self.library.encode(["a" * w.startswith(SPACE) + w.replace(SPACE, " ") for w in words], num_threads=1)
            return [o[first:] if w.startswith(SPACE) else o for w, o in zip(words, own)]
        cut = int(self.model.dummy_prefix)
        return self.library.encode([w[cut:].replace(SPACE, " ") for w in words], num_threads=1)

    def learn(self, words: list[str]) -> None:
        """Ids of words: many are read as one string where both encoders agree on it and the ids tell the words
        apart (each begins with U+2581, none ends with it, no unknown piece), and each by itself elsewhere."""
        alone = words
        if self.model.words_apart:
            joined = [w for w in words if w[0] == SPACE != w[-1]]
            alone = [w for w in words if not w[0] == SPACE != w[-1]]
            groups = [joined[i : i + GROUP] for i in range(0, len(joined), GROUP)]
            strings = list(map("".join, groups))
            for g, e, o in zip(groups, self.tokenizer.encode_batch_fast(strings, add_special_tokens=False), self._own(strings)):
                ids = e.ids
                a = np.array(ids, "<u4")
                first = self.starts[a]
                # A run of U+2581 may be several pieces: a word begins where the piece before isn't of that run.
                first[1:] &= ~self.blank[a[:-1]]
                cuts = np.flatnonzero(first)
                if ids != o or len(cuts) != len(g) or self.model.unk in ids:
                    alone += g
                    continue
                data, cuts = a.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
                self.words.update(zip(g, [data[i:j] for i, j in zip(cuts, cuts[1:])]))
        for w, e, o in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), self._own(alone)):
            self.words[w] = np.array(e.ids, "<u4").tobytes()
            if e.ids != o:
                self.unlike.add(w)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Each text's ids as little-endian 32-bit numbers, and whether they agree with the library's."""
        return [(ids, same) for ids, same, _ in self.read(texts)]

    def read(self, texts: list[str]) -> list[tuple[bytes, bool, str]]:
        """What ``encode`` has of each text, and its normal form."""
        if len(self.words) > CACHE or not self.model.words_apart:
            self.words, self.unlike = {}, set()
        normal = [self.normalise(t) for t in texts]
        same = [n == o for n, o in zip(normal, self.library.normalize(texts))]
        split = list(map(self.split, normal))
        new = set().union(*split) - self.words.keys()
        if new:
            self.learn(list(new))
        get = self.words.__getitem__
        out = []
        for s, ok, n in zip(split, same, normal):
            out.append((b"".join(map(get, s)), ok and self.unlike.isdisjoint(s), n))
        return out

    def pieces_text(self) -> list[bytes]:
        """The bytes that each id stands for, before U+2581 becomes a space again."""
        return [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.encode() for p, _, k in self.model.pieces]

    def decode(self, ids: bytes) -> str:
        """The text of some ids; a space that stands for the beginning goes."""
        parts = self._parts if hasattr(self, "_parts") else None
        if parts is None:
            parts = self._parts = self.pieces_text()
        text = b"".join(map(parts.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_crc32, parity, round_trip; ``ids`` too if asked for."""

    def f(batches):
        e = encoder(path)
        for b in batches:
            doc, texts, at = b.column("doc_id"), b.column("text").to_pylist(), 0
            rows = []
            while at < len(texts):
                to, total = at, 0
                while to < len(texts) and total < 1 << 21:
                    total += len(texts[to])
                    to += 1
                for ids, same, normal in e.read(texts[at:to]):
                    plain = normal.replace(SPACE, " ")
                    plain = plain[1:] if e.model.dummy_prefix else plain
                    rows.append((len(ids) // 4, zlib.crc32(ids), same, e.decode(ids) == plain, ids))
                at = to
            cols = [list(c) for c in zip(*rows)] or [[]] * 5
            arrays = [doc, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.bool_())]
            names = ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[4]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return with_text(docs).mapInArrow(f, "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean" + (", ids array<int>" if with_ids else ""))
