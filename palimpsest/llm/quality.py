"""Quality by weak supervision: rules vote or abstain, and their accuracies are estimated.

Each rule votes good (1), bad (0) or abstains (-1) on a document. The votes of all
documents are counted by pattern; there are at most 3 ** len(RULES) patterns at any size of
the corpus, so expectation-maximisation runs on the driver over those counts: it estimates
the share of good documents and, for each rule, how often it votes either way on good and
on bad ones. A document's verdict is the posterior of its pattern, not the conjunction of
all rules.

Null and empty texts have no words and fail the base rule. Repeated rows count each. Extra
columns are ignored; no label is read. Texts are whole. An empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint, mix, with_text

#: Characters that count as symbols, and white space that separates words.
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\v\f\r"
#: The commonest function words of the corpus's languages.
FUNCTION_WORDS = frozenset(
    b"the of and to in is that it for was on are as with be at by this from or an not de la le les et des en un une du est que pour dans qui sur el los las y del se por con para der die das und den von zu mit sich auf ist im dem nicht ein eine".split()
)
MARKS = frozenset(bytes([c]) for c in b"|-*#=+~_/<>&%$@^\\")
MIN_WORDS, MAX_REPEAT = 10, 20  # of the base rule: words, and repeated words in a hundred


def _window_repeats(words: list[bytes], width: int = 5) -> int:
    """Words in ``width``-word windows that occur twice or more, the first one included."""
    seen = Counter(zip(*(words[i:] for i in range(width))))
    covered, end = 0, 0
    for i, w in enumerate(zip(*(words[i:] for i in range(width)))):
        if seen[w] > 1:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def _may_repeat(docs: list[list[bytes]], width: int = 5) -> np.ndarray:
    """Documents in which two windows have equal hashes: none with a repeat is missed."""
    number: dict[bytes, int] = {}
    put = number.setdefault
    ids = np.array([put(w, len(number)) for d in docs for w in d], np.uint64)
    size = np.array([len(d) for d in docs], np.int64)
    owner = np.repeat(np.arange(len(docs)), size)
    if len(ids) < width:
        return np.zeros(len(docs), bool)
    h = owner[: len(ids) - width + 1].astype(np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - width + 1 + k])
    whole = owner[: len(h)] == owner[width - 1 :]
    h, own = h[whole], owner[: len(whole)][whole]
    order = np.argsort(h)
    twice = h[order][1:] == h[order][:-1]
    out = np.zeros(len(docs), bool)
    out[own[order[1:][twice]]] = True
    return out


def measures(texts: list[str]) -> list[dict]:
    """Counts of each text that the base rule and the voting rules use."""
    words = [t.encode().split() for t in texts]
    repeat = _may_repeat(words)
    out = []
    for t, w, r in zip(texts, words, repeat.tolist()):
        n = len(w)
        lines = [x for x in t.split("\n") if x.strip(BLANK)]
        letters = sum(map(str.isalpha, t))
        upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", t))
        common = sum(map(FUNCTION_WORDS.__contains__, w))
        out.append({
            "n_words": n, "word_chars": len(t) - sum(map(t.count, BLANK)), "n_symbols": sum(map(t.count, SYMBOLS)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": _window_repeats(w) if r else 0,
            "lines": len(lines), "letters": letters, "upper": upper, "common": common, "distinct": len(set(w)),
            "stops": t.count(".") + t.count("?"), "shouts": t.count("!"), "digits": len(re.findall(r"\d", t)), "marks": sum(map(MARKS.__contains__, w)),
        })
    return out


def _vote(x: float, good: float, bad: float) -> int:
    """Good up to ``good``, bad from ``bad`` on, nothing between."""
    return 1 if x <= good else 0 if x >= bad else -1


#: Each rule: name and vote, from the measures of a text with a word.
RULES = {
    "symbols": lambda m: _vote(m["n_symbols"] / m["n_words"], 0.02, 0.10),
    "bare_marks": lambda m: _vote(m["marks"] / m["n_words"], 0.03, 0.15),
    "capitals": lambda m: _vote(m["upper"] / max(1, m["letters"]), 0.12, 0.40),
    "shouts": lambda m: _vote(m["shouts"] / m["n_words"], 0.02, 0.15),
    "repeats": lambda m: _vote(m["n_repeat_words"] / m["n_words"], 0.05, 0.20),
    "variety": lambda m: -1 if m["n_words"] < 30 else _vote(1 - m["distinct"] / m["n_words"] ** 0.85, 0.3, 0.75),
    "function_words": lambda m: -1 if m["n_words"] < 20 else _vote(1 - m["common"] / m["n_words"], 0.95, 0.995),
    "sentences": lambda m: -1 if m["n_words"] < 20 else (1 if m["n_words"] / max(1, m["stops"]) <= 40 else 0 if m["stops"] == 0 or m["n_words"] / m["stops"] >= 150 else -1),
    "lines": lambda m: -1 if m["lines"] < 3 else _vote(m["n_dup_lines"] / m["lines"], 0.1, 0.3),
    "letters": lambda m: _vote(1 - m["letters"] / max(1, m["word_chars"]), 0.15, 0.35),
    "word_length": lambda m: 1 if 3 <= m["word_chars"] / m["n_words"] <= 12 else 0 if not 2 <= m["word_chars"] / m["n_words"] <= 18 else -1,
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def votes(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the base counts, and the rules' votes as one string of 0, 1 and -."""

    def f(batches):
        for b in batches:
            ids, texts, at = b.column("doc_id").to_pylist(), b.column("text").to_pylist(), 0
            rows = []
            while at < len(ids):
                to, total = at, 0
                while to < len(ids) and total < 1 << 22:
                    total += len(texts[to])
                    to += 1
                for i, m in zip(ids[at:to], measures(texts[at:to])):
                    pattern = "".join("-01"[rule(m) + 1] for rule in RULES.values()) if m["n_words"] else "-" * len(RULES)
                    rows.append((i, *(m[k] for k in BASE), pattern))
                at = to
            cols = [list(c) for c in zip(*rows)] or [[]] * 7
            kinds = [pa.int64()] * 6 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", *BASE, "votes"])

    return with_text(docs).mapInArrow(f, "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", votes string")


def fit(counts: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """Expectation-maximisation over counted vote patterns: each pattern's posterior of good.

    A rule's chance of voting good, given that it votes, is estimated for either class; to
    abstain says nothing. It starts from rules that are right more often than not, so that
    good stays good, and pseudo counts keep a rule that never errs from deciding alone."""
    patterns = sorted(counts)
    if not patterns:
        return {}
    v = np.array([["-01".index(c) - 1 for c in p] for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    yes, no = (v == 1).astype(float), (v == 0).astype(float)
    good, bad = np.full(v.shape[1], 0.95), np.full(v.shape[1], 0.6)  # chance of a good vote
    share = 0.85
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + yes @ np.log(good / bad) + no @ np.log((1 - good) / (1 - bad))
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        new = float(np.clip((n @ post + 1) / (n.sum() + 2), 1e-3, 1 - 1e-3))
        moved, share = abs(new - share), new
        good = ((n * post) @ yes + 1.9) / ((n * post) @ (yes + no) + 2)
        bad = ((n * (1 - post)) @ yes + 1.2) / ((n * (1 - post)) @ (yes + no) + 2)
        if moved < 1e-9:
            break
    return dict(zip(patterns, post.tolist()))


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Per row: doc_id, base counts, base_failed, kept, quality (the posterior), votes."""
    rows = checkpoint(votes(docs))
    counted = rows.groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3 ** len(RULES) rows
    posterior = fit({r["votes"]: r["n"] for r in counted})
    table = docs.sparkSession.createDataFrame(list(posterior.items()) or [("", 0.0)], "votes string, quality double")
    out = rows.join(F.broadcast(table), "votes", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return out.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & (F.col("quality") >= least)).alias("kept"), "quality", "votes")
