"""Operators 4 to 7 and the pipeline: fixtures with known results, parity, held-out accuracy."""

import random
import re
import struct

import numpy as np
import pytest

from palimpsest.llm import html_text, quality, sentencepiece_bpe as sp, toxicity

SCHEMA = "doc_id long, text string, score string, votes string, spans string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)


# --- 4: main text of pages --------------------------------------------------------------

BODY = "A first sentence of the story, long enough to count. And a second one, with commas, and stops."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/b">More</a></li></ul></nav><!-- ad -->
<div class="cookie-notice">We use cookies, as all do. Please agree.</div>
<div id="main-text"><h2>Head &amp; line</h2><p>{BODY}<br>after a&nbsp;break</p><p><b>{BODY}</p><div class="ad">Buy now, it is cheap.</div><p>Short <a href="x">link</a> &#233;.</p></div>
<aside>Side, with text. More text here.</aside><div class="comments"><p>{BODY}</p></div><form>Name <input></form><footer>&copy; 2020 Someone, all rights.</footer></body></html>"""


def test_page_without_article_is_told_by_its_paths():
    got = html_text.extract(PAGE).split("\n\n")
    assert got[0] == "Head & line" and BODY + " after a break" in got and BODY in got and "Short link é." in got and len(got) == 4


def test_article_keeps_all_its_blocks():
    page = f"<body><nav><a>x</a></nav><article><h1>Wh</h1><p>a<p>b<br>c<ul><li>one<li>two</ul><p>{BODY}</article><p>{BODY} {BODY}</p></body>"
    assert html_text.extract(page) == f"Wh\n\na\n\nb c\n\none\n\ntwo\n\n{BODY}"


STORY = [f"Paragraph {k} of the story tells more, at length, and in whole sentences. It goes on, with commas, until it stops." for k in range(8)]


@pytest.mark.parametrize("around", ["{}", "<article><h3>Other news</h3><p>Read this too</p></article>{}", "{}" + "<article><h3>Card</h3><p>Short card text</p></article>" * 6, "<main>{}<article><p>Nice one!</p></article></main>", "<article><p>Thanks, I liked it.</p></article>{}"])
def test_story_in_divs_is_found_beside_articles(around):
    page = "<body><nav><a>x</a></nav>" + around.format("<div class=story>" + "".join(f"<div>{x}</div>" for x in STORY) + "</div>") + "<div class=low><span>Site</span></div></body>"
    got = html_text.extract(page).split("\n\n")
    assert [x for x in got if x in STORY] == STORY and not {"Read this too", "Short card text", "Site"} & set(got)


def test_scores_choose_within_an_article_too():
    links = "".join(f'<li><a href="/{k}">Another page {k}</a></li>' for k in range(6))
    page = "<body><article>" + "".join(f"<p>{x}</p>" for x in STORY) + f"<ul>{links}</ul></article><div>Some site text</div></body>"
    assert html_text.extract(page).split("\n\n") == STORY


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<script>x", "</div></p>", "<div " * 300, '<a href="x>' * 50, "&#xZZ;&bogus;", "<p>" * 3000])
def test_broken_pages_do_not_crash(page):
    assert isinstance(html_text.extract(page), str)


def test_pages_table(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (1, None, None, "x"), (None, "v", "", "y")], "page_id long, url string, html string, text string")
    got = html_text.extract_pages(rows).collect()
    assert len(got) == 3 and all(r.n_chars == len(r.text) for r in got) and sum(r.text == "" for r in got) == 2
    assert html_text.extract_pages(rows.limit(0)).count() == 0


# --- 5: quality -------------------------------------------------------------------------


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, gone = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            gone |= {i + k for i in at for k in range(5)}
    lines, dup = set(), 0
    for x in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.add(x)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(gone))


def test_base_counts_match_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x y\x1cz é 😀 # *", "l\nl\n \n l\nl", "w " * 3000]
    texts += [rng.choice([" ", "\n"]).join(rng.choice("abc#|") * rng.randint(1, 2) for _ in range(rng.randint(0, 80))) for _ in range(40)]
    got = {r.doc_id: r for r in quality.judge(table(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        n = brute(t)
        assert tuple(got[i][k] for k in quality.BASE) == n
        assert got[i].base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (got[i].base_failed and got[i].kept)
    assert quality.judge(table(spark, [])).count() == 0


def test_accuracies_are_recovered_from_votes_alone():
    rng = random.Random(4)
    right = [0.95, 0.9, 0.8, 0.7, 0.85]
    counts, truth = {}, {}
    for _ in range(20000):
        good = rng.random() < 0.9
        p = "".join("-" if rng.random() < 0.2 else "01"[good == (rng.random() < r)] for r in right)
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(good)
    post = quality.fit(counts)
    hit = sum(sum(g == (post[p] >= 0.5) for g in gs) for p, gs in truth.items())
    assert hit / 20000 > 0.95


# --- 6: toxicity ------------------------------------------------------------------------


def test_gradients_are_those_of_the_loss():
    w = toxicity.Words(["aa bb cc dd", "ee aa bb"])
    win, _ = w.windows()
    net, y = toxicity.Network(1), np.array([1.0, 0.0])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g, _ = net.gradients(w, win, y, net.embed(w).astype(float))
    for k in ("U", "W", "A", "v", "o", "c"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        ends = []
        for e in (1e-3, -2e-3):
            net.p[k][i] += e
            ends.append(net.gradients(w, win, y, net.embed(w).astype(float))[1])
        assert abs((ends[0] - ends[1]) / 2e-3 - g[k][i]) < 1e-4


def labelled(n, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["on", "er", "th", "ing", "al"]) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(n):
        t = [word() for _ in range(rng.randint(5, 150))]
        bad = i % 3 == 0
        if bad:
            t[rng.randrange(len(t))] = rng.choice(["grumpf", "zwackel", "zwackelt"])
        rows.append((i, " ".join(t), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = labelled(500)
    docs = table(spark, [r[:2] for r in rows] + [(9000, None), (9001, " "), (9002, "zwackel " * 3 + "on er " * 5000)])
    labels = spark.createDataFrame([(r[0], r[2], "t") for r in rows], "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert sum(got[i].predicted == y for i, _, y in held) / len(held) > 0.9
    assert got[9000].score == got[9001].score == 0.0 and got[9002].predicted == 1
    assert toxicity.reject(docs, labels).count() == sum(r.predicted == 0 for r in got.values())


def test_one_class_or_no_labels(spark):
    docs = table(spark, [(i, "a b") for i in range(8)])
    make = lambda y: spark.createDataFrame([(i, y) for i in range(8)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_documents(docs, make(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.score_documents(docs, make(1)).collect()} == {1.0}
    assert toxicity.score_documents(docs.limit(0), make(0).limit(0)).count() == 0


# --- 7: SentencePiece -------------------------------------------------------------------

TEXTS = ["", " ", "a  b\n\n c\t", "😀 中文 ▁x ▁▁", "<s> </s> <unk> <0x41>", "  lead", "trail  ", "é́ \x00 \x1c", "The quick brown fox. " * 40]


def path():
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def test_parity_with_the_library_and_round_trip():
    e = sp.Encoder(path())
    for t, (ids, same) in zip(TEXTS, e.encode(TEXTS)):
        assert same and np.frombuffer(ids, "<u4").tolist() == e.library.encode(t)
        assert e.decode(ids) == (t.replace("▁", " "))


def _varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += _varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += _varint(number << 3) + _varint(value)
        else:
            out += _varint(number << 3 | 2) + _varint(len(value)) + value
    return out


def test_unigram_model_with_scores_and_byte_fallback(tmp_path):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [("▁", -3.0, 1), ("▁ab", -2.0, 1), ("ab", -2.5, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("▁abc", -7.0, 1), ("c", -3.5, 1), ("bc", -3.8, 1)]
    body = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    body += _message((2, _message((3, 1), (4, len(pieces)), (35, 1))), (3, _message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    file = tmp_path / "unigram.model"
    file.write_bytes(body)
    e = sp.Encoder(str(file))
    for t in ("ab abc", "abcabc  ab", "xé a", "", "cab bca"):
        assert np.frombuffer(e.encode([t])[0][0], "<u4").tolist() == e.library.encode(t), t


@pytest.mark.parametrize("group", [1, 3, 128])
def test_words_read_as_one_string_have_their_own_ids(monkeypatch, group):
    monkeypatch.setattr(sp, "GROUP", group)
    e = sp.Encoder(path())
    texts = ["the cat sat  on   the mat ", " ▁▁x ▁", "é 😀 字 \x00 <unk> </s> <0x41>", "   ", "z" * 3000 + " y", " ".join(f"word{i}" for i in range(500))]
    for (ids, same), t in zip(e.encode(texts), texts):
        assert same and np.frombuffer(ids, "<u4").tolist() == e.library.encode(t), t


def test_words_with_unknown_pieces_are_read_alone(tmp_path):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.0, 1), ("▁ab", -2.0, 1), ("ab", -2.5, 1), ("a", -4.0, 1), ("b", -4.5, 1)]
    body = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    body += _message((2, _message((3, 1), (4, len(pieces)))), (3, _message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    file = tmp_path / "unknown.model"
    file.write_bytes(body)
    e = sp.Encoder(str(file))
    texts = ["ab xé ab", "é é", "x", "abx ab ba"]
    for (ids, same), t in zip(e.encode(texts), texts):
        assert same and np.frombuffer(ids, "<u4").tolist() == e.library.encode(t), t


def test_model_with_pieces_across_words(tmp_path):
    """Texts go whole where a piece crosses into the next word."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.0, 1), ("▁a", -2.0, 1), ("a▁b", -1.5, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("c", -3.5, 1)]
    body = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    body += _message((2, _message((3, 1), (4, len(pieces)))), (3, _message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    file = tmp_path / "across.model"
    file.write_bytes(body)
    e = sp.Encoder(str(file))
    texts = ["a b", "ca b a b", "", "c  a", "b a ba bc"]
    for t, (ids, same) in zip(texts, e.encode(texts)):
        assert same and np.frombuffer(ids, "<u4").tolist() == e.library.encode(t), t


def test_sentencepiece_table(spark):
    got = {r.doc_id: r for r in sp.encode_documents(table(spark, [*enumerate(TEXTS), (99, None), (99, None)]), path(), with_ids=True).collect()}
    assert all(r.parity and r.round_trip and len(r.ids) == r.n_tokens for r in got.values()) and got[99].n_tokens == 0


# --- The pipeline -----------------------------------------------------------------------


def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rows = labelled(150, 3)
    texts = {i: t for i, t, _ in rows}
    passage = " ".join(f"passage{k}" for k in range(60))
    rows += [(1000, texts[1] + "  " + texts[2], 0), (1001, texts[1] + " " + texts[2], 0), (1002, " ".join(f"on{k}er" for k in range(80)) + " " + passage, 0), (1003, passage + " " + " ".join(f"al{k}er" for k in range(80)), 0), (1004, None, 0)]
    rows += [(1005, "intro one " + passage + " th al th", 0), (1006, "intro one " + passage + " th al on", 0)]  # 62 of 64 five-word strings in common
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, now = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), docs.schema)
        kept.append({r.doc_id: r for r in now.collect()})
    toxic = {i for i, _, y in rows if y}
    assert len(toxic & kept[0].keys()) < 0.1 * len(toxic) and len(kept[0]) > 0.9 * (len(rows) - len(toxic))
    assert 1000 in kept[1] and 1001 not in kept[1]
    assert 1005 in kept[2] and 1006 in kept[1] and 1006 not in kept[2]
    assert passage not in kept[3][1003].text and passage in kept[3][1002].text and kept[3][1003].n_chars == len(kept[3][1003].text)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept[3])


@pytest.mark.parametrize("n", [39, 41])
def test_a_letter_is_the_same_at_every_length(n):
    assert quality.measures(["½²Ⅳé" + " ½²Ⅳ" * (n - 1)])[0]["letters"] == 1


HOSTILE = {
    "nested": "<div>a", "quotes": '<a "', "quoted ends": '<a ">"', "declarations": "<!", "script": "</script", "tags": "<a ", "items": "<li>x<b>", "attributes": "<p a", "ends": "</b><i>",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_cost_no_more_than_their_length(name):
    """A megabyte of each; what is quadratic would take minutes."""
    import time

    page = "<p>" + BODY + "</p>" + HOSTILE[name] * ((1 << 20) // len(HOSTILE[name])) + '">'
    start = time.process_time()
    assert BODY in html_text.extract(page) or name not in ("declarations", "attributes")
    assert time.process_time() - start < 30


def test_paths_choose_without_any_mark(monkeypatch):
    """No list of names, no article: the ratios of tag paths tell the story from the rest."""
    monkeypatch.setattr(html_text, "_marked", lambda *_: False)
    menu = "".join(f"<li><a href='/{k}'>Menu {k}</a></li>" for k in range(12))
    story = "".join(f"<p>{BODY} It goes on, number {k}.</p>" for k in range(6))
    got = html_text.extract(f"<body><ul>{menu}</ul><div><div>{story}</div></div><ul>{menu}</ul><span>Copyright</span></body>")
    assert got.split("\n\n") == [f"{BODY} It goes on, number {k}." for k in range(6)]
