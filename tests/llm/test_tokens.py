"""Packing, token ids, sampled pieces and page text."""

import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from conftest import prose

from scribelake.llm import html_wrappers, piece_sampling, swap_packing
from scribelake.llm.token_ids import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", "a", "  two  spaces\n\n and \t tabs ", "don't we'll it's I'VE", "12 3e4 x_y --- ...", "你好 世界 🙂🙂 ñandú’s", "a   b c\x85d", "\n", " ", " lead", "trail ",
    "<|endoftext|> is text", "one\ntwo\n three\n\nfour", "▁ literal ▁▁x", "x" * 3000, prose(4, 300), "\x00\x01 control",
]


def _ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids


def test_ids_equal_the_tokenizer():
    enc = Encoder(BPE)
    more = ["<|endoftext|><|endoftext|>", " <|endoftext|> ", "x\n<|endoftext|>", "<|endoftext", "<|<|endoftext|>|>", " " * 300_000, "a" + "\n" * 200_000 + "b", "x" * 100_000]
    for text in TEXTS + more:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == _ids(text), text[:50]


def test_ids_of_many_texts_with_special_strings():
    from tokenizers import Tokenizer

    tokenizer, enc, r = Tokenizer.from_file(BPE), Encoder(BPE), random.Random(6)
    marks = ["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "\n", "\t", "'s", "'S", "é", "你", "🙂", "\u00a0", "\u200b", "1", "22", "!", "_", "\r\n", "\x1c", "\x85"]
    texts = ["".join(r.choice((prose(r.randrange(10**6), 1), r.choice(marks))) for _ in range(r.randrange(25))) for _ in range(10_000)]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == want.ids, text


def test_other_files_are_read_by_the_library(tmp_path):
    """Files that ranks alone do not describe: another word rule, a normalizer, tokens with conditions."""
    import json

    from tokenizers import Tokenizer

    words = public_tokenizers.path("word_bpe_49k.json")
    with open(BPE, encoding="utf-8") as f:
        plain = json.load(f)
    changed = {
        "prefix": {"pre_tokenizer": plain["pre_tokenizer"] | {"add_prefix_space": True}},
        "digits": {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, plain["pre_tokenizer"]]}},
        "lower": {"normalizer": {"type": "Lowercase"}},
        "strip": {"added_tokens": [plain["added_tokens"][0] | {"lstrip": True}]},
        "more": {"added_tokens": [*plain["added_tokens"], plain["added_tokens"][0] | {"id": 50257, "content": "<|end"}, plain["added_tokens"][0] | {"id": 50258, "content": "the"}]},
    }
    paths = [words]
    for name, change in changed.items():
        paths.append(str(tmp_path / f"{name}.json"))
        with open(paths[-1], "w", encoding="utf-8") as f:
            json.dump(plain | change, f)
    for path in paths:
        tokenizer, enc = Tokenizer.from_file(path), Encoder(path)
        for text in [*TEXTS, "The <|endoftext|> and 123 <|end the", "x <|endoftext|>"]:
            assert np.frombuffer(enc.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, (path, text[:40])


def test_local_search_empties_bins():
    r = np.random.default_rng(1)
    for lengths in (r.integers(1, 1024, 400), r.integers(300, 700, 300), np.array([600, 600, 424, 300, 100, 24]), np.array([5])):
        before = swap_packing.best_fit(lengths, 1024)
        after = swap_packing.pack_bucket(lengths, 1024)
        assert sorted(i for b in after for i in b) == list(range(len(lengths)))
        assert all(lengths[b].sum() <= 1024 for b in after) and len(after) <= len(before)
    # Three underfull bins that exchanges turn into two full ones.
    lengths = np.array([6, 5, 4, 3, 2]) * 100
    assert len(swap_packing._Search(lengths, [[0, 3], [1, 4], [2]], 1000).run()) == 2


def test_packing(odd_docs, no_docs):
    rows = swap_packing.packed(odd_docs, BPE, bucket_rows=4).collect()
    texts = Counter((r["doc_id"], r["text"]) for r in odd_docs.collect())
    want = Counter()
    for (i, t), n in texts.items():
        ids = [*_ids(t or ""), 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += n
    assert Counter(tuple(r[c] for c in ("id", "piece", "start", "length", "ids_crc32")) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0] + [n for _, n in held])[:-1].tolist() and sum(n for _, n in held) <= 1024
    assert swap_packing.packed(no_docs, BPE).count() == 0


def test_pieces_are_lossless_and_seeded():
    pieces = piece_sampling.Pieces(PIECES)
    seeds = np.arange(len(TEXTS), dtype=np.uint64)
    got = pieces.segment(TEXTS, seeds)
    for text, ids in zip(TEXTS, got):
        assert pieces.join(ids.tolist()) == text
    for i in range(len(TEXTS)):
        assert (pieces.segment(TEXTS[i : i + 1], seeds[i : i + 1])[0] == got[i]).all()
    other = pieces.segment([TEXTS[15]] * 2, np.array([1, 2], np.uint64))
    assert other[0].tolist() != other[1].tolist()


def test_pieces_follow_the_lattice():
    """Drawn shares of all segmentations of a word equal the enumerated ones."""
    pieces = piece_sampling.Pieces(PIECES)
    weight = {pieces.bytes_of[i].decode("utf-8", "ignore"): (i, w) for i, w in enumerate(pieces.weight) if pieces.bytes_of[i] and i not in set(pieces.byte_ids.tolist())}

    def cuts(text):
        if not text:
            yield (), 0.0
        for k in range(1, len(text) + 1):
            if text[:k] in weight:
                i, w = weight[text[:k]]
                for rest, more in cuts(text[k:]):
                    yield (i, *rest), w + more

    all_ = dict(cuts(" thing"))
    total = sum(np.exp(w) for w in all_.values())
    n = 20_000
    drawn = Counter(tuple(x.tolist()) for x in pieces.segment(["thing"] * n, np.arange(n, dtype=np.uint64)))
    assert set(drawn) <= set(all_)
    for ids, w in all_.items():
        p = np.exp(w) / total
        assert abs(drawn[ids] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3


def test_pieces_of_a_batch_are_drawn_in_little_memory():
    """A batch of a thousand long texts with many distinct words: what is held at once is bounded by characters, not by the batch."""
    r = np.random.default_rng(3)
    texts = pd.Series([" ".join("".join(chr(97 + c) for c in r.integers(0, 26, 7)) for _ in range(400)) for _ in range(600)])
    keys = pd.Series(np.arange(len(texts)))
    piece_sampling.loaded(PIECES, 1.0)
    tracemalloc.start()
    try:
        ids = piece_sampling.drawn(keys, texts, PIECES, 1.0)
        assert tracemalloc.get_traced_memory()[1] < 250 << 20
    finally:
        tracemalloc.stop()
    spelled = piece_sampling.spelling(PIECES)
    assert all(b"".join(spelled[i] for i in x.tolist()).decode()[1:] == t for x, t in zip(ids, texts))


def test_piece_columns(odd_docs, no_docs):
    rows = piece_sampling.segmentations(odd_docs, PIECES)
    back = rows.select("id", "text", piece_sampling.decoded(rows["ids"], PIECES).alias("back"), piece_sampling.ids_crc32(rows["ids"]).alias("crc"), "ids").collect()
    assert len(back) == odd_docs.count()
    for r in back:
        assert r["back"] == r["text"] and (r["crc"] is None) == (r["text"] is None)
        if r["ids"] is not None:
            assert r["crc"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert piece_sampling.segmentations(no_docs, PIECES).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="page"><div class="post-%d"><h1>Head %d</h1><p>First   <b>bold</b> &eacute;&nbsp;%d<br>line<p>Second %s</p>
<script>if (a < b) { "</p>" }</script><div class="ad">Buy</div><ul><li>one<li>two</ul><form><input value="a > b"><button>Go</button></form></div>
<div id="comments"><p>Nice post!</p></div></div><aside class="sidebar">Other</aside><footer>&copy;</footer></body></html>"""


def _page(i):
    return PAGE % (i, i, i, "word " * (20 + i))


def test_main_text_without_an_article_element(spark):
    pages = spark.createDataFrame([(i, "https://Host.example/x", _page(i)) for i in range(9)], "page_id bigint, url string, html string").repartition(3)
    for r in html_wrappers.extracted(pages).collect():
        i = r["id"]
        assert r["text"] == f"Head {i}\n\nFirst bold é {i} line\n\nSecond " + " ".join(["word"] * (20 + i)) + "\n\none\n\ntwo", r["text"]


def test_wrappers_are_union_free_and_shared(spark):
    a, b = "<body><h1>x</h1><p>a</p><p>b</p><hr></body>", "<body><h1>y</h1><p>a</p><div>opt</div></body>"
    whole = html_wrappers.aligned(html_wrappers.page_wrapper(a), html_wrappers.page_wrapper(b))
    body = {x[0]: x for x in whole[0][5][0]}
    assert body["p"][2] and not body["p"][1] and body["hr"][1] and body["div"][1] and not body["h1"][1]
    assert body["h1"][5][0][0][3] == 0  # x and y differ: a slot
    group = html_wrappers.page_wrapper("<dl><dt>1</dt><dd>2</dd><dt>3</dt><dd>4</dd></dl>")[0][5][0]
    assert [x[0] for x in group] == ["(dt dd)"] and group[0][2]
    pages = spark.createDataFrame([(i, "http://h/", _page(i)) for i in range(6)] + [(9, None, a)], "page_id int, url string, html string")
    assert sorted(r["host"] for r in html_wrappers.wrappers(pages).collect()) == ["", "h"]


def test_odd_pages(spark):
    rows = [
        (1, "http://a/", None), (2, "http://a/", ""), (None, None, "<p>x"), (3, "http://a/", "plain text"), (3, "http://a/", "plain text"),
        (4, "http://a/", "<article><p>un<b>closed<p>next"), (5, "http://a/", "<p title='it>x'>q</p><!-- c --><p>&lt;r&gt;"), (6, "nonsense", "</div></p>tail<"),
        (7, "http://b/", "<main>" + "<p>row</p>" * 3000 + "</main>"), (8, "http://b/", "<div " + "x" * 5000),
    ]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id int, url string, html string, host int, path int")
    got = html_wrappers.extracted(pages)
    texts = {(r["id"], r["text"]) for r in got.collect()}
    assert texts >= {(1, ""), (2, ""), (None, "x"), (3, "plain text"), (4, "unclosed\n\nnext"), (5, "q\n\n<r>"), (7, "\n\n".join(["row"] * 3000)), (8, "")}
    assert got.count() == len(rows) and html_wrappers.extracted(pages.where("false")).count() == 0
