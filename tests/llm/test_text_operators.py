"""BPE, secrets, pages and toxicity against the library, brute force and planted cases."""

import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugewise.llm import bpe, html, secrets, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n\t", "Hello  wörld it's 12a don'T", "日本 語 x", "\x00 \x1c a\x1fb \x85\xa0c", "İstanbul ſs ΣΑΣ", "éé",
    "a<|endoftext|>B <|startoftext|>", "<|", "'s'S'll 'LL x'd", "²³¼ ½", "ab " * 300, "x" * 3000, "ß" * 100, "🙂👍🏽 ok",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder(tmp_path_factory):
    vocabulary = bpe.Vocabulary(PATH)
    words = ["the", "hello", "help", "helpful", "w", "wörld", "12"]
    lettered = [vocabulary.words(w)[0] for w in words]
    path = tmp_path_factory.mktemp("lexicon") / "x.fst"
    path.write_bytes(bpe.compile_lexicon(zip(lettered, vocabulary.merge_many(lettered))))
    return bpe.Encoder(vocabulary, bpe.Lexicon(str(path))), bpe.Decoder(vocabulary)


def same(library, coder, texts):
    encoder, decoder = coder
    for text, ids in zip(texts, encoder.encode(texts)):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, wanted)), text
        assert decoder.decode(ids) == library.decode(wanted, skip_special_tokens=False)


def test_encode_as_library(library, coder):
    same(library, coder, [t or "" for t in ODD])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_encode_any_text(library, coder, texts):
    same(library, coder, texts)


def test_lexicon_shares_suffixes_and_finds_only_its_words(tmp_path):
    words = sorted({a + b for a in ("un", "re", "dis", "") for b in ("do", "doing", "tie", "tied", "ties")})
    path = tmp_path / "x.fst"
    path.write_bytes(bpe.compile_lexicon((w, [k, k + 1]) for k, w in enumerate(words)))
    lexicon = bpe.Lexicon(str(path))
    assert lexicon.find_many(words) == [[k, k + 1] for k in range(len(words))]
    assert lexicon.find_many(["d", "doi", "dooo", "x", "undoings"]) == [None] * 5
    assert len(lexicon.finals) < sum(map(len, words)) / 2
    path.write_bytes(bpe.compile_lexicon([]))
    assert bpe.Lexicon(str(path)).find_many(["a"]) == [None]


def test_encode_frame(spark, library):
    rows = [(k % 15, t, "x", 1) for k, t in enumerate(ODD)] + [(None, "hello", "y", 2), (None, "hello", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    found = bpe.digests(bpe.encode(docs, PATH)).collect()
    wanted = []
    for key, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        wanted.append((key, len(ids), *sha))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def base_spans_slowly(text):
    out = []
    for kind, pattern, least in (
        ("assign", r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 8),
        ("access", r"AKIA[A-Z0-9]+", 16),
        ("hex", r"[0-9a-f]+", 32),
    ):
        for m in re.finditer(pattern, text):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


PIECES = ["password", "Token", "API_KEY", "apikey", "=", ":", " ", '"', "'", "AKIA", "AB12", "0123456789abcdef", "xyz9", "é", "\n", "."]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_base_spans(text):
    assert sorted(secrets.base_spans(text), key=lambda s: (s[0], secrets.KINDS.index(s[2]))) == base_spans_slowly(text)


def test_secrets_frame(spark):
    choose = random.Random(3)
    made = ["".join(choose.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=32)) for _ in range(60)]
    prose = "the ordinary_identifier_of_things reads some_long_configuration_value2 and counts rows "
    rows = [(k, f"{prose} token = '{made[k]}' {prose}") for k in range(50)]
    rows += [(100, prose + made[55] + " end"), (101, prose * 3), (None, None), (102, ""), (102, "")]
    docs = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, spans string")
    found = {r.doc_id: r for r in secrets.digests(secrets.scan(docs)).collect()}
    assert found[100].n_markov == 1 and found[100].spans == f"markov:{len(prose)}:{len(prose) + 32}"
    assert found[101].n_markov == 0 and found[None].spans == "" and found[102].n_assign == 0
    assert all(found[k].n_assign == 1 and found[k].n_markov == 0 for k in range(50))
    assert found[102].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.scan(docs.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="no-sidebar">
<header>Site name here</header><nav><ul><li><a href="/a">Menu</a><li><a href="/b">Other</a></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy this now, it is cheap.</div><article><h1>Head &amp; line</h1><p><b>First&nbsp;bold<br>part 1 < 2.<p>Second
   <i>one</i>tail <a href="x>y">link</a> words.</p><div class="comments"><p>Nice article, thanks to all of you.</p></div>
<aside>See also the other things</aside><form><p>Your mail</p><button>Send</button></form><p>Last.</p></article>
<p>We use cookies on this site to make it better for you.</p><footer>&copy; host</footer></body></html>"""


def test_main_text():
    tree = html.grow_tree(*html.labelled_table())
    rows, labels = html.labelled_table()
    assert (html.classify(tree, rows) == labels.astype(bool)).all() and len(labels) < 200
    assert html.main_text(PAGE, tree) == "Head & line First bold part 1 < 2. Second onetail link words. Last."
    plain = "<div id=menu><a href=a>Home</a> <a href=b>News</a></div><h2>Some title of it</h2><p>" + "many words of text " * 12
    assert html.main_text(plain + "</p><div class=footer>Imprint</div>", tree).startswith("Some title of it many words")
    for odd in ("", "<", "<p", "<script>x", "<!-- x", "</p></div>", '<a "' * 2000, "<div>" * 3000, "a & b &am &#x; &#65;"):
        assert isinstance(html.main_text(odd, tree), str)


def test_pages_frame(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "y"), (2, "", "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html.extract(pages).collect()
    assert len(found) == 4 and [r.n_chars for r in found if r.page_id == 1] == [len(found[0].text)] * 2
    assert [r.text for r in found if r.page_id != 1] == ["", ""]
    assert html.extract(pages.limit(0)).count() == 0


def kernel_slowly(a, b):
    def weights(word):
        out, codes = {}, [toxicity.code_of(c) for c in word]
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, len(word)):
                    if codes[i] and codes[j] and codes[k]:
                        key = (codes[i], codes[j], codes[k])
                        out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    x, y = weights(a), weights(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5 if x and y else 0.0


def test_kernel():
    kernel, words = toxicity.Kernel(), ["idiot", "i-d-i-o-t", "idxiot", "stupid", "été", "abcabcabc", "..."]
    found = kernel.against(words, *kernel.landmarks(words))
    wanted = [[kernel_slowly(a, b) for b in words] for a in words]
    assert np.allclose(found, wanted)
    assert found[1][0] > 0.8 and found[2][0] > 0.3 > found[3][0]


def test_words_set_apart_and_windows():
    assert "idiot" in toxicity.words_in("you i d i o t here") and "idiot" in toxicity.words_in("i d i o t")
    assert toxicity.windows("(scum!)") == ["scum"] and toxicity.windows("ab") == []
    long = "x" * 200 + "idiot" + "y" * 200
    assert any("idiot" in w for w in toxicity.windows(long))


def corpus(n, seed=5):
    choose = random.Random(seed)
    syllables = ["an", "ter", "lo", "mi", "sta", "ren", "ing", "of", "ble", "ou"]
    out = []
    for k in range(n):
        words = ["".join(choose.choices(syllables, k=choose.randint(1, 4))) for _ in range(60)]
        toxic = k % 4 == 0
        if toxic:
            words.insert(choose.randrange(60), choose.choice(["idiot", "scumbag", "moron", "trash"]))
        out.append((k, " ".join(words), int(toxic)))
    return out


def test_toxicity_frame(spark):
    rows = corpus(900)
    planted = [(9001, "an you are an i-d-i-o-t ter lo mi", 1), (9002, "ter lo m o r o n sta ren", 1), (9003, "", 0), (9004, None, 0)]
    docs = spark.createDataFrame([(k, t, 0.5) for k, t, _ in rows + planted + planted[:1]], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(rows) + 5 and all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r for r in found}
    held = [(by_id[k].predicted, y) for k, _, y in rows if by_id[k].held_out]
    assert 200 < len(held) < 400 and sum(p == y for p, y in held) >= 0.95 * len(held)
    assert by_id[9001].predicted == by_id[9002].predicted == 1 and by_id[9003].predicted == by_id[9004].predicted == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (None, "more")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [(r.predicted, r.score < 0.01) for r in toxicity.score(docs, model).collect()] == [(0, True)] * 2


@pytest.mark.parametrize(
    "around",
    ['<article class="post comments-open">{}</article>', '<main class="no-sidebar">{}</main>', '<div class="content with-sidebar">{}</div>',
     '<div id="main" class="has-menu">{}</div>', '<body class="sidebar menu">{}</body>'],
)
def test_containers_that_tell_of_the_page_keep_their_article(around):
    tree = html.grow_tree(*html.labelled_table())
    menu = "<ul><li>Home<li><a href=1>All news</a><li><a href=2>Contact</a></ul>"
    article = "<h2>A title of some words</h2><p>" + "word " * 40 + "</p>"
    page = f"{menu}{around.format(article)}<div class=\"comment-list\"><p>{'reader ' * 30}</p></div>"
    assert html.main_text(page, tree) == "A title of some words " + "word " * 39 + "word"
    for never in ('<article class="comment">', '<div class="site-footer">', '<div class="post related">', '<section id="sidebar">'):
        assert html.main_text(f"<article>{article}</article>{never}<p>{'other ' * 30}</p>", tree).endswith("word")


def test_links_of_neighbours_decide():
    tree = html.grow_tree(*html.labelled_table())

    def fields(node):
        return {node[0]} | fields(node[2]) | fields(node[3]) if isinstance(node, tuple) else set()

    assert {html.FIELDS[k] for k in fields(tree)} >= {"words", "words_after", "links", "links_after", "place"}
    heading, label = [[8, 5, 12, 0, 0, after, html.NO_ARTICLE] for after in (0.0, 1.0)]
    assert html.classify(tree, np.array([heading, label], float)).tolist() == [True, False]


def blocks_slowly(page):
    """Another cut of plain nested pages: by a parser of the standard library, without classes or raw elements."""
    from html.parser import HTMLParser

    out, text = [], []

    class Cutter(HTMLParser):
        def flush(self):
            words = "".join(text).split()
            text.clear()
            if words:
                out.append(" ".join(words))

        def handle_starttag(self, tag, attrs):
            if tag not in ("b", "i", "a", "span"):
                self.flush()

        def handle_endtag(self, tag):
            if tag not in ("b", "i", "a", "span"):
                self.flush()

        def handle_data(self, data):
            text.append(data)

    parser = Cutter(convert_charrefs=True)
    parser.feed(page)
    parser.close()
    parser.flush()
    return out


def test_blocks_against_a_parser():
    choose = random.Random(8)
    for _ in range(200):
        page, open_ = "", []
        for _ in range(choose.randint(1, 40)):
            kind = choose.random()
            if kind < 0.3:
                open_.append(choose.choice(["div", "section", "td", "b", "i", "span"]))
                page += f"<{open_[-1]} data-x='1 > 2'>"
            elif kind < 0.5 and open_:
                page += f"</{open_.pop()}>"
            else:
                page += choose.choice(["some words ", "a &amp; b ", "\n", "x", "&eacute;t&eacute; ", "1 &lt; 2 "])
        assert [b[0] for b in html.blocks(page)] == blocks_slowly(page)


def test_long_texts_take_linear_time():
    tree = html.grow_tree(*html.labelled_table())
    began = time.time()
    html.main_text("<div>" * 500_000 + "</section>" * 250_000, tree)
    html.main_text("<p>word <b>bold</b> &amp; more</p>" * 150_000, tree)
    assert time.time() - began < 30
    ratio = np.zeros((secrets.N, secrets.N)) + 5.0
    text = " ".join(f"password=abcdefgh{k % 7} zZ9{k:017d}x{k % 3}" for k in range(120_000))
    began = time.time()
    found = secrets.spans(text, ratio.tolist())
    assert len(text) > 5_000_000 - 1_000_000 and len(found) == 240_000 and time.time() - began < 20


def test_markov_spans_touch_no_fixed_pattern():
    choose = random.Random(4)
    ratio = (np.zeros((secrets.N, secrets.N)) + 5.0).tolist()
    parts = ["password=abcdefgh1234567890abcdef", "AKIA" + "Q7" * 12, "0123456789abcdef" * 3, "Zz9_" * 7, "token: x", "api_key='0123456789abcdef0123456789abcdef00'", "plain words"]
    for _ in range(300):
        text = "".join(choose.choice(parts) + choose.choice([" ", "", "-", "/"]) for _ in range(choose.randint(1, 12)))
        base, markov = secrets.base_spans(text), secrets.markov_spans(text, ratio)
        free = [s for s in markov if all(s[1] <= a or b <= s[0] for a, b, _ in base)]
        assert sorted(secrets.spans(text, ratio)) == sorted(base + free)
