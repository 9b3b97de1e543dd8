"""HTML extraction, lexical search and token alignment against brute force; odd rows and tables."""

import collections
import hashlib
import html
import math
import random
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemart.llm import alignment, html_text, lexical_search
from tidemart.llm.queries import PIECES, QUERIES, TOKENIZER

LONG = "lorem ipsum dolor sit amet " * 8000

# ---------------------------------------------------------------------------------- HTML

PROSE = ["The river, wide and slow, passes the old mill; nobody works there any more.",
         "A second paragraph follows, with some more words, and it ends like this.",
         "Short one.", "Numbers & signs: 1 < 2, \"quoted\", and a café — done."]
AROUND = {
    "nav": "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>",
    "header": "<header><div class='logo'>The Daily Site</div><p>All the news, every day.</p></header>",
    "ad": "<div class='ad'>Buy now, the best offer of this long, long year, at once.</div>",
    "aside": "<aside><p>Related: another story, about something else, that is rather long.</p></aside>",
    "side": "<div id='sidebar-left'><p>Most read, this week, by many people of this town.</p></div>",
    "cookie": "<div class='cookie-notice'>We use cookies, as everybody does, to know you.</div>",
    "form": "<form action='/q'><label>Search</label><input name='q'><button>Go</button></form>",
    "script": "<script>if (a < b) { document.write('<p>no, not this</p>'); }</script>",
    "style": "<style>p > b { margin: 0 }</style>",
    "comment": "<!-- <p>hidden, of course</p> -->",
    "talk": "<section id='comments'><h2>Comments</h2><div class='comment'><p>I think, dear "
            "editor, that all of this is wrong, and I have said so, often.</p></div></section>",
    "footer": "<footer>&copy; 2024 The Daily Site, all rights reserved.</footer>"}


def page_of(rng, frame):
    prose = [rng.choice(PROSE) for _ in range(rng.randint(1, 9))]
    shown = [html.escape(p) for p in prose]
    body = [f"<p>{p}</p>" for p in shown]
    for k, p in enumerate(shown):
        kind = rng.randint(0, 5)
        if kind == 0:
            body[k] = f"<p>{p}"
        elif kind == 1:
            first, rest = p.split(" ", 1)
            body[k] = f"<p>\n  <b>{first}</b>\t {rest} </p>"
        elif kind == 2:
            body[k] = f"<ul><li>{p}<li>{p}</ul>"
            prose[k] = [prose[k]] * 2
    title = "What the river said"
    article = f"<h1>{title}</h1>" + "".join(body)
    around = [AROUND[k] for k in rng.sample(sorted(AROUND), rng.randint(0, len(AROUND)))]
    cut = rng.randint(0, len(around))
    text = (f"<!DOCTYPE html><html><head><title>{title}</title></head><body>"
            + "".join(around[:cut]) + frame.format(article) + "".join(around[cut:]) + "</body></html>")
    return text, "\n".join([title, *(q for p in prose for q in ([p] if isinstance(p, str) else p))])


@pytest.mark.parametrize("frame", [
    "<article>{}</article>", "<main><article class='post'>{}</article></main>",
    "<div id='page'><div class='content'>{}</div></div>",
    "<article>{}<footer>Filed under: rivers, mills</footer></article>",
    "<div class='has-sidebar'><main>{}</main></div>"])
def test_articles_among_other_things(frame):
    rng = random.Random(5)
    for _ in range(150):
        page, want = page_of(rng, frame)
        assert "\n".join(html_text.main_blocks(page)[0]) == want, page


def test_pages_as_their_articles(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op11_html_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    for row in rows:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[row.page_id], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "br" in p else "", p)).split())
                  for p in re.split(r"</?(?:p|h1)>", inner)]
        assert row.text == "\n".join(b for b in blocks if b)
        assert row.n_chars == len(row.text)


def test_path_ratios():
    nodes = [("body/ul/li", "Home"), ("body/ul/li", "News"), ("body/p", PROSE[0] * 3),
             ("body/p", PROSE[1]), ("body/p", "Short one."), ("body/div", "Imprint")]
    values, content = html_text.path_values(nodes)
    # by hand: means of the path, Gaussian over two neighbours a side, fused
    length = [4, 4, *[(len(PROSE[0]) * 3 + len(PROSE[1]) + 10) / 3] * 3, 7]
    marks = [0, 0, *[(12 + 3 + 1) / 3] * 3, 0]
    assert marks[2] == sum(map(html_text._marks, (PROSE[0] * 3, PROSE[1], "Short one."))) / 3

    def smooth(own, k):
        near = [(math.exp(-d * d / 2), own[k + d]) for d in range(-2, 3) if 0 <= k + d < len(own)]
        return sum(w * v for w, v in near) / sum(w for w, _ in near)
    want = [math.sqrt(smooth(length, k) * (1 + smooth(marks, k))) for k in range(6)]
    assert np.allclose(values, want)
    assert content.tolist() == [v >= 0.5 * np.std(want) for v in want]


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("no tags at all, just text", "no tags at all, just text"),
    ("<p>a<p>b", "a\nb"), ("<article><p>x &lt;y&gt; &#233;&nbsp;&amp z</article>", "x <y> é & z"),
    ("<article><p>one<br>two</p></article>", "one two"), ("<article><p>1 < 2</p>", "1 < 2"),
    ("<article><p>whole</p><p class='br", "whole"), ("<script>only", ""), ("<!-- open", ""),
    ("<nav>menu</nav>", ""), ("<article><div hidden>no</div>yes</article>", "yes")])
def test_odd_pages(page, text):
    assert "\n".join(html_text.main_blocks(page)[0]) == text


def test_html_rows(spark):
    rows = [(1, "u", LONG, 7), (1, "u", LONG, 7), (None, None, None, None), (3, "v", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = html_text.extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [
        (0, 0), (1, len(LONG.strip())), (1, len(LONG.strip())), (3, 0)]
    assert html_text.extract(pages.limit(0)).count() == 0


# ------------------------------------------------------------------------------- search

def best_of(docs, items):
    held = [(d, collections.Counter(w), len(w)) for d, t in docs
            for w in [lexical_search.terms_of((t or "").encode())] if w]
    total, df = sum(n for *_, n in held), collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = set(lexical_search.terms_of((text or "").encode()))
        rows = []
        for d, count, n in held:
            m = 10 + 90 * n * len(held) // total
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1)))
                        * (10**9 * count[t] // (1000 * count[t] + 8 * m)) for t in asked if count[t])
            if score > 0:
                rows.append((-score, math.inf if d is None else d, d))
        rows.sort(key=lambda r: r[:2])
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(rows[:10])]
    return collections.Counter(out)


def searched(spark, docs, items, **how):
    rows = lexical_search.ranked(
        spark.createDataFrame(docs, "doc_id long, text string, rank int, score string, query int"),
        spark.createDataFrame(items, "item_id long, text string, doc_id int"), **how)
    return collections.Counter(tuple(r) for r in rows.collect())


@pytest.mark.parametrize("how", [{}, {"most_terms": 12}])
def test_search_as_brute_force(spark, monkeypatch, how):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)] + ["Über", "UBER", "naïve", "x1", "A"]
    share = [1 / (k + 1) for k in range(len(words))]
    docs = [(k // 2 if k % 7 else None, " ".join(rng.choices(words, share, k=rng.randint(0, 40))),
             1, "s", 2) for k in range(300)]
    docs += [(900 + k, "w1 w2 w3 w1", 1, "s", 2) for k in range(150)]  # ties, in many blocks
    docs += [(5, None, 0, "", 0), (6, " .,", 0, "", 0), (7, LONG + " w50", 0, "", 0)]
    items = [(k % 9, " ".join(rng.choices(words, k=rng.randint(0, 9))), 3) for k in range(20)]
    items += [(30, None, 0), (31, "", 0), (32, "w1 w2 w3", 0), (33, "nowhere", 0), (None, "w4", 0)]
    want = best_of([d[:2] for d in docs], [i[:2] for i in items])
    assert searched(spark, docs, items, **how) == want
    assert not searched(spark, docs, [(1, None, 0)]) and not searched(spark, [], items)


def test_bounds_hold_and_skip():
    rng = np.random.default_rng(2)
    texts = [[b"t%d" % t for t in rng.zipf(1.4, 30) if t < 400] + [b"group%d" % (k % 12)] * 3
             for k in range(1500)]
    asked = [(q, [b"group%d" % q, b"t1", b"t2", b"t%d" % (q + 5)]) for q in range(12)]
    queries = lexical_search.Queries(asked)
    get = queries.vocabulary.get
    found = [np.unique([get(t) for t in own if get(t) is not None], return_counts=True)
             for own in texts]
    df = collections.Counter(t for own, _ in found for t in own.tolist())
    queries.weigh(len(texts), df)
    chunk = lexical_search.Chunk.build(
        range(len(texts)), [len(t) for t in texts], [a for a, _ in found], [n for _, n in found],
        len(texts), sum(map(len, texts)), queries.weights, queries.neighbours())
    again = lexical_search.Chunk.read(chunk.row([]), 0)
    assert chunk.block_rows[-1] == len(chunk.blocks) and max(np.diff(chunk.block_rows)) <= 64
    for own in queries.useful():
        weight = lexical_search._weight_of(queries, own)
        exact = chunk.scores(np.arange(len(texts)), weight)
        blocks, bound = again.bounds(own, weight)
        seen = np.zeros(len(texts), np.int64)
        for b, most in zip(blocks.tolist(), bound.tolist()):
            members = again.blocks[again.block_rows[b]:again.block_rows[b + 1]]
            seen[members] = np.maximum(seen[members], most)
        assert (seen >= exact).all()
        floor = int(np.sort(exact)[-10])
        places, scores = again.search(own, weight, floor)
        assert set(np.flatnonzero(exact >= floor)) <= set(places.tolist())
        assert (scores == exact[places]).all()
    assert again.opened < again.met / 2  # most blocks are skipped


# ---------------------------------------------------------------------------- alignment

def aligned_by_hand(texts):
    both = alignment.aligner(TOKENIZER, PIECES)
    model = Tokenizer.from_file(TOKENIZER)
    model.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    spelled = [both.a.bytes.to_pylist(), both.b.bytes.to_pylist()]
    rows, counts = [], collections.Counter()
    for text in texts:
        sides = []
        for ids, own in ((model.encode(" " + (text or ""), add_special_tokens=False).ids, spelled[0]),
                         (pieces.encode(text or ""), spelled[1])):
            ends = np.cumsum([len(own[i]) for i in ids]).tolist()
            sides.append([(e - len(own[i]), e, i) for i, e in zip(ids, ends)])
        a, b = sides
        joined = [b"".join(own[i] for *_, i in side) for side, own in zip(sides, spelled)]
        if not text or set(joined) != {(" " + text).encode()}:
            rows.append(None)
            continue
        links = [(x[2], y[2]) for x in a for y in b if max(x[0], y[0]) < min(x[1], y[1])]
        counts.update(set(links))
        cuts = [0, *sorted({x[1] for x in a} & {y[1] for y in b})]
        groups = ["|".join(",".join(str(i) for _, e, i in side if low < e <= high) for side in sides)
                  for low, high in zip(cuts, cuts[1:])]
        rows.append((len(a), len(b), len(groups), links,
                     hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = collections.defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (
        *r[:3], len(r[3]), sum(counts[p] == most[p[0]] for p in r[3]), sum(counts[p] for p in r[3]),
        r[4]) for r in rows]


def test_alignment_as_brute_force(spark, sf, monkeypatch):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "a", "hello", "don't", "é", "的话", "\U0001f600", "▁", "<|endoftext|>",
             "<s>", "<0x41>", "12", "\t", " x ", "\x00", "\xa0", "www", "ing", "▁ "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    texts += [None, "", "a", " ", "a", LONG[:3000]]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet")
              .filter("length(text) < 2000").limit(40).collect()]
    rows = [(k, t, 1, "p", 2) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, pair string, chunk int")
    monkeypatch.setattr(alignment, "CHUNK_PAIRS", 50)  # several chunks
    got = alignment.aligned(docs.repartition(3), TOKENIZER, PIECES).collect()
    want = aligned_by_hand(texts)
    assert len(got) == len(texts)
    for row in got:
        assert tuple(row)[1:] == (*want[row.doc_id][:6], want[row.doc_id][6]), texts[row.doc_id]


def test_alignment_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (None, "x"), (2, LONG)],
                                 "doc_id long, text string")
    got = alignment.aligned(docs, TOKENIZER, PIECES)
    assert got.count() == 4 and got.filter("n_a > 0").count() == 4
    assert got.filter("doc_id = 2").first().n_a > 30_000
    assert alignment.aligned(docs.limit(0), TOKENIZER, PIECES).count() == 0
    assert alignment.aligned(docs.select("doc_id", F.lit(None).cast("string").alias("text")),
                             TOKENIZER, PIECES).filter("n_links = 0").count() == 4
