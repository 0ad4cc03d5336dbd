"""Operators against brute force, round trips and SQL, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvlake.llm import chat, knn, lines, minhash, mixing, pages, pieces, quality, queries, shared, sharding, toxicity
from kvlake.llm.components import components
from tests.conftest import same_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {ord(c): c.lower() for c in string.ascii_uppercase}
rng = random.Random(11)
VOCAB = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, r=rng):
    words = [r.choice(VOCAB) for _ in range(n)]
    return " ".join(w + (". " if r.random() < 0.1 else "") for w in words).replace("  ", " ")


def edge_rows():
    """Nulls in each column, empty, blank and very long texts, repeated rows."""
    r = random.Random(21)
    long = prose(60_000, r)
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "b", 3), (5, "one", "en", "b", 3), (5, "one", "en", "b", 3),
        (None, "one two three four five six", None, "c", 1), (None, None, None, None, None), (6, long, "en", "a", 1), (7, long, "en", "a", 1), (8, "x" * 200_000, "en", None, 1),
        (9, "é ü ß \x00 𝔸 ▁ a", "de", "b", 9), (10, prose(200, r), "en", "d", 1),
    ]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOC).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


# 1 exact top-k


def brute_top(rows, k=5):
    v = {}
    out = set()
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            v.setdefault(i, []).append([int(np.floor(256 * float(np.float32(c)))) for c in x])
    for q in (i for i in v if i % 50 == 0):
        mine = min(v[q])
        all_ = sorted((-sum(a * b for a, b in zip(mine, x)), i) for i, xs in v.items() if i != q for x in xs if len(x) == len(mine))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(all_[:k])}
    return out


def test_top_k_random_and_ties(spark):
    r = np.random.default_rng(2)
    centre = r.normal(size=(8, 6))
    rows = [(int(i), [float(x) for x in centre[i % 8] + 0.05 * r.normal(size=6)]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 6) for i in range(120)] + [(1050, [0.25] * 6)]
    rows += [(2000, None), (2050, [None] + [0.1] * 5), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (None, [0.1] * 6), (2200, [0.1] * 3), (2201, [0.2] * 3), (2250, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    whole = knn.whole_vectors(df)
    for block in (64, 8192):
        got = knn.top_k(whole.filter("vec_id % 50 = 0"), whole, 5, block_rows=block, block_queries=8).collect()
        want = {t for t in brute_top(rows)}
        assert {tuple(t) for t in got if t.query_id != 2250} == want and len(got) == len(set(got))


def test_top_k_of_repeated_rows(spark):
    r = random.Random(33)
    rows = [(0, [1.0, 0.0, 0.0])] * 20 + [(1, [1.0, 0.0, 0.0])] * 20 + [(2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0])]
    rows += [(50, [0.5] * 3)] * 9 + [(i, [0.5] * 3) for i in range(51, 60)] + [(0, [0.25] * 3)] * 7 + [(100, [0.25] * 3)] * 7 + [(150, [0.25] * 3)] * 2
    rows += [(r.randrange(0, 400, 25), [r.choice([0.125, -0.5])] * 3) for _ in range(150)]
    whole = knn.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1))
    for block in (16, 8192):
        got = [tuple(t) for t in knn.top_k(whole.filter("vec_id % 50 = 0"), whole, 5, block_rows=block, block_queries=8).collect()]
        assert sorted(got) == sorted(brute_top(rows))


def test_top_k_empty(spark):
    none = knn.whole_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, rank int, score long"))
    assert knn.top_k(none, none).collect() == []


def test_tree_covers():
    x = np.random.default_rng(1).normal(size=(3000, 4)).round(1)
    t = knn.CoverTree(x)
    assert sorted(t.order) == list(range(3000))
    for n in range(len(t.lo)):
        d = np.sqrt(((t.points[t.lo[n] : t.hi[n]] - t.centres[n]) ** 2).sum(axis=1))
        assert d.max() <= t.radii[n] + 1e-6
        if len(t.kids[n]):
            assert [t.lo[n], *t.hi[t.kids[n]]] == [*t.lo[t.kids[n]], t.hi[n]]
    far = np.vstack([x, x + 1000])
    q, t = knn.CoverTree(x[:50] + 1000), knn.CoverTree(far)
    best = knn.Best(50, 3)
    done = knn.search(q, np.arange(50), t, t.order + 100, best)
    assert 0 < done < 0.1 * 50 * len(far)  # node pairs are pruned where the data allow it
    s = q.points @ t.points.T
    assert np.allclose(best.score, -np.sort(-s, axis=1)[:, :3])


def test_top_k_sql(spark, sf_dir, duck):
    same_rows(queries.op1_exact_top_k(spark, sf_dir), duck, queries.OP1_SQL)


# 2 toxicity


def test_toxicity_learns_and_holds_out(spark, edge):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        bad = r.random() < 0.3
        words = prose(40, r).split(" ")
        if bad:
            words.insert(r.randrange(len(words)), r.choice(["zqrude", "vxvile"]))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, DOC)
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, lab)
    out = {r.doc_id: (r.toxic_score, r.h) for r in toxicity.score(docs, model).withColumn("h", toxicity.held_out()).collect()}
    held = [i for i, (_, h) in out.items() if h]
    assert 100 < len(held) < 260
    right = sum((out[i][0] >= 0.5) == (labels[i][2] == 1) for i in held)
    assert right / len(held) > 0.95
    import zlib

    assert all(out[i][1] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    flipped = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert np.array_equal(toxicity.fit(docs, flipped).table, model.table)  # held-out labels change nothing
    scored = toxicity.score(edge.withColumn("toxic_score", F.lit("clash")), model).collect()
    assert len(scored) == len(edge_rows()) and all(0 <= r.toxic_score <= 1 for r in scored)
    by = {r.doc_id: r.toxic_score for r in scored}
    assert by[1] == by[2]


def test_toxicity_sample_is_bounded_in_rows(spark, monkeypatch):
    seen = []

    def keep(df, name):
        out = shared.keep(df, name)
        seen.append(out.count())
        return out

    monkeypatch.setattr(toxicity, "keep", keep)
    docs = spark.createDataFrame([(i % 3, f"word{i} text", "en", "s", 1) for i in range(900)] + [(None, "x", "en", "s", 1)], DOC)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(3)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, sample_rows=10)
    assert seen == [10] and all(0 <= r.toxic_score <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(docs, model).filter("doc_id IS NULL").select(toxicity.held_out().alias("h")).first().h is True


def test_scratch_tables_go(spark):
    with shared.scratch():
        inner = shared.keep(spark.range(3), "inner")
        outer = shared.keep(inner, "outer", hold=True)
    assert outer.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
        spark.read.parquet(inner.kept_path).count()


def test_toxicity_without_labels(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(edge, none)
    assert all(r.toxic_score < 0.5 for r in toxicity.score(edge, model).collect())
    assert toxicity.score(empty, model).collect() == []


def test_ngrams_across_pieces():
    text = prose(300_000)
    assert len(text) > toxicity._PIECE
    whole = set(np.concatenate(list(toxicity.buckets_of(text))).tolist())
    old, toxicity._PIECE = toxicity._PIECE, 1 << 30
    try:
        assert set(np.concatenate(list(toxicity.buckets_of(text))).tolist()) == whole
    finally:
        toxicity._PIECE = old


# 3 pieces


def sentencepiece_model():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_match_library(spark, edge, docs, empty):
    sp = sentencepiece_model()
    alphabet = [" ", "  ", "\n", "a", "é", "▁", "\t", "\x00", "<s>", "</s>", "th", "𝔸", "　", "<0x0A>", "ß", ". ", "​", "�"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))) for i in range(3000)]
    some = spark.createDataFrame(rows, "doc_id long, text string").unionByName(edge.select("doc_id", "text")).unionByName(docs.select("doc_id", "text"))
    texts = defaultdict(list)
    for r in some.collect():
        texts[r.doc_id].append(r.text or "")

    def want(t):
        ids = sp.encode(t, add_eos=True)
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()

    got = defaultdict(list)
    for r in pieces.digests(some).collect():
        got[r.doc_id].append((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        assert sorted(got[i]) == sorted(map(want, t)), i
    assert pieces.digests(empty).collect() == []
    clash = pieces.encode_documents(edge.withColumn("token_ids", F.lit(1))).collect()
    assert sorted(map(repr, (list(r.token_ids) for r in clash))) == sorted(repr(sp.encode(t or "", add_eos=True)) for _, t, *_ in edge_rows())


def test_table_starts_afresh():
    p = pieces.Pieces(pieces._model(None))
    texts = [prose(50) for _ in range(30)]
    want = [(c.tolist(), t) for c, t in p.coded(texts)]
    old, pieces.TABLE_CHUNKS = pieces.TABLE_CHUNKS, 40
    try:
        assert [(c.tolist(), t) for c, t in p.coded(texts)] == want and [w[1] for w in want] == texts
    finally:
        pieces.TABLE_CHUNKS = old


# 4 pages


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


LONG = "This is a paragraph of the article with enough words to count."


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("<p>", ""), ("plain", "plain"), ("<script>var a='</p>';</script>", ""),
        (page(f'<nav><a href="/">Home</a></nav><div class="ad">Buy</div><article><h1>Head</h1><p>{LONG} A&amp;B &eacute;<p><b>Two\n\n  lines<br>here</article><footer>f</footer>'), f"Head\n{LONG} A&B é\nTwo lines here"),
        (page(f'<div id="menu"><a>A</a> <a>B</a></div><div><div class="content"><h2>H</h2><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></div><div class="sidebar"><p>{LONG}</p></div></div><div class="comments"><p>{LONG} {LONG}</p></div>'), f"H\n{LONG}\none\ntwo\nc1\nc2"),
        (page(f'<div class="page with-sidebar"><main><p>{LONG}</p><form><p>Name</p></form><aside>s</aside></main><div class="cookie-notice"><p>{LONG}</p></div></div>'), LONG),
        (page(f'<main><article><p>{LONG}</p></article><section class="comments"><article class="comment"><p>{LONG} {LONG}</p></article></section></main>'), LONG),
    ],
)
def test_main_text(html, text):
    assert pages.main_text(html) == text


@pytest.mark.parametrize("name", ["content with-sidebar", "overflow-hidden", "page has-legal-notice", "post with-comments"])
def test_names_do_not_hide_the_body_text(name):
    rest = f'<div class="menu"><a>{LONG}</a></div><div class="footer"><p>All rights.</p></div>'
    own = f'<div><h2>H</h2><p>{LONG}</p><p>{LONG}</p></div><div class="sidebar"><p>Aside.</p></div>'
    assert pages.main_text(page(f'<div class="{name}">{own}</div>{rest}')) == f"H\n{LONG}\n{LONG}"
    if "comments" not in name:
        assert pages.main_text(page(f'<div class="{name}">{own}</div>{rest}<div class="comments">{f"<p>{LONG}</p>" * 9}</div>')) == f"H\n{LONG}\n{LONG}"


@pytest.mark.parametrize("wrap", ["{}{}", "<div>{}</div>{}", "<div><div>{}</div></div>{}", "<div>{}{}</div>"])
def test_links_in_an_article_stay(wrap):
    sources = "<p><a href='#1'>First source of the text</a> and <a href='#2'>Second source of the text</a></p>"
    body = wrap.format(f"<h2>H</h2><p>{LONG}</p><p>{LONG}</p>", sources)
    assert pages.main_text(page(f"<article>{body}<ul class='related'><li><a>A</a></li></ul></article>")) == f"H\n{LONG}\n{LONG}\nFirst source of the text and Second source of the text"


def test_names_weigh():
    prose_ = " ".join([LONG] * 5)
    art = lambda x: page(f"<nav><a href='/'>Home</a></nav><article>{x}</article><footer>f</footer>")
    assert pages.main_text(art(f'<h1 class="page-header">Head</h1><p>{LONG}</p><p class="legal">{prose_}</p><p>{LONG}</p>')) == f"Head\n{LONG}\n{prose_}\n{LONG}"
    assert pages.main_text(art(f'<div class="page-tags"><p>{LONG}</p></div>')) == LONG
    assert pages.main_text(art(f'<p>{LONG}</p><p>{LONG}</p><div class="share"><a href="/x">Share</a> this</div><div class="legal">Fine print.</div><div class="sidebar"><p>{prose_}</p></div>')) == f"{LONG}\n{LONG}"
    assert pages.main_text(art(f'<p>{LONG}</p><div class="comments"><p>{prose_} {prose_} {prose_}</p></div>')) == LONG


def naive(node, share=None):
    """(node, C, T, LC, LT) of every node by recursion."""
    own = sum(len(" ".join(k.split()) if k.strip() else "") for k in node.kids if isinstance(k, str))
    below = [naive(k) for k in node.kids if not isinstance(k, str) and k.noise in (0, pages._DOUBTED)]
    c = own + sum(x[0][1] for x in below)
    t = sum(x[0][2] + 1 for x in below)
    lc, lt = (c, sum(x[0][4] for x in below) + 1) if node.tag == "a" else (sum(x[0][3] for x in below), sum(x[0][4] for x in below))
    return [(node, c, t, lc, lt)] + [y for x in below for y in x]


def test_densities_decide():
    r = random.Random(12)
    kept = dropped = 0

    def tree(depth):
        if not depth or r.random() < 0.3:
            words = " ".join(r.choices(VOCAB, k=r.choice([1, 3, 10, 40])))
            return r.choice(["<p>{}</p>", "<p>{}</p>", "<a href='/'>{}</a>", "<div class='legal'>{}</div>", "<h2>{}</h2>", "<span>{}</span>"]).format(words)
        return "<div>" + "".join(tree(depth - 1) for _ in range(r.randint(1, 4))) + "</div>"

    for _ in range(300):
        html = page("".join(tree(3) for _ in range(3)))
        root = pages.parse(html)
        pages._unname(root)
        every = naive(root)
        body = next(x for x in every if x[0].tag == "body")
        dense = {}
        for n, c, t, lc, lt in every:
            a, b = max(1, lc), max(1, lt)
            base = np.log(c / max(1, c - lc) * lc + body[3] / max(1, body[1]) * c + np.e)
            dense[id(n)] = n.weight() * (c / max(1, t) * np.log(max(1.0000001, c / a * max(1, t) / b)) / max(1e-9, np.log(max(base, 1.0000001))) if c else 0.0)
        sums = [sum(dense[id(k)] for k in n.kids if not isinstance(k, str) and id(k) in dense) for n, *_ in every]
        leaf = [dense[id(n)] if not any(not isinstance(k, str) and naive(k)[0][1] for k in n.kids if not isinstance(k, str) and id(k) in dense) else 0.0 for n, *_ in every]
        total = np.maximum(sums, leaf)
        nodes = pages.measure(root)
        best = pages._core(nodes)
        assert total[[n is best for n, *_ in every].index(True)] >= total.max() - 1e-6 * abs(total.max())
        path = [best]
        while path[-1].tag != "body":
            path.append(path[-1].up)
        least = min(dense[id(n)] for n in path)
        facts = {id(n): (c, lc) for n, c, _, lc, _ in every}
        text = pages.main_text(html)
        for up, child in zip(path[1:], path):
            for k in up.kids:
                if not isinstance(k, str) and k is not child and k.tag in ("p", "span") and facts[id(k)][0]:
                    told = " ".join("".join(x for x in k.kids if isinstance(x, str)).split())
                    if dense[id(k)] >= least:
                        kept += 1
                        assert told in text
                    elif k.tag == "p" and len(told) > 12:
                        dropped += 1
                        assert told not in text.split("\n")
    assert kept > 20 and dropped > 5


def test_pages_of_stray_tags_take_no_longer():
    import time

    for bad in ("<div>" * 50_000 + "</section>" * 75_000, "<b><i>" * 30_000 + "</u>" * 100_000, "<div><b>" + "<i>" * 50_000 + "<div></b>" * 50_000, "<article>" * 75_000, "<p>" + "<i>" * 50_000 + "<hr>" * 100_000, "<ul>" + "<i>" * 50_000 + "<li>" * 100_000):
        began = time.process_time()
        pages.main_text(bad + f"<p>{LONG}")
        assert time.process_time() - began < 20  # seconds for some 1 MB, where walks of all that is open take an hour


def test_pages_rows(spark):
    deep = "<div>" * 5000 + "<p>deep</p>"
    rows = [(1, None, None, "x"), (None, "u", "<p>a</p>", "y"), (2, "u", "", None), (2, "u", "", None), (3, "v", page("<article><p>" + LONG * 20_000 + "</p></article>"), ""), (4, "w", deep, "")]
    out = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted((repr(r.page_id), r.n_chars) for r in out.collect()) == sorted([("1", 0), ("None", 1), ("2", 0), ("2", 0), ("3", len(LONG) * 20_000), ("4", 4)])
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pages_of_the_table(spark, sf_dir):
    import html

    for r in pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h\d|ul|li|div)[^>]*>", body)]
        assert r.text == "\n".join(b for b in blocks if b)


# 5 lines


def test_lines_cover_the_text():
    for _ in range(3000):
        t = "".join(rng.choice(["a", ". ", "\n", " ", "b c d e f", "!", "…"]) for _ in range(rng.randint(0, 15)))
        cut = lines.lines_of(t)
        assert "".join(t[s : s + n] for s, n, _, _ in cut) == (t if t.split() else "")
        assert cut[:, 2].sum() == len(t.split()) and (len(cut) < 2 or cut[:, 2].min() >= lines.LINE_WORDS)


def test_lines_depend_on_the_passage():
    r = random.Random(3)
    words = [f"w{i}é" for i in range(500)]
    for _ in range(50):
        passage = " ".join(r.choices(words, k=60))
        held = []
        for _ in range(2):
            t = " ".join([*r.choices(words, k=r.randint(0, 40)), passage, *r.choices(words, k=r.randint(0, 40))])
            held.append({h: n for _, _, n, h in lines.lines_of(t).tolist()})
        assert sum(held[0][h] for h in held[0].keys() & held[1].keys()) >= lines.MIN_BLOCK_WORDS


def brute_runs(words, least):
    """Every shortest run of lines with so many words, by trying all."""
    out = set()
    for i in range(len(words)):
        for j in range(i, len(words)):
            if sum(words[i : j + 1]) >= least and (sum(words[i + 1 : j + 1]) < least or sum(words[i:j]) < least):
                out.add((i, j))
    return {(i, j) for i, j in out if sum(words[i:j]) < least or sum(words[i + 1 : j + 1]) < least}


def test_runs_are_shortest():
    r = random.Random(6)
    for _ in range(500):
        words, least = np.array([r.randint(1, 30) for _ in range(r.randint(1, 10))]), r.choice([1, 5, 20])
        first, last, h = lines.runs_of(words, np.array([r.randrange(1 << 60) for _ in words]), least)
        assert set(zip(first.tolist(), last.tolist())) == brute_runs(words.tolist(), least) and len(set(h.tolist())) == len(h) == len(set(zip(first, last)))


def test_patience_deals_fewest_ascending_runs():
    for _ in range(300):
        there = [rng.randrange(9) for _ in range(rng.randint(0, 12))]
        run = lines.patience(there)
        for name in set(run):
            own = [p for p, n in zip(there, run) if n == name]
            assert own == sorted(set(own))
        falling = []  # as many runs as the longest row that doesn't ascend
        for i, p in enumerate(there):
            falling.append(1 + max((falling[j] for j in range(i) if there[j] >= p), default=0))
        assert len(set(run)) == max(falling, default=0)


def covered(rows, n):
    """For each row, which of its words lie in n words that one document of smaller id holds in the same order."""
    held, out = set(), {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        own = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
        hit = [False] * len(w)
        for k, x in enumerate(own):
            if x in held:
                hit[k : k + n] = [True] * n
        held.update(own)
        out[i] = hit
    return out


def test_line_dedup_of_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    cuts = {r.doc_id: r for r in lines.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    short, long = covered(rows, lines.MIN_BLOCK_WORDS), covered(rows, 50)
    wrong = found = wanted = 0
    for i, t in rows:
        spans = [(c.start, c.start + c.length) for c in cuts[i].cuts] if i in cuts else []
        gone = [any(s <= m.start() and m.end() <= e for s, e in spans) for m in WORD.finditer(t or "")]
        wrong += sum(g and not c for g, c in zip(gone, short[i], strict=True))
        found += sum(g and c for g, c in zip(gone, long[i], strict=True))
        wanted += sum(long[i])
        assert sum(e - s for s, e in spans) <= len(t or "")
        blocks = cuts[i].blocks if i in cuts else []
        assert all(x.of < i and len(WORD.findall(t[x.start : x.start + x.length])) >= lines.MIN_BLOCK_WORDS for x in blocks)
    assert wrong == 0 and wanted > 1000 and found >= 0.9 * wanted  # words of passages of over 50 words


def test_lines_of_several_documents_are_no_block(spark):
    r = random.Random(35)
    stock = [" ".join(prose(9, r).strip(" .").replace(". ", " ").split()) + ".\n" for _ in range(4)]
    own = [sentences(4, r) for _ in range(5)]
    rows = [(i, own[i] + stock[i] + own[i][::-1]) for i in range(4)] + [(9, "".join(stock)), (10, own[4] + "".join(stock))]
    out = {x.doc_id: x.text for x in lines.dedup_lines(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)).collect()}
    assert out == {**dict(rows), 10: own[4]}  # the four together are a block of 9 only


def test_line_dedup_of_one_long_text(spark):
    r = random.Random(36)
    long = prose(400_000, r)
    rows = [(1, long), (2, "start " * 3 + long), (3, "w " * 300_000), (4, None)]
    out = {x.doc_id: x.text for x in lines.dedup_lines(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)).collect()}
    assert out[1] == long and len(out[2]) < 200 and out[3] == rows[2][1] and out[4] is None


def test_line_dedup(spark, edge, empty):
    passage = " ".join(f"Each sentence number {i} of this shared passage has words." for i in range(8))
    licence = "All rights are reserved by nobody here at all."
    r = random.Random(9)
    own = [" ".join(prose(12, r).strip(" .") + "." for _ in range(12)) for _ in range(6)]
    rows = [(1, f"{own[0]} {passage} {own[1]}"), (2, f"{own[2]}\n{passage}\n{own[3]}"), (3, own[4]), (4, own[4]), (5, f"{own[5]}\n{licence}"), (6, f"{licence}\n{own[3][::-1]}")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)
    out = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert out[1] == rows[0][1] and out[3] == own[4] and out[4] == ""
    assert "number 5" not in out[2] and own[2].split(". ")[0] in out[2]
    assert out[5] == rows[4][1] and out[6] == rows[5][1]  # a shared licence line alone is left
    refrain = "And so they all came home again at last.\n" * 9 + own[0]  # each repeat of a line is a line of its own
    again = spark.createDataFrame([(1, own[1] + "\n" + passage, "en", "s", 1), (2, refrain, "en", "s", 1), (3, f"{passage} {refrain}", "en", "s", 1)], DOC)
    assert {r.doc_id: len(r.text) for r in lines.dedup_lines(again).collect()}[3] == 0
    wide = lines.dedup_lines(edge.withColumn("cuts", F.lit(1)).withColumn("first", F.lit(2)))
    assert wide.columns == [*edge.columns, "cuts", "first"] and wide.count() == edge.count()
    by = {r.doc_id: r.text for r in wide.filter("doc_id IN (6, 7)").collect()}
    assert by[7] == "" and len(by[6]) > 200_000
    assert lines.dedup_lines(empty).collect() == []


def sentences(n, r):
    """n sentences of twelve words and a newline each, so that a line starts at each."""
    return "".join(prose(12, r).replace(". ", " ").strip(" .") + ".\n" for _ in range(n))


def test_line_dedup_in_any_order(spark):
    r = random.Random(31)
    p, q, *own = [sentences(5, r) for _ in range(5)]
    many = [sentences(5, r) for _ in range(30)]
    mixed = r.sample(many, 30)
    rows = [(1, p + own[0] + q), (2, q + own[1] + p), (3, "".join(many)), (4, own[2] + "".join(mixed)), (5, "".join(reversed(many)))]
    out = {x.doc_id: x.text for x in lines.dedup_lines(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)).collect()}
    assert out == {1: rows[0][1], 2: own[1], 3: rows[2][1], 4: own[2], 5: ""}


def test_line_dedup_of_repeats(spark):
    r = random.Random(32)
    p, q, *own = [sentences(5, r) for _ in range(8)]
    quote = "".join(p.splitlines(True)[1:3])
    short = "These ten words are much too short for a block.\n"
    pair = "A line of ten words that is held twice here.\n"
    rows = [
        (1, p + own[0] + short + own[1] + pair * 2), (2, p + own[2] + p + p), (3, own[3] + quote + own[4] + p), (4, own[5] + short * 5), (5, pair * 7),
        (6, quote + q), (7, q * 2 + own[0]),
    ]
    out = {x.doc_id: x.text for x in lines.dedup_lines(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)).collect()}
    assert out == {1: rows[0][1], 2: own[2], 3: own[3] + own[4], 4: rows[3][1], 5: "", 6: q, 7: ""}


# 6 chat


def test_chat_sql(spark, sf_dir, duck):
    same_rows(queries.op6_chat_format(spark, sf_dir), duck, queries.OP6_SQL)


def test_chat_round_trip(spark):
    r = random.Random(3)
    bits = ["<|im_end|>", "<|im_start|>", "\\", "<", "|", "\n", "a", "<\\|", "assistant", "é", ""]
    rows = []
    for c in range(60):
        for t in range(r.randint(1, 6)):
            text = lambda: "".join(r.choice(bits) for _ in range(r.randint(0, 6)))
            rows.append((c, t, r.choice(["user", "assistant", "system", text()]), text()))
    rows += [(96, 0, "r\n\\" * 300_000, "long role"), (96, 1, "assistant", "ok")]
    rows += [(99, 0, None, None), (None, 0, "assistant", "x"), (98, None, "user", "n"), (97, 0, "assistant", "y" * 100_000), (97, 0, "assistant", "y" * 100_000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, example int")
    made = chat.examples(df)
    by = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0], x[1] is not None, x[1], x[2] or "", x[3] or "")):
        by[c].append((role or "", text or ""))
    for e in made.withColumn("back", chat.turns_of(F.col("formatted"))).withColumn("reply", chat.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))).collect():
        want = by[e.conv_id][: e.n_turns]
        assert [tuple(x) for x in e.back] == want
        assert e.trains == (want[-1][0] == "assistant") and (not e.trains or e.reply == want[-1][1])
    for d in chat.digests(made).collect():
        turns = by[d.conv_id]
        loss = "".join(t for r_, t in turns if r_ == "assistant")
        assert d.n_turns == len(turns) and d.loss_chars == len(loss)
        assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert d.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.examples(df.limit(0))).collect() == []


# 7 near-duplicates


def brute_groups(rows, percent):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    held = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            held[x].append(d)
    both = Counter((a, b) for v in held.values() for j, b in enumerate(v) for a in v[:j])
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            r, s = sorted((root(a), root(b)))
            up[s] = r
    return {d: (len(sets[d]), root(d)) for d in sets}


def near_rows():
    r, rows = random.Random(8), []
    for _ in range(12):
        base = prose(150, r).split()
        rows.append(" ".join(base))
        for _ in range(8):
            words = list(base)
            for _ in range(r.randint(0, 5)):
                words[r.randrange(len(words))] = r.choice(VOCAB).upper()
            rows.append(" ".join(words))
    chain = prose(100, r).split()
    for k in range(12):  # each like the next, the ends unlike
        rows.append(" ".join(chain[k * 3 : k * 3 + 60]))
    return list(enumerate(rows + ["One two", "one TWO", "one", "", " ", "a b c d e"]))


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, percent):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, percent).collect()}
    assert got == brute_groups(rows, percent)


def test_blocks_find_what_stars_miss(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", 4)
    r, rows = random.Random(1), []
    hub = prose(200, r).split()
    for i in range(40):  # copies that are like the hub but not like each other; the hub has the largest id
        words = list(hub)
        for at in r.sample(range(200), 2):
            words[at] = f"w{i}x{at}"
        rows.append((i, " ".join(words)))
    rows.append((99, " ".join(hub)))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 90).collect()}
    assert got == brute_groups(rows, 90)


def test_near_duplicates_edges(spark, edge, empty):
    out = minhash.near_duplicates(edge.withColumn("kept", F.lit(1)).withColumn("digest", F.lit(0))).collect()
    assert len(out) == len(edge_rows())
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[7].component_id == 6 and not by[7].kept and by[6].kept and by[5].component_id == 4 and by[4].kept
    assert all(by[i].n_shingles == 0 and by[i].kept for i in (1, 2, 3))
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    assert minhash.near_duplicates(empty).collect() == []
    kept = minhash.keep_one(edge)
    assert kept.columns == edge.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 8, 9, 10]


def test_hashes_of_long_texts():
    text = prose(200_000)
    assert len(text) > minhash._PIECE // 2
    old, minhash._PIECE = minhash._PIECE, 1000
    try:
        cut = minhash.word_hashes(text)
    finally:
        minhash._PIECE = old
    words = WORD.findall(text.translate(LOWER))
    whole = minhash.word_hashes(text)
    assert np.array_equal(cut, whole) and len(whole) == len(words)
    assert len({w: h for w, h in zip(words, whole.tolist())}) == len(set(whole.tolist()))
    assert len(minhash.word_hashes("a \x00 a\x00 \x00a")) == 4 == len(set(minhash.word_hashes("a \x00 a\x00 \x00a").tolist()))


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 1), (1, None), (7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r_.node: r_.comp for r_ in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


# 8 quality rules


def brute_quality(text):
    words = WORD.findall(text or "")
    held = defaultdict(list)
    for i in range(len(words) - 4):
        held[tuple(words[i : i + 5])].append(i)
    covered = {x for v in held.values() if len(v) > 1 for i in v for x in range(i, i + 5)}
    full = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(covered)


def test_quality_counts(spark, docs, edge, empty):
    r = random.Random(2)
    odd = [(i, "".join(r.choice(["a", "b ", "a b c d e ", "\n", "a b c d e f\n", "#|", "\x0b", "　", "É"]) for _ in range(r.randint(0, 20))), None, None, None) for i in range(400)]
    df = docs.select(*edge.columns).unionByName(edge).unionByName(spark.createDataFrame(odd, DOC)).withColumn("kept", F.lit("clash"))
    judged = quality.judge(df)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter(tuple(x[n] for n in names) for x in judged.collect()) == Counter(brute_quality(x.text) for x in df.select("text").collect())
    assert all(x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words) and not (x.kept and x.base_failed) for x in judged.collect())
    assert quality.judge(empty).collect() == []


def test_votes_find_the_bad():
    patterns = [((0, 0, 1), 900), ((-1, -1, 0), 60), ((-1, 0, 0), 3), ((0, -1, 0), 3), ((0, 0, 0), 34)]
    for rounds in (1, 10, 1000):
        votes = quality.fit(patterns, rounds)
        assert votes.good((0, 0, 1)) > (0.8 if rounds == 1 else 0.9) and votes.good((-1, -1, 0)) < 0.1
    assert quality.fit([]).rate == {0: [], 1: []}


def simulated(n=3000, seed=3):
    """Rows of votes by rules that are right so often each, independently, and which rows are good."""
    r = np.random.default_rng(seed)
    good = r.random(n) < 0.75
    right = np.array([0.9, 0.8, 0.75, 0.85, 0.7])
    v = np.where(r.random((n, 5)) < right, 1, -1) * np.where(good, 1, -1)[:, None]
    return np.where(r.random((n, 5)) < 0.1, 0, v), good


def test_em_is_that_of_rows():
    v, _ = simulated()
    learned = quality.fit(sorted(Counter(map(tuple, v.tolist())).items()), rounds=25)
    rate = {c: np.array([[quality._START[c][x]] * 5 for x in (-1, 0, 1)]) for c in (0, 1)}
    prior = 0.8
    for _ in range(25):  # row by row, without patterns
        odds = np.full(len(v), prior / (1 - prior))
        for j in range(5):
            odds *= rate[1][v[:, j] + 1, j] / rate[0][v[:, j] + 1, j]
        good = odds / (1 + odds)
        prior = min(0.95, max(0.05, good.mean()))
        for c, w in ((1, good), (0, 1 - good)):
            rate[c] = np.array([[((w * (v[:, j] == x)).sum() + 10 * quality._START[c][x]) / (w.sum() + 10) for j in range(5)] for x in (-1, 0, 1)])
    assert learned.prior == pytest.approx(prior, abs=1e-6)
    assert all(learned.rate[c][j][x] == pytest.approx(rate[c][x + 1, j], abs=1e-6) for c in (0, 1) for j in range(5) for x in (-1, 0, 1))


def test_posterior_beats_every_rule_and_their_conjunction():
    v, good = simulated()
    learned = quality.fit(sorted(Counter(map(tuple, v.tolist())).items()))
    told = np.array([learned.good(tuple(x)) >= 0.5 for x in v.tolist()])
    assert (told == good).mean() > max([((v[:, j] >= 0) == good).mean() for j in range(5)] + [((v >= 0).all(axis=1) == good).mean()])
    assert len({round(learned.good(tuple(x)), 9) for x in v.tolist()}) > 100


def test_quality_is_no_conjunction(spark, sf_dir):
    judged = quality.judge(spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")).filter("NOT base_failed").collect()
    rules = [f"vote_{r}" for r in quality.votes()]
    assert any(x.kept and min(x[r] for r in rules) < 0 for x in judged) and any(not x.kept for x in judged)
    assert all(any(x[r] == 1 for x in judged) for r in rules) and sum(any(x[r] == -1 for x in judged) for r in rules) > 3 and len({round(x.p_good, 9) for x in judged}) > 10


def test_quality_keeps_clean_texts(spark, sf_dir):
    judged = queries.op8_quality_rules(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("NOT base_failed")
    n = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert n[(1, True)] > 20 * n.get((1, False), 0)


# 9 mixing


def test_targets():
    told = mixing.targets([("b", 10), (None, 5), ("a", 1000), ("é", 7)])
    assert [s for s, _, _ in told] == ["a", "b", "é", None]
    assert sum(t for _, _, t in told) == pytest.approx(1022) and all(t <= 3 * n + 1e-9 for _, n, t in told)
    assert [t for _, _, t in told[1:]] == [30, 21, 15]
    assert mixing.targets([]) == [] and mixing.targets([("a", 0)]) == [("a", 0, 0.0)]


def test_mix(spark, docs, edge, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    words = {d.doc_id: (len(WORD.findall(d.text or "")), d.source) for d in docs.collect()}
    taken, size, target = Counter(), Counter(), {}
    for x in rows:
        assert (x.size, x.source) == words[x.doc_id] and 0 <= x.taken <= 3 * x.size
        taken[x.source] += x.taken
        size[x.source] += x.size
        target[x.source] = x.target
    for s, t in target.items():
        assert taken[s] == round(t)
        assert all(x.source_size == size[s] for x in rows if x.source == s)
    again = mixing.mix(docs.repartition(3))
    assert {(x.doc_id, x.taken) for x in again.collect()} == {(x.doc_id, x.taken) for x in rows}
    odd = mixing.mix(edge.withColumn("size", F.lit(1)).withColumn("slot", F.lit(1))).collect()
    assert len(odd) == len(edge_rows()) and all(x.taken <= 3 * x.size for x in odd)
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_mix_of_few_words(spark):
    rows = [(1, "a b c", "en", "a", 1), (2, "d e f g", "en", "b", 1), (3, "h", "en", None, 1), (None, "i j", "en", "a", 1), (None, "k l", "en", "a", 1)]
    out = mixing.mix(spark.createDataFrame(rows, DOC)).collect()
    assert sum(x.taken for x in out) == 12 and all(x.taken <= 3 * x.size for x in out)
    for s in ("a", "b", None):
        assert sum(x.taken for x in out if x.source == s) == round(next(x.target for x in out if x.source == s))


def test_schedule_is_even(spark, docs):
    pieces_, _, sources = mixing.schedule(docs)
    slots = sorted((x.slot, x.source_no) for x in pieces_.select("slot", "source_no").distinct().collect())
    assert len({s for s, _ in slots}) == len(slots)
    total = sum(x.target for x in sources.collect())
    for s in sources.collect():
        for upto in (len(slots) // 3, len(slots)):
            share = sum(n == s.source_no for _, n in slots[:upto])
            assert abs(share - upto * s.target / total) <= 5


def test_word_count(spark):
    texts = ["", " ", "a", " a", "a ", " a b ", "\x0ba\x0cb　c", None, "\n\n", "\x1fa"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", mixing.word_count().alias("n")).collect()
    assert [x.n for x in sorted(got)] == [len(WORD.findall(t or "")) for t in texts]


# 10 sharding


def test_shards(spark, docs, edge, empty, tmp_path):
    for df, small in ((docs, 1000), (edge, 1 << 22)):
        clash = df.withColumn("shard", F.lit("x"))
        placed = sharding.shuffle_to_shards(clash, 40, bucket_bytes=small)
        assert set(placed.columns) == {*df.columns, "shard", "slot", "shard_size"}
        rows = placed.collect()
        assert len(rows) == df.count()
        by = defaultdict(list)
        for x in rows:
            by[x.shard].append(x.slot)
            assert x.shard_size == len((x.text or "").encode()) + 16
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        counts = [len(by[i]) for i in range(40)]
        assert max(counts) - min(counts) <= 1
        assert Counter(x.text for x in rows) == Counter(x.text for x in df.collect())
    a = {(x.doc_id, x.shard, x.slot) for x in sharding.shuffle_to_shards(docs).collect()}
    assert a == {(x.doc_id, x.shard, x.slot) for x in sharding.shuffle_to_shards(docs.repartition(7)).collect()}
    assert sharding.shuffle_to_shards(empty).collect() == []
    sharding.write_shards(docs, f"{tmp_path}/out", 5)
    assert spark.read.parquet(f"{tmp_path}/out").count() == docs.count()


def test_shards_do_not_depend_on_the_cluster(spark, docs):
    was, out = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("4", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append({(x.doc_id, x.shard, x.slot) for x in sharding.shuffle_to_shards(docs, bucket_bytes=20_000).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert out[0] == out[1] and len(out[0]) == docs.count()


def test_shards_of_many_copies(spark):
    rows = [(None, None, None, None, None)] * 3000 + [(i, f"text {i}", "en", "s", 1) for i in range(500)] + [(7, "x" * 50, "en", "s", 1)] * 900
    df = spark.createDataFrame(rows, DOC).repartition(3)
    out = sharding.shuffle_to_shards(df, 40, bucket_bytes=5000)
    assert out.columns == [*DOC.replace(" long", "").replace(" string", "").split(", "), "shard_size", "shard", "slot"]
    got = out.collect()
    assert Counter(tuple(x)[:5] for x in got) == Counter(rows)
    places = sorted(x.slot * 40 + x.shard for x in got)
    assert places == list(range(len(rows)))
    first = [x.doc_id is None for x in got if x.slot * 40 + x.shard < 1000]
    assert 450 < sum(first) < 900  # copies are spread over the whole


def test_running_sums(spark):
    from kvlake.llm.shared import running

    rows = [(g, i, (i * 7 + 3) % 11) for g in (1, 2) for i in range(100)]
    df = spark.createDataFrame(rows, "g int, i long, n long")
    for together in (3, 7, 1000):
        got = {(x.g, x.i): x.upto for x in running(df, "i", "n", "upto", 100, ("g",), together).collect()}
        assert got == {(g, i): sum(n for h, j, n in rows if h == g and j < i) for g, i, _ in rows}
