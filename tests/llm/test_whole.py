"""Cases in which an operator once did less than the whole job."""

import math
import random
import tracemalloc
from collections import Counter

import corpus_pipeline
import numpy as np

from groundling.llm import decontaminate, html_text, lm_score, near_text, neardup_vectors


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}


def test_html_copied_pages_keep_their_text(spark):
    long = [f"Paragraph {k} of the one article that was copied, long enough to weigh" for k in range(3)]
    body = "".join(f"<p>{x}</p>" for x in long)
    whole = "\n".join(["The title", *long])
    bare = f"<html><body><div><h1>The title</h1>{body}</div></body></html>"
    article = f"<html><body><article><h1>The title</h1>{body}</article></body></html>"
    rows = [(i, "http://copies.a/x", bare) for i in range(12)] + [(20 + i, None, article) for i in range(12)]
    # nearly copies: a short part differs, so that pages are different
    rows += [(40 + i, "http://near.a/x", bare.replace("</div>", f"<p>no. {i}</p></div>")) for i in range(12)]
    # the same text in a fixed slot and in the article: nothing of the article goes
    rows += [(60 + i, "http://slot.a/x", f"<body><div><article><h1>Title {i}</h1><p>Join us</p><p>Own text number {i} {'q' * 40}</p></article><div><p>Join us</p></div></div></body>") for i in range(12)]
    got = texts(spark, rows)
    assert all(got[i] == whole and got[20 + i] == whole and got[40 + i] == f"{whole}\nno. {i}" for i in range(12))
    assert all(got[60 + i] == f"Title {i}\nJoin us\nOwn text number {i} {'q' * 40}" for i in range(12))


def test_near_vectors_of_a_crowd(spark):
    """A dense group, and vectors that link to only a few of it: every link counts, however crowded the window."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.standard_normal(64))
    group = unit(centre + 0.075 * unit(rng.standard_normal((1500, 64))))
    few = []
    for m in group[:60]:  # beyond the group on a member's own side: near that member, further from the rest
        few.append(unit(m + 0.17 * unit(m - (m @ centre) * centre) + 0.05 * unit(rng.standard_normal(64))))
    x = np.concatenate([group, np.array(few)])
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    label, todo = np.full(len(x), -1), []
    for i in range(len(x)):
        if label[i] < 0:
            label[i], todo = i, [i]
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & (label < 0)).tolist():
                    label[j] = i
                    todo.append(j)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup_vectors.near_vectors(df).collect()}
    assert {i: (int(near[i].sum()), int(label[i])) for i in range(len(x))} == got


def test_near_vectors_recall_of_lone_pairs_in_crowds(spark):
    """Pairs just above the threshold inside crowds without any other link, at three densities."""
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)

    def apart(x, cosine):
        """Unit vectors at this cosine to the rows of ``x``."""
        y = rng.standard_normal(x.shape)
        y = unit(y - (y * x).sum(axis=1, keepdims=True) * x)
        return cosine * x + math.sqrt(1 - cosine * cosine) * y

    rows, pairs = [], {}
    for label, cosine in ((1, 0.96), (2, 0.9), (3, 0.8)):
        crowd = apart(np.repeat(unit(rng.standard_normal((1, 64))), 2500, axis=0), cosine)
        other = apart(crowd[:100], 0.981)
        at = len(rows)
        rows += [(at + i, v, label) for i, v in enumerate([*crowd.tolist(), *other.tolist()])]
        x = np.concatenate([crowd, other])
        near = np.argwhere(np.triu(x @ x.T >= 0.98, 1)) + at
        pairs |= {(a, b): label for a, b in near.tolist()}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    for label in (1, 2, 3):
        own = [p for p, k in pairs.items() if k == label]
        assert len(own) >= 100 and sum(got[a][1] == got[b][1] for a, b in own) >= 0.99 * len(own)
    assert sum(n for n, _ in got.values()) <= 2 * len(pairs)


def test_pipeline_drops_near_copies(spark):
    """Against brute force over the shingle sets, and through the pipeline's stage."""
    rng = random.Random(9)
    own = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, base = [], [own(120) for _ in range(12)]
    for k, words in enumerate(base):
        rows.append((100 * k, " ".join(words)))
        for c in range(1, 9):
            w = list(words)
            for _ in range(c):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((100 * k + c, " ".join(w)))
    rows += [(5000, None), (5001, " "), (5002, "two words"), (5003, "Two  WORDS"), (None, rows[0][1]), (300, "two words"), (6000, " ".join(base[0]).upper())]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for _, t in rows)]
    least, reach = [], [{j for j in range(len(rows)) if len(a & sets[j]) >= 0.8 * len(a | sets[j])} for a in sets]
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = reach[todo.pop()] - seen
            seen |= new
            todo += new
        least.append(min((rows[j][0] for j in seen if rows[j][0] is not None), default=None))
    want = Counter(r for r, c in zip(rows, least) if r[0] == c)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for n, texts_, shingles_ in ((near_text.BROADCAST_ROWS, 2048, 1 << 20), (-1, 3, 200)):
        near_text.BLOCK_TEXTS, near_text.BLOCK_SHINGLES = texts_, shingles_
        assert Counter(map(tuple, near_text.keep_one(df, broadcast_rows=n).collect())) == want
    near_text.BLOCK_TEXTS, near_text.BLOCK_SHINGLES = 2048, 1 << 20
    assert Counter(map(tuple, corpus_pipeline.drop_near_copies(spark, df, "").collect())) == want
    assert near_text.keep_one(df.limit(0)).count() == 0


def test_html_names_do_not_drop_the_main_text(spark):
    word = lambda i: f"Own text of page {i}, " + "long " * 20
    shapes = {
        "a": '<body><div class="layout with-sidebar"><article><h1>T{0}</h1><p>{1}</p></article><div class="sidebar">side</div></div></body>',
        "b": '<body><div id="page" class="no-comments"><h1>T{0}</h1><p>{1}</p></div><div class="comments">few</div></body>',
        "c": '<body><article class="post category-search"><h1>T{0}</h1><p>{1}</p></article><article class="teaser"><p>x</p></article></body>',
        "d": '<body><article><div class="post-header"><h1>T{0}</h1>by me</div><p>{1}</p><div class="share">share</div></article></body>',
        "e": '<body><article><h1>T{0}</h1><p>{1}</p><div class="comments"><p>nice</p></div></article><div class="related"><article><p>other story</p></article></div></body>',
    }
    rows = [(100 * k + i, f"http://{h}.x/y", page.format(i, word(i))) for k, (h, page) in enumerate(shapes.items()) for i in range(10)]
    got = texts(spark, rows)
    assert got == {n: f"T{n % 100}\n{word(n % 100).strip()}" for n, _, _ in rows}


def test_html_keeps_what_is_the_articles_own(spark):
    """Lines that all pages of a host have, classes that only look like other matter, and deep nesting, in the article."""
    rows = [(i, "http://same.x/y", f"<body><nav>m</nav><main><h2>Summary</h2><p>About the thing number {i}</p><p>Read on below</p></main></body>") for i in range(12)]
    rows += [(20 + i, "http://names.x/y", f'<body><article><h1>T{i}</h1><div class="side effects">Nausea {i}</div><div class="form">A form of verse</div><div class="share-prices">Up {i}</div><div class="ad-box">Buy</div><div class="comments">nice</div></article></body>') for i in range(12)]
    for k, depth in enumerate((100, 180, 400, 3000)):
        rows.append((40 + k, "http://deep.x/y", "<div>" * depth + f"<article><h1>Head {k}</h1><p>Deep <b>down</b></p></article>" + "</div>" * depth + "<footer>f</footer>"))
        rows.append((50 + k, "http://deep.x/z", "<body><article><h1>Head</h1>" + "<div><span>" * depth + "<p>Deep</p>" + "</span></div>" * depth + "<p>after</p></article><footer>f</footer></body>"))
    got = texts(spark, rows)
    assert all(got[i] == f"Summary\nAbout the thing number {i}\nRead on below" and got[20 + i] == f"T{i}\nNausea {i}\nA form of verse\nUp {i}" for i in range(12))
    assert all(got[40 + k] == f"Head {k}\nDeep down" and got[50 + k] == "Head\nDeep\nafter" for k in range(4)), [got[k] for k in (40, 41, 42, 43, 50, 51, 52, 53)]


def test_html_long_comments_stay_out_of_an_article(spark):
    page = '<body><article><h1>T{0}</h1><p>Own text of page {0}</p><div class="comments"><p>{1}</p></div></article></body>'
    got = texts(spark, [(i, "http://talk.x/y", page.format(i, f"comment {i} and more " * 5)) for i in range(10)])
    assert got == {i: f"T{i}\nOwn text of page {i}" for i in range(10)}


def test_short_benchmark_items_match_exactly(spark):
    bench = spark.createDataFrame([(1, "Blue whale"), (2, "42"), (3, " "), (4, "4" * 30)], "item_id long, text string")
    rows = [(1, "the BLUE \n whale."), (2, "blue whales"), (3, "bluewhale, 421 and 142"), (4, "(42)"), (5, "blve whale"), (6, None), (7, "a42 blue whale 42")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["distance"], r["budget"], dict(rows)[r["doc_id"]][r["start_char"] : r["end_char"]]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert found == {(1, 1, 0, 0, "BLUE \n whale"), (4, 2, 0, 0, "42"), (7, 1, 0, 0, "blue whale"), (7, 2, 0, 0, "42")}
    assert {r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()} == {2, 3, 5, 6}


def test_lm_chunks_hold_little_and_score_alike_in_parts(monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts_ = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 900))) for _ in range(600)]
    totals = [x.astype(np.uint64) for x in lm_score.Chunk(texts_, 3, False).counts]
    tracemalloc.start()
    try:
        c = lm_score.Chunk(texts_, 3, True)
        made = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        whole = lm_score.score_chunk(c, totals, 10**6)
        scored = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert made < 110 * len(c.doc) and scored < 150 * len(c.doc)  # bytes a word; 127 were made while both sides' tables were held
    monkeypatch.setattr(lm_score, "OWN_WORDS", 700)
    assert (lm_score.score_chunk(lm_score.Chunk(texts_, 3, True), totals, 10**6) == whole).all()


def test_pipeline_finds_near_fingerprints(spark):
    """SimHash over five-word shingles: the stage's candidates against brute force."""
    rng = random.Random(11)
    rows, near = [], [rng.getrandbits(64) for _ in range(20)]
    for k, f in enumerate(near):
        for _ in range(12):
            flips = sum(1 << b for b in rng.sample(range(64), rng.randrange(6)))
            rows.append((len(rows), 100 if k % 5 else rng.choice([100, 50]), (f ^ flips) - (1 << 64 if (f ^ flips) >> 63 else 0)))
    got = {(r["a"], r["b"]) for r in near_text.fingerprint_pairs(spark.createDataFrame(rows, "id long, n int, fp long").repartition(3)).collect()}
    bits = lambda i, j: ((rows[i][2] ^ rows[j][2]) & (1 << 64) - 1).bit_count()
    assert all(a < b and bits(a, b) <= 3 and rows[a][1] == rows[b][1] for a, b in got)

    def groups(pairs):
        of = {i: {i} for i, n, _ in rows}
        for a, b in pairs:
            if of[a] is not of[b]:
                of[a] |= of[b]
                for i in of[b]:
                    of[i] = of[a]
        return {frozenset(x) for x in of.values()}

    alike = [k for k in range(20) if k % 5]  # one size: nothing that links goes by size
    own = lambda pairs: {g for g in groups(pairs) if min(g) // 12 in alike}
    assert own(got) == own({(i, j) for i in range(len(rows)) for j in range(i) if bits(i, j) <= 3})
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(300))
    hashes = [int(h) for h in near_text.shingles(text)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert near_text.fingerprint(near_text.shingles(text)) % (1 << 64) == want
