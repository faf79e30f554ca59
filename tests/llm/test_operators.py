"""Each training-data operator against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from groundling.llm import decontaminate, html_text, langid, line_dedup, lm_score, neardup_vectors, ngrams, packing, quality, simhash, token_file
from groundling.llm.common import MemoTokenizer, connected_components, tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, label int, host string, chunk string, a long, b long, n long, row long, __row long, __lines string, __gone long, __f long, __fp string, _gone0 long, _row0 string, shard long, key string"
LINE = "a line that very many of the documents hold, word for word"


def corpus():
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma,", "don't", "naïve", "größer", "x1", "42", "漢字", "ſtop", "İx", "\U0001f600!", "e.g."]
    texts = [None, "", " ", "\n", "one", "two words", "  lead  two\t\ttabs \r\n\n end ", "a\0b", "<|endoftext|> x", "x" * 50_000, "\xa0y z ", "A  b", "é́"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 200))) for _ in range(30)]
    texts += [texts[20], texts[20], texts[20] + " more"] + [f"own {i}\n  {LINE.upper() if i % 2 else LINE}\t\nlast" for i in range(7)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[20]), (None, f"x\n{LINE}"), (3, "same id again")]


def frame(spark, rows, parts=3):
    full = [(i, t, "en", "s", len(t or ""), "clash", 1, "clash", "clash", 1, 2, 3, 4, 5, "clash", 6, 7, "clash", 8, "clash", 9, "clash") for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain(path):
    t = Tokenizer.from_file(public_tokenizers.path(path))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.mark.parametrize("path, kind", [("byte_bpe_50k.json", "space_prefix"), ("word_bpe_49k.json", "space_dropped")])
def test_memo_gives_the_tokenizers_ids(path, kind):
    texts, ids = [t or "" for _, t in corpus()], plain(path)
    memo = tokenizer(public_tokenizers.path(path), kind)
    for _ in range(2):
        assert [np.frombuffer(x, memo.dtype).tolist() for x in memo.encode(texts)] == [ids(t) for t in texts]


@pytest.mark.parametrize("path, kind", [("byte_bpe_50k.json", "space_prefix"), ("word_bpe_49k.json", "space_dropped")])
def test_memo_knows_words_without_the_signs_after_them(path, kind):
    tok, ids = MemoTokenizer(public_tokenizers.path(path), kind), plain(path)
    texts = ["Word, word. word! (word) word's", "don't'll X's y'ALL a.b@c.d", "a", ".b", "\u0130. \u0130x. K. e\u0338.x \u226e \xe9. c\n(d)\n.e", ""]
    rng = random.Random(2)
    texts += [" ".join("".join(rng.choices("aZb's.,!(\xe9e\u0301\u03a3\u01300<\u0338=", k=rng.randrange(1, 7))) for _ in range(12)) for _ in range(500)]
    assert [np.frombuffer(x, tok.dtype).tolist() for x in tok.encode(texts)] == [ids(t) for t in texts]
    assert "word," not in tok.memo and "word" in tok.memo and ("Word" in tok.memo or "\0Word" in tok.memo) == tok.spaced
    assert not any(a.isascii() and a.isalpha() and b in "!'(.,<=" for k in tok.memo for a, b in zip(k, k[1:]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    got = {r["node"]: r["rep"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(51)}) == 1 and got[100] == got[101] == got[102] != got[0]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_code_lengths_are_optimal_and_limited():
    import heapq

    rng = random.Random(1)
    counts = np.array([rng.randrange(0, 50) for _ in range(60)])
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        cost += s
        heapq.heappush(heap, s)
    assert int((counts * token_file.code_lengths(counts)).sum()) == cost
    steep = np.array([2**k for k in range(30)])
    lengths = token_file.code_lengths(steep, 8)
    assert lengths.max() <= 8 and abs(sum(2.0 ** -int(n) for n in lengths) - 1) < 1e-12
    assert token_file.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    ids = np.array([rng.choice(np.flatnonzero(counts).tolist()) for _ in range(1000)])
    n = token_file.code_lengths(counts)
    bits, checks = token_file.encode(ids, token_file.canonical(n), n)
    assert token_file.decode(bits, checks, 1000, token_file.decode_table(n)).tolist() == ids.tolist()


def test_token_file(docs, empty):
    ids = plain("byte_bpe_50k.json")
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_file.token_digest(docs, path).collect()
    want = Counter()
    for i, t in corpus():
        x = np.array([*ids(t or ""), 0], "<u4")
        want[i, len(x), zlib.crc32(x.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert token_file.token_digest(empty, path).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    c = rng.standard_normal(8)
    rows = [(i, (c + 0.12 * rng.standard_normal(8)).tolist(), 1) for i in range(60)] + [(100 + i, rng.standard_normal(8).tolist(), i % 2) for i in range(60)]
    rows += [(200, rows[0][1], 1), (201, rows[0][1], 2), (202, rows[0][1], None), (203, None, 1), (204, [], 1), (205, [0.0] * 8, 1), (206, [math.nan] + [1.0] * 7, 1), (207, [None] + [1.0] * 7, 1), (208, [1e300] * 8, 1), (209, [2e300] * 8, 1), (210, [1.0, 2.0], 1), (211, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, key string")
    old = neardup_vectors.BLOCK, neardup_vectors.LEAST_BLOCK
    neardup_vectors.BLOCK, neardup_vectors.LEAST_BLOCK = 16, 4
    try:
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup_vectors.near_vectors(df).collect()}
    finally:
        neardup_vectors.BLOCK, neardup_vectors.LEAST_BLOCK = old
    def ok(v, label):
        return label is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)
    def unit(v):
        x = np.array(v) / np.abs(v).max()
        return x / np.linalg.norm(x)
    near = defaultdict(set)
    for i, v, a in rows:
        for j, w, b in rows:
            if i != j and a == b and ok(v, a) and ok(w, b) and len(v) == len(w) and unit(v) @ unit(w) >= 0.98:
                near[i].add(j)
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i] == (len(near[i]), min(seen), i == min(seen)), i
    assert neardup_vectors.near_vectors(df.limit(0)).count() == 0


PAGE = """<html><head><title>t</title><script>var x="</p>";</script></head><body><header><a href=/>Site</a></header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title {0}</h1><p>First &eacute;&amp;lt; {0}<br>line <b>bold</b></p><aside>side</aside><p>Second <i>{0}</i><p>Third<div class="ad">Buy</div><ul><li>one<li>two</ul><form>f</form></article>
<section id="comments"><p>nice {0}</p></section><footer>&copy; x</footer></body></html>"""
BARE = "<html><body><div id=top class=menu><a>x</a></div><div id=wrap><h2>Head {0}</h2><p>Body number {0} is long enough</p><p>Join our club today</p></div><div class=foot>c</div></body></html>"


def test_html_text(spark):
    rows = [(i, "http://a.b/x", PAGE.format(i)) for i in range(3)] + [(10 + i, "http://C.d:80/y", BARE.format(f"{i} " + "q" * i)) for i in range(12)]
    rows += [(30, None, None), (31, "u", ""), (32, "u", "<p"), (33, "u", "plain & text"), (34, "u", "<![bad <p>x"), (35, "http://a.b/x", "<main><p>" + "w " * 100_000 + "</p></main>"), (0, "http://a.b/x", PAGE.format(0))]
    df = spark.createDataFrame([(*r, "host") for r in rows], "page_id long, url string, html string, host string").repartition(3)
    for limit in (html_text.BROADCAST_BYTES, 0):
        got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_text(df, limit).collect()]
        assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
        by = dict((i, t) for i, t, _ in got)
        assert by[1] == "Title 1\nFirst é&lt; 1 line bold\nSecond 1\nThird\none\ntwo"
        assert by[15] == "Head 5 qqqqq\nBody number 5 qqqqq is long enough"  # the club is the same on all pages
        assert by[30] == by[31] == "" and by[33] == "plain & text" and len(by[35]) == 199_999
    assert html_text.extract_text(df.limit(0)).count() == 0


def line_rules(rows):
    strip = lambda x: x.strip(line_dedup.SPACE)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in strip(x))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 40:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= 5 and max(held[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(docs, empty):
    want = line_rules(corpus())
    old, line_dedup.TASK_PROBES = line_dedup.TASK_PROBES, 2
    for size in (line_dedup.BROADCAST_BYTES, -1):
        got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.line_dedup_digest(docs, broadcast_bytes=size).collect())
        assert got == Counter((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in want)
        rows = line_dedup.line_dedup(docs, broadcast_bytes=size)
        assert rows.columns == docs.columns and Counter((r["doc_id"], r["text"] or "", r["n_chars"]) for r in rows.collect()) == Counter((i, t, len(t)) for i, _, _, t in want)
    line_dedup.TASK_PROBES = old
    shards, bits = line_dedup.line_index(docs)
    index = line_dedup._Probe({r['shard']: r['blob'] for r in shards.collect()}, bits)
    held = Counter(k for _, t in {(i, t) for i, t in corpus() if i is not None} for k in {line_dedup.line_hash(x) for x in (t or '').split('\n')} - {None})
    for (hi, lo), n in held.items():  # the count array holds every key of more than one document
        hi, lo = np.array([hi], np.uint64), np.array([lo], np.uint64)
        shard = index.shards.get(int(line_dedup._shard_of(hi, bits)[0]))
        at = -1 if shard is None else int(shard.probe(hi, lo)[0])
        assert at == -1 if n == 1 else int(shard.count[at]) == n
    assert sum(d for _, _, d, _ in want) == 7 and line_dedup.line_dedup_digest(empty).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(2)
    hi, lo = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    s = line_dedup.Shard(hi, lo, np.arange(5000), np.arange(5000))
    assert (s.keeper[s.probe(hi, lo)] == np.arange(5000)).all() and len(set(s.probe(hi, lo).tolist())) == 5000
    assert (s.probe(hi + np.uint64(1), lo + np.uint64(1)) == -1).all()


def distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontaminate(spark, docs, empty):
    rng = random.Random(4)
    items = ["".join(rng.choice("abcdefg ") for _ in range(n)) for n in (30, 45, 60, 80)] + ["short one", None, "x" * 40]
    bench = spark.createDataFrame([(i, t, "c") for i, t in enumerate(items)] + [(None, "y" * 50, "c")], "item_id long, text string, doc_id string")
    rows = [(None, items[0]), (-1, None), (-2, ""), (-3, "y" * 200)]
    for k in range(60):
        t = list(items[k % 4])
        for _ in range(rng.randrange(10)):
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice([[], ["Z"], ["Q", t[at]]])
        rows.append((k, "pre\n" * rng.randrange(3) + "".join(t).upper().replace(" ", " \t\n") + " after"))
    df = frame(spark, rows)
    want = set()
    for i, t in rows:
        for k, item in enumerate(items):
            if item and len(v := decontaminate.normalise(item)) >= 20 and (d := distance_in(v, decontaminate.normalise(t or ""))) <= int(len(v) * 0.1):
                want.add((i, k, d))
    for block in (decontaminate.BLOCK_CHARS, 50):
        found = decontaminate.find_leaks(df, bench, block_chars=block).collect()
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in found} == want and len(found) == len(want)
        kept = decontaminate.drop_leaks(df, bench, block_chars=block)
        assert kept.columns == df.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _ in rows if i not in {w[0] for w in want})
    whole = dict(rows)
    for r in found:
        assert distance_in(decontaminate.normalise(items[r["item_id"]]), decontaminate.normalise((whole[r["doc_id"]])[r["start_char"] : r["end_char"]])) == r["distance"]
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0 and decontaminate.drop_leaks(df, bench.limit(0)).count() == len(rows)


def test_lm_scores(docs, empty):
    rows = corpus()
    words = [lm_score.words_of(t or "") for _, t in rows]
    def grams(w, n):
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    own = [{n: grams(w, n) for n in (1, 2, 3)} for w in words]
    total = {n: sum((o[n] for o in own), Counter()) for n in (1, 2, 3)}
    size = sum(map(len, words))
    want = Counter()
    for (i, _), w, o in zip(rows, words, own):
        c = lambda g: total[len(g)][g] - o[len(g)][g]
        s = 0.0
        for k in range(len(w)):
            for n in range(min(k, 2), -1, -1):
                g = tuple(w[k - n : k + 1])
                back = (min(k, 2) - n) * math.log(0.4)
                if n == 0:
                    s += back + math.log(max(c(g), 0.5)) - math.log(max(size - len(w), 1))
                elif c(g) > 0:
                    s += back + math.log(c(g) / c(g[:-1]))
                    break
        want[i, len(w), round(s, 6)] += 1
    for bytes_ in (lm_score.CHUNK_BYTES, 500):
        got = Counter((r["doc_id"], r["n_words"], round(r["log_sum"], 6)) for r in lm_score.lm_scores(docs, chunk_bytes=bytes_).collect())
        assert got == want
    assert lm_score.lm_scores(empty).count() == 0


def test_quality(spark):
    rng = random.Random(6)
    good, bad = "the quick house stands on green hills".split(), "$$$ click buy!!! free ### win".split()
    rows = [(i, " ".join(rng.choice(bad if i % 3 == 0 else good) for _ in range(30))) for i in range(300)] + [(1000, None), (1001, ""), (None, "the house"), (5, "free win $$$")]
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(300)] + [(None, 1, 0), (1, 0, 0), (2, None, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    got = quality.score(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held) >= 0.97 * len(held)
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in got)
    assert quality.score(df.limit(0), model).count() == 0
    for few in (labels.limit(0), labels.where("quality = 1")):
        assert quality.score(df, quality.train(df, few)).count() == len(rows)


def plain_hash(gram: bytes, bits: int) -> int:
    h = sum(b << 8 * k for k, b in enumerate(gram)) ^ (len(gram) * 0x3C6EF35F & 0xFFFFFFFF)
    h ^= h >> 15
    h = h * 0x9E3779B1 & 0xFFFFFFFF
    h ^= h >> 13
    return (h * 0x85EBCA77 & 0xFFFFFFFF) >> (32 - bits)


def plain_grams(text, sizes, letters):
    raw = f" {text.lower()} ".encode()
    raw = bytes(b if not letters or b >= 128 or chr(b).isalpha() else 32 for b in raw)
    return [raw[i : i + n] for n in sizes for i in range(len(raw) - n + 1)]


def test_quality_and_language_against_brute_force(spark, monkeypatch):
    """Scores from plain dictionaries of n-grams; pieces of 64 bytes stand for the pieces of very long texts."""
    monkeypatch.setattr(ngrams, "_PIECE", 64)
    rng = random.Random(31)
    texts = ["", "a", "größer İx 漢字", "x" * 500] + [" ".join(rng.choice("the house Häuser 42 $$$ click über".split()) for _ in range(n)) for n in (1, 5, 30, 200)]
    own = ngrams.Indicators(quality.SIZES, quality.BITS)
    gen = np.random.default_rng(3)
    model = quality.NbSvm(gen.standard_normal(1 << quality.BITS), gen.standard_normal(1 << quality.BITS), 0.3, 2.0, -0.1)
    tf, at = [], []
    for t in texts:
        seen = {plain_hash(g, quality.BITS) for g in plain_grams(t, quality.SIZES, False)}
        assert set(own(t).tolist()) == seen
        norm = math.sqrt(sum(model.square[h] for h in seen))
        margin = sum(model.linear[h] for h in seen) / norm + 0.3
        assert abs(model.score(own(t)) - 1 / (1 + math.exp(-(2 * margin - 0.1)))) < 1e-9
        counts = Counter(plain_hash(g, langid.BITS) for g in plain_grams(t, langid.SIZES, True))
        tf.append({h: 1 + math.log(n) for h, n in counts.items()})
    vectors = langid._tf(texts)
    for row, want in zip(vectors, tf):
        assert {h: round(float(row[h]), 5) for h in np.flatnonzero(row).tolist()} == {h: round(v, 5) for h, v in want.items()}
    fitted = langid.Centroids.fit(["a", "a", "b", "b"], vectors[4:])
    idf = [math.log(5 / (1 + sum(h in row for row in tf[4:]))) + 1 for h in range(1 << langid.BITS)]
    for t, row, (lang, score, _) in zip(texts, tf, fitted.predict(texts)):
        if langid.has_letter(t):
            size = math.sqrt(sum((v * idf[h]) ** 2 for h, v in row.items()))
            cos = [sum(v * float(fitted.weights[h, j]) for h, v in row.items()) / size for j in range(len(fitted.names))]
            assert abs(max(cos) - score) < 1e-4 and lang in {n for n, c in zip(fitted.names, cos) if c > max(cos) - 1e-4}
        else:
            assert lang == "und"


def test_bottom_is_that_of_the_whole_table(spark):
    """From more tasks than groups, with ties, nulls and names that clash."""
    rng = random.Random(17)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(200), i, 1) for i in range(2000)] + [("c", 5, 9000, 1)]
    df = spark.createDataFrame(rows, "lang string, x int, i int, _place0 int").repartition(40)
    got = langid.bottom(df, "lang", [df["x"], df["i"]], 30)
    want = [r for lang in ("a", "b", "c", None) for r in sorted((r for r in rows if r[0] == lang), key=lambda r: r[1:])[:30]]
    assert got.columns == df.columns and Counter(map(tuple, got.collect())) == Counter(want)


def test_language_ties_take_the_first_name():
    x = langid._tf(["the house", "the house"])
    model = langid.Centroids.fit(["zz", "aa"], x)
    assert model.predict(["the house"])[0][0] == "aa"


def test_dual_coordinate_descent_separates():
    rows = [np.array([0, 2]), np.array([1, 2]), np.array([0]), np.array([1])]
    w, b = quality.dual_coordinate_descent(rows, [np.ones(len(r)) for r in rows], np.array([1.0, -1, 1, -1]), np.full(4, 10.0), 3, 50)
    assert all(y * (w[r].sum() + b) > 0.9 for r, y in zip(rows, (1, -1, 1, -1)))


def test_language(spark):
    rng = random.Random(8)
    vocab = {"en": "the and house with water".split(), "de": "der und haus mit wasser größe".split(), "fr": "le et maison avec eau été".split()}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(20)), k) for i, k in enumerate(rng.choice(list(vocab)) for _ in range(240))] + [(900, None, "en"), (901, "", "de"), (902, "123 !?", None), (903, "the house", None), (None, "der und", "de")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string").repartition(2)
    got = langid.identify(df).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(by[k]["lang_pred"] == "und" for k in (900, 901, 902)) and by[903]["lang_pred"] == "en"
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 240]
    assert held and all(r["lang_pred"] == rows[r["doc_id"]][2] and 0 <= r["score"] <= 1 for r in held)
    assert not any(r["rejected"] for r in held[:1]) and all(by[k]["rejected"] for k in (900, 901, 902))
    odd = df.limit(0).union(spark.createDataFrame([(7000, "zzqx kkj wvvx qqz", "en", "x"), (7001, "the house with water and the house", "de", "x")], df.schema))
    model = langid.fit(df)
    marks = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in langid.predict(odd, model, reject=True).collect()}
    assert marks == {7000: ("und", True), 7001: ("en", False)}
    assert {r["lang_pred"] for r in langid.predict(odd, model).collect()} <= set(vocab)
    few = langid.fit(df.union(df.where("doc_id = 5").withColumn("text", df["text"])), sample_per_lang=3)  # a bounded sample, ties and repeats included
    assert set(few.names) == set(vocab) and langid.fit(df, max_langs=1).names[0] in vocab and len(set(langid.fit(df, max_langs=1).names)) == 1
    assert langid.identify(df.limit(0)).count() == 0 and {r["lang_pred"] for r in langid.identify(df.withColumn("lang", df["source"] if "source" in df.columns else df["lang"].substr(9, 1)).where("lang is null")).collect()} <= {"und"}


@pytest.mark.parametrize("bins", [4, 2048])
def test_packing(docs, empty, bins):
    ids, path = plain("word_bpe_49k.json"), public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs, path, 64, bins, with_ids=True).collect()
    want = Counter()
    for i, t in corpus():
        x = np.array([*ids(t or ""), 1], "<u4")
        for k, s in enumerate(range(0, len(x), 64)):
            want[i, k, s, len(x[s : s + 64]), zlib.crc32(x[s : s + 64].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty, path).count() == 0


def test_packing_hardly_depends_on_the_split(spark):
    """The number of sequences against the lower bound, from one task and from many."""
    rng, path = random.Random(12), public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, " ".join(rng.choice("the house stands on green hills near water".split()) for _ in range(int(rng.lognormvariate(3.5, 1))))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 40):
        got = packing.pack(df.repartition(parts), path, 512, again_rows=2000).collect()
        fill = Counter()
        for r in got:
            fill[r["sequence_id"]] += r["length"]
        least = math.ceil(sum(fill.values()) / 512)
        assert max(fill.values()) <= 512 and least <= len(fill) <= 1.01 * least + 1
        assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)


def test_best_fit_takes_the_least_space():
    p = packing.BestFit(10, 2)
    assert [p.place(x) for x in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    q = packing.BestFit(10, 1)
    assert [q.place(x)[0] for x in (4, 7, 3)] == [0, 1, 1] and q.place(6)[0] == 2


def fingerprint(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, empty):
    rows = corpus()
    fps = [fingerprint(t) for _, t in rows]
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(docs).collect())
    want = Counter()
    for (i, _), f in zip(rows, fps):
        seen, todo = {f}, [f]
        while todo:
            x = todo.pop()
            for y in set(fps) - seen:
                if (x ^ y).bit_count() <= 2:
                    seen.add(y)
                    todo.append(y)
        want[i, f"{f:016x}", min((j for (j, _), g in zip(rows, fps) if g in seen and j is not None), default=None)] += 1
    assert got == want
    for n in (simhash.BROADCAST_ROWS, -1):
        kept = simhash.keep_one(docs, broadcast_rows=n)
        assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(i for (i, _, c), k in want.items() for _ in range(k) if c is None or i == c)
    assert simhash.simhash_groups(empty).count() == 0


@pytest.mark.parametrize("heavy", [1, 4, 1024])
def test_simhash_index_against_brute_force(spark, heavy):
    """Chains and near misses over all bytes; with ``heavy`` 1 every posting of two passes its fingerprints on."""
    rng = np.random.default_rng(heavy)
    v = rng.integers(0, 1 << 62, 150, dtype=np.uint64)
    v = np.concatenate([v, v ^ np.uint64(3), v ^ np.uint64(1 << 40 | 1 << 9), v ^ np.uint64(7 << 20), v[:1] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64)), v[1:2] ^ np.arange(400, dtype=np.uint64)])
    v = np.unique(v)
    least, near = {}, np.bitwise_count(v[:, None] ^ v[None, :]) <= 2
    for i in range(len(v)):
        if i not in least:
            todo, least[i] = [i], i
            while todo:
                for j in np.flatnonzero(near[todo.pop()]).tolist():
                    if j not in least:
                        least[j] = i
                        todo.append(j)
    fps = spark.createDataFrame([(i, x) for i, x in enumerate(v.view(np.int64).tolist())], "doc_id long, fp long").repartition(3)
    got = {r["fp"]: r["component_id"] for r in simhash.fingerprint_components(fps, heavy=heavy).collect()}
    assert got == {x: least[i] for i, x in enumerate(v.view(np.int64).tolist())}


def test_tally_and_count_filter():
    x = np.array([0x1122334455667788] * 4, np.uint64)
    y = np.array([0x1122334455667788, 0x1122334455667789, 0x1122334455660000, 0x1022334455667780], np.uint64)
    assert simhash.shared_bytes(x, y).tolist() == [8, 7, 6, 6]
    assert simhash._retained(x, y, 2).tolist() == [0, 1, 3]
    assert simhash.position_groups(2) == [(0, 1), (2, 3), (4, 5), (6, 7)]
    for n in (50, 600):  # the two searches of a posting agree
        rng = np.random.default_rng(n)
        v = rng.integers(0, 1 << 16, n, dtype=np.uint64)
        v = np.unique(v)
        for links in (simhash.spanning_links(v, np.zeros(len(v), int), 2), simhash.neighbour_links(v, 2)):
            group = np.arange(len(v))
            for i, j in links.tolist():
                assert int(v[i] ^ v[j]).bit_count() <= 2 and group[i] != group[j]
                group[group == group[j]] = group[i]
            near = np.argwhere(np.bitwise_count(v[:, None] ^ v[None, :]) <= 2)
            assert (group[near[:, 0]] == group[near[:, 1]]).all()
