"""Periodic runs, main text of pages and phrase collocations against brute force, and on odd input."""

import hashlib
import random
import re
from collections import Counter
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrain.llm import collocations as C
from talkgrain.llm import html as H
from talkgrain.llm import runs as R
from talkgrain.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
SMALL = "/root/testdata/sf0.001"
CLASHING = ("_id", "n", "runs", "best", "page", "path", "category", "phrase", "f", "_text", "digest", "deleted", "key")


def clash(df):
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


# --- periodic runs ------------------------------------------------------------------------------------------------------


def brute_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                s = w[i : i + length]
                if not any(all(s[k] == s[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def sequences():
    rng = random.Random(5)
    for _ in range(400):
        n, k = rng.randint(0, 60), rng.randint(1, 4)
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 2)):
            if n > 10:
                a, p, m = rng.randrange(n), rng.randint(1, 12), rng.randint(1, 50)
                w[a : a + m] = [w[a + i % p] if a + i % p < n else 0 for i in range(len(w[a : a + m]))]
        yield w
    base = [rng.randrange(50) for _ in range(400)]
    yield base + base[:97] * 5 + base + [1, 2] * 300 + [7] * 90 + base  # long enough for frequent words and blocks
    yield [0] * 3000
    yield ([0] * 40 + [1]) * 60


def test_runs_equal_brute_force():
    for w in sequences():
        assert R.find_runs(np.array(w, np.int64)) == brute_runs(w), w


def test_lag_counts_are_exact():
    rng = random.Random(1)
    for n in (10, 500, 5000):
        ids = np.array([min(int(rng.expovariate(0.4)), 40) for _ in range(n)])
        most = n // 4
        assert R.matches(ids, most).tolist() == [0] + [int((ids[:-q] == ids[q:]).sum()) for q in range(1, most + 1)]


def plain_row(doc_id, text):
    words = R.looped(doc_id, (text or "").encode().split())
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], digest("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), digest(left))


def test_runs_query_equals_brute_force(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) < 6000").collect()]
    rows += [(None, "a a a a a a a"), (None, None), (10**9, None), (10**9 + 1, ""), (10**9 + 2, " \t\n "), (7, "x y " * 4), (7, "x y " * 4), (8, "a b " * 6), (9, "a\x0bb\x0cc " * 6)]
    clash(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((plain_row(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 10


def test_runs_of_a_long_text_and_of_none(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(3000)}" for _ in range(150_000)]
    words[60_000:100_000] = words[60_000:70_000] * 4
    long = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    (row,) = R.periodic_runs(long).collect()
    assert [tuple(r) for r in row.runs] == [(60_000, 40_000, 10_000)] and row.collapsed.split(" ") == words[:70_000] + words[100_000:]
    assert R.run_digests(R.periodic_runs(spark.createDataFrame([], DOCS))).count() == 0


# --- main text ----------------------------------------------------------------------------------------------------------


def plain_shared(a, b):
    """Longest common subsequence by the full table, read off from its end."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    i, j, out = len(a), len(b), []
    while i and j:
        if table[i - 1][j] == table[i][j]:
            i -= 1
        else:
            j -= 1
            if not j or table[i - 1][j] == table[i][j]:
                i -= 1
                out.append(i)
    return out[::-1], table[-1][-1]


def test_alignment_equals_the_full_table(monkeypatch):
    rng = random.Random(4)
    for bits in (1 << 28, 64):  # the second halves the table
        monkeypatch.setattr(H, "MATRIX_BITS", bits)
        for _ in range(300):
            a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 30))] for _ in range(2))
            got = H.shared(np.array(a, np.int64), np.array(b, np.int64)).tolist()
            plain, most = plain_shared(a, b)
            assert len(got) == most and got == sorted(set(got))
            common = iter(b)
            assert all(a[i] in common for i in got)  # a common subsequence
            if bits > 1000:
                assert got == plain


def test_marked_lines():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p><p>no</p>";</script><body class="has-sidebar">
      <header class=top>no</header><nav><ul><li><a href="/x">no</a><li>no</ul></nav><div id="cookie-notice">no <b>no</b></div><!-- <p>no</p> -->
      <article class="post"><header><h1>Title &amp; more</h1></header><p>One<b>two</b>
         three&nbsp;four<br>five <p>six &lt;b&gt; &amp;amp; a < b<div class="ad-slot">no<div>no</div></div><img alt="no > no">
      <form><p>no</p></form><div class="content-with-sidebar">seven</div><table><tr><td>1<td>2</table><footer>no</footer></article>
      <section class="comments"><article class="comment"><p>no</p></article></section><aside>no</aside><p hidden>no</p><footer>no &copy;</footer>"""
    kept = [t for t, k in H.page_lines(page) if k == H.KEPT]
    assert kept == ["Title & more", "Onetwo three four", "five", "six <b> &amp; a < b", "seven", "1", "2"]
    assert all(t.startswith("no") for t, k in H.page_lines(page) if k == H.DROPPED)
    assert H.main_text(H.page_lines(page), set()) == " ".join(kept)


@pytest.mark.parametrize("html, text", [("", ""), ("plain", "plain"), ("<p>a<p>b", "a b"), ("<p title='x>y\">a</p><p>b", 'y">a b'), ("<div class='nav menu'>x</div>y", "y"), ("<main><p>a</p></main><p>b</p>", "a"), ("<p>a</p><script>x", "a"), ("a<", "a<"), ("<p>a</p><p cl", "a"), ("<nav>x<main>y</main></nav>", "y"), ("<p><a href=x>menu</a></p><p>text <a>link</a>", "text link"), ("</>a</ b>c", "ac"), ("<p>&#x41;&eacute;&bogus;</p>", "Aé&bogus;"), ("<b><p>x</b>y</p>z", "xy z")])
def test_pages_without_neighbours(html, text):
    assert H.main_text(H.page_lines(html), set()) == text


def plain_extract(rows):
    """Each page against its nearest neighbour in the sorted list of its host, with the full table."""
    keyed = []
    for k, (_, url, html) in enumerate(rows):
        m = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", url or "")
        host, rest = (m.group(1).lower(), url[m.end() :]) if m else ("", url or "")
        path = re.sub(r"(?s)[?#].*$", "", rest).split("/")
        order = (host, path, hashlib.sha256(f"{url or ''}\n{html or ''}".encode()).digest(), rows[k][0] is not None, rows[k][0], k)
        keyed.append((host, path, k, H.page_lines(html or ""), order))
    keyed.sort(key=lambda x: x[4])
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    out = []
    for at, (host, path, k, lines, _) in enumerate(keyed):
        near = [x for x in (keyed[at - 1 : at] if at else []) + keyed[at + 1 : at + 2] if x[0] == host]
        deleted = set()
        if near:
            best = max(near, key=lambda x: common(path, x[1]))
            a, b = [t for t, _ in lines], [t for t, _ in best[3]]
            deleted = set() if a == b else set(plain_shared(a, b)[0])
        text = H.main_text(lines, deleted)
        out.append((rows[k][0], rows[k][1], text, len(text)))
    return sorted(out, key=repr)


def made_pages():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    rows = []
    for i in range(300):
        host = "big.example" if i % 3 else f"h{i % 7}.example"
        site = [f"<div>Welcome to {host}</div>", "<div><a href=/>home</a> <a href=/x>x</a></div>", "<p>Sign our guest book</p>"]
        body = [f"<p>{' '.join(word() for _ in range(rng.randint(1, 9)))}</p>" for _ in range(rng.randint(0, 6))]
        page = "".join([*site[:2], *body, site[2]])
        if i % 10 == 0:
            page = "".join([*site, "<article>", *site, *body, "</article>"])
        rows.append((i, f"http://{host}/{rng.choice('abc')}/{rng.randrange(40)}/{word()}?q={i}", page))
    return rows + [(None, None, None), (1000, None, "<p>one</p>"), (1001, "", "<p>one</p>"), (1002, "no url", ""), (1002, "no url", ""), (5, *rows[5][1:]), (1003, "http://alone.example/", "<p>kept</p>")]


def test_pages_equal_brute_force(spark):
    rows = made_pages()
    df = clash(spark.createDataFrame(rows, PAGES)).repartition(5)
    got = sorted((tuple(r) for r in H.extract_pages(df).collect()), key=repr)
    want = plain_extract(rows)
    assert got == want
    plain = [t for i, _, t, _ in got if i and i < 300 and i % 10]
    assert sum("Welcome" in t for t in plain) < 0.1 * len(plain) < sum(bool(t) for t in plain)
    assert H.extract_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_given_pages(spark):
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in QUERIES["op12_main_text"](spark, SMALL).collect():
        inner = re.search(r"<article>(.*?)</article>", rows[r.page_id], re.S).group(1)
        assert r.text == " ".join(unescape(re.sub(r"</?(?:p|h1|br)>", "\n", inner).replace("<b>", "").replace("</b>", "")).split())
        assert r.n_chars == len(r.text)


def test_a_very_long_page(spark):
    html = "<article>" + "".join(f"<p>line {i}</p>" for i in range(150_000)) + "</article>"
    rows = [(k, f"http://h/{k}", html if k else html.replace("line 9", "other 9")) for k in range(2)]
    got = {r.page_id: r for r in H.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[1].text.startswith("line 0 line 1 ") and got[1].text.endswith("line 149999") and got[1].n_chars > 1_000_000


# --- phrases ------------------------------------------------------------------------------------------------------------


def brute_phrases(rows, least, longest, percent, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    known = {p: c for p, c in f.items() if c >= least}
    out = []
    for (lang, *w), a in known.items():
        if len(w) < 2:
            continue
        over = [c for (lang2, *v), c in known.items() if lang2 == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * c >= percent * a for c in over):
            continue
        cut = min((1_000_000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[(lang, *w[: cut[1]])], f[(lang, *w[cut[1] :])], n[lang], cut[0]))
    ranked = []
    for lang in {r[0] for r in out}:
        some = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], k + 1, *r[1:]) for k, r in enumerate(some)]
    return sorted(ranked)


def made_texts():
    rng = random.Random(8)
    vocabulary = ["The", "of", "né", " x", "日本", "New", "york", "don't", "a-b", "%"] + [f"w{i}" for i in range(30)]
    texts = []
    for i in range(400):
        w = [vocabulary[min(int(rng.expovariate(0.15)), len(vocabulary) - 1)] for _ in range(rng.randint(0, 40))]
        texts.append((rng.choice([" ", "  ", "\t"]).join(w).replace("w1 ", "w1, ").replace("w2 ", "w2\r\n"), rng.choice(["en", "en", "en", "fr", None])))
    return texts + [(None, "en"), ("", None), (" \n\t", "xx"), ("one two three " * 30, "und"), ("one two three " * 30, "und"), ("a.b;c" * 20, "fr")]


@pytest.mark.parametrize("least, percent, top", [(10, 50, 2000), (2, 70, 2000), (3, 50, 25)])
def test_phrases_equal_brute_force(spark, least, percent, top):
    rows = made_texts()
    df = clash(spark.createDataFrame([(i, t, lang, None, None) for i, (t, lang) in enumerate(rows)], DOCS)).repartition(3)
    got = C.collocations(df, least, 3, percent, top).select("category", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    want = brute_phrases(rows, least, 3, percent, top)
    assert sorted(map(tuple, got)) == want and len(want) > 20


def test_phrases_of_nothing(spark):
    assert C.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, "only words", None, None, None)], DOCS)).count() == 0


def test_chunks_and_steps_change_nothing(monkeypatch):
    """Cut anywhere, a long text has the same n-grams; pieces without an end are cut between words."""
    rng = random.Random(3)
    text = "".join(rng.choice(["aa", "b", "é", "dd"]) + rng.choice([" ", " ", " ", "  ", ". ", "\n"]) for _ in range(3000)) + "x " * 3000
    whole = Counter()
    for piece in re.split("[.\n]", text):
        w = piece.split()
        whole.update(" ".join(w[i : i + 3]) for i in range(len(w) - 2))
    for chunk, step, tally in ((1 << 20, 400_000, 10**6), (64, 7, 5), (1000, 33, 50)):
        monkeypatch.setattr(C, "CHUNK", chunk)
        monkeypatch.setattr(C, "STEP", step)
        monkeypatch.setattr(C, "TALLY", tally)
        state, out = C._Pass(3, False, None, None), []
        for tokens, own in C._chunks([text.encode()], 3):
            out += state.count(b"en", tokens, own)
        out += state.emit()
        got = Counter()
        for b in out:
            for p, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                got[p] += n
        assert got == whole
    assert list(C._chunks([], 3)) == []


def test_scores_beyond_64_bits(spark):
    rows = spark.range(1).selectExpr("cast(5000000000000 as bigint) a", "cast(6000000000000 as bigint) l", "cast(7000000000000 as bigint) r")
    assert C.scored(rows).first().score == 10**6 * 5_000_000_000_000**2 // (6_000_000_000_000 * 7_000_000_000_000)
