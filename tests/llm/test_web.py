"""HTML extraction, WARC archives, shard store."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import html_text, sharding, warc
from ledgerloom.llm._storage import new_path

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
<div id="cookie-notice">We use cookies</div><header>Head <nav><a href="/">Home</a></nav></header><div class="wrapper promo"><main><article class="post"><header>By X</header><h1>Title &lt;1&gt;</h1>
<p>One<b>two</b>&nbsp; three<p>four &eacute;&#233;<br>five<!-- gone <p>x</p> --><aside>See also</aside><div class="share">Tweet</div><form>f<input><select><option>o</option></select></form>
<table><tr><td>a</td><td>b</td></tr></table></div></div>tail<section class="comments"><article class="comment">c1</article></section></article></main></div>
<div class="comments"><article>c2</article></div><div style="display: none">h</div><footer>Foot</footer></body></html>"""


def mains(page):
    return " ".join(t for t, k in html_text.blocks(page) if k == html_text.MAIN)


def test_article_text():
    assert mains(PAGE) == "Title <1> Onetwo three four éé five a b tail"


@pytest.mark.parametrize("page,text", [
    ("<article><p>a<p>b</article>x", "a b"), ("<ARTICLE>a &amp b</ARTICLE>", "a & b"), ("<article>a < b > c", "a < b > c"), ("<article>a<p cla", "a"),
    ("<nav>menu<article>a</article>", "a"), ("<article><aside>ad</aside>a</article><aside><article>b</article></aside>", "a"), ("<main>m<footer>f</footer></main>", "m"),
    ("<article>a<script>x</article>", "a"), ("<article>x<!-- y", "x"), ("<article><p title='a > b'>q</p></article>", "q"), ("<article></article>", ""),
])
def test_broken_markup(page, text):
    assert mains(page) == text


@pytest.mark.parametrize("inside,text", [
    ('<p class="alert-level">Real.</p>', "Real."), ('<div class="search-results-study"><p>a</p>b</div>', "a b"), ('<p id="ad-hoc-committee">x</p>', "x"), ('<p class="comment-worthy">x</p>', "x"), ('<div class="share-of-voice">x</div>', "x"),
    ('<div class="ad">x</div>y', "y"), ('<div class="ad-slot top">x</div>y', "y"), ('<div id="cookie-notice">x</div>y', "y"), ('<section class="related-posts">x</section>y', "y"), ('<div class="comments-list">x</div>y', "y"),
    ('<div class="social_share-buttons">x</div>y', "y"), ('<p class="story alert">x</p>y', "y"), ('<div class="newsletter signup">x</div>y', "y"),
])
def test_names_inside_an_article(inside, text):
    assert mains(f"<article>{inside}</article>") == text


def test_pages_equal_an_independent_parser(spark):
    """Article text by the standard library's parser, which knows of the given pages only that adverts are of class ``ad``."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.blocks = [], [""]

        def handle_starttag(self, tag, attrs):
            if tag not in html_text.INLINE:
                self.blocks.append("")
            if tag not in html_text.VOID and tag != "p" and tag != "li":
                self.stack.append((tag, tag in ("nav", "header", "footer", "aside", "form", "script", "style") or dict(attrs).get("class") == "ad"))

        def handle_endtag(self, tag):
            if tag not in html_text.INLINE:
                self.blocks.append("")
            if any(t == tag for t, _ in self.stack):
                while self.stack.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            if any(t == "article" for t, _ in self.stack) and not any(out for _, out in self.stack):
                self.blocks[-1] += data

    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        reader = Reader()
        reader.feed(r.html or "")
        reader.close()
        want[r.page_id] = " ".join(" ".join(b.split()) for b in reader.blocks if b.strip())
    got = {r.page_id: r.text for r in html_text.main_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    assert got == want


def test_odd_tag_names_and_long_runs_of_tags():
    assert html_text.blocks('<x( class="ad">hi') == [("hi", html_text.OPEN)] and html_text.blocks("<a[b)*>x</a[b)*>") == [("x", html_text.OPEN)]
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        html_text.blocks("<aside>x" * n)
        html_text.blocks("<div>" * n + "</section>" * n)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]


def test_suffix_groups_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(60):
        streams = [[rnd.randint(0, 3) for _ in range(rnd.randint(0, 25))] for _ in range(6)]
        flat = np.array([t for s in streams for t in s], np.uint64)
        owner = np.repeat(np.arange(6), [len(s) for s in streams])
        run = rnd.randint(1, 9)
        seen, at = {}, 0
        for s in streams:
            for i in range(len(s) - run + 1):
                seen.setdefault(tuple(s[i : i + run]), []).append(at + i)
            at += len(s)
        starts, group = html_text.suffix_groups(flat, owner, run)
        got = {}
        for i, g in zip(starts.tolist(), group.tolist()):
            got.setdefault(g, []).append(i)
        assert sorted(map(sorted, got.values())) == sorted(x for x in seen.values() if len(x) > 1)


def plain_texts(rows, run=html_text.RUN, pages=html_text.PAGES, long=html_text.LONG):
    """Main texts by counting every substring and every stretch of blocks in plain Python."""
    name = lambda u: re.split(r"[/?#]", re.sub(r"(?s)^.*?://", "", u or ""))[0].rpartition("@")[2].lower()
    found = [(i, name(u), html_text.blocks(h or "")) for i, u, h in rows]
    out = []

    def runs(b):
        flat = [(t, k, n) for n, (text, k) in enumerate(b) for t in text.split(" ")]
        for i in range(len(flat) - long + 1):
            yield ("w", *[t for t, _, _ in flat[i : i + long]]), i, i + long, all(k == html_text.MAIN for _, k, _ in flat[i : i + long])
        at = [0]
        for text, _ in b:
            at.append(at[-1] + len(text.split(" ")))
        for i in range(len(b)):
            for j in range(i + 1, len(b) + 1):
                if at[j] - at[i] >= run:
                    yield ("b", *[t for t, _ in b[i:j]]), at[i], at[j], all(k == html_text.MAIN for _, k in b[i:j])

    for h in {h for _, h, _ in found}:
        distinct = {tuple(b) for _, x, b in found if x == h}
        count = {}
        for b in distinct:
            has = {}
            for key, _, _, main in runs(list(b)):
                has[key] = has.get(key, False) or main
            for key, main in has.items():
                n, m = count.get(key, (0, 0))
                count[key] = (n + 1, m + main)
        least = max(pages, -(-len(distinct) // html_text.SHARE))
        for i, _, b in (x for x in found if x[1] == h):
            gone = [False] * sum(len(t.split(" ")) for t, _ in b)
            far = list(gone)  # by long runs and very common ones only, which is what counts inside an article
            for key, x, y, _ in runs(b):
                n, m = count[key]
                if n >= least and 2 * m < n:
                    gone[x:y] = [True] * (y - x)
                    if key[0] == "w" or 2 * n >= len(distinct):
                        far[x:y] = [True] * (y - x)
            want = html_text.MAIN if any(k == html_text.MAIN for _, k in b) else html_text.OPEN
            at, texts = 0, []
            for text, k in b:
                n = len(text.split(" "))
                if k == want and 100 * sum((far if k == html_text.MAIN else gone)[at : at + n]) < html_text.COVERED * n:
                    texts.append(text)
                at += n
            out.append((i, " ".join(texts)))
    return sorted(out, key=repr)


def small_hosts(seed, n=140):
    """Pages of four hosts, one with most of them: furniture in and outside of elements that say so, articles with and without markup, copies."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    shared = [text(rnd.choice([3, 7, 12, 25])) for _ in range(8)]
    out = []
    for i in range(n):
        if out and rnd.random() < 0.3:
            out.append((i, out[-1][1], rnd.choice(out)[2]))
            continue
        piece = lambda: rnd.choice([text(rnd.randint(1, 9)), rnd.choice(shared), rnd.choice(shared[:2])])
        tag = lambda t, body: f"<{t}>{body}</{t}>"
        body = "".join(tag("p", piece()) for _ in range(rnd.randint(0, 5)))
        around = [tag(rnd.choice(["nav", "div", "footer"]), piece() + tag("p", piece())) for _ in range(2)]
        host = rnd.choice(["big.example"] * 5 + ["a.example", "b.example", ""])
        out.append((i, f"http://{host}/{i}" if host else None, around[0] + (tag("article", body) if rnd.random() < 0.5 else body) + around[1]))
    return out + [(None, None, None), (n, "u", ""), (n, "u", "")]


@pytest.mark.parametrize("part", [None, 2500, 600])
def test_main_text_equals_brute_force_for_any_size_of_parts(spark, part):
    rows = small_hosts(5)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("text", "cell", "host", "row", "parts")})
    for long in (20, 4):
        want = plain_texts(rows, long=long)
        got = html_text.main_text(df.repartition(3), part_bytes=part, long=long).collect()
        assert sorted(((r.page_id, r.text) for r in got), key=repr) == want
        assert all(r.n_chars == len(r.text) for r in got)


def test_furniture_inside_articles_goes_and_quotations_stay(spark):
    banner, quote = "Support our newsroom with a gift of any size you like today", "It was the best of times it was the worst of times"
    own = [f"story {i} has its own words {i * 7} and {i * 11}" for i in range(40)]
    rows = [(i, f"http://h/{i}", (f"<footer>{banner}</footer>" if i % 4 else "") + f"<article><p>{o}</p>" + (f"<p>{banner}</p>" if i % 4 == 0 else "") + f"<p>{quote}</p></article>") for i, o in enumerate(own)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{o} {quote}" for i, o in enumerate(own)}


def test_main_text_of_an_empty_table(spark):
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def big_host(n=3000):
    """Pages without article or main: a menu of many blocks, a long footer, passages that five articles share, a stock phrase in each."""
    word = lambda *key: "w" + hashlib.md5(repr(key).encode()).hexdigest()[:6]
    text = lambda words, *key: " ".join(word(*key, k) for k in range(words))
    menu = "".join(f"<div>{w}</div>" for w in "Home News Sport Weather Travel Contact".split())
    foot = text(40, "foot")
    own = [[f"{text(15, i)} as our reporter told us on Monday {text(15, i, 'b')}", text(25, "shared", i // 5), text(8, "quote", i // 4), text(12, i, "end")] for i in range(n)]
    return own, [(i, f"http://big.example/{i}", menu + "".join(f"<p>{p}</p>" for p in body) + f"<div>{foot}</div>") for i, body in enumerate(own)]


def test_shared_passages_of_a_big_host_stay(spark):
    own, rows = big_host()
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join(body) for i, body in enumerate(own)}


def test_parts_of_a_host_count_pages_together(spark):
    own, rows = big_host(300)
    notice = "Our offices are closed for the holiday until the second of January"
    rows = [(i, u, h + f"<div>{notice}</div>" if i % 9 == 0 else h) for i, u, h in rows]  # on 34 of 300 pages, fewer than three in a part
    rows += [(1000 + k, f"http://big.example/copy/{k}", rows[1][2]) for k in range(200)]  # copies count once
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: " ".join(body) for i, body in enumerate(own)} | {1000 + k: " ".join(own[1]) for k in range(200)}
    for part in (None, 16000):
        assert {r.page_id: r.text for r in html_text.main_text(df, part_bytes=part).collect()} == want


def pages(spark):
    rows = [(i, f"http://H{i % 3}.example/p?q={i % 2}#f", f"<p>{i}</p>" * 30) for i in range(40)]
    rows += [(100, "http://x/y\r\nz", "a" * 100), (101, None, "a" * 100), (102, "u", None), (103, "u", "\r\n\r\nWARC/1.1 é"), (None, "u", "a" * 100), (104, "u", "b" * 99), (105, "u", "b" * 99), (100, "http://x/y\r\nz", "a" * 100)]
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string"), rows


def test_warc_round_trip_and_order(spark):
    df, rows = pages(spark)
    index = warc.archive_and_index(df, records_per_file=7)
    got = index.collect()
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = sorted(repr((None if i is None else str(i), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if first.get(h, i) != i else "response", str(first[h]) if first.get(h, i) != i else None)) for i, _, h in rows)
    assert sorted(repr((r.id, r.payload_bytes, r.digest, r.record_type, r.refers_to)) for r in got) == want
    history = sorted(got, key=lambda r: r.history_pos)
    assert [r.history_pos for r in history] == list(range(len(rows)))
    keys = [warc._order(r.url, r.time, r.id) for r in history]
    assert keys == sorted(keys)
    folder = got[0].archive.rsplit("/", 1)[0]
    cut = sorted(warc.merge_index(warc.resolve(warc.read(spark, folder)), range_rows=5).collect(), key=lambda r: r.history_pos)
    assert [warc._order(r.url, r.time, r.id) for r in cut] == keys and len({r.capture_range for r in cut}) > 3


def test_warc_empty_table(spark):
    assert warc.archive_and_index(pages(spark)[0].limit(0)).count() == 0


def test_loser_tree_merges():
    rnd = random.Random(9)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted((rnd.randint(0, 9), j, i) for i in range(rnd.randint(0, 12))) for j in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_shard_store(spark):
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.repeat(F.md5(F.col("id").cast("string")), 20)).alias("text"), F.lit("x").alias("shard"), F.lit(1).alias("bytes"), F.lit("r").alias("run"))
    store = sharding.ShardStore(spark, new_path(spark, "store"), target_bytes=200_000, shard_rows=20, fanout=3)
    for k in range(4):
        assert store.append(rows.where(F.col("doc_id") % 4 == k)) == k + 1
    before = store.manifest().count()
    assert [len(runs) for runs in store.due()] == [4]
    last = store.compact()
    live = store.manifest()
    assert last > 4 and live.count() < before and live.agg(F.sum("rows")).first()[0] == 300 and store.due() == []
    assert store.read().exceptAll(rows).isEmpty() and rows.exceptAll(store.read()).isEmpty()
    assert store.read(1).count() == 75 and store.compact() == last
    with pytest.raises(Exception, match="exist"):
        store._commit(live, last)
    assert store.vacuum() == 4 and store.read().count() == 300
    empty = sharding.ShardStore(spark, new_path(spark, "store"))
    empty.append(rows.limit(0))
    assert empty.compact() == 1 and empty.read().columns == rows.columns and empty.read().count() == 0


def test_runs_of_one_tier_are_merged_and_large_ones_left(spark):
    """Arrivals of different sizes: similar ones meet, a large one with small shards is rewritten, one of full shards stays."""
    rows = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    store = sharding.ShardStore(spark, new_path(spark, "store"), target_bytes=100_000, shard_rows=50, fanout=3)
    store.append(rows.where("id < 3000").coalesce(1))
    assert [len(x) for x in store.due()] == [1]
    store.compact()
    large = {r.run for r in store._runs()}
    assert all(r.bytes * 2 >= store.target * r.shards for r in store._runs())
    for k in range(2):
        store.append(rows.where(f"id >= {3000 + 10 * k} AND id < {3010 + 10 * k}"))
        assert store.due() == []
    store.append(rows.where("id >= 3020 AND id < 3030"))
    store.compact()
    assert large < {r.run for r in store._runs()} and len(store._runs()) == 2 and store.read().count() == 3030


def test_sharding_runs_no_python(spark):
    store = sharding.ShardStore(spark, new_path(spark, "store"))
    store.append(spark.range(5).withColumn("text", F.lit("t")))
    assert not any(x in store.read()._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow"))
