"""Personal data, main text, URL rules and toxicity."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import html_extract, pii, toxicity, url_filter

# Personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in re.sub("[ -]", "", m[0])]
        check = sum(sum(divmod(d * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1]))
        if 12 <= len(digits) <= 19 and check % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.text("ab12.@+-() 0é\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.detect(text) == plain_pii(text)
    assert pii.find(text)[0] == plain_pii(text)


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("write to john [at] example (dot) com today", "email", "john [at] example (dot) com"),
        ("write to john at example dot com today", "email", "john at example dot com"),
        ("a jоhn@exаmple.com b", "email", "jоhn@exаmple.com"),
        ("j​ohn@exa​mple.org", "email", "j​ohn@exa​mple.org"),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("é plus one two three four five six seven eight nine zero!", "phone", "plus one two three four five six seven eight nine zero"),
        ("one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("four one one one, one one one one, one one one one, one one one one", "card", "four one one one, one one one one, one one one one, one one one one"),
        ("card ４１１１ 1111 1111 1111.", "card", "４１１１ 1111 1111 1111"),
        ("write to john at example.com today", "email", "john at example.com"),
        ("write to jane.doe at mail.example.co.uk.", "email", "jane.doe at mail.example.co.uk"),
        ("write to john @ example . com today", "email", "john @ example . com"),
        ("plus eins zwei drei vier fünf sechs sieben acht neun", "phone", "plus eins zwei drei vier fünf sechs sieben acht neun"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, span):
    base, added = pii.find(text)
    assert base == []
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in added] == [(kind, span)]


@pytest.mark.parametrize("text", ["I was at the dot of noon", "one of two or three at the door", "look at this. dot dot dot", "We were at home. In the morning we left", "See more at example.com now", "stay . com si com sa", "", "привет, как дела, мир"])
def test_prose_is_left_alone(text):
    assert pii.find(text) == ([], [])


def test_base_spans_stay_beside_disguised_ones():
    base, added = pii.find("a@b.com and c [at] d [dot] org, +1 (017) 555-7713")
    assert len(base) == 2 and len(added) == 1


def test_query_against_the_patterns(spark):
    """Counts, digest and span strings of every document, recomputed from the five patterns over whole texts."""
    from millrace.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op4_pii"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_pii(texts[r.doc_id])
        told = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert [x for x in spans if x in told] == told and len(spans) == len(told) + r.n_disguised
        order = [(int(a), pii.KINDS.index(k)) for k, a, _ in (x.split(":") for x in spans)]
        assert order == sorted(order)


def test_scan_edge_cases(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "x" * 300_000 + " a@b.com", 9), (4, "a@b.com", 9), (4, "a@b.com", 9), (None, "1.2.3.4", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii int").repartition(2)
    got = pii.scan(df)
    assert got.columns == ["doc_id", "text", "pii"]
    found = {(r.doc_id, None if r.text is None else len(r.text)): [(x.kind, x.start, x.end) for x in r.pii] for r in got.collect()}
    assert found[1, None] == found[2, 0] == []
    assert found[3, 300_008] == [("email", 300_001, 300_008)] and found[None, 7] == [("ip", 0, 7)]
    assert got.count() == 6 and pii.scan(df.limit(0)).count() == 0
    assert pii.mask("write a@b.com now", [(6, 13, "email")]) == "write [EMAIL] now"


# Main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><!-- <p>gone</p> -->
<div id="cookie-notice"><p>We use cookies, accept them all, please, now, or else we cannot go on</p></div>
<div class="layout"><div class="sidebar"><p>Popular posts, news, and other things that you may like, a lot of them</p></div>
<{tag}><h2>A &amp; B</h2><p>First part, with text,\n and   more text to make it long enough for points.<p>Second &#8212; with <a href=x>one link</a>, and more,
of it.<ul><li>one<li>two</ul><div class="ad">Buy now, cheap, cheap, cheap</div><script>if (a < b) x("</p>")</script>
<table><tr><td>a<td>b</table><form>Name <input></form></{end}>
<section class="comments"><article class="comment"><p>I like this, very much, indeed I do, thanks for it all</p></article></section></div>
<aside>More</aside><footer>(c) us, and others, and more</footer></body></html>"""
TEXT = "A & B\nFirst part, with text, and more text to make it long enough for points.\nSecond — with one link, and more, of it.\none\ntwo\na\nb"


@pytest.mark.parametrize("tag", ["article", 'div class="content"', "main", "section"])
def test_main_text(tag):
    assert html_extract.extract(PAGE.replace("{tag}", tag).replace("{end}", tag.split()[0])) == TEXT


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("just text", "just text"),
        ("<p>a<p>b", "a\nb"),
        ("<p>a<b>b<p>c</b> d", "ab\nc d"),
        ("<p>x 1 < 2 &lt; 3</p>", "x 1 < 2 < 3"),
        ("<nav>menu</nav>", ""),
        ("<script>never closed <p>x</p>", ""),
        ("<article><p>short</p></article>", "short"),
        ("<p>a<br>b&nbsp;c</p>", "a b c"),
        ("<p hidden>no</p><p>yes</p>", "yes"),
        ("<p>a\u2003b\u3000 c</p>", "a b c"),
        ("<p data-x=" + "a" * 9000 + ">hello</p>", "hello"),
        ("<p title='odd>one</p><p>two</p>", "one\ntwo"),
        ("<p>text</p><a href=never", "text"),
        ("<svg>x<svg>y", "xy"),
        (f"<article><p>{'One, two. ' * 30}</p></article><article><p>{'Three, four. ' * 30}</p></article>", f"{('One, two. ' * 30).strip()}\n{('Three, four. ' * 30).strip()}"),
        (f"<main><h1>Title</h1><p>A lead.</p><article><p>{'One, two. ' * 30}</p></article></main>", f"Title\nA lead.\n{('One, two. ' * 30).strip()}"),
        (f"<div class='layout no-sidebar'><p>{'One, two. ' * 30}</p></div><div class=sidebar><p>{'Side, show. ' * 30}</p></div>", ("One, two. " * 30).strip()),
        (f"<div class='page header'><p>{'One, two. ' * 90}</p><div class=menu>Home</div></div>", ("One, two. " * 90).strip()),
    ],
)
def test_small_and_broken_pages(page, text):
    assert html_extract.extract(page) == text


@pytest.mark.parametrize("piece", ["<div>", '<a "', "<", "<li>x", "<!--", "<svg>x", "<p class='a", "</a 'x", "<header>", "<script>", "<div class=header>x"])
def test_deep_and_hostile_pages_are_linear(piece):
    def took(n):
        began = time.process_time()
        html_extract.extract(piece * n)
        return time.process_time() - began

    took(1000)
    # Four times the page takes nowhere near sixteen times as long.
    assert took(40_000) < 9 * max(took(10_000), 0.02)
    assert html_extract.extract("<div>" * 3000 + "deep, but there") == "deep, but there"


def random_tree(rng, depth=0):
    """``(tag, class, children)`` where a child is a tree, a text or a linked text."""
    tag = rng.choice(["div", "section", "article", "div", "ul"]) if depth else "body"
    children = []
    for _ in range(rng.randrange(1, 5)):
        if depth < 4 and rng.random() < 0.5:
            children.append(random_tree(rng, depth + 1))
        else:
            words = " ".join(rng.choice(["one,", "two", "three", "four."]) for _ in range(rng.randrange(1, 40)))
            children.append(("p", "", [("a", "", [words]) if rng.random() < 0.2 else words]))
    return tag, rng.choice(["", "", "content", "sidebar" if depth else ""]), children


def page_of(tree):
    if isinstance(tree, str):
        return tree
    tag, name, children = tree
    return f"<{tag}{f' class={name}' * bool(name)}>" + "".join(map(page_of, children)) + f"</{tag}>"


def plain_main_text(tree):
    """The stated scores by plain recursion over the tree itself; nothing of the page is parsed."""
    nodes = []  # tag, parent, aside, bonus, own blocks (text, linked)

    def walk(node, parent, aside):
        tag, name, children = node
        aside = aside or name == "sidebar" and tag != "article"
        bonus = {"article": 30.0, "div": 5.0, "section": 5.0}.get(tag, 0.0) + 25.0 * (name == "content")
        at = len(nodes)
        nodes.append([tag, parent, aside, bonus, []])
        for child in children:
            if isinstance(child, str):
                nodes[at][4].append((child, 0))
            elif child[0] == "a":
                nodes[at][4].append((child[2][0], len(child[2][0])))
            else:
                walk(child, at, aside)

    walk(tree, -1, False)
    below = lambda k: [x for x in range(len(nodes)) if any(a == k for a in line(x))]

    def line(k):
        out = []
        while k >= 0:
            out.append(k)
            k = nodes[k][1]
        return out

    text_of = lambda k: [(t, n) for x in below(k) if not nodes[x][2] for t, n in nodes[x][4]]
    kept_all = sum(len(t) for t, _ in text_of(0))
    score = [0.0] * len(nodes)
    for k, (tag, _, aside, _, own) in enumerate(nodes):
        for text, _ in own:
            if not aside and len(text) >= 25:
                steps = line(k)[0 if tag in ("div", "section", "article", "body") else 1 :]
                for level, up in enumerate(steps[:5]):
                    score[up] += (1 + text.count(",") + min(len(text) / 100, 3)) / [1, 2, 6, 9, 12][level]

    def value(k):
        own = text_of(k)
        size = sum(len(t) for t, _ in own)
        return (score[k] + nodes[k][3] * bool(size)) * (1 - (sum(n for _, n in own) / size if size else 0))

    if not kept_all:
        return None
    holders = [k for k in range(len(nodes)) if text_of(k) and not nodes[k][2] and (score[k] or nodes[k][3])]
    best = max(holders, key=lambda k: (value(k), -k), default=-1)
    if best < 0:
        return None
    best = next((k for k in line(best) if nodes[k][0] == "article"), best)
    kept, loose = {best}, True
    if nodes[best][0] != "body":
        loose = nodes[best][0] != "article" or nodes[nodes[best][1]][0] != "body"
        for k in range(len(nodes)):
            own = text_of(k)
            if k != best and nodes[k][1] == nodes[best][1] and not nodes[k][2] and own:
                density = sum(n for _, n in own) / sum(len(t) for t, _ in own)
                if value(k) >= max(10.0, 0.2 * value(best)) or loose and nodes[k][0] in ("p", "ul") and density < 0.25:
                    kept.add(k)
    return "\n".join(t for k in range(len(nodes)) if not nodes[k][2] and kept & set(line(k)) for t, _ in nodes[k][4])


def test_scores_against_plain_recursion():
    rng, seen = random.Random(6), 0
    for _ in range(400):
        tree = random_tree(rng)
        expected = plain_main_text(tree)
        page = html_extract._Page(page_of(tree))
        if expected is None or any(w == 1 and not a for w, a in zip(page.why, page.aside)):
            continue  # no text to score, or a wrapper taken back
        seen += 1
        assert html_extract.extract(page_of(tree)) == expected
    assert seen > 250


def test_main_text_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (2, "", "u"), (3, "<p>a" + "b" * 200_000, "u")], "page_id long, html string, text string")
    got = html_extract.main_text(df)
    assert got.columns == ["page_id", "html", "text"]
    assert sorted((r.page_id, len(r.text)) for r in got.collect()) == [(1, 0), (2, 0), (2, 0), (3, 200_001)]
    assert html_extract.main_text(df.limit(0)).count() == 0


# URL rules


def plain_verdict(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fit, default=(0, None, "allow"))
    return host, path, rule, verdict


def urls(n=400):
    rng = random.Random(4)
    hosts = ["example.org", "www.EXAMPLE.org", "a.com", "b.a.com", "org", "x.net", "notexample.org", ""]
    paths = ["", "/", "/en/1", "/en/12?x=/de/", "/es/", "/es", "/fr/x", "/de/y#z", "?q", "#f", "/DE/"]
    out = [rng.choice(["http", "HTTPS", "ftp"]) + "://" + rng.choice(hosts) + rng.choice(paths) for _ in range(n)]
    return [*out, None, "", "no scheme/org/", "http:/x.org/", "://org/", "a://b://c.org/x", "http://x.org/é/\n/y"]


@pytest.mark.parametrize("joined", [False, True])
def test_verdicts_against_plain(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(url_filter, "CASCADE_RULES", 0)
    rules = [*url_filter.RULES, ("net", "", "block"), ("x.net", "/en/", "allow"), *[(f"r{k}.io", "/p", "block") for k in range(200)]]
    every = [*urls(), *[f"http://s.r{k}.io/p{k}" for k in range(0, 400, 3)]]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(every)], "page_id long, url string, rule string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {k: plain_verdict(u, rules) for k, u in enumerate(every)}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).selectExpr("array(concat('k', id)) AS keys")
    listed = spark.range(0, 20_000, 37).selectExpr("concat('k', id) AS key")
    cascade = url_filter.build(listed, universe)
    rows = universe.select(F.col("keys")[0].alias("key"), F.xxhash64(F.col("keys")[0]).alias("a"), F.xxhash64(F.col("keys")[0], F.lit(1)).alias("b")).toPandas()
    keys = rows[["a", "b"]].to_numpy(np.int64).astype(np.uint64)
    assert cascade.has(keys).tolist() == [int(k[1:]) % 37 == 0 for k in rows["key"]]
    assert cascade.size < 541 * 4 and len(cascade.levels) > 1


def test_a_key_says_where_its_host_ends(spark):
    rules = [("a", "b.org", "block"), ("a/b", "/c", "block"), ("x.org", "", "block"), ("y.org", "/z", "block")]
    every = ["http://ab.org/", "http://a/b/c", "http://ab.org", "http://y.org/z", "http://x.org"]
    df = spark.createDataFrame([(u, "mine") for u in every], "url string, keys string")
    got = {r.url: (r.keys_, r.rule, r.verdict) for r in url_filter.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).withColumnRenamed("keys", "keys_").collect()}
    assert got == {u: ("mine", *plain_verdict(u, [r for r in rules if r[1][:1] in ("", "/") and "/" not in r[0]])[2:]) for u in every}
    assert got["http://ab.org/"] == ("mine", None, "allow") and got["http://y.org/z"][2] == "block"


def test_url_edge_cases(spark):
    rules = spark.createDataFrame([(None, "/", "block"), ("a.com", None, "block"), ("b.com", "/", None)], "host string, path string, verdict string")
    df = spark.createDataFrame([("http://a.com",), ("http://b.com/",)], "url string")
    assert sorted((r.rule or "", r.verdict) for r in url_filter.judge(df, rules).collect()) == [("", "allow"), ("a.com", "block")]
    assert {r.verdict for r in url_filter.judge(df, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(df.limit(0), rules).count() == 0


# Toxicity


def toxic_corpus(n, seed=1):
    """Toxic where an insult meets a group, harmless where either stands alone."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        if insult:
            words.insert(rng.randrange(len(words)), rng.choice(["Rotten", "rotten!"]))
        if group:
            words.insert(rng.randrange(len(words)), rng.choice(["martian", "Martians,"]))
        rows.append((k, " ".join(words), int(insult and group)))
    return rows


def test_pairs_of_terms_are_learnt(spark):
    rows = toxic_corpus(3000)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 2000] + [(None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    wrong = sum((got[i] >= 0.5) != y for i, _, y in rows if i >= 2000)
    assert wrong <= 10
    again = toxicity.FactorizationMachine.from_json(model.to_json())
    assert {r.doc_id: r.score for r in toxicity.score(docs, again).collect()} == got


def test_prediction_equals_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    names = np.sort(rng.choice(1 << toxicity.BITS, 30, replace=False))
    model = toxicity.FactorizationMachine(-0.3, names, rng.normal(size=30), rng.normal(size=(30, toxicity.FACTORS)))
    docs = [np.unique(rng.choice(np.append(names, [1, 2, 3]), n)) for n in (0, 1, 2, 9, 25)]
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    got = model.predict(len(docs), row, np.concatenate(docs).astype(np.int64))
    for score, doc in zip(got, docs, strict=True):
        own = [int(np.flatnonzero(names == t)[0]) for t in doc if t in names]
        z = model.bias + sum(model.weight[i] for i in own)
        z += sum(float(model.factor[i] @ model.factor[j]) for i in own for j in own if i < j)
        assert score == pytest.approx(1 / (1 + np.exp(-z)))


def test_documents_that_repeat_an_id_count_once(spark):
    rows = toxic_corpus(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    often = docs.unionByName(docs.where("doc_id = 3").crossJoin(spark.range(300)).select("doc_id", "text"))
    assert toxicity.fit(often, labels).to_json() == toxicity.fit(docs, labels).to_json()


def test_labels_of_the_held_out_fifth_do_not_matter(spark):
    rows = toxic_corpus(500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(toxicity.in_training(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert toxicity.fit(docs, labels).to_json() == toxicity.fit(docs, turned).to_json()


def test_scores_of_edge_cases(spark):
    model = toxicity.FactorizationMachine.fit([], np.zeros(0))
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x " * 100_000)], "doc_id long, text string")
    scores = [r.score for r in toxicity.score(df, model).collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(df.limit(0), model).count() == 0
    empty = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(df, empty).count() == 4
