"""Every corpus operator on small fixtures: brute force, round trips, held-out accuracy, odd inputs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import common, html, licenses, mixing, neardup, neighbours, packing, quality, suffixes, toxicity, urls

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "word " * 3000), (5, "word " * 3000), (None, "x y z"), (6, "é" * 300), (7, "Ω≈ç <|endoftext|> \u200b" * 20)]


def documents(spark, rows):
    """Documents with columns beside those the operators read, clashing with names they use inside."""
    df = spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 3}" if d != 4 else None, 0, 1, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, start long, found string")
    return df.repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def repeated_brute(words, least):
    cover, best = set(), 0
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            n = 0
            while j + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            if n >= least:
                best = max(best, n)
                cover |= {*range(i, i + n), *range(j, j + n)}
    return len(cover), best


@pytest.mark.parametrize("least", [3, 6, 7, 12])
def test_quality_against_brute_force(least):
    rng = random.Random(least)
    texts = [" ".join(rng.choice("abcd"[: 2 + k % 3]) for _ in range(rng.randint(0, 70))) for k in range(90)] + ["a " * 90, "", None]
    got = quality.measure(texts, quality.QualityRules(min_repeat=least))
    for i, t in enumerate(texts):
        w = common.words(t)
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        windows = {p for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)}
        assert (got["n_repeat_words"][i], got["n_covered_words"][i], got["longest_repeat"][i]) == (len(windows), *repeated_brute(w, least))


def test_quality_verdict_against_brute_force(spark):
    rng, rules = random.Random(51), quality.QualityRules()
    rows = []
    for i in range(120):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(30, 400))]
        for _ in range(rng.randrange(0, 4)):  # a planted repeat
            at, n = rng.randrange(len(w)), rng.randint(4, 60)
            place = rng.randrange(len(w))
            w[place:place] = w[at : at + n]
        rows.append((i, " ".join(w)))
    verdicts = Counter()
    for r in quality.quality_rules(documents(spark, rows)).collect():
        w = common.words(dict(rows)[r.doc_id])
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        windows = {p for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)}
        failed = len(w) < 50 or 100 * len(windows) > 50 * len(w)
        covered, longest = repeated_brute(w, rules.min_repeat)
        assert r.base_failed == failed
        assert r.kept == (not failed and covered <= rules.max_covered * len(w) and longest <= rules.max_longest * len(w))
        verdicts[r.base_failed, r.kept] += 1
    assert verdicts[False, False] > 10 and verdicts[False, True] > 10 and verdicts[True, False] > 3


def test_quality_rows(odd, empty):
    rows = quality.quality_rules(odd).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows if r.doc_id == 5)
    assert quality.quality_rules(empty).count() == 0


def test_neighbours_in_small_bundles(spark):
    """Lists cut into parts, bundles and blocks of queries give what one block gives; extra columns and repeated rows."""
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (900, 8))
    rows = [(i, v.tolist(), 0, "x", 1.0) for i, v in enumerate(x)] + [(0, x[0].tolist(), 0, "x", 1.0), (0, x[1].tolist(), 0, "x", 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, qid long, list string, most double")
    get = lambda rules: sorted(map(tuple, neighbours.search(df, "vec_id % 20 = 0", rules).collect()))
    one = get(neighbours.AnnRules(sample=500, lists=0.2))
    assert one == get(neighbours.AnnRules(sample=500, lists=0.2, block=50, query_block=7))
    assert {r[0] for r in one} == set(range(0, 900, 20)) and all(r[0] != r[2] for r in one)


def test_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 4, (12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 1500)] + rng.normal(0, 1, (1500, 16)), np.tile(centres[:1], (300, 1))]).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 100 = 0").collect()
    hits = total = 0
    for q in range(0, 1800, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10].tolist()
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        assert np.allclose([r.score for r in mine], [d[r.vec_id] for r in mine])
        if q >= 1500:  # equal vectors: the smallest ids
            assert [r.vec_id for r in mine] == want
        hits += len({r.vec_id for r in mine} & set(want))
        total += 10
    assert hits / total >= 0.9
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), "true").count() == 0


def near_brute(rows, size, percent):
    sets = {}
    for d, t in rows:
        w = [x.lower() for x in common.words(t)]
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: (len(sets[d]), top(d)) for d in ids}


def near_rows(n=160):
    rng, rows = random.Random(4), []
    for d in range(n):
        if d % 4 and rows:
            w = (rows[rng.randrange(len(rows))][1] or "x").split()
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(900)}"
            rows.append((d, " ".join(w).upper() if d % 3 else " ".join(w)))
        else:
            rows.append((d, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 120)))))
    return rows + [(900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (904, "one")]


@pytest.mark.parametrize("rules", [neardup.NearRules(), neardup.NearRules(shingle=5, percent=80), neardup.NearRules(leaf=4, block=5, hubs=2)])
def test_near_duplicates_against_brute_force(spark, rules):
    rows = near_rows()
    got = neardup.near_duplicates(documents(spark, rows), rules).collect()
    want = near_brute(rows, rules.shingle, rules.percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_one_id_with_two_texts(spark):
    base = " ".join(f"w{i}" for i in range(100))
    other = " ".join(f"v{i}" for i in range(100))
    rows = [(1, base), (1, other), (2, other + " tail"), (3, base + " tail"), (4, "unlike " + " ".join(f"u{i}" for i in range(50))), (5, base), (5, "")]
    got = neardup.near_duplicates(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [
        (1, 98, 1, True), (1, 98, 1, True), (2, 99, 1, False), (3, 99, 1, False), (4, 49, 4, True), (5, 0, 5, True), (5, 98, 1, False),
    ]


def test_near_duplicates_bounds():
    rules = neardup.NearRules()
    for percent in (80, 85, 100):
        one = neardup.NearRules(percent=percent)
        assert (1 - min(0.99, percent / 100) ** one.last) ** one.trees <= one.miss
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in rng.integers(1, 400, 60)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * f)], rng.integers(0, 1 << 63, 3, np.uint64)])) for s in sets for f in (0.8, 0.9, 0.97)]
    size, counts = np.array([len(s) for s in sets]), neardup._counts(sets)
    for i in range(len(sets)):
        others = np.array([j for j in range(len(sets)) if j != i])
        want = [j for j in others if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= rules.percent * (size[i] + size[j] - n)]
        assert neardup._expand(i, others, sets, size, counts, rules.percent).tolist() == want


def test_components_settle_or_fail(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    scratch = common.Scratch(spark)
    assert {r.root for r in common.components(chain, scratch).collect()} == {0}
    with pytest.raises(RuntimeError):
        common.components(chain, scratch, rounds=1)


def test_near_duplicates_odd(odd, empty):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and sum(r.kept for r in got if r.doc_id == 5) == 2
    assert all(r.kept for r in got if r.doc_id is None)
    assert neardup.near_duplicates(empty).count() == 0


def licenses_brute(rows, containment):
    """Every window of every template's size, without bands."""
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())
    out = {}
    for d, text in rows:
        words = licenses.tokens(text or "")
        for name, template in licenses.TEMPLATES:
            t = licenses.tokens(template)
            step, own = licenses.window_words(len(t)), grams(t)
            for at in range(0, max(1, len(words)), step):
                share = len(own & grams(words[at : at + 2 * step])) / len(own)
                if words and share >= containment:
                    best, first, n = out.get((d, name), (0.0, at, 0))
                    out[d, name] = (max(best, share), first, n + 1)
    return out


def test_licenses_against_brute_force(spark, odd, empty):
    """Whole notices and edited ones on both sides of the containment, and what only looks alike."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    rows = []
    for i in range(110):
        notice = licenses.TEMPLATES[i % len(licenses.TEMPLATES)][1].split()
        for _ in range(rng.randrange(0, 1 + len(notice) // 12) if i >= 22 else 0):
            notice[rng.randrange(len(notice))] = word()
        rows.append((i, " ".join([word() for _ in range(rng.randint(0, 90))] + notice + [word() for _ in range(rng.randint(0, 90))])))
    rows += [(200, "Licensed under nothing at all, free of charge"), (201, None), (202, ""), (203, "MIT"), (204, rows[0][1].upper())]
    rows += [(205, (word() + " ") * 30_000 + rows[11][1])]
    got = {(r.doc_id, r.license): (r.containment, r.first_word, r.windows) for r in licenses.license_scan(documents(spark, rows)).collect()}
    want = licenses_brute(rows, 0.8)
    assert got.keys() == want.keys() and {n for _, n in got} == {n for n, _ in licenses.TEMPLATES}
    for key, (share, first, n) in want.items():
        assert got[key][0] == pytest.approx(share) and got[key][1:] == (first, n)
    some = [r.containment for r in licenses.license_scan(documents(spark, rows), containment=0.5).collect()]
    assert sum(c < 0.8 for c in some) > 10
    assert licenses.license_scan(odd).count() == 0 and licenses.license_scan(empty).count() == 0
    one = documents(spark, [(7, rows[3][1])])
    twice = licenses.license_scan(documents(spark, [(7, rows[3][1])] * 2)).collect()
    assert [(r.doc_id, r.license) for r in twice] == [(r.doc_id, r.license) for r in licenses.license_scan(one).collect()]


def test_license_bands_keep_the_miss():
    for _, text in licenses.TEMPLATES:
        n = len(licenses.tokens(text))
        step = licenses.window_words(n)
        bands = licenses.bands_needed(n, step, 0.8, 1e-6)
        shingles = max(1, n - 2)
        assert step >= n and (1 - 0.8 * shingles / (2 * step + shingles)) ** bands <= 1e-6


def test_html_held_out():
    extract = html.Extractor(400)
    made, f = html.PageGenerator(77), 0.0
    for _ in range(60):
        page = made.page()
        out, work = [], [html.parse(page)[0]]
        while work:
            item = work.pop()
            if isinstance(item, str):
                out += [item.replace(made.MARK, "")] if made.MARK in item else []
            else:
                work += reversed(html.blocks(item))
        a, b = Counter(out), Counter(extract([page.replace(made.MARK, "")])[0].split("\n"))
        f += 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))
    assert f / 60 > 0.95
    assert extract([None, "", "<", "<p", "<!--", "plain &amp; text"])[:2] == ["", ""]


def everything(page):
    nodes = html.parse(page)
    return html.main_text(nodes, [True] * len(nodes))


#: Written by hand, in layouts that the generator has no copy of.
PAGES = {
    "columns": (
        "<html><head><title>x</title></head><body><table><tr><td width=120><a href=/>Home</a><br><a href=/a>About</a><br><a href=/c>Contact</a></td><td><h1>The old mill</h1>"
        "<p>The mill was built in 1820 by two brothers, who came from the north. It stood by the river for ninety years.</p><p>Later, in the great flood, the wheel was lost; "
        "only the walls remain today.</p></td></tr></table><center>Copyright 1999</center></body></html>",
        "The old mill\nThe mill was built in 1820 by two brothers, who came from the north. It stood by the river for ninety years.\nLater, in the great flood, the wheel was lost; only the walls remain today.",
    ),
    "wiki": (
        '<html><body><div id="content"><h1>Lynx</h1><div class="hatnote">For other uses, see <a href=x>Lynx (disambiguation)</a>.</div><p>A <b>lynx</b> is any of the four living species '
        "within the genus of <a href=y>medium-sized wild cats</a>, found in forests.</p><h2>Appearance</h2><p>Lynxes have a short tail, characteristic tufts of black hair on the tips of the "
        'ears, and large paws.</p></div><div id="navigation"><ul><li><a href=1>Main page</a></li><li><a href=2>Contents</a></li></ul></div><div id="footer"><p>This page was last edited on 3 May.</p></div></body></html>',
        "Lynx\nA lynx is any of the four living species within the genus of medium-sized wild cats, found in forests.\nAppearance\nLynxes have a short tail, characteristic tufts of black hair on the tips of the ears, and large paws.",
    ),
    "answers": (
        "<body><header><a href=/>My blog</a><nav><a href=/1>Posts</a><a href=/2>Tags</a></nav></header><main><article><h1>On bread</h1><p>I have baked bread every week for a year now, and this is "
        "what I learned from it.</p><p>Use less yeast, and wait longer.</p></article><section id=comments><h2>2 comments</h2><div class=comment><p>Anna</p><p>Thank you for this, I tried it and it "
        "worked well.</p><div class=children><div class=comment><p>Bob: same here, works in my small oven too.</p></div></div></div></section></main><footer>Powered by something</footer></body>",
        "On bread\nI have baked bread every week for a year now, and this is what I learned from it.\nUse less yeast, and wait longer.",
    ),
    "formula": (
        "<body><article><h1>Squares</h1><p>The area is <math><mi>a</mi><mo>=</mo><mn>4</mn></math> in this long example of a sentence with some math in it.</p></article></body>",
        "Squares\nThe area is a=4 in this long example of a sentence with some math in it.",
    ),
}


@pytest.fixture(scope="module")
def extractor():
    return html.Extractor()


@pytest.mark.parametrize("name", PAGES)
def test_html_by_hand(extractor, name):
    assert extractor([PAGES[name][0]]) == [PAGES[name][1]]


@pytest.mark.parametrize("tag", ["button", "select", "svg", "noscript", "object", "template", "video"])
def test_html_unclosed_elements_cost_no_article(tag):
    page = f"<body><div><{tag}>menu</div><article><p>text of it</p></article></body>"
    assert everything(page) == "text of it"
    assert everything(f"<body><article><p>some <{tag}>menu</{tag}>text</p></article></body>") == "some text"


def test_html_scopes():
    texts = lambda page: everything(page).split("\n")
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    rows = [n for n in html.parse("<table><tr><td>a<td>b<tr><td>c</table>") if n.tag == "tr"]
    assert len(rows) == 2 and rows[0].depth == rows[1].depth
    assert texts("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts("<p>a<p>b<div>c</div>x < y &lt; z<p>1 <2") == ["a", "b", "c", "x < y < z", "1 <2"]
    assert texts("<p title='a > b'>c</p><p title=\"d>e</p>") == ["c", "e"]
    assert texts("a<script>b</script >c<style>d</style\n>e<textarea>f</textarea>g<title>h") == ["aceg"]


@pytest.mark.parametrize("part", ["<a '", '<b "', "<a \"'>", "<", "</a ", "<!-- ", "<script>", "<div>", "<p>x</p>", "<ul><li><b>x", "&", "<a x='", "<p><form><b></i>", '<a "> '])
def test_html_is_linear(extractor, part):
    """A megabyte of what a parser may go through again and again."""
    import time

    start = time.time()
    extractor([part * (1_000_000 // len(part))])
    assert time.time() - start < 60


def test_html_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", PAGES["wiki"][0]), (3, "u", PAGES["wiki"][0]), (None, "u", "<p>"), (4, "v", "<article><p>" + "long text of it, " * 40_000 + "</p></article>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(2)
    got = html.extract_text(pages, pages_fitted=400).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got)[:3] == [(0, "u", 0), (1, "u", 0), (2, "", 0)]
    assert len({r.text for r in got if r.page_id == 3}) == 1 and len(got) == len(rows)
    assert [r.n_chars for r in got if r.page_id == 4] == [17 * 40_000 - 1]
    assert html.extract_text(pages.limit(0), pages_fitted=50).count() == 0


def test_html_decoding_is_consistent():
    nodes = html.parse("<body><div><p>a</p><div><p>b</p></div></div></body>")
    html.features(nodes, {}, {})
    rng = np.random.default_rng(3)
    for _ in range(50):
        kept = dict(zip(map(id, nodes), html.decode(nodes, rng.random(len(nodes))), strict=True))
        for node in nodes:  # below a node that main text leaves out, nothing is kept
            up = node.parent
            if up and up.parent and kept[id(up.parent)] and not kept[id(up)]:
                assert not kept[id(node)]


def test_urls(spark):
    rows = [(1, "http://a.example.net/en/x?y"), (2, "http://a.example.net/de/x"), (3, "http://EXAMPLE.com/de/"), (4, "https://x.org/fr/#t"), (5, None), (6, "no scheme"), (7, "http://net"), (8, "http://net/"), (9, "http://notnet/"), (10, "a://b://c.net/"), (11, "http://x.internet/"), (11, "http://x.internet/")]
    pages = spark.createDataFrame([(a, b, "x") for a, b in rows], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, urls.rule_table(spark)).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2][2:] == ("net/", "block") and got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    empty = urls.judge(pages.limit(0), urls.rule_table(spark))
    assert empty.count() == 0 and empty.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert {r.verdict for r in urls.judge(pages, urls.rule_table(spark).limit(0)).collect()} == {"allow"}
    assert got[7][2] is None and got[8][2] == "net/" and got[9][2] is None and got[10][:2] == ("b:", "//c.net/") and got[11][2] is None


def suffix_brute(rows, length):
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: r[0]):  # a repeated row is one document
        raw = (t or "").encode()
        cover = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                cover[i] += 1
                cover[min(i + length, len(raw))] -= 1
            seen.add(w)
        gone = np.cumsum(cover)[: len(raw)] > 0
        out[d] = (len(raw), hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("rules", [suffixes.SuffixRules(), suffixes.SuffixRules(group=2), suffixes.SuffixRules(length=40, kgram=10), suffixes.SuffixRules(bits=3, group=2)])
def test_suffixes_against_brute_force(spark, rules):
    """Also with every anchor taken apart into windows, and with content hashes that collide in the first attempt."""
    rng = random.Random(3)
    base = "".join(rng.choice("ab c") for _ in range(2000))
    rows = [(i, base[rng.randint(0, 1500) :][: rng.randint(0, 600)] + "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 150))) + base[rng.randint(0, 1800) :][:200]) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "a" * 500), (203, "ab" * 300), (204, "a" * 99), (206, "é" * 200), (207, base), (208, base), (210, rows[5][1]), (210, rows[5][1]), (211, base[300:900] + "q"), (211, base[300:900] + "q")]
    got = suffixes.dedup_substrings(documents(spark, rows), rules).select("doc_id", "n_bytes", F.sha2("kept", 256)).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == suffix_brute(rows, rules.length)


def test_suffixes_with_colliding_prefix_hashes(monkeypatch):
    """The sort's own hashes hold next to nothing: the bytes refute its order, and settle every bucket."""
    rng = random.Random(31)
    base = "".join(rng.choice("ab") for _ in range(400)).encode()
    contents = [base[i : i + 60] for i in (0, 3, 40, 90, 200)] * 3
    group, doc, start = np.zeros(15, np.int64), np.arange(15), np.zeros(15, np.int64)
    windows, offset = np.full(15, 21), np.full(15, 30)
    want = suffixes.repeated_windows(contents, group, doc, start, windows, offset, 40)
    weak = suffixes._Hasher(1)
    weak.of = np.full(256, np.uint64(1 << 63))
    monkeypatch.setitem(suffixes._HASHER, suffixes.SuffixRules.seed, weak)
    got = suffixes.repeated_windows(contents, group, doc, start, windows, offset, 40)
    assert len(want) == 210 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_suffixes_odd(odd, empty):
    assert suffixes.dedup_substrings(odd).count() == len(ODD)
    assert suffixes.dedup_substrings(empty).count() == 0


def test_mix(spark, odd, empty):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 40)) for i in range(900)]
    got = mixing.mix(documents(spark, rows)).taken.toPandas()
    assert len(got) == 900 and (got["taken"] <= 3 * got["size"]).all()
    per = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert np.allclose(per["target"].sum(), per["size"].sum()) and (per["target"] <= 3 * per["size"] + 1e-6).all()
    big = per[per["size"] > 500]
    assert (abs(big["taken"] / big["target"] - 1) < 0.02).all()
    again = mixing.mix(documents(spark, rows)).taken.toPandas()
    assert got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    assert mixing.mix(odd).taken.count() == len(ODD)
    assert mixing.mix(empty).taken.count() == 0


def test_mix_reaches_every_target(spark):
    """Sources far below a block, of one block, and above one; weights go round them."""
    rng = random.Random(18)
    rows = [(i, "w " * rng.randint(1, 60), "hot" if i % 2 else f"m{i % 5}") for i in range(1500)]
    rows += [(5000 + i, "w " * n, f"tiny{i}") for i, n in enumerate((1, 7, 30, 63, 64, 65, 200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = mixing.mix(docs, mixing.MixRules(block=64, least_slots=50, slots_per_source=2, bucket=16))
    assert made.block == 64
    got = made.taken.toPandas()
    per = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["taken"] == per["target"].round()).all() and (per.loc[[f"tiny{i}" for i in range(6)], "taken"] > 0).all()
    slots = made.schedule.toPandas().sort_values("slot")
    assert slots["slot"].tolist() == list(range(len(slots)))
    by_sid = made.sources.toPandas().set_index("sid")
    assert (slots.groupby("sid")["tokens"].sum() == by_sid["target"].sort_index().round()).all()
    # In every stretch from the start, a source has its share of slots.
    for sid, ranks in slots.groupby("sid"):
        assert ranks["rank"].tolist() == list(range(len(ranks)))
        assert (abs(ranks["slot"] / len(slots) - (ranks["rank"] + 0.5) / len(ranks)) <= 1 / len(ranks) + len(by_sid) / len(slots)).all()


def test_mix_reads_what_it_takes_off_the_schedule(spark, monkeypatch):
    """Every document's words beside the schedule's slots, one by one; other offsets take other blocks, to the same targets."""
    rng = random.Random(28)
    docs = spark.createDataFrame([(i, "w " * rng.randint(1, 60), f"s{i % 4}" if i % 3 else "t") for i in range(700)], "doc_id long, text string, source string")
    rules = mixing.MixRules(block=64, least_slots=50, slots_per_source=2, bucket=16)
    made = mixing.mix(docs, rules)
    held, read = {}, Counter()
    for r in made.segments.collect():
        held.setdefault((r.sid, r.block), []).append(r)
    for slot in made.schedule.collect():
        tokens = slot.tokens
        for r in sorted(held[slot.sid, slot.block], key=lambda r: r.start):
            read[r.doc_id] += min(tokens, r.tokens)
            tokens -= min(tokens, r.tokens)
        assert not tokens
    rows = {r.doc_id: r for r in made.taken.collect()}
    assert {d: r.taken for d, r in rows.items()} == {d: read[d] for d in rows} and max(r.taken / r.size for r in rows.values()) <= 3
    monkeypatch.setattr(mixing, "GOLDEN", 1234567891)
    other = {r.doc_id: r for r in mixing.mix(docs, rules).taken.collect()}
    sums = lambda of: Counter({s: sum(r.taken for r in of.values() if r.source == s) for s in {r.source for r in of.values()}})
    assert sums(rows) == sums(other) and {d: r.taken for d, r in rows.items()} != {d: r.taken for d, r in other.items()}


def test_toxicity_held_out():
    rng = random.Random(9)
    calm = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    make = lambda bad: " ".join(rng.choice(("zogfool", "zogbrat", "grumwit")) + rng.choice(("", "!", "ly")) if bad and rng.random() < 0.06 else rng.choice(calm) for _ in range(rng.randint(50, 160)))
    texts, y = zip(*[(make(k % 4 == 0), int(k % 4 == 0)) for k in range(600)], strict=True)
    rules = toxicity.ToxicRules(rounds=5, least_steps=50)
    score = toxicity.Scorer(toxicity.fit(list(texts[:400]), list(y[:400]), [1.0] * 400, rules))
    got = np.array(score(list(texts[400:]))) >= 0.3
    assert (got == np.array(y[400:])).mean() > 0.95
    assert len(score([None, "", "x"])) == 3
    one = texts[0]
    assert score([one])[0] == pytest.approx(max(score.windows(one)), abs=1e-6)


def test_toxicity_tables(spark, odd, empty):
    """Odd rows of both tables; the sample doesn't depend on the order of rows, and is bounded."""
    rules = toxicity.ToxicRules(rounds=1, least_steps=1, warm=1, most_rounds=1)
    texts = [(i, f"calm word {i} " * 5 if i % 3 else f"zogfool {i} " * 5) for i in range(1, 60)]
    docs = documents(spark, [*texts, (1, "another text"), (2, None), (100, "x " * 200_000), (None, "no id")])
    marks = [(i, int(i % 3 == 0)) for i in range(1, 60)] + [(1, 1), (3, 0), (3, None), (None, 1), (4, 7), (100, 1), (900, 1)]
    labels = spark.createDataFrame([(d, 0, t, "x") for d, t in marks], "doc_id long, quality int, toxic int, text string")
    seen = []
    fit = toxicity.fit
    try:
        toxicity.fit = lambda *a: seen.append(a) or fit(*a)
        for one, two in ((docs, labels), (docs.orderBy(F.desc("doc_id")), labels.orderBy("toxic"))):
            network = toxicity.train(one, two, rules)
        assert seen[0][:3] == seen[1][:3]
        toxicity.train(docs, labels, toxicity.ToxicRules(positives=5, negatives=7, rounds=1, least_steps=1, most_rounds=1))
        assert len(seen[2][0]) <= 12 and not any(len(t or "") > toxicity.ToxicRules.longest for t in seen[0][0])
        for nothing in (labels.limit(0), labels.where("doc_id is null")):
            assert toxicity.score(docs, toxicity.train(docs, nothing, rules)).count() == docs.count()
    finally:
        toxicity.fit = fit
    got = toxicity.score(odd, network).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    alike = [r.score for r in got if r.doc_id == 5]
    assert alike[0] == pytest.approx(alike[1], abs=1e-6)
    # A text's score doesn't depend on the texts beside it, whatever the last window lacks.
    texts, alone = [t for _, t in ODD], toxicity.Scorer(network)
    for together in (toxicity.Scorer(network)(texts), toxicity.Scorer(network)(texts[::-1])[::-1]):
        assert together == pytest.approx([alone([t])[0] for t in texts], abs=1e-6)
    assert toxicity.score(empty, network).count() == 0


def test_toxicity_network_learns_beyond_its_start():
    """With no log odds to start from, training alone tells the two apart; the start alone is not the classifier."""
    rng = random.Random(29)
    calm = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    # Toxic is a pair of words next to each other; each alone is as frequent in calm texts.
    def make(bad):
        w = [rng.choice(calm) for _ in range(40)]
        at = rng.sample(range(0, 38, 4), 3)
        for k in at:
            w[k], w[k + (1 if bad else 3)] = "grum", "wit"
        return " ".join(w)
    texts, y = zip(*[(make(k % 2 == 0), int(k % 2 == 0)) for k in range(900)], strict=True)
    right = {}
    for start in (True, False):
        rules = toxicity.ToxicRules(rounds=30, least_steps=200, odds_start=start)
        score = toxicity.Scorer(toxicity.fit(list(texts[:700]), list(y[:700]), [1.0] * 700, rules))
        right[start] = ((np.array(score(list(texts[700:]))) >= 0.5) == np.array(y[700:])).mean()
    assert min(right.values()) > 0.8, right


def test_toxicity_reads_long_tokens_whole():
    rng = random.Random(19)
    calm = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    make = lambda bad: [rng.choice(("zogfool", "zogbrat")) if bad and rng.random() < 0.1 else rng.choice(calm) for _ in range(90)]
    made = [(make(k % 3 == 0), int(k % 3 == 0)) for k in range(300)]
    score = toxicity.Scorer(toxicity.fit([" ".join(w) for w, _ in made], [y for _, y in made], [1.0] * 300, toxicity.ToxicRules(rounds=5, least_steps=50)))
    plain = [rng.choice(calm) for _ in range(90)]
    for joint in "_-/,":
        spaced, joined = score([" ".join(plain), " ".join([*plain, "zogfool", "zogbrat"])]), score([joint.join(plain), joint.join([*plain, "zogfool", "zogbrat"])])
        assert joined == pytest.approx(spaced, abs=1e-5) and joined[0] < 0.3 <= joined[1]
    # Without any joining character: what stands at the end still counts.
    unspaced = "数据文本" * 100
    assert score([unspaced])[0] != pytest.approx(score([unspaced + "zogfoolzogbrat" * 3])[0], abs=1e-6)
    assert toxicity.pieces("-" * 45, 40) == ["-" * 40, "-" * 25] and toxicity.pieces("ab_--c", 4) == ["ab_--", "c"]
    run = lambda first, n: "".join(map(chr, range(first, first + n)))
    for word in (run(0x4E00, 120), run(0xA1, 90), run(0x1F300, 50), run(0xD800, 60), run(0x30, 9) + "_" + run(0x4E00, 40) + "," + run(0x61, 26)):
        cut, at = toxicity.pieces(word, 40), 0
        for p in cut:  # each piece begins within or right after the one before
            found = word.find(p, max(0, at - len(p)))
            assert 0 <= found <= at and len(toxicity._bytes(p)) <= 40
            at = max(at, found + len(p))
        assert at == len(word)


def test_toxicity_gradients():
    rules = toxicity.ToxicRules(state=3, word_size=2, char_size=2)
    net = toxicity.Network(rules, {"a": 1})
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x, mask, y = rng.normal(size=(5, 4, 4)), np.ones((5, 4)), np.array([0, 1, 1, 0.0])
    mask[3:, 1] = 0
    loss = lambda: float(np.logaddexp(0, z := net.forward(net.project(x), mask)).sum() - (y * z).sum())
    keep: dict = {}
    z = net.forward(net.project(x), mask, keep)
    grads, _ = net.backward(x, keep, 1 / (1 + np.exp(-z)) - y)
    for name, g in grads.items():
        flat, at = net.w[name].reshape(-1), rng.integers(net.w[name].size)
        old = flat[at]
        flat[at] = old + 1e-4
        up = loss()
        flat[at] = old - 1e-4
        down = loss()
        flat[at] = old
        assert (up - down) / 2e-4 == pytest.approx(g.reshape(-1)[at], abs=5e-3)


def test_packing_round_trip(spark, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.PackingRules().tokenizer)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "token", "ünïcode", "数", "it's", "12"]) for _ in range(rng.choice((0, 3, 50, 400, 6000))))) for i in range(120)] + [((r[0] or 0) + 1000, r[1]) for r in ODD if r[0] != 5]
    got = packing.pack(documents(spark, rows)).collect()
    by_doc = {}
    for r in sorted(got, key=lambda r: r.piece):
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert b"".join(r.ids for r in by_doc[d]) == np.array(ids, "<u4").tobytes()
        assert len(by_doc[d]) == -(-len(ids) // 2048) and all(r.length == 2048 for r in by_doc[d][1:])
    _offsets(got)
    assert packing.pack(empty).count() == 0


def test_packing_hardly_depends_on_partitions(spark):
    """Whole sequences from gapless offsets, and nearly as few of them from 200 partitions as the bound allows."""
    rng = random.Random(6)
    df = spark.createDataFrame([(i, "x" * max(1, int(rng.lognormvariate(5.5, 1)))) for i in range(9000)], "doc_id long, text string")
    rules = packing.PackingRules(group=256)
    made = lambda parts: packing.pack(df.repartition(parts), rules, lambda _: lambda t: np.zeros(len(t or ""), np.uint32)).drop("ids")
    for parts in (1, 200):
        got = made(parts).collect()
        least = -(-sum(r.length for r in got) // 2048)
        assert len(got) >= 9000 and len({r.sequence_id for r in got}) <= 1.02 * least
        _offsets(got)


def _offsets(got):
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def plain_best_fit(lengths, size, most):
    """Bins as lists: the fullest open one that takes a piece; where a bin too many would open, the fullest closes."""
    bins, still = [], []
    for n in lengths:
        fits = [b for b in still if sum(bins[b]) + n <= size]
        if fits:
            one = max(fits, key=lambda b: sum(bins[b]))
        else:
            if len(still) == most:
                still.remove(max(still, key=lambda b: sum(bins[b])))
            bins.append([])
            still.append(one := len(bins) - 1)
        bins[one].append(n)
        if sum(bins[one]) == size:
            still.remove(one)
    return bins


@pytest.mark.parametrize("most", [1, 2, 7, 50])
def test_bins_against_plain_best_fit(most):
    rng = random.Random(most)
    lengths = [rng.randint(1, 64) if rng.random() < 0.8 else rng.randint(1, 9) for _ in range(1500)]
    bins, made = packing.OpenBins(64, most), []
    for n in lengths:
        made += bins.place(n, n)
        assert bins.open <= most
    made += [b for _, b in bins.rest()]
    # Equally full bins are interchangeable, so bins are compared by how full they are.
    assert sorted(map(sum, made)) == sorted(map(sum, plain_best_fit(lengths, 64, most)))
    assert sorted(n for b in made for n in b) == sorted(lengths)


def pipeline_rows():
    """Documents long enough to pass, some with repeats, near copies, shared passages, one id with two texts, repeated rows."""
    rng, rows = random.Random(44), []
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage = " ".join(text(60))
    for d in range(0, 120):
        w = text(rng.randint(40, 160))
        if d % 9 == 0:
            w[5:5] = w[:40] * 2
        if d % 6 == 1:
            w = rows[-1][1].split()
            w[rng.randrange(len(w))] = "changed"
        body = " ".join(w)
        rows.append((d, f"{body} {passage} {rng.randrange(9)}" if d % 11 == 3 else body, f"s{d % 4}"))
    return [*rows, (500, " ".join(text(80)), "s0"), (500, " ".join(text(80)), "s1"), (501, rows[20][1], "s1"), (502, rows[21][1] + " é", None), (502, rows[21][1] + " é", None), (None, " ".join(text(70)), "s2"), (503, None, "s3"), (504, "", "s3")]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before the first stage and after each."""
    import corpus_pipeline as p

    at = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in pipeline_rows()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(at / "documents.parquet"))
    now, out = spark.read.parquet(str(at / "documents.parquet")), [docs.collect()]
    for k, (_, stage) in enumerate(p.STAGES):
        now = stage(spark, now, str(at))
        now.write.parquet(str(at / f"stage{k}"))
        now = spark.read.parquet(str(at / f"stage{k}"))
        assert k == len(p.STAGES) - 1 or now.columns == list(p.COLUMNS)
        out.append(now.collect())
    return at, out


def key(rows):
    return sorted(((-1 if r.doc_id is None else r.doc_id, r.text or "", r.source or "") for r in rows))


def test_pipeline_quality(stages):
    before, after = stages[1][:2]
    rules = quality.QualityRules()
    stay = []
    for r in before:
        w = common.words(r.text)
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        windows = {p for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)}
        covered, longest = repeated_brute(w, rules.min_repeat)
        if len(w) >= 50 and 100 * len(windows) <= 50 * len(w) and covered <= 0.2 * len(w) and longest <= 0.1 * len(w):
            stay.append(r)
    assert key(after) == key(stay) and 20 < len(stay) < len(before) - 10


def test_pipeline_near_dedup(stages):
    before, after = stages[1][1:3]
    # The rows of one id are one document: its texts are linked, and where it stays each of them does, once.
    nodes = sorted({(r.doc_id, r.text) for r in before if r.doc_id is not None})
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.lower().split() for _, t in nodes)]
    root = list(range(len(nodes)))
    for _ in nodes:
        for i in range(len(nodes)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if nodes[i][0] == nodes[j][0] or 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    root[i] = root[j] = min(root[i], root[j])
    want = [(d, t) for k, (d, t) in enumerate(nodes) if nodes[root[k]][0] == d]
    assert [(d, t) for d, t, _ in key(after) if d >= 0] == want and sum(r.doc_id is None for r in after) == 1
    assert 5 < len(want) < len(nodes) - 5 and sum(d == 500 for d, _ in want) == 2


def test_pipeline_near_dedup_shuffles_texts_once(spark, stages):
    """Beyond the size of a broadcast, too."""
    import corpus_pipeline as p

    at, out = stages
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        got = p.near_dedup(spark, spark.read.parquet(str(at / "stage0")), str(at))
        nodes, moved = [got._jdf.queryExecution().executedPlan()], 0
        while nodes:
            node = nodes.pop()
            moved += node.nodeName() == "Exchange" and "text#" in node.output().toString()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
        assert moved == 1 and key(got.collect()) == key(out[2])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_pipeline_suffix_dedup(stages):
    before, after = stages[1][2:4]
    one = [r for r in before if r.doc_id is not None and r.doc_id != 500]
    want = suffix_brute([(r.doc_id, r.text) for r in one], 100)
    got = {r.doc_id: r for r in after}
    assert sorted(r.doc_id or -1 for r in after) == sorted(r.doc_id or -1 for r in before)
    changed = 0
    for r in one:
        text = got[r.doc_id].text
        assert hashlib.sha256(text.encode()).hexdigest() == want[r.doc_id][1] and got[r.doc_id].n_chars == len(text)
        changed += text != r.text
    assert changed >= 5


def test_pipeline_mix(spark, stages):
    before, after = stages[1][3:5]
    docs = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")
    per = Counter()
    for r in mixing.mix(docs).taken.collect():
        per[r.doc_id] += r.taken
    size = Counter()
    for r in before:
        size[r.doc_id] += len((r.text or "").split())
    times = {d: int(per[d] / n + 0.5) if n else 1 for d, n in size.items()}
    assert Counter(key(after)) == Counter({k: n for r, k in zip(before, [key([r])[0] for r in before], strict=True) if (n := times[r.doc_id])})
    # No source loses all its documents.
    assert {r.source for r in after} == {r.source for r in before}


def test_pipeline_packing_and_run(spark, stages):
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    at, out = stages
    tok = Tokenizer.from_file(packing.PackingRules().tokenizer)
    pieces = out[5]
    assert sum(r.length for r in pieces) == sum(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in out[4])
    assert len({r.sequence_id for r in pieces}) <= -(-sum(r.length for r in pieces) // 2048) + 1
    _offsets(pieces)
    digest = lambda rows: sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert digest(p.run(spark, str(at)).collect()) == digest(pieces)


def test_pipeline_odd_and_empty(spark, odd, empty, tmp_path):
    import corpus_pipeline as p

    for name, docs in (("odd", odd.select(*p.COLUMNS)), ("empty", empty)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        rows = p.run(spark, str(tmp_path / name)).collect()
        assert name == "odd" or not rows
    one = odd.select(*p.COLUMNS)
    for _, stage in p.STAGES[:-1]:  # every stage by itself on rows that the first would have left out
        got = stage(spark, one, str(tmp_path))
        assert got.columns == list(p.COLUMNS) and got.count() >= 0
