"""Collocations, ranked search and main text against brute force."""

import math
import re
from collections import Counter, defaultdict

import pytest

from labelforge.llm import collocations, pages, queries, search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = "/root/testdata/sf0.001"


# ---- collocations

def brute_collocations(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in cands.items():
        around = any(lg == lang and len(d) > len(p) and 100 * b >= 80 * a and any(d[i:i + len(p)] == p for i in range(len(d)))
                     for (lg, d), b in cands.items())
        if around:
            continue
        score, cut = min((2000000 * a // (f[lang, p[:j]] + f[lang, p[j:]]), j) for j in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), " ".join(p), f[lang, p[:cut]], f[lang, p[cut:]], cut))
    return sorted((lang, rank, p, -a, lft, r, n[lang], -s, cut) for lang, rows in out.items()
                  for rank, (s, a, _, p, lft, r, cut) in enumerate(sorted(rows)[:top], 1))


def told(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"], r["cut"]) for r in df.collect())


@pytest.mark.parametrize("bits", [3, 10, None])
def test_collocations_match_brute_force(spark, docs, texts, bits):
    want = brute_collocations([("en" if (i or 0) % 2 else "de", t) for i, t in texts], 6, 40)
    assert want and max(len(r[2].split()) for r in want) > 2
    assert told(collocations.collocations(docs, least=6, top=40, bits=bits)) == want


def test_collocations_of_odd_rows(spark):
    rows = [(None, "Ab cd ef, ab cd\x0bab\tcd  ef"), ("und", "AB CD EF gh"), ("x", None), ("x", ""), ("x", " .,;"), ("é", "Été été Été été"),
            ("r", "aa bb cc dd ee"), ("r", "aa bb cc dd ee"), ("r", "aa bb x aa bb")] * 2
    df = spark.createDataFrame([(i, t, lang, 1, "x", 2) for i, (lang, t) in enumerate(rows)],
                               "doc_id long, text string, lang string, n int, phrase string, w1 int")
    assert told(collocations.collocations(df, least=2)) == brute_collocations(rows, 2, 2000)


def test_collocations_of_an_empty_table(empty):
    assert collocations.collocations(empty).count() == 0


def test_a_pair_longer_than_a_batch_and_a_long_text(spark):
    rows = [("a", "north star " * 70000 + ". south star")]
    got = told(collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=30))
    # `north star north star` and its like hold almost every shorter one
    assert [r[2] for r in got] == [r[2] for r in sorted(got, key=lambda r: r[1])]
    assert all(r[6] == 140002 for r in got) and {r[2] for r in got} == {"north star north star", "star north star north"}


# ---- search

def brute_search(docs, items, top=10):
    term = re.compile(search.TERM)
    words = [[w.translate(LOWER) for w in term.findall(t or "")] for _, t in docs]
    n_docs, n_terms = sum(map(bool, words)), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= {w.translate(LOWER) for w in term.findall(t or "")}
    out = []
    for item, terms in asked.items():
        found = []
        for (doc, _), w in zip(docs, words):
            tf, m = Counter(w), 0 if not n_terms else 10 + 90 * len(w) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 8 * m))
                    for t in terms if tf[t])
            if s > 0:
                found.append((-s, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def listed(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def items(texts):
    some = {i: t for i, t in texts if i is not None}
    rows = [(1, some[3]), (2, some[5][:500]), (3, None), (4, ""), (5, "...  !"), (6, "Word WORD word-one x7 été 日本語"), (None, some[2]),
            (7, some[4][:200]), (7, some[6][:200]), (8, "neverseenanywhere"), (9, some[300]), (9, some[300]), (10, "a")]
    return rows


@pytest.mark.parametrize("slice_bytes", [search.SLICE_BYTES, 6000, 1500])
def test_search_matches_brute_force(spark, docs, texts, items, slice_bytes):
    df = spark.createDataFrame([(i, t, 1.0, 3) for i, t in items], "item_id long, text string, score double, rank int")
    want = brute_search(texts, items)
    assert len(want) > 50
    assert listed(search.search(docs, df, slice_bytes=slice_bytes)) == want


def test_search_of_empty_tables(spark, docs, empty, items):
    df = spark.createDataFrame(items, "item_id long, text string")
    assert search.search(empty, df).count() == 0
    got = search.search(docs, df.limit(0))
    assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_match_whole_only():
    a = search.automaton(["art", "a", "é", "tart"])
    n, at, tf = search._scan(a, "Art, art|tart; start a1 É é a")
    assert n == 8 and dict(zip(at.tolist(), tf.tolist())) == {0: 2, 1: 1, 2: 1, 3: 1}


# ---- pages

HEAD = "<!DOCTYPE html><html><head><title>{t}</title><style>p{{x:y}}</style><script>var a='</p><p>no';</script></head><body>"
SITE = ("<div id='top'><a href='/'>Home</a> <a href='/n'>News</a></div><div class='box7'>Sign up for our letter today and never miss it.</div>")


def page(title, body, before=SITE, after="<div>(c) site 2024</div></body></html>"):
    return HEAD.format(t=title) + before + body + after


CASES = [
    # (html, text)
    (None, ""), ("", ""), ("   \n ", ""), ("<p>", ""), ("plain words", "plain words"),
    ("<article><h1>A &amp; B</h1><p>one\n two<br>three &nbsp;&lt;x&gt;</p><p>four<p>five</article><footer>f</footer>",
     "A & B\n\none two three <x>\n\nfour\n\nfive"),
    ("<nav>menu</nav><main><h1>T</h1><p>body <b>bold<p>next <i>x</i></p><aside>side</aside><form>f <input> g</form></main>", "T\n\nbody bold\n\nnext x"),
    ("<body class='has-sidebar'><div class='page with-sidebar'><article class='post'><p>kept</p><div class='share-buttons'>Share</div>"
     "<section id='comments'><article class='comment'><p>nice</p></article></section></article></div>", "kept"),
    ("<article><header><h1>Head</h1></header><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><footer>tags</footer></article>",
     "Head\n\na\n\nb\n\nc\n\nd"),
    ("<header>site</header><h1>T</h1><p>x</p><div role=navigation>n</div><div style='display: none'>h</div><!-- c <p>no</p> --><p>y</p><footer>f",
     "T\n\nx\n\ny"),
    ("<div class=\"cookie-notice\">We use cookies</div><div class=ad>buy</div><div class=read>bread</div><noscript>js</noscript><p>a < b & c &am &amp d</p>",
     "bread\n\na < b & c &am & d"),
    ("<form action=x><h1>T</h1><p>all in a form</p><select><option>1<option>2</select></form>", "T\n\nall in a form"),
    ("<article><p>cut off <a href=\"x", "cut off"), ("<p title='a>b' class = \"x\">q</p><p>it's 5\" wide</p>", "q\n\nit's 5\" wide"),
    ("<article></article><div><p>elsewhere</p></div>", "elsewhere"),
    ("<h1>T</h1><div class=text><p>the text</p></div><section id=comments><article><p>a comment longer than the text</p></article></section>", "T\n\nthe text"),
    ("<h1>T</h1><p>the text</p><div><article class='comment reply'><p>a comment longer than the text</p></article></div>", "T\n\nthe text"),
    ("<aside><article><h2>more</h2><p>a teaser of another article</p></article></aside><div class='has-sidebar'><article><p>text</p></article></div>", "text"),
    ("<div class=sidebar><h1>Site</h1><p>links</p></div><p>the text</p>", "the text"),
    ("<h1>T</h1><div><a href=1>one</a> <a href=2>two</a></div><p>see <a href=3>this</a></p>", "T\n\nsee this"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_main_text_of_one_page(html, text):
    assert pages.Page(html).main(set())[0] == text


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "y") for i, u, h in rows],
                                 "page_id long, url string, html string, text string, host int, subtrees string").repartition(3)


def test_templates_of_a_site_go(spark):
    many = [(i, f"https://u:p@Site.example:80/{i}?x=//y", page(f"t{i}", f"<div><h1>t{i}</h1><p>own words {i}</p><p>Licensed as is.</p></div>")) for i in range(12)]
    # 9 copies of one article under several addresses are no template
    many += [(100 + i, f"http://copy.example/{i}", page("same", "<div class='body'><h1>same</h1><div>first part</div><div>second part</div></div>", "", ""))
             for i in range(9)]
    lone = [(200, "http://lone.example", page("l", "<p>l</p>")), (201, None, page("n", "<p>n</p>")), (202, "no url", None), (203, None, "")]
    got = {r["page_id"]: (r["text"], r["n_chars"], r["n_templates"]) for r in pages.main_text(table(spark, many + lone)).collect()}
    for i in range(12):
        assert got[i] == (f"t{i}\n\nown words {i}\n\nLicensed as is.", len(f"t{i}own words {i}Licensed as is.") + 4, 3)
    assert all(got[100 + i][0] == "same\n\nfirst part\n\nsecond part" for i in range(9))
    assert got[200][0].startswith("Sign up") and got[200][0].endswith("l\n\n(c) site 2024")
    assert got[202] == ("", 0, 0) and got[203] == ("", 0, 0)


def test_main_text_matches_a_count_in_plain_python(spark):
    rows = [(r["page_id"], f"http://h{r['page_id'] % 3}.example/x", r["html"].replace("<body>", "<body>" + SITE)) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    rows += [(1000 + k, u, h.replace("<article>", "<div>").replace("</article>", "</div>")) for k, (_, u, h) in enumerate(rows)]
    rows += rows[:3]
    seen, names = defaultdict(set), defaultdict(set)
    parsed = [(u.split("/")[2].lower(), pages.Page(h)) for _, u, h in rows]
    for host, p in parsed:
        names[host].add(p.named())
        for s in p.subtrees():
            seen[host, s].add(p.named())
    want = Counter()
    for (i, u, h), (host, _) in zip(rows, parsed):
        known = {s for (hh, s), who in seen.items() if hh == host and len(who) >= 3 and len(who) >= 0.02 * len(names[host])}
        text, n = pages.Page(h).main(known)
        want[i, u, text, len(text), n] += 1
    got = Counter(tuple(r) for r in pages.main_text(table(spark, rows)).collect())
    assert got == want and sum(k[4] > 0 for k in got) > 10


def test_main_text_is_what_the_article_holds(spark):
    """The pages of the test tables mark their articles."""
    from html import unescape

    got = {r["page_id"]: r["text"] for r in queries.op13_site_templates(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S).group(1).replace("<br>", " ")
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


def test_main_text_of_an_empty_table(spark):
    df = table(spark, [(1, "u", "h")]).limit(0)
    assert pages.main_text(df).count() == 0


def test_very_long_and_deep_pages():
    deep = "<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000
    assert pages.Page(deep).main(set())[0] == "deep"
    long = "<article>" + "<p>some words here</p>" * 60000 + "</article>"
    assert pages.Page(long).main(set())[0].count("\n\n") == 59999


# ---- the registered queries

@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_their_sql(spark, name):
    from labelforge.plans.check import duck

    got = queries.QUERIES[name](spark, SMALL).toPandas()
    want = duck(SMALL).sql(queries.ORACLE[name]).df()
    rows = lambda d: sorted(map(tuple, d[sorted(d)].astype(object).itertuples(index=False)), key=repr)
    assert sorted(got) == sorted(want) and rows(got) == rows(want)
