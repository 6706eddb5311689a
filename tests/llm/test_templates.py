import html as references
import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tidemark.llm import templates
from tidemark.llm.common import Scratch
from tidemark.llm.markup import Page

COLUMNS = "page_id long, url string, html string"


def marked(rng, title, paragraphs):
    menu = "".join(f'<li><a href="/{i}">{prose(rng, 1)}</a></li>' for i in range(5))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"""<html><head><title>{title}</title><script>var t="</article><p>no</p>";</script></head><body><nav><ul>{menu}</ul></nav>
      <article><h1>{title}</h1>{body}<section class="comments"><p>First! {prose(rng, 9)}</p></section></article><footer>&copy; {prose(rng, 4)}</footer></body></html>"""


def unmarked(rng, title, paragraphs):
    """Nothing names the article, the notice or the list of links."""
    body = "".join(f"<div class=x>{p}</div>" for p in paragraphs)
    links = "".join(f'<div class=l><a href="#">{prose(rng, 3)}</a></div>' for _ in range(12))
    return f"<div class=a><div class=n>All of this is set by hand</div><div class=k>{links}</div><div class=b><h2>{title}</h2>{body}</div></div>"


@pytest.fixture(scope="module")
def site():
    rng, rows, want = random.Random(3), [], {}
    for i in range(60):
        title, paragraphs = prose(rng, 4), [prose(rng, rng.randint(8, 40)) for _ in range(rng.randint(2, 6))]
        make = marked if i % 2 else unmarked
        rows.append((i, f"http://h{i % 2}.example.org/{i}", make(rng, title, paragraphs)))
        want[i] = "\n".join([title, *paragraphs])
    return rows, want


def found(df):
    return {r.page_id: r.text for r in df.collect()}


def test_articles_of_marked_and_unmarked_pages(spark, site):
    rows, want = site
    out = templates.extract(spark.createDataFrame(rows, COLUMNS).repartition(4))
    assert found(out) == want
    assert out.where("templated and n_chars = char_length(text)").count() == len(rows)


def test_classes_share_vectors_and_come_in_order(spark, site):
    """Against brute force: tokens of a class have one vector; on each page they come in their class's order."""
    rows, _ = site
    pages = spark.createDataFrame(rows, COLUMNS).select(templates.host_id(F.col("url")), F.col("page_id").alias("key"), "html")
    numbers = {r.host: r.key % 2 for r in pages.collect()}
    for r in templates.templates(pages, Scratch(spark)).collect():
        template = templates._template(bytes(r.template))
        mine = [Page(h) for i, _, h in rows if i % 2 == numbers[r.host]]
        met = [dict(zip(*templates.counted(p, {})[:2])) for p in mine]
        firsts = [dict(zip(*(templates.counted(p, {})[j] for j in (0, 2)))) for p in mine]
        vectors = {}
        for t, (c, _, _) in template.of.items():
            vectors.setdefault(c, set()).add(tuple(m.get(t, 0) for m in met))
        assert all(len(v) == 1 for v in vectors.values()) and len({next(iter(v)) for v in vectors.values()}) == len(vectors)
        for c, size in template.size.items():
            order = [t for _, t in sorted((o, t) for t, (d, o, _) in template.of.items() if d == c)]
            assert len(order) == size >= 2
            assert all(places == sorted(places) for f in firsts if (places := [f[t] for t in order if t in f]))


@pytest.mark.parametrize("held, part", [(1, 10_000), (400, 10_000), (400, 20), (3000, 7), (1_000_000, 10_000)])
def test_bounds_lose_no_frequent_token(monkeypatch, held, part):
    """However pages are put together and tokens parted, what is sent bounds the pages of every token, and it is little if pages are many."""
    monkeypatch.setattr(templates, "_HELD", held)
    monkeypatch.setattr(templates, "_PART", part)
    rng = random.Random(held)
    rows = [(h, (marked if h % 2 else unmarked)(rng, prose(rng, 4), [prose(rng, rng.randint(8, 40)) for _ in range(rng.randint(0, 3))])) for h in [0] * 83 + [1] * 35 + [2] * 5 + [3] * 3]
    rng.shuffle(rows)
    on, total = Counter(), Counter(h for h, _ in rows)
    for h, page in rows:
        on.update((h, t) for t in templates.counted(Page(page), {})[0])
    pages = pd.DataFrame([(h, total[h], page) for h, page in rows], columns=["host", "total", "html"])
    sent = pd.concat(templates._present(pages[i : i + 40] for i in range(0, len(pages), 40)))
    found = {h: set() for h in total}
    for (h, i, n), group in sent.groupby(["host", "part", "total"]):
        bounds = Counter()
        for tokens, above in zip(group.tokens, group.above):
            bounds.update(dict(zip(templates._whole(tokens).tolist(), memoryview(above).cast("i").tolist())))
        assert group.least.sum() < templates.SHARE * n
        assert all(x + group.least.sum() >= on[h, t] for t, x in bounds.items())
        for blob in templates._bounded((h, i, n), group).wanted:
            found[h] |= templates._wanted(blob)
    assert sent.part.nunique() == 1 + max(total.values()) // part
    assert all(t in found[h] for (h, t), n in on.items() if n >= max(templates.SUPPORT, templates.SHARE * total[h]))
    assert held < 1_000_000 or sent.tokens.map(len).sum() / 8 < sum(on.values()) / 10


def test_pages_send_few_rows_and_lose_no_vector(spark, site):
    """The wanted tokens hold all that are frequent, and are few beside all tokens; their vectors are whole."""
    rows, _ = site
    pages = spark.createDataFrame(rows, COLUMNS).select(templates.host_id(F.col("url")), F.col("page_id").alias("key"), "html").repartition(3)
    asked = pages.join(pages.groupBy("host").agg(F.count("*").alias("total")), "host")
    found = {r.host: templates._wanted(bytes(r.wanted)) for r in templates.candidates(asked, Scratch(spark)).collect()}
    on, counts = Counter(), {}
    for r in pages.collect():
        whole, some = (dict(zip(ids, zip(times, firsts))) for ids, times, firsts in (templates.counted(Page(r.html), {}), templates.counted(Page(r.html), {}, found[r.host])))
        assert some == {t: x for t, x in whole.items() if t in found[r.host]}
        on.update((r.host, t) for t in whole)
        counts[r.host] = counts.get(r.host, 0) + 1
    frequent = {k for k, n in on.items() if n >= templates.SHARE * counts[k[0]]}
    assert frequent and all(t in found[h] for h, t in frequent)
    assert sum(map(len, found.values())) < len(on) / 2


def test_fixed_text_in_an_article_goes_and_passages_of_few_pages_stay(spark):
    rng, rows, want = random.Random(4), [], {}
    passage = prose(rng, 60)
    for i in range(20):
        paragraphs = [prose(rng, 20), prose(rng, 12)]
        kept = paragraphs + ([passage] if i % 3 == 0 else [])
        rows.append((i, "http://a.example.org/", marked(rng, f"title {i}", ["Read the weekly letter of ours", *kept])))
        want[i] = "\n".join([f"title {i}", *kept])
    assert found(templates.extract(spark.createDataFrame(rows, COLUMNS))) == want


def test_given_pages_against_a_plain_reading(spark):
    pages = spark.read.parquet(f"/root/testdata/sf0.001/pages.parquet")

    def plain(page):
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
        lines = [" ".join(references.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts]
        return "\n".join(x for x in lines if x)

    assert found(templates.extract(pages)) == {r.page_id: plain(r.html) for r in pages.collect()}


def test_defined_cases(spark):
    long = "<article><p>" + "word " * 300_000 + "</p></article>"
    rows = [
        (1, None, None), (2, "http://a.b.example.org/", ""), (3, "nothing", "<p>only text &amp; more"), (4, None, long), (5, "http://a.b.example.org/", None),
        (6, "http://a.b.example.org/", "<article><p>one<br>two<p>three</article>"), (6, "http://a.b.example.org/", "<article><p>one<br>two<p>three</article>"),
        (None, "http://a.b.example.org/", "<main><h1>x</h1></main><form>y</form>"), (7, "", " \n "), (8, "http://c.example.org", "<" * 5000 + "<p a='" + "b" * 5000),
    ]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS + ", text string, n_chars int")
    out = templates.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars", "templated"] and out.count() == len(rows)
    texts = found(out)
    assert texts[1] == texts[2] == texts[5] == texts[7] == ""
    assert texts[3] == "only text & more" and len(texts[4]) == 1_499_999 and texts[6] == "one two\nthree" and texts[None] == "x"
    assert [r.text for r in out.where("page_id = 6").collect()] == ["one two\nthree"] * 2
    assert templates.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("attribute", [" hidden", " HIDDEN", " hidden=''", " class=x hidden", " hidden class=x"])
def test_hidden_elements_are_no_content(attribute):
    page = f"<article><p>one</p><p{attribute}>two</p><p title='the hidden way' class=unhidden>three</p></article>"
    assert templates.article(page, None) == "one\nthree"
