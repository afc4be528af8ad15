import itertools
import random

from grove.llm import pages

TEMPLATE = """<!DOCTYPE html><html><head><title>T {k}</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<nav><ul><li>Home<li>About</ul></nav><div>Shared masthead of the site</div><!-- x --><div class="ad">Buy {k}</div>
{open}<h1>Title &amp; {k}</h1><p>First   para\ngraph {k}.<p><b>Second</b> one<br>here {k}<div class="comments"><p>A reader says</div><form>Mail <input></form>{close}
<div>Shared line before the end</div><aside>Side</aside><footer>&copy; us</footer>"""


def page(k, article=True):
    return TEMPLATE.format(k=k, open="<article>" if article else "<div>", close="</article>" if article else "</div>")


def want(k):
    return f"Title & {k}\n\nFirst para graph {k}.\n\nSecond one here {k}"


def rows_of(spark, pages_):
    return spark.createDataFrame(pages_, "page_id long, url string, html string")


def test_article_without_its_surroundings(spark):
    docs = rows_of(spark, [(k, f"https://a.org/en/{k}", page(k, k % 2 == 0)) for k in range(40)])
    found = {r.page_id: r for r in pages.extract(docs).collect()}
    for k in range(40):
        assert found[k].text == want(k) and found[k].n_chars == len(found[k].text), k


def test_ranges_make_no_difference(spark, monkeypatch):
    rng = random.Random(8)
    docs = rows_of(spark, [(k, f"https://{rng.choice('ab')}.org/{rng.choice(['en', 'de'])}/{rng.randint(0, 99)}", page(k, False)) for k in range(300)])
    whole = sorted(map(tuple, pages.extract(docs).collect()))
    monkeypatch.setattr(pages, "RANGE_PAGES", 7)
    assert sorted(map(tuple, pages.extract(docs.repartition(5)).collect())) == whole


def test_odd_pages(spark):
    odd = [(1, None, page(1)), (2, "https://x.org/a", None), (3, "https://x.org/b", ""), (None, "https://x.org/c", "<p>Only &lt;text&gt;&nbsp;here"), (4, "https://x.org/d", page(4)), (4, "https://x.org/d", page(4))]
    odd += [(5, "not a url", "<div>" * 2000 + "deep"), (6, "https://x.org/e", "<p>" + "long text " * 30_000), (7, "https://x.org/f", "<script>never closed <p>x</p>"), (8, "https://x.org/g", "a < b & c > d <3")]
    found = pages.extract(rows_of(spark, odd).selectExpr("*", "1 as text")).collect()
    text = {}
    for r in found:
        text.setdefault(r.page_id, []).append(r.text)
    assert text[1] == [want(1)] and text[2] == text[3] == [""] and text[None] == ["Only <text> here"] and text[4] == [want(4)] * 2
    assert text[5] == ["deep"] and text[7] == [""] and len(text[6][0]) == 299_999 and text[8] == ["a < b & c > d <3"]
    assert pages.extract(rows_of(spark, odd).limit(0)).count() == 0


def test_lcs_against_brute_force():
    rng = random.Random(9)

    def longest(a, b):
        return max(n for n in range(len(a) + 1) if any(is_sub(c, b) for c in itertools.combinations(a, n)))

    def is_sub(c, b):
        it = iter(b)
        return all(x in it for x in c)

    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 8))] for _ in range(2))
        found = sorted(pages._lcs(a, b))
        assert is_sub([a[i] for i in found], b) and len(found) == longest(a, b)


def test_lcs_of_long_pages():
    rng = random.Random(14)

    def table(a, b):  # the plain table, and the walk through it that takes the earliest lines
        rows = [[0] * (len(b) + 1)]
        for x in reversed(a):
            row = [0] * (len(b) + 1)
            for j in range(len(b) - 1, -1, -1):
                row[j] = rows[-1][j + 1] + 1 if x == b[j] else max(rows[-1][j], row[j + 1])
            rows.append(row)
        return rows[-1][0]

    for size, names in ((390, 30), (410, 30), (800, 7), (900, 3000)):
        a, b = ([f"line {rng.randrange(names)}" for _ in range(size)] for _ in range(2))
        found = sorted(pages._lcs(a, b))
        it = iter(b)
        assert all(a[i] in it for i in found) and len(found) == table(a, b), (size, names)
    # every Reply is shared, however often it comes
    a, b = ([x for k in range(600) for x in (f"{name} {k}", "Reply")] for name in ("own", "other"))
    assert len(pages._lcs(a, b)) == 600
    long = [f"line {rng.randrange(5000)}" for _ in range(20_000)]
    assert len(pages._lcs(["x", *long], [*long, "y"])) == 20_000


def test_copies_are_no_template(spark):
    bare = "<div>Site head</div><div>" + "".join(f"<p>Paragraph {k} of one long story.</p>" for k in range(9)) + "</div>"
    found = pages.extract(rows_of(spark, [(1, "https://c.org/1", bare), (2, "https://c.org/2", bare)])).collect()
    assert all(r.text.count("Paragraph") == 9 for r in found)


def test_names():
    assert pages._tells("sidebar left") and pages._tells("comment-list") and pages._tells("site-footer")
    assert not pages._tells("has-sidebar") and not pages._tells("article-body") and not pages._tells("lead")


def test_tags_as_html_reads_them():
    texts = lambda h: [x for x, _ in pages.blocks(h)]
    assert texts("<a href=\"x\" title='it's'>Link</a> text <p>more 'quoted' here</p>") == ["Link text", "more 'quoted' here"]
    assert texts('<p title="5" tall">Lost</p>') == ["Lost"] and texts("<p a='never closed>one</p>two") == ["one", "two"]
    assert texts('<p title="a > b" id=x>kept</p>') == ["kept"] and texts("a < b <3 </ c") == ["a < b <3 </ c"]
    assert texts("<article><header><h1>Title</h1><p>by a reader</p></header><p>Body</p></article><header><h1>Site</h1></header>") == ["Title", "Body"]
    assert texts("<div class='share-price'>price</div><p class='related-work'>work</p><div class='notice'>n</div><div class=siteFooter>f</div><div class='entry-header'>h</div>") == ["price", "work", "h"]
    for part in ("<x '", "<x a='", '<x a=">" ', "<i><div><b>", "</i></div>", "<!-"):  # in one pass, whatever is left open
        assert pages.blocks("<p>first" + part * 50_000)[0][0].startswith("first")


def changed(spark, rows):
    """How many pages differencing changes, and the texts."""
    found = {r.page_id: r.text for r in pages.extract(rows_of(spark, rows)).collect()}
    return sum(found[k] != pages.main_text(pages.blocks(h)) for k, _, h in rows), found


def test_differencing_decides(spark):
    story = lambda k: "".join(f"<p>Paragraph {j} of the story of page {k}.</p>" for j in range(5))
    own = lambda k: "\n\n".join(f"Paragraph {j} of the story of page {k}." for j in range(5))
    site = ("<div>Our site, since 1999</div><div>Start here</div>", "<div>Tell your friends</div><div>Reply</div><div>Reply</div>")
    for around in ("div", "main"):
        rows = [(k, f"https://d.org/{k:02}", f"<{around}>{site[0]}{story(k)}{site[1]}</{around}>") for k in range(20)]
        n, found = changed(spark, rows)
        assert n == 20 and all(found[k] == own(k) for k in range(20)), around
    # site lines within the article go where both neighbours have them; a quoted passage and a chance likeness stay
    passage = "<p>" + " ".join(f"quoted{j}" for j in range(60)) + "</p>"
    rows = [(k, f"https://e.org/{k:02}", f"<article>{passage}{story(k)}<p>Of.</p><p>All of this site's texts are free to read</p></article>") for k in range(20)]
    n, found = changed(spark, rows)  # the first and the last page have one neighbour alone
    assert n == 18 and all(found[k].startswith("quoted0") and found[k].endswith(f"page {k}.") for k in range(1, 19))
    # cards are articles, but the main text isn't
    rows = [(k, f"https://f.org/{k:02}", f"{site[0]}<article>Card {k} one</article><article>Card {k} two</article><div>{story(k)}</div>{site[1]}") for k in range(9)]
    assert all(own(k) in x and "Reply" not in x and "since" not in x for k, x in changed(spark, rows)[1].items())


def test_runs_of_copies_hide_no_neighbour(spark):
    head, copy = "<div>Site head of the pages</div>", "".join(f"<p>Paragraph {k} of one long story.</p>" for k in range(9))
    rows = [(k, f"https://c.org/{k:03}", head + copy) for k in range(50)] + [(100, "https://c.org/100", head + "<p>Another story, and quite a short one it is</p>")]
    n, found = changed(spark, rows)
    assert n == 51 and all("Site head" not in x for x in found.values()) and all(found[k].count("Paragraph") == 9 for k in range(50))


def test_pages_without_a_host_meet_no_other(spark):
    rows = [(k, None if k % 2 else "not a url", f"<div>The same line</div><p>Own {k}</p>") for k in range(6)]
    n, found = changed(spark, rows)
    assert n == 0 and found == {k: f"The same line\n\nOwn {k}" for k in range(6)}


def brute(rows):
    """By the definition, over one sorted list."""
    read = sorted((*pages.place_of(u), p, u, pages.blocks(h)) for p, u, h in rows)
    found = {}
    for i, (host, path, page_id, _, own) in enumerate(read):
        neighbours = []
        for step in (-1, 1):
            j, last, seen = i + step, own, 0
            while 0 <= j < len(read) and read[j][0] == host and seen <= pages.LENT:
                other = read[j][4]
                if other != last:  # a run of equal texts is one
                    seen += 1
                    if seen <= pages.LENT and (shared := pages.shared_lines(own, other)) is not None:
                        neighbours.append((read[j][1], shared))
                        break
                last, j = other, j + step
        neighbours.sort(key=lambda x: -pages.common(path, x[0]))
        found[page_id] = pages.main_text(own, *[shared for _, shared in neighbours])
    return found


def test_operator_against_brute_force(spark, monkeypatch):
    rng = random.Random(15)
    lines = [f"Site line {k} of many" for k in range(4)]
    rows = []
    for k in range(400):
        kind = rng.choice(["div", "main", "article", "div"])
        body = "".join(f"<p>{rng.choice(lines) if rng.random() < 0.4 else f'Own words {rng.randint(0, 10**6)}'}</p>" for _ in range(rng.randint(0, 8)))
        rows.append((k, f"https://{rng.choice('abc')}.org/{rng.randint(0, 60)}/{rng.choice('xy')}", rows[-1][2] if rows and rng.random() < 0.1 else f"<div>{rng.choice(lines)}</div><{kind}>{body}</{kind}>"))
    want = brute(rows)
    assert {r.page_id: r.text for r in pages.extract(rows_of(spark, rows)).collect()} == want
    monkeypatch.setattr(pages, "RANGE_PAGES", 40)
    got = {r.page_id: r.text for r in pages.extract(rows_of(spark, rows).repartition(3)).collect()}
    assert sum(got[k] == want[k] for k in want) == len(want)
