import pytest

from marlstone.llm import blocks as B

LONG = "The river of the north is one of the places that people in the town have known for a long time, and it was there that they met when the days were long and the work was done. "

PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- <p>no</p> --><header><h2>Site name</h2></header><div class="cookie-notice">We use cookies.</div>
<div class="ad">Buy &amp; win.</div><article><h1>Head &amp; more</h1><p><b>First  line.<br><p>{LONG}</p><p>Short one.
<aside>side</aside><form><p>Name</p></form></article><div id="comments"><p>{LONG}</p></div><footer>&copy; x</footer></body></html>"""

CASES = [
    (None, ""), ("", ""), ("<p></p>", ""),
    (PAGE, f"Head & more\nFirst line.\n{LONG.strip()}\nShort one."),
    (f"<body><div class='menu'><a href=x>a</a></div><h2>News of the day</h2><p>{LONG}{LONG}</p><p>Short &lt;b&gt; end.</p><p>{LONG}{LONG}</p><ul><li><a href=y>{LONG}</a></ul>", f"News of the day\n{LONG}{LONG.strip()}\nShort <b> end.\n{LONG}{LONG.strip()}"),
    ("<article>a < b &#233; &eacute; &#x41; 1 <2 <i>x</i>y &unknown; &am", "a < b é é A 1 <2 xy &unknown; &am"),
    (f"<article><p>{LONG}<section class='comments'><p>I agree</p></section><p>Last.</p>", f"{LONG.strip()}\nLast."),
    ("<article><p>one<p>two <a href='z'>link</a> three</p><table><tr><td>c1<td>c2</table></article>", "one\ntwo link three\nc1\nc2"),
    ("<article><script>if (a < b) '</article>'</script><p>kept</article>", "kept"),
    ("<article><p>open <b>bold", "open bold"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_cases(page, text):
    assert B.main_text(page) == text


def test_query(spark):
    rows = [(i, f"u{i}", p, "x") for i, (p, _) in enumerate(CASES)] + [(None, None, PAGE, "x"), (3, "u3", PAGE, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = B.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            assert r.text == CASES[r.page_id][1] and r.n_chars == len(r.text) and r.url == f"u{r.page_id}"
    assert B.extract(df.limit(0)).count() == 0


def test_long_and_broken_pages():
    import time

    t = time.time()
    assert B.main_text("<article>" + "<p>word " * 50_000).count("\n") == 49_999
    B.main_text("<" * 200_000)
    B.main_text("<a b='" * 20_000)
    B.main_text("<div>" * 20_000 + "x")
    assert time.time() - t < 30


FOREIGN = "Talo seisoi metsän reunalla ja joki virtasi sen ohi hitaasti kohti merta jonka rannalla kalastajat korjasivat verkkojaan auringon laskiessa. "
UNMARKED = [  # pages without article or main: (body, blocks that are the article)
    (f"<div class='site-content no-sidebar'><h1>Title here</h1><p>{LONG}{LONG}</p></div>", ["Title here", f"{LONG}{LONG}"]),
    (f"<div class='content has-sidebar'><p>{LONG}{LONG}</p><div class='sidebar'><p>{LONG}</p></div></div>", [f"{LONG}{LONG}"]),
    (f"<div class='layout-sidebar-right'><div class='sidebar'><p>{LONG}</p></div><p>{LONG}{LONG}</p></div>", [f"{LONG}{LONG}"]),
    (f"<p><a href=a>{LONG}</a></p><h2>Head</h2><p>{LONG}{LONG}</p><p>Yes.</p><p>{LONG}</p><p><a href=b>next page</a></p>", ["Head", f"{LONG}{LONG}", "Yes.", LONG]),
    (f"<h1>Joki</h1><p>{FOREIGN}{FOREIGN}</p><p>{FOREIGN}</p>", ["Joki", f"{FOREIGN}{FOREIGN}", FOREIGN]),
    (f"<p><a href=x>one</a> <a href=y>two</a></p><p>{FOREIGN}{FOREIGN}</p><p><a href=z>three</a></p>", [f"{FOREIGN}{FOREIGN}"]),
    ("<p>Hello there.</p><p>Good bye.</p>", ["Hello there.", "Good bye."]),
    ("<ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul>", []),
    (f"<div id='comments'><article class='comment'><p>{LONG}{LONG}</p></article></div><p>{LONG}{LONG}</p>", [f"{LONG}{LONG}"]),
    (f"<div class='promo'><p>{LONG}</p></div><p>{LONG}{LONG}</p><form><p>{LONG}</p></form>", [f"{LONG}{LONG}"]),
    (f"<p>{LONG}{LONG}</p><p>Menu</p><p><a href=a>{LONG}</a></p><p>Tags</p><p><a href=b>{LONG}</a></p>", [f"{LONG}{LONG}"]),
]
MARKED = [
    (f"<div class='layout-sidebar'><article><header class='entry-header'><h1>Head</h1></header><p>{LONG}</p><ul><li><a href=x>A link</a></li><li><a href=y>Another</a></li></ul></article></div>", ["Head", LONG, "A link", "Another"]),
    (f"<main><p>{FOREIGN}</p><pre>x = 1</pre><table><tr><td>7</td></tr></table></main><p>{LONG}{LONG}</p>", [FOREIGN, "x = 1", "7"]),
    (f"<article class='post has-comments'><p>{LONG}</p><div class='comments'><article class='comment'><p>{LONG}</p></article></div><p>End</p></article>", [LONG, "End"]),
]


@pytest.mark.parametrize("page, want", [*UNMARKED, *MARKED])
def test_written_pages(page, want):
    assert B.main_text(page) == "\n".join(x.strip() for x in want)


@pytest.mark.parametrize("page, want", UNMARKED)
def test_hints_say_nothing_where_there_are_none(page, want):
    assert B.main_text(page, hints=False) == B.main_text(page)


def brute_second_pass(labels, edge, alone, headings, sentences):
    """The second pass by looking each neighbour up."""

    def near(labels, i, step):
        i += step
        while 0 <= i < len(labels):
            if labels[i] in ("good", "bad"):
                return labels[i]
            i += step
        return edge

    if alone and "good" not in labels:
        if "near" in labels:
            labels = ["good" if x == "near" else x for x in labels]
        elif "bad" not in labels:
            labels = ["good"] * len(labels)
    labels = [("bad" if near(labels, i, -1) == near(labels, i, 1) == "bad" else "good") if x == "near" else x for i, x in enumerate(labels)]
    out = list(labels)
    for i, x in enumerate(labels):
        if x == "short":
            one, two = near(labels, i, -1), near(labels, i, 1)
            out[i] = one if one == two else "good" if (two == "good" if headings[i] else sentences[i]) else "bad"
    return out


def test_second_pass_against_brute_force():
    import random

    r = random.Random(1)
    for _ in range(3000):
        n = r.randint(0, 12)
        labels, headings, sentences = [[r.choice(x) for _ in range(n)] for x in (B.STEPS, (True, False), (True, False))]
        edge, alone = r.choice(["good", "bad"]), r.random() < 0.5
        found = []
        for label, h, s in zip(labels, headings, sentences):
            b = B.Block("Words." if s else "Words", 0, h, False, False)
            b.label = label
            found.append(b)
        B.second_pass(found, edge, alone)
        assert [b.label for b in found] == brute_second_pass(labels, edge, alone, headings, sentences)


def test_many_blocks_take_linear_time():
    import time

    t = time.time()
    assert B.main_text("<p>hi</p>" * 200_000).count("\n") == 199_999
    B.main_text(f"<p>{LONG * 2}</p>" + "<p>hi</p><p><b>x</b></p>" * 50_000)
    assert time.time() - t < 15
    t = time.time()
    B.main_text("<b>" * 20_000 + "<li></li>" * 20_000 + "</section></i>" * 20_000 + "x")
    B.main_text("<div>" * 20_000 + "</section>" * 20_000 + "x")
    assert time.time() - t < 10
