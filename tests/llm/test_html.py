import random

import pytest

from ledgerleaf.llm import html

ARTICLE = "Some words of the story, with commas, and enough of them to count as text. " * 3


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_extract_edges(spark):
    rows = [(1, "u", page(f"<article><h1>A &amp; B</h1><p>one\n two&nbsp;x</p></article>")), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "u", "<p>just this"), (4, "u", "no markup at all"), (5, "u", page("<nav><a href=x>only menu</a></nav>")), (6, "u", "<div>" * 5000 + "deep")]
    frame = spark.createDataFrame([(*r, "clash", 0) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in html.extract(frame).collect()), key=str)
    want = [(1, "u", "A & B\none two x", 15), (2, None, "", 0), (3, "u", "", 0), (3, "u", "", 0), (None, "u", "just this", 9), (4, "u", "no markup at all", 16), (5, "u", "", 0), (6, "u", "deep", 4)]
    assert got == sorted(want, key=str)
    assert html.extract(frame.limit(0)).count() == 0


def test_furniture_goes():
    furniture = (
        "<nav><ul><li><a href=a>Home</a></li></ul></nav><header><p>Site name, a slogan, and more</p></header><div class='ad box'>Buy, buy, buy now</div>"
        "<div id=cookie-notice><p>We use cookies, many of them, all day long, every day</p></div><form><p>Sign in, please</p></form>"
        "<script>if (a < b) document.write('<p>no</p>')</script><style>p{}</style><noscript>no</noscript>"
    )
    after = "<section class=comments><p>First, I disagree, strongly, with all of this</p></section><aside><p>Also read, this, that</p></aside><footer>&copy; us, 2020</footer>"
    for kind in ("article", "main", "div"):
        assert html.main_text(page(f"{furniture}<{kind}><h2>Head</h2><p>{ARTICLE}</p><p>{ARTICLE}</p>{after}</{kind}>{after}")) == "\n".join(["Head", ARTICLE.strip(), ARTICLE.strip()])


def test_broken_markup():
    assert html.main_text("<article><p><b>one<br><p>two<ul><li>a<li>b</ul><p>th&eacute;&am") == "one\ntwo\na\nb\nthé&am"
    assert html.main_text("<article><p>one</p><p>two</p><foo bar='x") == "one\ntwo"
    assert html.main_text("<table><tr><td>a, b<td>c</table>") == "a, b\nc"


def test_best_of_two_containers():
    links = "".join(f"<p><a href=x>{ARTICLE}</a></p>" for _ in range(9))
    assert html.main_text(page(f"<div><div>{links}</div><div><p>{ARTICLE}</p><p>{ARTICLE}</p></div></div>")) == "\n".join([ARTICLE.strip()] * 2)


def slow_scores(node):
    """Sizes, link sizes and values of all nodes, each straight from its definition, in page order."""
    squeeze = lambda t: " ".join(t.split())
    kids = lambda n: [c for c in n.children if isinstance(c, html.Node) and not c.dropped]
    every = lambda n: [n, *(x for k in kids(n) for x in every(k))]
    own = lambda n: [c for c in n.children if isinstance(c, str)]
    size = lambda n: sum(len(squeeze(t)) for x in every(n) for t in own(x))
    links = lambda n: size(n) if n.tag == "a" else sum(links(k) for k in kids(n))
    inline = lambda n: own(n) + [t for k in kids(n) if k.tag not in html.BLOCKS for t in inline(k)]

    def gained(n):
        text = squeeze("".join(inline(n)))
        heading = len(n.tag) == 2 and n.tag[0] == "h" and n.tag[1] in "123456"
        if not text or heading or not (n.tag in html.PARAGRAPHS or n.tag in html.BLOCKS and any(t.strip() for t in own(n))):
            return 0
        return 1 + text.count(",") + min(len(text) / 100, 3)

    def points(n):
        total = html.START_POINTS.get(n.tag, 0) + n.cost
        for x in every(n):
            steps, at = (0 if x.tag in html.PARAGRAPHS else 1), x
            while at is not n:
                steps, at = steps + 1, at.parent
            if steps:
                total += gained(x) * (1 if n.tag == "article" else 1 / steps if steps <= 5 else 0)
        return total

    return [(size(n), links(n), points(n) * (1 - links(n) / size(n)) if size(n) else 0) for n in every(node)]


def random_page(rng, depth=0):
    tag = rng.choice(["div", "p", "section", "article", "ul", "li", "a", "b", "td", "h1", "blockquote", "span"])
    name = rng.choice(["", "", "", " class='related x'", " id=comments", " class=story"])
    inner = "".join(random_page(rng, depth + 1) if depth < 6 and rng.random() < 0.6 else rng.choice(["some words, ", "x" * rng.randint(1, 150), " \n "]) for _ in range(rng.randint(1, 4)))
    return f"<{tag}{name}>{inner}</{tag}>"


def test_scores_match_brute_force():
    rng = random.Random(11)
    for _ in range(150):
        root = html.parse(random_page(rng) + random_page(rng))
        nodes = html._nodes(root)
        html._score(nodes)
        got = [(n.size, n.links, html._value(n)) for n in nodes]
        for a, b in zip(got, slow_scores(root), strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2])


def test_the_score_decides(monkeypatch):
    """An article element of a line loses to a container of paragraphs; without scores the choice is another one."""
    shown = page(f"<div><article><p>Short, teaser.</p></article></div><div><p>{ARTICLE * 3}</p><p>{ARTICLE * 3}</p><p>{ARTICLE * 3}</p><p>{ARTICLE * 3}</p><p>{ARTICLE * 3}</p></div>")
    assert html.main_text(shown) == "\n".join([(ARTICLE * 3).strip()] * 5)
    monkeypatch.setattr(html, "_value", lambda n: 0.0)
    assert "teaser" in html.main_text(shown)


def test_names_weigh_but_do_not_condemn():
    long = "".join(f"<p>{ARTICLE}</p>" for _ in range(12))
    assert html.main_text(page(f"<div class='search-story related'><h1>Head</h1>{long}</div><div class='related'><p>See this, too</p></div>")) == "\n".join(["Head", *[ARTICLE.strip()] * 12])


def test_a_heading_beside_the_body_stays():
    body = f"<div class=body><p>{ARTICLE}</p><p>{ARTICLE}</p></div>"
    for wrap in ("<article><h1>Head</h1>{}</article>", "<div><h1>Head</h1>{}</div>", "<article><div><h1>Head</h1></div><div>{}</div></article>"):
        assert html.main_text(page(wrap.format(body))) == "\n".join(["Head", ARTICLE.strip(), ARTICLE.strip()])


def test_ties_and_long_pages():
    two = f"<div><p>{ARTICLE}</p></div>" * 2
    assert html.main_text(page(two)) == "\n".join([ARTICLE.strip()] * 2)  # equal containers are siblings of the best
    long = page("<article>" + f"<p>{ARTICLE}</p>" * 20_000 + "</article>")
    assert html.main_text(long).count("\n") == 19_999


@pytest.mark.parametrize("n", [1, 30, 60, 300, 3000])
def test_comments_go_however_long(n):
    story = [f"Paragraph {i} of the story, with some words, and more of them, until it is long enough." for i in range(5)]
    for tag, name in (("div", "comments"), ("section", "comment-list"), ("div", "sidebar")):
        inner = "".join(f'<article class="comment"><p>Reader {i} says, at length, that it is, well, a very long comment on it all.</p></article>' for i in range(n))
        page = f'<html><body><div class="page"><h1>Story</h1><div class="text">{"".join(f"<p>{p}</p>" for p in story)}</div><{tag} class="{name}">{inner}</{tag}></div></body></html>'
        assert html.main_text(page).split("\n")[-5:] == story


def test_a_named_wrapper_of_the_article_stays():
    story = "".join(f"<p>Paragraph {i} of the story, with some words, and more of them, until it is long.</p>" for i in range(5))
    for inner in (f"<main>{story}</main>", f"<article>{story}</article>", f"<h1>T</h1><div>{story}</div>", f"<div>{story}</div>"):
        assert html.main_text(f'<body><div class="with-sidebar">{inner}</div></body>').count("Paragraph") == 5


@pytest.mark.parametrize("depth", [10, 405, 1000, 20000])
def test_depth_leaks_nothing(depth):
    story = "".join(f"<p>Paragraph {i} of the story, with some words, and more of them, until it is long.</p>" for i in range(5))
    hidden = "<script>var evil=1;</script><nav>MENU</nav><div hidden>HIDDEN</div>"
    for tag in ("div", "span"):
        text = html.main_text(f"<body><article>{story}" + f"<{tag}>" * depth + f"deep words {hidden}" + f"</{tag}>" * depth + "</article></body>")
        assert text.count("Paragraph") == 5 and "deep words" in text and not any(w in text for w in ("evil", "MENU", "HIDDEN"))
