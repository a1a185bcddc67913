import html
import random
import re
import time

import pytest

from clearway.llm.html_text import extract, main_text, tokens

FOLDER = "/root/testdata/sf0.001"


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


LONG = "Some longer words make a paragraph that nobody would take for a menu, " * 3
CASES = {
    "article": (page(f"<nav><a href=x>m</a></nav><article><h1>Head</h1><p>One  two\n three<p>Four</article><footer>f</footer>"), "Head\nOne two three\nFour"),
    "no article": (page(f"<div id=menu><a>x</a></div><div><div class=story><p>{LONG}</p><p>{LONG}</p></div><div class=sidebar>side</div></div>"), f"{LONG.strip()}\n{LONG.strip()}"),
    "comments": (page(f"<article><p>{LONG}</p><section class='comments'><p>{LONG}</p></section></article><div class=comment-list>{LONG}</div>"), LONG.strip()),
    "nested comment articles": (page(f"<article><p>{LONG}</p></article><article class=comment><p>{LONG}{LONG}</p></article>"), LONG.strip()),
    "furniture inside": (page(f"<article><header><h1>A</h1></header><p>{LONG}</p><aside>no</aside><div class=ad>no</div><form>no<input></form><div class=cookie-notice>no</div><footer>no</footer></article>"), f"A\n{LONG.strip()}"),
    "page header": (page(f"<header>Site</header><main><p>{LONG}</p></main>"), LONG.strip()),
    "references": (page("<article><p>a &amp; b &lt;c&gt; &eacute; &#65; &nbsp; z &am</p></article>"), "a & b <c> é A z &am"),
    "scripts": (page("<article><script>var t='<p>no</p>';</script><style>p{}</style><p>yes<!-- no --></p></article>"), "yes"),
    "inline": (page("<article><p>a<b>b</b>c<br>d <i>e</i></article>"), "abc d e"),
    "lists and tables": (page("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y<tr><td>z</table></article>"), "one\ntwo\nx\ny\nz"),
    "stray ends": ("</div></p><article></b><p>x</i></p></article></article>tail", "x"),
    "text only": ("just text", "just text"),
    "unclosed script": ("<article><p>kept</p><script>if (a < b", "kept"),
    "nothing": (page("<nav>only</nav>"), ""),
}


DIVS = f"<div class=story><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>"
STORY = "\n".join([LONG.strip()] * 3)
CHOSEN = {
    "teaser article beside divs": (page(f"<div>{DIVS}</div><div><article><p>Teaser</p></article></div>"), STORY),
    "main text beside many articles": (page(f"{DIVS}<ul>" + "<li><article><p>Teaser</p></article>" * 12 + "</ul>"), STORY),
}
WRAPPED = {
    "sidebar layout": (page(f"<div class='page has-sidebar'>{DIVS}</div>"), STORY),
    "no ads": (page(f"<div class='layout no-ads'>{DIVS}</div>"), STORY),
    "widget": (page(f"<div class='elementor-widget post-content'><article>{DIVS}</article></div>"), STORY),
    "named wrapper": (page(f"<div class=widget>{DIVS}</div><div class=sidebar>side</div>"), STORY),
    "named wrapper of the article": (page(f"<div class='sidebar'><article>{DIVS}</article></div>"), STORY),
    "page-wide form": (page(f"<form><article>{DIVS}</article><input></form>"), STORY),
    "page-wide form without article": (page(f"<form>{DIVS}<input></form>"), STORY),
    "inline": (page(f"<article><p>{LONG}<span class='hljs-comment'>one</span> <span class='search-hit'>two</span> <a class='related'>three</a></p></article>"), f"{LONG}one two three"),
}


REMARK = "I do not agree with a single word of this, and I have read all of it twice. " * 2
MANY = "".join(f"<div class=item><b>reader {n}</b><p>{REMARK}{n}</p></div>" for n in range(40))
REMARKS = {
    "many beside an article": (page(f"<article>{DIVS}</article><div class='comments'>{MANY}</div>"), STORY),
    "many beside divs": (page(f"<div class=content>{DIVS}</div><div class='comments'>{MANY}</div>"), STORY),
    "many inside the article": (page(f"<article>{DIVS}<section id=comment-list>{MANY}</section></article>"), STORY),
    "a short text beside more remarks": (page(f"<div class=content><p>{'word ' * 90}</p></div><div class=comments><p>{'remark ' * 100}</p></div>"), ("word " * 90).strip()),
    "articles as remarks": (page(f"<article>{DIVS}</article><ol class=comment-list>" + f"<li class=comment><article class=comment-body><p>{REMARK}</p></article>" * 30 + "</ol>"), STORY),
    "plain articles as remarks": (page(f"<div>{DIVS}</div><section class=comments>" + f"<article><p>{REMARK}</p></article>" * 30 + "</section>"), STORY),
    "a wrapper with an odd name": (page(f"<div class=discussion><article>{DIVS}</article></div>"), STORY),
    "an article that has comments": (page(f"<article class='post has-comments'>{DIVS}</article>"), STORY),
    "an article on replies": (page(f"<article id='why-reply-matters'>{DIVS}</article>"), STORY),
    "text hidden from readers aloud": (page(f"<article><h1 aria-hidden=true>Head</h1><p>a <span aria-hidden='true'>b</span> c</p></article>"), "Head\na b c"),
    "hidden text": (page(f"<article><p>{LONG}</p><p hidden>no</p></article>"), LONG.strip()),
}


@pytest.mark.parametrize("name", REMARKS)
def test_remarks_of_readers_go_and_articles_stay(name):
    given, wanted = REMARKS[name]
    assert main_text(given) == wanted


@pytest.mark.parametrize("seed", range(40))
def test_generated_pages(seed):
    """Any number of paragraphs, furniture and remarks in random wrappers: the paragraphs come out, nothing else."""
    rng = random.Random(seed)

    def prose(name, least, most):
        return " ".join(f"{name}{rng.randrange(1000)}" for _ in range(rng.randint(least, most))) + "."

    paragraphs = [prose("text", 15, 80) for _ in range(rng.randint(3, 12))]
    story = "".join(f"<p>{p}</p>" for p in paragraphs)
    story = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>", "<div><div id=story>{}</div></div>", "<main><article class=has-comments>{}</article></main>"]).format(story)
    menu = "<ul class=menu>" + "".join(f"<li><a href=x>{prose('menu', 1, 3)}</a>" for _ in range(rng.randint(2, 12))) + "</ul>"
    remarks = "".join(rng.choice(["<div class=comment><p>{}</p></div>", "<article class=comment>{}</article>", "<li>{}</li>"]).format(prose("remark", 5, 60)) for _ in range(rng.randint(0, 60)))
    remarks = rng.choice(["<div class=comments>{}</div>", "<section id=comments>{}</section>", "<ol class='comment-list wide'>{}</ol>", "<div id=disqus_thread>{}</div>", "<div role=complementary class=replies>{}</div>"]).format(remarks)
    around = [f"<header>{prose('site', 2, 9)}</header>", f"<nav>{menu}</nav>", menu, f"<div class=sidebar>{prose('side', 3, 20)}</div>", "<script>var x='<p>no</p>'</script>", f"<div class=ad>{prose('buy', 3, 12)}</div>"]
    before = "".join(rng.sample(around, rng.randint(0, 4)))
    assert main_text(page(f"{before}{story}{remarks}<footer>{prose('foot', 2, 9)}</footer>")) == "\n".join(paragraphs)


def test_furniture_at_any_depth():
    deep = "<div>" * 2100
    assert main_text(f"{deep}<p>text here</p><script>var x=1</script><nav>menu</nav>") == "text here"
    assert main_text(f"{deep}<article><p>{LONG}</p><div class=comments><p>no</p></div></article><div class=ad>no</div>") == LONG.strip()


@pytest.mark.parametrize("part", ["<a ", "<!--", "<", "</", "<![CDATA[", "<p title='", "&", "<script>", "</x ", "<?", "<p><x>", "<td><x>", "<b><i>", "<ul><li>", "<p><td><x><div></div>", "<title>", "<a href=\"x"])
def test_time_grows_with_the_page(part):
    started = time.time()
    main_text("<article><p>kept</p>" + part * 60_000)
    assert time.time() - started < 10


def test_tokens():
    cases = {
        "a<b c=d e='f>g' h>i</b >j": [("text", "a"), ("start", "b", [("c", "d"), ("e", "f>g"), ("h", "")]), ("text", "i"), ("end", "b"), ("text", "j")],
        "x<!-- <p> -->y<!-->z<!doctype html>": [("text", "x"), ("text", "y"), ("text", "z")],
        "1 < 2 &lt; 3 <4> </5>6": [("text", "1 "), ("text", "<"), ("text", " 2 < 3 "), ("text", "<"), ("text", "4> "), ("text", "6")],
        "<SCRIPT>a</b></Script><p>": [("start", "script", []), ("text", "a</b>"), ("end", "script"), ("start", "p", [])],
        "<title>a &amp; <b></title>c": [("start", "title", []), ("text", "a & <b>"), ("end", "title"), ("text", "c")],
        "a<br/>b<img src=x/y alt = 'é'>": [("text", "a"), ("start", "br", []), ("text", "b"), ("start", "img", [("src", "x/y"), ("alt", "é")])],
        "a<p class='x": [("text", "a")], "a<": [("text", "a"), ("text", "<")], "": [],
    }
    for given, wanted in cases.items():
        assert [(k, v, a) if k == "start" else (k, v) for k, v, a in tokens(given)] == wanted


@pytest.mark.parametrize("name", CHOSEN)
def test_density_chooses_the_content(name):
    given, wanted = CHOSEN[name]
    assert main_text(given) == wanted


@pytest.mark.parametrize("name", WRAPPED)
def test_names_of_wrappers_and_inline_elements_lose_no_text(name):
    given, wanted = WRAPPED[name]
    assert main_text(given) == wanted


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    given, wanted = CASES[name]
    assert main_text(given) == wanted


def test_pages_table(spark):
    """The pages' own article element, cut out by patterns, holds the wanted text."""
    for r in extract(spark.read.parquet(f"{FOLDER}/pages.parquet")).join(spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p>" * 50_000 + "deep"), (2, "u", "<div>" * 20_000 + "deep"), (3, "u", "<p>" + "w " * 200_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 0), (2, 4), (2, 4), (3, 399_999)]
    assert extract(pages.limit(0)).collect() == []
