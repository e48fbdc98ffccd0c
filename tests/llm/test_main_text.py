"""Main text of pages: rules one by one, whole pages, odd input."""

import html
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atlasledger.llm import main_text as M
from atlasledger.llm.queries import QUERIES

LONG = "This is a sentence of the article, and it has the words that a text in a language has. " * 3
BODY = f"<p>{LONG}</p><p>A short end.</p><p>{LONG}</p>"
WANT = f"{LONG.strip()} A short end. {LONG.strip()}"
SIDE = "Here is a long notice of the kind that is on many pages, and it has all of the usual words in it. " * 3


@pytest.mark.parametrize(
    "extra",
    [
        f"<nav><p>{SIDE}</p></nav>",
        f"<header>{SIDE}</header>",
        f"<footer><p>{SIDE}<p>&copy; x</footer>",
        f"<aside class=x>{SIDE}</aside>",
        f"<form><p>{SIDE}<input><select><option>a<option>b</select></form>",
        f"<div class='cookie-banner'><div><p>{SIDE}</div></div>",
        f'<div class="ad">{SIDE}</div>',
        f"<div id=comments><h3>3 comments</h3><p>{SIDE}</p></div>",
        f"<section class='user-comment'>{SIDE}</section>",
        f"<div class=newsletter>{SIDE}</div>",
        f"<div role=navigation>{SIDE}</div>",
        f"<div style='display:none'>{SIDE}</div>",
        f"<p class='notice'>{SIDE}</p>",
        f"<script>var a = '<p>{SIDE}</p>';</script>",
        f"<style>p {{ content: '{SIDE}' }}</style>",
        f"<!-- <p>{SIDE}</p> -->",
        "<ul>" + "".join(f"<li><a href='/{k}'>A link to the other page of the site, {k}</a></li>" for k in range(20)) + "</ul>",
    ],
)
@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>", "{}"])
def test_what_is_left_out(extra, around):
    for page in (f"<html><body>{extra}{around.format(BODY)}", f"<body>{around.format(BODY)}{extra}</body>"):
        assert M.main_text(page) == WANT
    if "article" in around:  # within the article too, but for its own header
        page = f"<body>{around.format(BODY + ('' if 'header' in extra else extra))}</body>"
        assert M.main_text(page) == WANT


def test_white_space_references_and_markup():
    page = f"<article><h1>Caf&eacute; &amp;\n\t<i>more</i></h1><p>{LONG}<br>x&nbsp;&lt;b&gt; &#233;&#x1F642;<p>un<b>clos</b>ed {LONG}</article>"
    assert M.main_text(page) == f"Café & more {LONG.strip()} x <b> é🙂 unclosed {LONG.strip()}"


def test_ambiguous_blocks_follow_their_nearest_neighbours():
    links = "<p>" + "<a href=x>a link of the page</a> " * 10 + "</p>"
    page = f"<div><p>{LONG}</p><p>near good</p><p>good too</p><p>near links</p><p>at links</p>{links}<p>near bad</p>{links}</div>"
    assert M.main_text(page) == f"{LONG.strip()} near good good too"


def test_an_article_with_odd_words_is_kept_whole():
    odd = "Xq zrrt%%% vvk*** brr### " * 8
    page = f"<nav>{SIDE}</nav><article><h1>Xq zrrt</h1><p>{odd}</p><p>brr</p></article><p>{SIDE}</p>"
    assert M.main_text(page) == f"Xq zrrt {odd.strip()} brr"


def test_headers_of_an_article_hold_its_title():
    page = f"<header>Site</header><article><header class='entry-header'><h1>Title</h1></header>{BODY}</article>"
    assert M.main_text(page) == f"Title {WANT}"


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("<div>", ""),
        ("plain", "plain"),
        ("a < b", "a < b"),
        ("<p>one<p>two", "one two"),
        ("<script>x", ""),
        ("<!-- x", ""),
        ("</p></div>x", "x"),
        ("<a href='x>y'>q</a>", ""),
        ('<p title="a > b">x</p>', "x"),
        ("<p", "<p"),
    ],
)
def test_odd_pages(page, want):
    assert M.main_text(page) == want


@given(st.text("<>/pab!-\"'= &;#x1\n", max_size=60))
@settings(deadline=None, max_examples=300)
def test_any_text_is_a_page(page):
    out = M.main_text(page)
    assert out == " ".join(out.split())


def test_large_and_hostile_pages():
    assert M.main_text("<div>" * 20_000 + "x") == "x"
    assert len(M.main_text("<p>" + "the word of it " * 200_000)) == 15 * 200_000 - 1
    M.main_text("<a b=\"" * 3000)
    M.main_text("<button>" * 3000)


MEGABYTE = 1_000_000
HOSTILE = {
    **{f"<{name}>": f"<{name}>x " for name in sorted(M._SKIPPED | M._RAW)},
    **{k: k for k in ("<a ", '<a "x', "<a \"'<b '", "<!", "</ ", "<!--", "&", "&#", "&#x", "<button", "<a =")},
}


@pytest.mark.parametrize("name", HOSTILE)
def test_a_hostile_megabyte_takes_no_longer_than_others(name):
    began = time.process_time()
    M.main_text(HOSTILE[name] * (MEGABYTE // len(HOSTILE[name])))
    assert time.process_time() - began < 2


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 100_000 + "</p>" * 120_000,
        f"<article><div class='{'a' * MEGABYTE}'>x</div></article>",
        f"<p>&#{'9' * MEGABYTE}; &#x{'f' * 50};</p>",
        '<a "x' * (MEGABYTE // 5) + ">",
        "<article>" + '<div class="a-b header_c" hidden2 x=1>t' * (MEGABYTE // 40),
    ],
    ids=["unmatched ends", "long word", "long number", "open quotes", "many names"],
)
def test_hostile_wholes(page):
    began = time.process_time()
    M.main_text(page)
    assert time.process_time() - began < 2


def model(found):
    """Both passes once more, block by block, straight from their description."""
    total, own = sum(len(b.text) for b in found), sum(len(b.text) for b in found if b.article)
    bounded = own and own * 3 >= total

    def stop_share(b):
        words = re.findall(r"\w+", b.text.lower())
        return sum(w in M.STOP_WORDS for w in words) / max(1, len(words))

    def judged(b):
        return not (bounded and not b.article) and b.links <= M.LINKS * len(b.text) and len(b.text) >= M.SHORT and not b.heading

    known = any(stop_share(b) >= M.STOP_LOW for b in found if judged(b))

    def first(b):
        if bounded and not b.article or b.links > M.LINKS * len(b.text):
            return "bad"
        if not judged(b):
            return "bad" if b.links and not b.article else "open"
        if stop_share(b) >= M.STOP_HIGH or not known and not b.article:
            return "good" if len(b.text) >= M.LONG or b.article else "open"
        return "bad" if stop_share(b) < M.STOP_LOW and not b.article else "open"

    labels = [first(b) for b in found]

    def second(k, numbers):
        near = min((abs(j - k) for j in numbers if labels[j] != "open"), default=None)
        return None if near is None else any(labels[j] == "good" for j in numbers if abs(j - k) == near)

    out = []
    for k, b in enumerate(found):
        told = second(k, [j for j, c in enumerate(found) if c.article == b.article])
        if told is None:
            told = True if b.article else second(k, range(len(found)))
        out.append(told)
    return [True] * len(found) if None in out else out


def test_both_passes_equal_a_plain_model():
    rng = random.Random(5)
    kinds = [LONG, "A short one.", "Xq zrrt vvk brr " * 12, "the of and to in is " * 6, "<a href=x>a link of this page here</a> " * 6, "It is a <a href=x>link</a> of it."]
    for _ in range(400):
        page = "".join(
            f"<{tag}>{rng.choice(kinds)}</{tag}>" if rng.random() < 0.9 else rng.choice(["<article>", "</article>"])
            for tag in rng.choices(["p", "div", "h2", "li"], k=rng.randint(1, 14))
        )
        found = list(M.blocks(page))
        if found:
            assert M.settled(M.classified(found), found) == model(found), page


def test_query_equals_the_model_without_names(spark, sf):
    """With structural names and classes taken out, block rules alone decide."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    bare = F.regexp_replace(F.regexp_replace("html", r"(?i)</?(article|main|nav|header|footer|aside|section)\b[^>]*>", "<div>"), r"(class|id|role)=", "data-x=")
    rows = M.extract(pages.withColumn("html", bare)).collect()
    texts = {r.page_id: r.html for r in pages.withColumn("html", bare).collect()}
    kept = 0
    for r in rows:
        found = list(M.blocks(texts[r["row"].page_id]))
        want = [b.text for b, keep in zip(found, model(found)) if keep]
        assert r.text == " ".join(want)
        kept += len(want) < len(found)
    assert kept > len(rows) / 2


def test_query(spark, sf):
    """These pages mark their article."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op9_main_text"](spark, sf).collect()}
    assert len(got) == len(pages)
    for r in pages:
        own = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        own = re.sub(r"<!--.*?-->|<script.*?</script>", " ", own, flags=re.S)
        assert got[r.page_id].text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", own)).split())
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_rows(spark):
    schema = "page_id long, url string, html string, text int, n_chars string, `row` int"
    rows = [(1, "u", "<p>é</p>", 5, "n", 1), (1, "u", "<p>é</p>", 5, "n", 1), (None, None, None, None, None, None)]
    out = M.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["row"].page_id or 0, r["row"].text or 0, r.text, r.n_chars) for r in out) == [(0, 0, "", 0), (1, 5, "é", 1), (1, 5, "é", 1)]
    assert M.extract(spark.createDataFrame([], schema)).count() == 0


def test_languages_without_known_stop_words():
    body = ["Жители небольшого города собрались вчера вечером у реки, чтобы решить судьбу старого моста. " * 4, "Весной начнутся большие работы, говорит глава города, и продлятся они почти до самой зимы."]
    links = "".join(f"<a href=/{k}>Раздел номер {k} нашего сайта</a> " for k in range(9))
    page = f"<body><div><p>{links}</p></div><div><p>{body[0]}</p><p>{body[1]}</p></div></body>"
    assert M.main_text(page) == " ".join(" ".join(b.split()) for b in body)


def test_an_article_that_is_a_teaser_only():
    body = "The town has met at the river and it was decided that the old bridge is to be kept for all of us. " * 6
    teaser = "A short teaser of another story that is on the site, with a few words of it to be read by all. " * 2
    assert body.strip() in M.main_text(f"<body><div><p>{body}</p></div><article><p>{teaser}</p></article></body>")
