import random
import time

import pytest

from rallyframe.llm import pages
from rallyframe.llm.pages import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies on this site.</div>
<div class="ad">Buy now.</div><aside><p>A sidebar that goes on for a long time with many of the words that are in the text of an article.</p></aside>
<article><header><h1>The  head &amp; line</h1></header><p><b>First paragraph &lt;of&gt; the text,
with a <a href="/x">link</a> inside and more than enough words to be long by itself.<br><p>Short one.</p>
<div class="ad">Not this.</div><form><input name=q><button>Go</button>Search here</form><p>Last &#233;nd &copy without mark.</p></article>
<section id="comments"><p>A reader says that this is the best article that was ever written in the history of the world.</p></section>
<footer>&copy; site</footer></body>"""


def test_article_without_the_rest():
    lines = main_text(PAGE).split("\n")
    assert lines[0] == "The head & line"
    assert lines[1].startswith("First paragraph <of> the text, with a link inside")
    assert "Short one." in lines and not any("cookies" in x or "Not this" in x or "Search" in x or "reader" in x or "Buy" in x for x in lines)


def test_page_without_article_elements():
    body = "The text of the page is in a plain division and it goes on for quite some time with all of the usual words."
    page = f"<div id=menu><a href=/>Home</a> <a href=/b>News</a></div><div><p>{body}</p><p>A short one.</p><p>{body}</p></div><div class=footer>x</div>"
    assert main_text(page) == f"{body}\nA short one.\n{body}"


def test_broken_pages():
    assert main_text("") == "" and main_text(None) == ""
    assert main_text("<p") == "" and main_text("<!-- never closed <p>x") == "" and main_text("<script>x") == ""
    assert main_text("<article><p>cut o") == "cut o"
    assert main_text("<article><p>a < b and c</p></article>") == "a < b and c"
    assert main_text("<article>" + "<div>" * 5000 + "deep" + "</article>") == "deep"
    assert main_text("<ul><li><a href=/>only links</a></li></ul>") == ""


def test_rows_stay_one_to_one(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", ""), (3, "w", "<article><p>" + "many words " * 50_000 + "</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS _html")
    got = extract(pages).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert max(r.n_chars for r in got) == 11 * 50_000 - 1
    assert extract(pages.filter("false")).count() == 0


BODY = "The text of the page goes on for quite some time and it has all of the usual words of an article in it."


@pytest.mark.parametrize(
    "head",
    [
        '<div class="overflow-hidden"><article>', '<div data-hidden="0"><article>', '<main class="has-sidebar">', '<div class="content-with-sidebar"><article>',
        '<article class="post social">', '<div class="wrapper menu-open"><div>', '<div title="hidden treasure" data-id="sidebar"><main id=search>',
    ],
)
def test_loose_names_remove_no_article(head):
    assert main_text(f"<body>{head}<p>{BODY}</p></body>") == BODY


@pytest.mark.parametrize("head", ["<div hidden>", "<div class='x sidebar'>", "<div class=sidebar-list>", "<div id=site-footer>", "<div style='color:red; display: none'>", "<article hidden>"])
def test_marked_and_hidden_elements_still_go(head):
    assert main_text(f"<body>{head}<p>{BODY}</p></body>") == ""


def test_copyright_sign_in_a_long_block():
    text = BODY + " The photo is © of its owner."
    assert main_text(f"<article><p>{text}</p></article><p>© a site</p>") == text
    assert main_text(f"<div><p>{text}</p></div>") == text


@pytest.mark.parametrize(
    "text",
    [
        "Depois de muitos anos de trabalho, a equipa apresentou ontem os resultados do estudo sobre o clima da região.",
        "Po wielu latach pracy zespół przedstawił wczoraj wyniki badań nad klimatem regionu, które zaskoczyły ekspertów.",
        "После многих лет работы группа представила вчера результаты исследования климата региона, удивившие экспертов.",
        "Monivuotisen työn jälkeen ryhmä esitteli eilen alueen ilmastoa koskevan tutkimuksen tulokset, jotka yllättivät.",
        "经过多年的工作，研究小组昨天公布了有关该地区气候的研究结果，这些结果让许多专家感到惊讶，也引起了公众的广泛关注。",
    ],
)
def test_other_languages_without_article(text):
    assert main_text(f"<div><a href=\"/x\">x</a></div><div><p>{text}</p><p>{text}</p></div><div class=footer>{text}</div>") == f"{text}\n{text}"


def plain_labels(found):
    """The second pass by looking back and forth from every open block; first labels are given."""
    out = []
    for i, b in enumerate(found):
        if b.label != pages.OPEN:
            out.append(b.label)
            continue
        near = []
        for way in (range(i - 1, -1, -1), range(i + 1, len(found))):
            for j in way:
                c = found[j]
                if c.inside == b.inside and not c.outside and c.label != pages.OPEN:
                    near.append((abs(j - i), j, c.label))
                    break
        if not near:
            out.append(pages.GOOD if b.inside else pages.BAD)
        elif b.inside:
            out.append(pages.BAD if [n[2] for n in near] == [pages.BAD] * 2 else pages.GOOD)
        else:
            out.append(min(near)[2])
    return out


def first_labels(found):
    """The first pass from the rules as they are stated."""
    long, good_inside, told, rest = [], False, 0, 0
    for b in found:
        words = [w.strip(".,;:!?\"'()") for w in b.text.lower().split()]
        stops = len([w for w in words if w in pages.STOP]) / len(words)
        size = len(b.text) + len(pages.DENSE.findall(b.text))
        b.label = pages.OPEN
        if b.outside or b.linked > pages.LINKED * len(b.text) or ("©" in b.text and not b.inside and size < pages.LONG):
            b.label = pages.BAD
        elif size >= pages.LONG and (b.inside or stops >= pages.STOPPED):
            b.label, told, good_inside = pages.GOOD, told + size, good_inside or bool(b.inside)
        elif size >= pages.LONG:
            long.append(b)
            rest += size
    if not good_inside and told < pages.UNTOLD * (told + rest):
        for b in long:
            b.label = pages.GOOD


@pytest.mark.parametrize("seed", range(40))
def test_labels_equal_the_plain_rules(seed):
    pick = random.Random(seed)
    made = []
    for _ in range(pick.randint(0, 60)):
        text = pick.choice(["Short.", "© 2020 firm", "zyx " * 40, "the cat and the dog of a house is in it " * 5, "said the"])
        made.append((text.strip(), pick.choice([0, 0, len(text)]), pick.random() < 0.2, pick.choice([0, 0, 1, 2])))
    one, two = [pages.Block(*m) for m in made], [pages.Block(*m) for m in made]
    first_labels(two)
    assert [b.label for b in pages.classify(one)] == plain_labels(two)


@pytest.mark.parametrize("unit", ["<p>short one</p>", "<b>x<p>y</p>", "<i>z", "</section>w<li>v", "<td>short<br>"])
def test_time_grows_with_the_page(unit):
    def seconds(n):
        start = time.process_time()
        main_text("<div>" + unit * n + "</div>")
        return time.process_time() - start

    seconds(1000)
    assert seconds(80_000) < 16 * max(seconds(10_000), 0.05)
