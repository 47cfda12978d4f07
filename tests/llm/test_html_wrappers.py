"""Articles of pages whose parts are known, and the wrappers they come from."""

import html as entities
import random
import re

import pytest
from pyspark.sql import functions as F

from orientlake.llm import html_wrappers
from orientlake.llm.common import Scratch
from orientlake.llm.html_wrappers import Page, add_item, aligned, expression
from orientlake.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"
SHAPE = "page_id bigint, url string, html string"


def letters(text):
    out = []
    for c in text:
        add_item(out, [c, False, False, [], 0])
    return out


def matches(items, text):
    """Whether the expression over one-letter elements accepts a text."""
    pattern, i = "", 0
    while i < len(items):
        k = i + 1
        while items[i][4] and k < len(items) and items[k][4] == items[i][4]:
            k += 1
        body = "".join(x[0] + ("+" if x[2] else "") if not x[1] else f"(?:{x[0]}{'+' if x[2] else ''})?" for x in items[i:k])
        pattern += f"(?:{body})*" if items[i][4] else body
        i = k
    return re.fullmatch(pattern, text) is not None


@pytest.mark.parametrize("seed", range(3))
def test_wrappers_accept_every_page_they_come_from(seed):
    rnd = random.Random(seed)
    for _ in range(300):
        words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 7))) for _ in range(rnd.randint(1, 6))]
        wrapper = letters(words[0])
        for w in words[1:]:
            wrapper = aligned(wrapper, letters(w))
        assert len({x[0] for x in wrapper}) == len(wrapper) <= 5
        for w in words:
            assert matches(wrapper, w), (words, wrapper)


def test_mismatches_become_options_and_repeats():
    pages = [Page("<div><p>a<p>b</p></div><ul><li>x</ul>"), Page("<div><p>a</div>"), Page("<div><h2>t</h2><p>a</p></div><ul><li>x<li>y</ul>")]
    wrapper = pages[0].items
    for p in pages[1:]:
        wrapper = aligned(wrapper, p.items)
    assert expression(wrapper) == "<div>(<h2>#</>)?(<p>#</>)+</>(<ul>(<li>#</>)+</>)?"
    assert expression(letters("abcab")) == "((<a></>)?(<b></>)?(<c></>)?)+"


def extracted(spark, rows):
    found = html_wrappers.extract_articles(spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit(1) for c in ("host", "text", "deal", "wrapper", "_key")}), Scratch(spark))
    return {r["page_id"]: r["text"] for r in found.collect()}


def test_articles_of_given_parts(spark):
    body = "<article><h1>T&eacute;  t</h1><p>One <b>bo</b>ld<br>two&nbsp;&nbsp;three<p>x &lt; y<script>var t='</p><p>no'</script></article>"
    want = "Té t One bold two three x < y"
    frames = {
        1: f"<nav><ul><li><a href=/>Menu</a></ul></nav>{body}<footer>&copy; us</footer>",
        2: f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><!-- ad --><div class='ad'>Buy</div>{body}",
        3: f"<header><h1>Site</h1></header><aside>Side<article>teaser</article></aside>{body}<section id=comments><article class=comment><p>Reader</p></article></section>",
        4: f"<nav><ul><li>never closed{body}",
        5: f"<form action=/><input name=q><label>Find</label>{body}</form><form><p>Sign up</p></form>",
        6: f"<div class='cookie-notice'>We use cookies</div><div class=has-sidebar><main>{body}</main></div><div role=complementary>More</div>",
        7: f"<noscript>Turn it on</noscript>{body}<template><p>No</p></template><div hidden>No</div>",
        8: f"{body[:-len('</article>')]}<footer>end",
        9: "<main><p>Only main</p><!-- a > b <p>no</p> --></main><p>outside</p>",
        10: "", 11: None, 12: "plain &amp; simple", 13: "<div><div>" * 3000 + "<p>deep</p>" + "</div></div>" * 3000, 14: "<p title='a > b' class=\"x\">kept</p><p title=\"open>kept too</p>",
        15: "<div>unclosed comment <!-- <p>no</p>", 16: "<script>never closed <p>no</p>", 17: "2 < 3 and <1> <p>ok", 18: "<table><tr><td>a<td>b<tr><td>c</table>", 19: "<p>word " + "long " * 50000,
    }
    got = extracted(spark, [(k, f"http://h{k}.org/x", v) for k, v in frames.items()])
    assert [got[k] for k in range(1, 9)] == [want] * 8
    assert [got[k] for k in range(9, 20)] == ["Only main", "", "", "plain & simple", "deep", "kept kept too", "unclosed comment", "", "2 < 3 and <1> ok", "a b c",
                                            ("word " + "long " * 50000).strip()]


def test_region_of_pages_without_marked_articles(spark):
    rnd = random.Random(2)
    rows, want = [], {}
    for k in range(40):  # one host, which holds all pages
        text = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(rnd.randint(5, 60))) for _ in range(rnd.randint(1, 6))]
        extra = f"<ul><li>{text[0][:20]}</ul>" if k % 3 == 0 else ""
        rows.append((k, "https://One.org/p", f"<div id=top><a href=/>Home</a> <a href=/b>About</a></div><div id=wrap><div id=c{k}>{''.join(f'<p>{t}</p>' for t in text)}{extra}</div></div>"
                     "<div id=bot>Same words on every page, long enough to be taken for text by themselves.</div>"))
        want[k] = " ".join(text + ([text[0][:20].strip()] if extra else []))
    assert extracted(spark, rows) == want
    wrappers = html_wrappers.infer_wrappers(spark.createDataFrame(rows, SHAPE), Scratch(spark)).collect()
    assert [(w["host"], w["pages"]) for w in wrappers] == [("one.org", 40)]
    import json
    assert expression(json.loads(wrappers[0]["wrapper"])) == "<div#top>#</><div#wrap><div#c>(<p>#</>)+(<ul><li>#</></>)?</></><div#bot>#</>"


def test_rounds_of_many_different_pages(spark):
    tags = ["p", "h2", "h3", "ul", "dl", "pre", "table", "blockquote", "figure", "section", "ol"]
    rnd = random.Random(4)
    rows, want = [], {}
    for k in range(400):  # more expressions of one host than are merged at a time
        parts = [(rnd.choice(tags), f"text {k} {i}") for i in range(rnd.randint(1, 9))]
        rows.append((k, "http://many.org", "<nav>no</nav><article>" + "".join(f"<{t}>{s}</{t}>" for t, s in parts) + "</article>"))
        want[k] = " ".join(s for _, s in parts)
    assert extracted(spark, rows) == want


def test_edges(spark):
    assert extracted(spark, []) == {}
    rows = [(None, None, "<p>a"), (None, None, "<p>a"), (1, "no host", "<p>b"), (2, "x://H.org", None)]
    got = sorted(((r["page_id"], r["url"], r["text"]) for r in html_wrappers.extract_articles(spark.createDataFrame(rows, SHAPE), Scratch(spark)).collect()), key=str)
    assert got == sorted([(None, None, "a"), (None, None, "a"), (1, "no host", "b"), (2, "x://H.org", "")], key=str)


def test_query_takes_the_article_of_every_page(spark):
    got = {r["page_id"]: r for r in QUERIES["op12_html_wrappers"](spark, SF).collect()}
    pages = table(spark, SF, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [entities.unescape(re.sub(r"</?b>", "", b)) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        want = " ".join(t for b in blocks if (t := " ".join(b.split())))
        assert (got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"]) == (want, len(want))
