import random
from collections import Counter
from html.parser import HTMLParser

from tideline.llm.common import Scratch
from tideline.llm.html_extract import extract, host_paths, html_extract, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header class="masthead"><p>Site</p></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<div class="wrap"><{box}><h1>{title}</h1><p>First &amp; <b>bold <p>Second<br>line &lt;3&nbsp;x<div class="ad">Buy</div><form><p>Sign up</p></form><ul><li>one<li>two</ul>
<blockquote>{body}</blockquote><!-- <p>hidden</p> --></{end}></div><aside>Side</aside><section id="comments"><p>First comment that is rather long, and says little, and goes on and on</p></section><footer>&copy; x</footer></body></html>"""


def page(box="article", end="article", title="Title", body="Long text " * 20):
    return PAGE.format(box=box, end=end, title=title, body=body)


def expected(title="Title", body="Long text " * 20):
    return "\n\n".join([title, "First & bold", "Second line <3 x", "one", "two", body.strip()])


def test_article_without_the_rest():
    assert extract(page())[0] == expected()
    assert extract(page('div class="post-content p12"', "div"))[0] == expected()


def test_host_consensus_decides_for_a_short_page(spark):
    box = 'div class="c c7"'
    rows = [(k, f"http://h.example/{k}", page(box, "div", f"T{k}")) for k in range(5)]
    short = f'<body><div class="wrap"><{box}><h1>Tiny</h1></div></div><div class="promoted x"><p>{"Something else entirely. " * 9}</p></div></body>'
    rows += [(9, "http://h.example/9", short), (10, None, page()), (11, "nonsense", None), (12, "http://h.example/9", ""), (None, "http://h.example/3", page(box, "div"))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string")
    got = {r.page_id: r for r in html_extract(df).collect()}
    assert got[9].text == "Tiny" and got[10].text == expected() and got[11].text == "" == got[12].text
    assert all(got[k].text == expected(f"T{k}") for k in range(5)) and all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract(df.limit(0)).count() == 0


def test_testdata_pages_give_their_articles(spark, small):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{small}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_layout_names_and_forms_around_the_article_are_no_junk():
    text = "Long text of the story. " * 20
    for box in ("content with-sidebar", "no-sidebar", "comments-open", "article-share-wrap", "related-story", "sidebar-grid"):
        assert extract(f'<body><div class="{box}"><div class="inner"><p>{text}</p></div></div><div class="sidebar"><p>Aside</p></div></body>')[0] == text.strip()
    assert extract(f'<body><form action="/x"><div class="inner"><p>{text}</p></div></form></body>')[0] == text.strip()
    assert extract(f'<body><div class="inner"><p>{text}</p></div><form><p>Sign up</p></form><div class="sidebar-left"><p>Aside</p></div></body>')[0] == text.strip()
    assert "Reply" not in extract(f'<body><div class="inner"><p>{text}</p></div><div class="comments"><p>{"Reply " * 200}</p></div></body>')[0]


def test_the_winner_that_scores_best_on_the_page():
    text = "Long text of the story. " * 20
    html = f'<body><div class="teaser"><p>Read more</p></div><div class="story"><p>{text}</p></div></body>'
    assert extract(html, [">body>div.teaser", ">body>div.story"]) == (text.strip(), ">body>div.story")


def test_prose_inside_the_article_stays_whatever_its_name():
    body = "".join(f'<p class="{c}" id="{i}">Paragraph {k} of the story.</p>' for k, (c, i) in enumerate([("related-work", ""), ("", "comment-on-law"), ("notice", "reply-to-critics"), ("share", "ad"), ("promo", "subscribe")]))
    got = extract(f'<body><nav><a href="/">Home</a></nav><article><h2 class="banner">Head</h2>{body}<div class="ad">Buy</div></article><footer>x</footer></body>')[0]
    assert got == "\n\n".join(["Head", *(f"Paragraph {k} of the story." for k in range(5))])


def test_deep_and_broken_pages_take_time_in_proportion():
    import time

    began = time.process_time()
    for html in ("<div>" * 16_000 + "deep", "<span>" * 16_000 + "<p>x</p>" * 16_000, "<div class='a b'><b>" * 8_000 + "</i></b>" * 8_000 + "end", "<p>" + "<i>" * 16_000 + "<p>y" * 8_000, "<ul>" + "<li>z" * 16_000):
        assert extract(html)[0].replace("\n\n", "").strip("xyz") in ("deep", "end", "")
    assert time.process_time() - began < 5


def text_of(html):
    page = parse(html)
    return "".join(data for _, _, data, _ in page.runs)


def test_quotes_that_open_no_value():
    assert extract("<p>He said <i title=it's>yes</i> and it was fine.</p><p>It's done.</p>")[0] == "He said yes and it was fine.\n\nIt's done."
    assert extract('<div class="a"">First words stay here.</div>')[0] == "First words stay here."
    for tag in ("<i a='>x</i>", '<i a=">x</i>', "<i a=b'c\"d>x</i>", "<i 'a' \"b\">x</i>", "<i a = \"1>2\" b='>'>x</i>", "<i a=>x</i>", "<i =a>x</i>", "<i a/b=/c/>x</i>", "<i a=1/>x</i>", "<i\na\n=\n'b'\n>x</i>"):
        assert extract(f"<p>before {tag} after</p>")[0] == "before x after", tag
    assert extract("<p>one <i a='b>two</i> three</p><p c='d'>four</p>")[0] == "one four"  # the value runs to the next quote, as in a browser
    assert extract("<p>a < b and c <d")[0] == "a < b and c <d" and extract("<p>x</p><!-- open <p>y</p> z")[0] == "x" and extract("<p>x<![CDATA[y<z]]></p>")[0] == "xy<z"


def test_tokens_match_the_standard_parser():
    """Random tags with quoted, unquoted and stray quotes, closed: the text between them is what the standard parser gives."""
    rng = random.Random(11)
    values = ["", "=x", "='x y'", '="x y"', "=it's", '=a"b', "='a>b'", '="c>d"', " = 'e'", '=f"', "=/g/"]
    for _ in range(300):
        parts, words = [], []
        for k in range(rng.randrange(1, 12)):
            attributes = "".join(f" a{j}{rng.choice(values)}" for j in range(rng.randrange(4)))
            tag = rng.choice(["i", "b", "span", "u"])
            words.append(f"w{k} ")
            parts.append(f"<{tag}{attributes}{rng.choice(['', ' '])}>w{k} {rng.choice(['</' + tag + '>', ''])}")
        found = []
        standard = HTMLParser()
        standard.handle_data = found.append
        standard.feed("".join(parts))
        standard.close()
        assert text_of("".join(parts)) == "".join(words) == "".join(found), parts


def test_votes_match_brute_force(spark):
    """Winners of each host against a plain count, with tied votes, single votes, shares below the bound and a hot host."""
    body = lambda box: f'<body><div class="{box}"><p>{"Words of the story. " * 9}</p></div></body>'
    boxes = {"hot.example": ["a"] * 40 + ["b"] * 40 + ["c"] * 5 + [f"x{chr(97 + k)}" for k in range(20)], "tie.example": ["d", "e"], "one.example": ["f"], "few.example": ["g", "g", "h"]}
    rows = [(None, f"http://{host}/{k}", body(box), "n") for host, names in boxes.items() for k, box in enumerate(names)]
    df = spark.createDataFrame([*rows, (1, None, body("z"), "n"), (2, "http://none.example/", None, "n")], "page_id long, url string, html string, host string")
    want = {}
    for host, names in boxes.items():
        counts = Counter(names)
        won = [(-n, f">body>div.{b}") for b, n in counts.items() if 10 * n >= len(names) and (n > 1 or max(counts.values()) == 1)]
        want[host] = [path for _, path in sorted(won)]
    got = {r.host: r.paths for r in host_paths(df, Scratch(spark, "votes")).collect()}
    assert got == want
    assert sorted(map(tuple, html_extract(df, broadcast_hosts=0).collect()), key=str) == sorted(map(tuple, html_extract(df).collect()), key=str)
