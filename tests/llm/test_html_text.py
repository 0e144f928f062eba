import math
import random
import re
import time

from veritally.llm.html_text import extract_text, main_text

PAGES = {
    "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><!-- ad --><div class='ad'>Buy this</div><article><h1>Head</h1><p>Fish &amp; chips,\n  <b>bold</b>ly&nbsp;said<br>next line.<p>Ok.</p></article><footer>&copy; x</footer>": "Head Fish & chips, boldly said next line. Ok.",
    "<header>Site</header><main><h1>T</h1><p>A paragraph that goes on for quite a while here.</p><aside>side</aside><form><p>Name</p><button>Go</button></form></main><div id='comments'><p>First!</p></div>": "T A paragraph that goes on for quite a while here.",
    "<div id='cookie-notice'>We use cookies</div><div class='post'><p>Hello <b>w</b>orld, this is a long text with many words.</p><p>Ok.</p></div><div class='comment-list'><p>nice</p></div>": "Hello world, this is a long text with many words. Ok.",
    "<article><p>Long enough text of the article itself, with words.</p><section class='comments'><article class='comment'><p>A comment that is nearly as long as the article's text.</p></article></section><div class='related'>More</div></article>": "Long enough text of the article itself, with words.",
    "<div id=siteHeader>Brand</div><article><p>All of the text of this article.</p><div class='AdvertBox'>Buy</div><ul class=commentsList><li>Hi</ul></article><div class='pageFooter'>x</div>": "All of the text of this article.",
    "plain text": "plain text",
    "": "",
    "<p>": "",
    "<script>x": "",
    "<nav>only a menu</nav>": "",
    "<article>a<div>b</div>c<p>d<ul><li>e<li>f</ul></article>": "a b c d e f",
}


def test_known_pages():
    for html, text in PAGES.items():
        assert main_text(html) == text, html


def test_random_articles():
    """Articles of a generator with all kinds of boilerplate around; short and long paragraphs are all kept."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    for _ in range(200):
        paragraphs = [" ".join(word() for _ in range(rng.choice([1, 3, 20, 120]))) for _ in range(rng.randint(1, 12))]
        html = "<body><nav>" + "".join(f"<a href='/{word()}'>{word()}</a>" for _ in range(6)) + f"</nav><div class='{rng.choice(['ad', 'sidebar widget', 'cookie-banner', 'share-buttons'])}'>{word()} {word()}</div><article>"
        html += "".join(f"<p>{p}{rng.choice(['</p>', '', '<br></p>'])}" for p in paragraphs) + f"</article><aside>{word()}</aside><footer>{word()}</footer></body>"
        assert main_text(html) == " ".join(paragraphs)


def test_query_edge_cases(spark, rows):
    long = "<article>" + "<p>word &lt;x&gt;</p>" * 30_000 + "</article>"
    df = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (3, "u", long, "t"), (4, "u", "<p>x</p>", "t"), (4, "u", "<p>x</p>", "t"), (None, "u", "y", "t")], "page_id long, url string, html string, text string")
    assert rows(extract_text(df), "page_id", "url", "n_chars") == [(1, "u", 0), (2, None, 0), (3, "u", 30_000 * 9 - 1), (4, "u", 1), (4, "u", 1), (None, "u", 1)]
    assert extract_text(df.limit(0)).count() == 0


#: Markup that nothing closes, unknown sections, references of absurd length; with what stands before and after it.
BROKEN = {
    "<![foo[bar]]>": "one two",
    "<![ [": "one",
    "<![%[]": "one",
    "<![CDATA[x]]>": "one two",
    "<![CDATA[x": "one",
    "<![if !IE]>": "one two",
    "<!-- x": "one",
    "<!-->": "one two",
    "<?php echo 1": "one",
    "<!doctype x": "one",
    "<i x=x=": "one",
    '<i x="1"y=2 / z>': "one two",
    "</i x": "one",
    "<": "one < two",
    "&#" + "9" * 5000 + ";": "one � two",
    "&#" + "0" * 5000 + "65;": "one A two",
}


def test_broken_markup_is_neither_text_nor_an_error():
    for markup, text in BROKEN.items():
        tail = markup if text == "one" else markup + " two</p></article>"
        assert main_text("<article><p>one " + tail) == text, markup
        main_text(markup)


def test_time_is_linear_in_the_page():
    """Each of these was quadratic in some parser; megabytes of them take seconds at most."""
    for unit in ("<b>x", "</q>", "<![CDATA[ >", "<!--x>", "<?", "<a <a ", "<a x='", '<a x=">', "<b><hr>", "<p><b>", "</", "<b></i>"):
        start = time.monotonic()
        main_text("<div>" + unit * (1_000_000 // len(unit)))
        assert time.monotonic() - start < 8, unit
    start = time.monotonic()
    main_text("<div>" + "<b>" * 200_000 + "<hr>" * 200_000 + "</z>" * 200_000)
    assert time.monotonic() - start < 8


def plain(lines):
    """Ratio, smoothing, threshold and choice by the definitions, for (region, tags, text, prose) without articles or names."""
    ratio = [len(t) / n for _, n, t, _ in lines]
    weight = lambda d: math.exp(-d * d / 2) if abs(d) <= 3 else 0.0
    level = [sum(weight(i - j) * r for j, r in enumerate(ratio)) / sum(weight(i - j) for j in range(len(ratio))) for i in range(len(ratio))]
    low, high = min(level), max(level)
    cut = (low + high) / 2
    while True:
        a, b = [x for x in level if x <= cut], [x for x in level if x > cut]
        if not b:
            break
        if (sum(a) / len(a), sum(b) / len(b)) == (low, high):
            break
        low, high = sum(a) / len(a), sum(b) / len(b)
        cut = (low + high) / 2
    above = {}
    for i, (region, *_) in enumerate(lines):
        if level[i] > cut:
            above.setdefault(region, []).append(i)
    if not above:
        size = {r: sum(len(t) for x, _, t, _ in lines if x == r) for r, *_ in lines}
        above = {max(size, key=lambda r: (size[r], -r)): [0, len(lines)]}
    return " ".join(t for i, (region, _, t, prose) in enumerate(lines) if region in above and (prose or above[region][0] <= i <= above[region][-1]))


def test_neutral_names_against_a_plain_second_version():
    """No name or element tells what a container is; only ratios do. Menus are short bare lines, articles paragraphs."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    dropped = 0
    for _ in range(200):
        html, lines = "<body>", []
        for c in range(rng.randint(1, 5)):
            html += f"<div class=c{c}>"
            for i in range(rng.randint(1, 6)):
                long = rng.random() < 0.5
                text = " ".join(word() for _ in range(rng.randint(30, 80) if long else rng.randint(1, 3)))
                prose = long or rng.random() < 0.3
                html += f"<p>{text}</p>" if prose else f"<dl>{text}</dl>"
                lines.append((c, text, prose))
            html += "</div>"
        # a line's tags: those since the line before, with the one that ends it
        count, at = [], 0
        for before, tag in re.findall(r"([^<]*)(<[^>]*>)", html):
            at += 1
            if before:
                count.append(at)
                at = 0
        want = plain([(c, n, t, p) for (c, t, p), n in zip(lines, count, strict=True)])
        assert main_text(html) == want
        dropped += len(want) < len(" ".join(t for _, t, _ in lines))
    assert dropped > 50


def test_a_menu_and_a_footer_in_the_articles_own_container():
    article = "".join(f"<p>{'Words of the article go on and on here. ' * 5}</p>" for _ in range(4))
    page = f"<div class=c1><dl>Home</dl><dl>News</dl><dl>Sport</dl><dl>Contact</dl><h1>Title</h1>{article}<p>By me</p><dl>Imprint</dl><dl>Legal</dl><dl>Top</dl></div>"
    assert main_text(page) == "Title " + " ".join(["Words of the article go on and on here. " * 5] * 4).replace("  ", " ").strip() + " By me"


PROSE = [f"Paragraph {i} of the article goes on with words and more words, as prose does." for i in range(5)]
BODY = "<h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in PROSE)
WHOLE = " ".join(["Title", *PROSE])

#: Wrappers, as blog software writes them, whose names hold words of boilerplate; {} is the article.
WRAPPERS = [
    '<div id="page" class="layout has-sidebar"><article>{}</article></div>',
    '<div class="content no-sidebar">{}</div>',
    '<article class="post has-ad comments-open">{}</article>',
    '<main><div class="article-body related-content">{}</div></main>',
    '<div id="wrap" class="sidebar-right"><div id="content">{}</div><div id="sidebar"><p>About me, at length enough.</p></div></div>',
    '<form id="aspnetForm"><div class="main">{}</div></form>',
    '<div class="comments-open with-comments"><main>{}</main></div>',
    '<div class="page-with-banner search-enabled">{}</div>',
    '<section class="notice-board">{}</section>',
    '<div class="newsletter">{}</div>',
    '<div class="widget-area"><div class="social side">{}</div></div>',
]


def test_wrappers_with_telling_names_hold_the_article():
    for wrapper in WRAPPERS:
        around = "<nav><a href=x>Home</a></nav>" + wrapper.format(BODY) + "<footer>End</footer><div class='cookie-banner'>We use cookies</div>"
        assert main_text(around) == WHOLE, wrapper


def test_parts_of_an_article_with_ambiguous_names():
    article = '<article><div class="post-header"><h1 class="page-header">Title</h1><p class="lead">The lead.</p></div>' + "".join(f"<p>{p}</p>" for p in PROSE) + '<p class="side-note">A note.</p><section class="notice-board"><p>On the board.</p></section><p>So <math><mi>x</mi><mo>+</mo><mn>1</mn></math> it is.</p>{}</article>'
    want = " ".join(["Title", "The lead.", *PROSE, "A note.", "On the board.", "So x+1 it is."])
    for extra in ("", '<div class="ad">Buy</div>', '<div class="share-buttons">Share</div>', '<div class="related-posts">More</div>', '<form><p>Mail</p></form>', '<div id="comments"><p>First!</p><p>Second.</p></div>'):
        assert main_text(article.format(extra)) == want, extra
    assert main_text("<main>" + article.format("").replace("article>", "div>") + "</main>") == want
    assert main_text('<main><header><h1 class="page-header">Title</h1></header>' + BODY[14:] + "</main>") == WHOLE


def test_comments_go_even_where_they_are_most_of_the_text():
    talk = "".join(f"<article class=comment><p>{p}</p></article>" for p in PROSE * 4)
    assert main_text(f"<div class=post>{BODY}</div><section class=comments>{talk}</section>") == WHOLE
    assert main_text(f"<article>{BODY}<ol class=comment-list>{talk}</ol></article>") == WHOLE


def test_random_wrappers():
    rng = random.Random(9)
    names = ["layout", "has-sidebar", "no-ads", "with-comments", "content", "comments-open", "is-promo", "page", "entry", "single-post", "sidebar-left", "col-8", "supports-popup", "not-sponsored"]
    for _ in range(200):
        html = f"<h1>Title</h1>{BODY[14:]}"
        for _ in range(rng.randint(1, 4)):
            html = f"<{(t := rng.choice(['div', 'section', 'article']))} class='{' '.join(rng.sample(names, rng.randint(1, 3)))}'>{html}</{t}>"
        around = ["<div class='ad'>Buy now</div>", "<nav><a>Menu</a></nav>", "<div id='sidebar'><p>Archive of things</p></div>", "<div class='cookie-notice'><p>We use cookies</p></div>"]
        rng.shuffle(around)
        assert main_text("<body>" + around[0] + around[1] + html + around[2] + around[3] + "</body>") == WHOLE, html


def test_invalid_utf8(spark):
    from pyspark.sql import functions as F

    df = spark.range(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.expr("cast(unhex('3C703E61FF623C2F703E') as string)").alias("html"))
    assert extract_text(df).first().text == "a�b"
