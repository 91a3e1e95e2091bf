import pytest

from threatlake.llm.html_density import extract_main_text, main_text

ARTICLE = "<h1>Title of it</h1><p>First paragraph, with some length to it.</p><p>Second &amp; <b>bold</b>er\n  one.</p>"
WANT = "Title of it First paragraph, with some length to it. Second & bolder one."


@pytest.mark.parametrize("page", [
    f"<html><head><title>t</title></head><body><nav><a href=1>Home</a></nav><article>{ARTICLE}</article><footer>&copy; x</footer></body></html>",
    f"<body><div class='ad'>Buy this now, it is a really long advert text for its own good.</div><main>{ARTICLE}</main></body>",
    f"<body><header>Site name</header><div><div>{ARTICLE}</div></div><aside>More of this and that</aside></body>",
    f"<body><article>{ARTICLE}<section class='comments'><p>A reader says a lot about all of this, at length.</p></section></article></body>",
    f"<body><div id='cookie-notice'>We use them.</div><article>{ARTICLE}<form>Name <input name=n></form></article></body>",
    f"<body><script>if (a<b) document.write('</p>')</script><style>p{{}}</style><!-- <p>no</p> --><article>{ARTICLE}</article>",
    f"<body><article>{ARTICLE}<!-- unclosed comment <p>gone</p>",
    f"<body><nav hidden><ul><li><a href=x>one<li><a href=y>two</ul></nav><article>{ARTICLE}</article><script>never closed",
])
def test_article_is_found(page):
    assert main_text(page) == WANT


TEXT = ARTICLE.replace("h1", "h2")


@pytest.mark.parametrize("page", [
    *[f"<body><nav><a href=1>Home</a></nav><div {name}>{TEXT}</div><div class='sidebar'>Other <a href=x>things</a></div></body>" for name in (
        "class='content no-sidebar'", "class='has-sidebar'", "class='with-banner'", "class='post-share'", "class='entry related-layout'", "id='page-widget'",
        "class='widget'",
    )],
    f"<body><div class='layout sidebar'><article>{TEXT}</article></div><div class='comments'><article class='comment'>{'A reader says this. ' * 20}</article></div></body>",
])
def test_class_words_alone_take_no_article_out(page):
    assert WANT in main_text(page)
    assert "Other" not in main_text(page)


def test_sections_and_headings_outside_an_article_element():
    page = (
        "<body><div><a href=1>Home</a> <a href=2>News</a></div><div class=wrap><h1>Head</h1><div><div><p>One long paragraph that goes on.</p>"
        "<p>Two, with a <a href=x>link</a> and more text after it.</p></div><div><p>Three in a section of its own, long too.</p></div></div></div></body>"
    )
    assert main_text(page) == "Head One long paragraph that goes on. Two, with a link and more text after it. Three in a section of its own, long too."


def test_blocks_inline_and_white_space():
    assert main_text("<article><p>a<b>b</b>c\n\t d<br>e<p>f&nbsp;g<ul><li>h<li>i</ul></article>") == "abc d e f g h i"


@pytest.mark.parametrize("page", [None, "", "   ", "<p>", "<", "<!--", "<nav>x</nav>", "<script>", "</div></p>"])
def test_pages_without_text(page):
    assert main_text(page) in ("", "<")


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "x y" + "</div>" * 10) == "x y"
    assert len(main_text("<article>" + "<p>word word</p>" * 30000)) == 30000 * 10 - 1


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "clash", 0), (1, "u", None, None, None), (None, None, "é", "", 1)]
    got = {tuple(r) for r in extract_main_text(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, "u", WANT, len(WANT)), (1, "u", "", 0), (None, None, "é", 1)}
    assert extract_main_text(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("page", [
    f"<body><form id=aspnetForm><input type=hidden><nav><a href=1>Home</a></nav><article>{ARTICLE}</article><label>Search</label><input></form></body>",
    f"<body><form method=post><div><div>{ARTICLE}</div></div><select><option>one<option>two</select><button>Go</button></form></body>",
    f"<body><noscript><div>{ARTICLE}</div></noscript><script>app()</script></body>",
    f"<body><div>{ARTICLE}</div><form><p>Leave your mail for news</p><input></form><noscript>Turn on scripts</noscript></body>",
])
def test_forms_hold_pages_and_pages_hold_forms(page):
    assert main_text(page) == WANT


def test_end_tags_without_starts_take_linear_time():
    import time

    took = []
    for n in (4000, 16000):
        began = time.process_time()
        main_text("<div>" * n + "</i>" * n + f"<article>{ARTICLE}</article>")
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.2


class Plain:
    """Text density once more, by recursion over the tree of the standard library's parser, for pages without parts to take out."""

    def __init__(self, page):
        from html.parser import HTMLParser

        root = stack = None

        class Reader(HTMLParser):
            def handle_starttag(self, tag, attrs):
                if tag != "body":
                    stack.append((tag, []))
                    stack[-2][1].append(stack[-1])

            def handle_endtag(self, tag):
                if tag != "body":
                    stack.pop()

            def handle_data(self, data):
                stack[-1][1].append(data)

        root = ("body", [])
        stack = [root]
        Reader().feed(page)
        self.root = root
        self.body = self.counts(root)

    def counts(self, node):
        chars = tags = link_chars = link_tags = 0
        for c in node[1]:
            if isinstance(c, str):
                chars += len(" ".join(c.split()))
            else:
                a, b, d, e = self.counts(c)
                chars, tags, link_chars, link_tags = chars + a, tags + b + 1, link_chars + d, link_tags + e + (c[0] == "a")
        return (chars, tags, chars, link_tags) if node[0] == "a" else (chars, tags, link_chars, link_tags)

    def density(self, node):
        import math

        c, t, lc, lt = self.counts(node)
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + self.body[2] / max(1, self.body[0]) * c + math.e)
        value = c / max(1, t) * math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt)))
        return value / (math.log(base) if base > 1 + 1e-9 else 1.0)

    def total(self, node):
        own = [self.density(c) for c in node[1] if not isinstance(c, str) and c[0] in ("div", "p")]
        return sum(own) if own else self.density(node)

    def text(self):
        nodes = []

        def walk(node, path):
            if node[0] in ("div", "p", "body"):
                nodes.append((node, path))
            for c in node[1]:
                if not isinstance(c, str):
                    walk(c, [*path, node])

        walk(self.root, [])
        best, path = max(nodes, key=lambda x: self.total(x[0]))
        threshold = min(self.density(n) for n in [best, *path])
        chosen = set()
        for node, _ in nodes:
            if self.counts(node)[0] and self.density(node) >= threshold:
                below = [n for n, p in nodes if n is node or any(x is node for x in p)]
                chosen.add(id(max(below, key=lambda n: self.total(n))))
        out = []

        def say(node, inside):
            inside = inside or id(node) in chosen
            out.append("\0" if node[0] != "a" else "")
            for c in node[1]:
                if isinstance(c, str):
                    out.append(c if inside else "")
                else:
                    say(c, inside)
            out.append("\0" if node[0] != "a" else "")

        say(self.root, False)
        return " ".join(x for x in (" ".join(b.split()) for b in "".join(out).split("\0")) if x)


@pytest.mark.parametrize("seed", range(60))
def test_equals_a_second_implementation(seed):
    import random

    r = random.Random(seed)

    def words(n):
        return " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 9))) for _ in range(n))

    def block(depth):
        if depth == 0 or r.random() < 0.3:
            links = "".join(f"<a href=x>{words(r.randint(1, 4))}</a> " for _ in range(r.choice([0, 0, 0, 1, 5])))
            return f"<p>{words(r.randint(1, 60))} {links}</p>"
        return "<div>" + "".join(block(depth - 1) for _ in range(r.randint(1, 4))) + "</div>"

    page = "<body>" + "".join(block(3) for _ in range(4)) + "</body>"
    assert main_text(page) == Plain(page).text()
