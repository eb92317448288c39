import random
import time

from paperloom.llm import html_text


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header>
    <nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div><div id="cookie-notice">Cookies</div><article><header><h1>Head &amp; line</h1></header>
    <p><b>First<br>text.<p>Second <a href="x">link</a>&nbsp;text &lt;b&gt;</p><form><input>Mail<button>Go</button></form><p>x</p><aside>Side</aside>
    <section class="comments"><p>Reader</p></section></article><div class="sidebar"><p>More</p></div><footer>&copy;</footer></body></html>"""
    assert html_text.extract(page) == "Head & line\nFirst text.\nSecond link text <b>\nx"


def test_pages_without_article():
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
    page = f"<body><div><a>Home</a> <a>News</a></div><p>{words * 4}</p><p>{words * 3}</p><p>Short end.</p></body>"
    assert html_text.extract(page) == f"{(words * 4).strip()}\n{(words * 3).strip()}\nShort end."


def test_odd_pages():
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<p") == html_text.extract("<script>x") == ""
    assert html_text.extract("<article><p>a</p><p>b <i") == "a\nb"
    assert html_text.extract("<article><p title='a>b'>x &am") == "x &am"
    assert html_text.extract("<article><p>1 < 2 </b></p></article>") == "1 < 2"
    assert len(html_text.extract("<article>" + "<p>word</p>" * 50_000)) == 5 * 50_000 - 1
    assert isinstance(html_text.extract("<article>" + '<p x="' * 20_000), str)  # never a tag, and no quadratic time
    assert html_text.extract("<article>" + "<div>" * 20_000 + "x") == "x"


def test_tables(spark):
    df = spark.createDataFrame([(1, "u", "<article>é</article>", 9), (1, "u", "<article>é</article>", 9), (2, None, None, 9)], "page_id long, url string, html string, n_chars int")
    assert sorted(map(tuple, html_text.extracted(df).select("page_id", "text", "n_chars").collect())) == [(1, "é", 1), (1, "é", 1), (2, "", 0)]
    assert html_text.extracted(df.limit(0)).count() == 0


def plain_page(rnd):
    """A page of nothing but divs, and its main text: menu, headings with paragraphs, link lists under a short title, footer."""
    words = lambda n: " ".join(rnd.choice("alpha beta gamma delta rho sigma tau".split()) for _ in range(n))
    link = lambda n: f'<a href="/x">{words(n)}</a>'
    parts, main = [f"<div>{link(rnd.randint(1, 3))}</div>" for _ in range(rnd.randint(3, 9))], []
    for _ in range(rnd.randint(1, 4)):
        for n in [rnd.randint(3, 9), *(rnd.randint(15, 150) for _ in range(rnd.randint(2, 5)))]:
            text = words(n)
            main.append(text)
            parts.append(f"<div>{text if n < 15 or rnd.random() < 0.7 else text.replace(' ', f' {link(0)}', 1)}</div>")
    parts += [f"<div>{words(rnd.randint(1, 2))}</div>"] + [f"<div>{link(rnd.randint(2, 8))}</div>" for _ in range(rnd.randint(3, 8))]
    parts += [f"<div>{link(rnd.randint(1, 3))} {link(1)}</div>" for _ in range(2)]
    return f"<html><body>{''.join(parts)}</body></html>", main


def test_pages_without_helpful_tags():
    """Held-out accuracy by blocks: only words and link densities tell here."""
    rnd, hit, missed, wrong = random.Random(12), 0, 0, 0
    for _ in range(200):
        html, main = plain_page(rnd)
        got = html_text.extract(html).split("\n")
        hit += sum(x in got for x in main)
        missed += sum(x not in got for x in main)
        wrong += sum(x not in main for x in got)
    assert hit / (hit + missed) >= 0.97 and wrong / (hit + wrong) <= 0.03, (hit, missed, wrong)


def test_the_tree_uses_words_and_density():
    """In an article, in a form and in neither, words or link densities of the block or its neighbours are asked."""
    tree = html_text.tree()
    assert all(tree.judge(r[:-1]) == bool(r[-1]) for r in html_text.EXAMPLES)

    def asked(node, context):
        """Features of the nodes that a block of this context can come to."""
        if node.feature < 0:
            return set()
        name = html_text.FEATURES[node.feature]
        if name in context:
            return asked(node.low if context[name] <= node.threshold else node.high, context)
        return {name} | asked(node.low, context) | asked(node.high, context)

    for context in ({"in_article": 1, "has_article": 1, "in_form": 0}, {"in_article": 0, "has_article": 0, "in_form": 0}, {"in_article": 0, "has_article": 0, "in_form": 1}):
        assert asked(tree, context | {"aside": 0}) & {"words", "links"}, context
    assert {"links_before", "links_after", "words_before", "words_after"} & asked(tree, {"aside": 0})
    assert asked(tree, {"aside": 1}) == set()  # named parts are never text, as asked


def test_link_runs_in_main_parts_and_forms_around_pages():
    long = " ".join(["word"] * 60)
    menu = "".join(f"<li><a href='#'>Item {i}</a></li>" for i in range(5))
    assert html_text.extract(f"<main><ul>{menu}</ul><p>{long}</p><p>See <a>this</a></p></main>").startswith("Item 0\n") is False
    assert html_text.extract(f"<body><form><div>Search</div><p>{long}</p><p>{long}</p><button>Go</button></form></body>") == f"{long}\n{long}"


def test_text_of_drawings_and_formulas_stays():
    assert html_text.extract("<article><p>a <math><mi>x</mi></math> b</p><object>fallback</object><svg><text>label</text></svg></article>") == "a x b\nfallback\nlabel"


def test_many_unmatched_tags_take_linear_time():
    began = time.perf_counter()
    for html in ("<div>" * 20_000 + "</p>" * 20_000, "<b>" * 20_000 + "</i>" * 20_000, "<p>" + "<b>" * 20_000 + "<div></div>" * 20_000):
        html_text.extract(html)
    assert time.perf_counter() - began < 15


def test_a_name_drops_a_part_only_as_a_whole_word():
    text = " ".join(["word"] * 40)
    for name in ("layout with-sidebar", "post no-comments", "ad-free", "related-work", "has-sidebar", "no-ads", "adventure", "navy", "socially", "without-header"):
        for tag in ("div", "article", "section"):
            assert html_text.extract(f'<body><{tag} class="{name}"><p>{text}</p><p>{text}</p></{tag}></body>') == f"{text}\n{text}", (name, tag)
    for name in ("ad", "ad-slot", "Sidebar", "site-footer", "cookie_notice", "main-nav", "comments-area", "related-posts", "x comment-list y", "social-links", "post-comments", "ad ad-free"):
        assert html_text.extract(f'<body><article><p>{text}</p><div class="{name}"><p>{text} gone</p></div></article></body>') == text, name


def test_a_name_never_drops_the_article():
    text = " ".join(["word"] * 40)
    assert html_text.extract(f'<body><div class="banner"><article><p>{text}</p></article></div></body>') == text
    assert html_text.extract(f'<body><article class="widget"><p>{text}</p><div class="ad">x</div></article></body>') == text
    assert html_text.extract(f'<body><div id="header"><p>{text}</p><p>{text}</p></div><div class="ad">Buy</div><div>{text}</div></body>').startswith(f"{text}\n{text}")
    comments = "".join(f'<article class="comment"><p>{text} reader</p></article>' for _ in range(9))
    assert html_text.extract(f'<body><article><p>{text}</p></article><div id="comments">{comments}</div></body>') == text
    assert html_text.extract(f'<body><article><p>{text}</p><div class="sidebar"><article><p>{text} teaser</p></article></div></article></body>') == text
    assert html_text.extract(f'<body><nav class="x"><article>{text}</article></nav></body>') == ""


def test_a_run_of_links_goes_or_stays_as_one():
    text, menu = " ".join(["word"] * 40), [f"Item {i}" for i in range(6)]
    links = "".join(f'<li><a href="#">{x}</a></li>' for x in menu)
    for tag in ("article", "main"):
        assert html_text.extract(f"<{tag}><p>{text}</p><ul>{links}</ul><p>{text}</p></{tag}>") == "\n".join([text, *menu, text])
        assert html_text.extract(f"<{tag}><ul>{links}</ul><p>{text}</p></{tag}>") == text
        assert html_text.extract(f"<{tag}><p>{text}</p><ul>{links}</ul></{tag}>") == text
        assert html_text.extract(f'<{tag}><p>{text}</p><p><a href="#">one link</a></p></{tag}>') == f"{text}\none link"
    rnd = random.Random(3)
    for _ in range(300):  # whatever stands around it
        n = rnd.randint(1, 9)
        around = ["".join(f"<p>{'w ' * rnd.randint(1, 50)}</p>" for _ in range(rnd.randint(0, 3))) for _ in "ab"]
        run = "".join(f'<li><a href="#">run{i} {"x " * rnd.randint(0, 9)}</a></li>' for i in range(n))
        got = html_text.extract(f"<body><{(t := rnd.choice(['article', 'div', 'main', 'form']))}>{around[0]}<ul>{run}</ul>{around[1]}</{t}></body>")
        assert sum(f"run{i}" in got for i in range(n)) in (0, n)
