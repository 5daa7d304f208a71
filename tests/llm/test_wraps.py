"""Main text by wrappers; pages whose main text stands inside a form or an element with a furniture word."""

import random

from pointloom.llm.html_extract import Fold, Wrapper, align, extract, extract_main_text, infer, stream, tokens

ARTICLE = "<article><h1>T</h1><p>a b</p><div class=share>s</div></article>"


def test_furniture_words_around_the_article():
    menu = "<nav>m</nav><div>top</div>"
    assert extract(f"<body>{menu}<div class='content-sidebar-wrap'>{ARTICLE}</div><footer>f</footer></body>") == "T a b"
    assert extract(f"<body><form action=x>{menu}{ARTICLE}</form></body>") == "T a b"
    assert extract("<body><form><nav>m</nav><p>a</p><p>b</p></form></body>") == "a b"


def test_furniture_beside_the_article_stays_out():
    page = f"<body>{ARTICLE}<form><main>login</main></form><div class=related><article>r</article></div></body>"
    assert extract(page) == "T a b"


def plain(k: int, rng: random.Random) -> tuple[str, str]:
    """A page without article or main tags, and its main text."""
    words = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    title, parts = words(4), [words(12) for _ in range(1 + k % 4)]
    sub = f"<h3>{words(3)}</h3>" if k % 3 == 0 else ""
    body = "".join(f"<p>{p}</p>" for p in parts)
    top = "<div><b>The Daily Page</b><div>All rights are ours</div></div>"
    page = f"<html><body>{top}<div><h2>{title}</h2>{sub}{body}</div><div><span>Call 555</span></div></body></html>"
    return page, " ".join([title, *([sub[4:-5]] if sub else []), *parts])


def test_constants_of_the_template_go_by_the_wrapper():
    rng = random.Random(4)
    pages = [plain(k, rng) for k in range(12)]
    wrapper = infer([p for p, _ in pages[:6]])
    for page, text in pages:
        assert extract(page, wrapper) == text
        assert extract(page) == f"The Daily Page All rights are ours {text} Call 555"
    assert "( <p> #slot </p> )+" in str(wrapper) and "( <h3> #slot </h3> )?" in str(wrapper) and "'Call 555'" in str(wrapper)
    assert Wrapper.load(wrapper.dump()).match(list(tokens(pages[7][0]))) == wrapper.match(list(tokens(pages[7][0])))


def test_another_template_of_the_host_is_read_by_itself():
    rng = random.Random(5)
    wrapper = infer([plain(k, rng)[0] for k in range(6)])
    other = "<body><ul><li>x</li></ul><table><tr><td>y</td></tr></table><article><p>z</p></article></body>"
    assert extract(other, wrapper) == "z"


def test_long_pages_are_aligned_whole():
    rng = random.Random(6)
    middle = ["<p>{}</p><i>{}</i>".format(k, k) * (1 + k % 2) + f"<b id=x{k}>c</b>" for k in range(3000)]
    a = [x.key for x in stream(list(tokens("".join(middle))))]
    b = [k for k in a if rng.random() > 0.05]
    assert len(align(a, b)) > 0.9 * len(b)
    text = "<article><p>" + "</p><p>".join(f"w{k}" for k in range(50_000)) + "</p></article>"
    assert extract(text, infer([plain(k, rng)[0] for k in range(4)])).split() == [f"w{k}" for k in range(50_000)]


def test_wrappers_by_host(spark):
    rng = random.Random(7)
    pages = [plain(k, rng) for k in range(20)]
    rows = spark.createDataFrame([(k, f"http://h{k % 2}.example/{k}", p) for k, (p, _) in enumerate(pages)], "page_id long, url string, html string")
    for options in ({}, {"fan": 2}, {"fan": 3, "held": 60}):
        got = {r.page_id: r.text for r in extract_main_text(rows.repartition(7), **options).collect()}
        assert got == {k: t for k, (_, t) in enumerate(pages)}


def folded(pages: list[str], tasks: int = 1, **options) -> Fold:
    """Pages dealt to tasks, their folds written, read and folded."""
    parts = []
    for k in range(tasks):
        fold, *rest = [Fold.of(p, **options) for p in pages[k::tasks]]
        for other in rest:
            fold.merge(other)
        parts.append(Fold.load(fold.dump()))
    for other in parts[1:]:
        parts[0].merge(other)
    return parts[0]


def test_a_template_that_comes_late_is_in_the_wrapper():
    rng = random.Random(8)
    early = [plain(k, rng) for k in range(300)]
    late = lambda k: f"<body><table><tr><td>Second look</td></tr></table><section><h4>{k} a</h4><p>{k} b c d</p></section><dl><dt>Write to us</dt></dl></body>"
    pages = [p for p, _ in early] + [late(k) for k in range(60)]
    for tasks in (1, 7):
        wrapper = folded(pages, tasks).wrapper()
        for page, text in early:
            assert extract(page, wrapper) == text
        for k in range(60):
            assert extract(late(k), wrapper) == f"{k} a {k} b c d"


def test_folds_stay_bounded():
    rng = random.Random(9)
    odd = lambda k: "".join(f"<i id=x{rng.randrange(10**9)}>{k}</i>" for _ in range(5))
    pages = [(plain(k, rng), odd(k)) for k in range(1500)]
    for tasks in (1, 5):
        fold = folded([p.replace("</h2>", f"</h2>{o}") for (p, _), o in pages], tasks, rare=0.05)
        assert fold.n == 1500 and len(fold.nodes) < 40 + 15 * 20 * 4
        assert {"div", "h2", "/h2"} <= {x.key for x in fold.nodes if x.pages >= 1400}
        assert extract(pages[0][0][0], fold.wrapper()) == pages[0][0][1]


def test_copies_make_no_constants():
    rng = random.Random(10)
    (page, text), others = plain(0, rng), [plain(k, rng) for k in range(2)]
    wrapper = folded([page] * 500 + [p for p, _ in others], 3).wrapper()
    assert text in extract(page, wrapper)
    assert folded([page] * 500, 3).wrapper() is None
