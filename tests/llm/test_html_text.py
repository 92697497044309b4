import random
import re
import tracemalloc
from html.parser import HTMLParser

import pytest

from tagframe.llm import html_text

BODY = "This is a sentence, with commas. It goes on for a while; then it ends."


def page(article, extra=""):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script><style>p{{}}</style></head><body><nav><ul><li><a href=/a>A</a></ul></nav>{extra}<article>{article}</article><footer>&copy; x</footer></body></html>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (page(f"<h1>Head</h1><p>{BODY}</p><p>Two\n  lines</p>"), f"Head\n{BODY}\nTwo lines"),
        (page(f"<p><b>{BODY}<br><p>Short.</p>"), f"{BODY}\nShort."),
        (page(f"<p>{BODY} a &lt;b&gt; &amp; &#65;&eacute;</p>"), f"{BODY} a <b> & Aé"),
        (page(f"<p>{BODY}</p>", "<div class='sidebar-left'><p>Side, side. More side text here, really.</p></div><div id=cookie-notice>We use cookies.</div>"), BODY),
        (page(f"<p>{BODY}</p><form><p>Mail, please.</p></form><div class=ad>Buy!</div>", "<header><h1>Site</h1></header>"), BODY),
        (page(f"<p>{BODY}</p>").replace("<footer>", "<section class='comments'><p>I agree, I agree. Nice one, thanks!</p></section><footer>"), BODY),
        (page(f"<p>{BODY}</p><!-- no <p>x</p> --><ul><li>a<li>b</ul>"), f"{BODY}\na\nb"),
        (page(f"<p>{BODY}</p>")[:-30], BODY),
        (page(f"<p>one <em>two</em><a href='x>y'>three</a> {BODY}</p>"), f"one twothree {BODY}"),
        (page(f"<p>{BODY}</p><div class='ad2'>Buy, buy now.</div>"), BODY),
        (page(f"<p>{BODY}</p>").replace("<article>", "<div class='sidebar-left main'><article>"), BODY),
        (page(f"<p>{BODY}</p>").replace("<body>", "<body><div class='page has-sidebar'>"), BODY),
        (page(f"<p>{BODY}</p>", "<aside><article><p>Other, other. More of it, here.</p></article></aside><div class=related><article><p>Third, third.</p></article></div>"), BODY),
        ("<div class=ad>Buy, buy now.</div>", ""),
        ("", ""),
        (None, ""),
        ("plain text", "plain text"),
        ("<p>", ""),
        ("<!-- open", ""),
        ("<script>x", ""),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html)[0] == text


def test_ratios_choose_the_article_without_semantic_tags():
    menu = "".join(f"<div><span>Item {i}</span></div>" for i in range(30))
    html = f"<body><div><div>{menu}</div><div><p>{BODY}</p><p>{BODY}</p><p>Yes.</p></div></div></body>"
    assert html_text.main_text(html)[0] == f"{BODY}\n{BODY}\nYes."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (page(f"<h1>Head</h1><div class=body><p>{BODY}</p><p>{BODY}</p><p>{BODY}</p><p>{BODY}</p><p>{BODY}</p><p>{BODY}</p></div><div class=more><p>{BODY}</p></div>"), "\n".join(["Head", *[BODY] * 7])),
        (page(f"<h1>Head</h1><p>Intro, here.</p><ul>{f'<li>{BODY}' * 6}</ul>"), "\n".join(["Head", "Intro, here.", *[BODY] * 6])),
        (f"<body><div><h1>Head</h1><p>Intro, here.</p><table>{f'<tr><td>{BODY}' * 6}</table></div></body>", "\n".join(["Head", "Intro, here.", *[BODY] * 6])),
        (f"<body><div><div>{f'<p>{BODY}' * 6}</div></div><div><h2>More</h2><p>{BODY}</p></div></body>", "\n".join([*[BODY] * 6, "More", BODY])),
        (f"<body><main><article>{f'<p>{BODY}' * 6}</article><article><h2>More</h2><p>{BODY}</p></article></main></body>", "\n".join([*[BODY] * 6, "More", BODY])),
        (page(f"<p>{BODY}</p><form><p>Mail, please.</p></form>").replace("<body>", "<body><form id=aspnet>").replace("</body>", "</form></body>"), BODY),
        (f"<body><form><div><p>{BODY}</p><p>{BODY}</p></div></form><div>Short</div></body>", f"{BODY}\n{BODY}"),
    ],
)
def test_all_content_of_nested_layouts(html, text):
    assert html_text.main_text(html)[0] == text


def test_frames(spark):
    rows = [(1, "u", page(f"<p>{BODY}</p>"), 5), (1, "u", None, 5), (2, None, "<p>" + "word, " * 50_000, 5)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")
    got = html_text.extracted(df).orderBy("n_chars").collect()
    assert [r.n_chars for r in got] == [0, len(BODY), 6 * 50_000 - 1]
    assert html_text.extracted(df.limit(0)).count() == 0


class Tree(HTMLParser):
    """A plain reading of well-formed pages: (full path as text, text, marked by class) of each p, li or div text."""

    def __init__(self, source):
        super().__init__()
        self.open, self.blocks = [], []
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        name = re.sub(r"\d+", "", dict(attrs).get("class") or "") if tag == "div" else ""
        self.open.append((f"{tag}.{name}", name in ("ad", "sidebar")))

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        if data.strip():
            self.blocks.append(("/".join(x for x, _ in self.open), " ".join(data.split()), any(y for _, y in self.open)))


def content_by_brute_force(source):
    """Texts of the blocks whose paths' smoothed and fused ratios reach the threshold, straight from the definition."""
    blocks = Tree(source).blocks
    same = {p: [t for q, t, _ in blocks if q == p] for p, _, _ in blocks}
    dots = lambda t: sum(t.count(c) for c in ".,;:!?")
    length = [sum(map(len, same[p])) / len(same[p]) for p, _, _ in blocks]
    marks = [1 + sum(map(dots, same[p])) / len(same[p]) for p, _, _ in blocks]
    near = lambda x, k: 0.25 * x[max(0, k - 1)] + 0.5 * x[k] + 0.25 * x[min(len(x) - 1, k + 1)]
    value, mass = {}, {}
    for p in same:
        at = [k for k, b in enumerate(blocks) if b[0] == p]
        weight = 0.1 if blocks[at[0]][2] else 1.0
        value[p] = weight * sum((near(length, k) * near(marks, k)) ** 0.5 for k in at) / len(at)
        mass[p] = weight * sum(map(len, same[p]))
    mean = sum(value[p] * mass[p] for p in same) / sum(mass.values())
    spread = (sum(mass[p] * (value[p] - mean) ** 2 for p in same) / sum(mass.values())) ** 0.5
    threshold = max(1.0, mean / 4, min(0.6 * mean, mean - spread / 2))
    return [t for p, t, _ in blocks if value[p] >= threshold - 1e-12], threshold


def test_content_nodes_against_brute_force():
    rnd = random.Random(8)
    words = "alpha beta, gamma delta. epsilon zeta; eta theta! iota kappa".split()
    sizes = set()
    for _ in range(300):
        text = lambda n: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, n)))
        part = lambda depth: "".join(
            f"<div{rnd.choice(['', '', ' class=\"ad\"', ' class=\"body7\"'])}>{part(depth - 1)}</div>" if depth and rnd.random() < 0.5 else f"<p>{text(rnd.choice([3, 60]))}</p>" for _ in range(rnd.randint(1, 4))
        )
        source = f"<body>{part(4)}</body>"
        want, threshold = content_by_brute_force(source)
        page_ = html_text.read(source)
        paths, links, got = html_text.content_paths(page_)
        assert got == pytest.approx(threshold) and not links
        assert [t for e, t, _ in page_.blocks if page_.path[e] in paths] == want
        sizes.add(len(want) == len(page_.blocks))
    assert sizes == {True, False}


SIDE = "".join(f"<div class=x{k}><p>Side item {k}</p></div>" for k in range(4))
LONG = f"{BODY} {BODY} {BODY}"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # neither telling tags nor classes: only the ratios can tell
        (f"<body><div><div>Home</div><div>About us</div></div><div class=x><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><div class=y><div>Terms</div><div>Contact</div></div></body>", f"{LONG}\nYes.\n{LONG}"),
        (f"<body><div class=q>{SIDE}</div><div class=r><h2>Head</h2><p>{LONG}</p><ul><li>one</li><li>two</li></ul><p>{LONG}</p></div></body>", f"Head\n{LONG}\none\ntwo\n{LONG}"),
        # lists of links inside the article's element
        (f"<body><div class=r><p>{LONG}</p><div class=s><a href=/1>More of it here</a></div><div class=s><a href=/2>And of that</a></div><p>{LONG}</p></div></body>", f"{LONG}\n{LONG}"),
        # words of a class weigh, but do not decide
        (f"<body><div class='ad share'><p>{LONG}</p><p>{LONG}</p></div></body>", f"{LONG}\n{LONG}"),
        (f"<body><div class=x><p>{LONG}</p><div class=share>Tell all your friends.</div><p>{LONG}</p></div></body>", f"{LONG}\n{LONG}"),
    ],
)
def test_ratios_decide(html, text):
    assert html_text.main_text(html)[0] == text


def test_the_ratios_change_what_tags_leave():
    html = f"<body><div><div>Home</div></div><div class=x><p>{LONG}</p></div></body>"
    left = [t for _, t, _ in html_text.read(html).blocks]
    assert left == ["Home", LONG] and html_text.main_text(html)[0] == LONG


@pytest.mark.parametrize("tag", ["div", "p><ul><li"])
def test_deep_nesting_takes_memory_in_proportion(tag):
    def peak(n):
        tracemalloc.start()
        text = html_text.main_text(f"<{tag}>" * n + BODY + "</x></y>" * n)[0]
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert text == BODY
        return top

    small, large = peak(2_000), peak(20_000)
    assert large < 14 * small and large < 40 << 20
    assert html_text.main_text(f"<{tag}>" * 100_000 + BODY)[0] == BODY
