"""What only the alignment of a host's pages can tell, and pages that are long, deep or broken."""

import random
import time

from cairn.llm import html_text
from cairn.llm.html_text import Alignment, induce, main_text, packed, parse, unpacked

WORDS = "the page tells of many rivers and towns that lie beyond the hills".split()


def story(rng, n=40):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def extracted(pages):
    template = unpacked(packed(induce(pages)))
    return [main_text(p, template) for p in pages]


def test_constants_and_slots_without_any_role():
    rng, want, pages = random.Random(3), [], []
    for i in range(7):
        paragraphs = [story(rng) + f" {i} {k}" for k in range(rng.randrange(1, 6))]
        want.append(" ".join([f"Title {i}", *paragraphs]))
        body = "".join(f"<p>{x}</p>" for x in paragraphs)
        pages.append(
            f"<html><body><div><span>{story(rng, 3)}</span></div><div><div>Terms: {'all constant words of a long line ' * 20}</div>"
            f"<div><h1>Title {i}</h1>{body}<p>Subscribe for more</p><p>Call us on 555</p></div></div><div>{story(rng, 4)}</div></body></html>"
        )
    assert extracted(pages) == want


def test_equal_text_elsewhere_stays():
    rng = random.Random(4)
    pages = [f"<body><div>Latest news</div><div><p>{story(rng)}{i}</p><p>{'Latest news' if i == 2 else story(rng)}</p></div></body>" for i in range(5)]
    assert extracted(pages)[2].endswith("Latest news") and not any("Latest" in x for i, x in enumerate(extracted(pages)) if i != 2)


def test_class_names():
    page = "<body><article><p>One</p><div class='ad-free'>Two</div><div class='side ad'>no</div><div class='cookie-notice'>no</div><div class='comments'>no</div></article></body>"
    assert main_text(page, None) == "One Two"


def test_one_odd_seed_does_not_undo_the_template():
    rng = random.Random(5)
    pages = [f"<body><div>Always here</div><div><p>{story(rng)}{i}</p></div></body>" for i in range(5)] + ["<table><tr><td>odd page", "<p></p>"]
    assert not any("Always" in x for x in extracted(pages))


def brute_match(a, b):
    """Simple tree matching by its definition: the largest number of pairs over all alignments of children in order."""
    if a.tag != b.tag:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), (brute_match(x[0], y[0]) or -99) + best(x[1:], y[1:]))

    return 1 + best(a.elements, b.elements)


def test_alignment_is_as_large_as_any():
    rng = random.Random(6)

    def tree(depth):
        tag = rng.choice("ab")
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randrange(4) if depth else 0)) + f"</{tag}>"

    for _ in range(60):
        # no texts or names: every pair scores one and one more for the same (empty) name
        a, b = parse(tree(2)), parse(tree(2))
        assert Alignment(a, b).score == 2 * brute_match(a, b) == 2 * len(Alignment(a, b).pairs)


def test_deep_long_and_broken_pages():
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    assert main_text(deep, unpacked(packed(induce([deep, deep.replace("text", "words")])))) == "deep text"
    wide = ["".join(f"<p>word {i} {k}</p>" for i in range(3000)) + "<p>the same end</p>" for k in range(3)]
    texts = extracted(wide)
    assert all(len(t.split()) == 9000 for t in texts)
    for broken in ("<a ", "<script ", "<!x ", "<a '", '<a "b', "<!--", "<a href='x\" "):
        began = time.time()
        main_text(broken * 60_000, None)
        assert time.time() - began < 20, broken
    assert html_text.main_text("<", None) == "<"


def test_two_pages_of_a_host_and_repeated_rows(spark):
    rows = [(i % 2, f"http://two.example/{i % 2}", f"<body><div>Same line</div><div><p>Only on page {i % 2} and long enough</p></div></body>") for i in range(4)] + [(9, "http://two.example/9", " "), (None, None, None)]
    got = html_text.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.text) for r in got) == [(False, 0, "Only on page 0 and long enough")] * 2 + [(False, 1, "Only on page 1 and long enough")] * 2 + [(False, 9, ""), (True, 0, "")]
