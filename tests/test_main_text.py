"""The main text of pages against a walk of each block's own tree."""

import random
from xml.etree import ElementTree

from sigloom.operators import main_text as M

WORDS = "the story goes on, and on; it was said by many".split()
NAMES = ["", "article-body", "sidebar", "share post", "box", "nav", "content main"]


def page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice(["div", "section", "p", "ul", "nav", "span", "article", "script", "a"] if depth < 4 else ["p", "a", "span"])
        name = rng.choice(NAMES)
        inside = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60))) + "\n" + (page(rng, depth + 1) if tag in ("div", "section", "article", "nav", "ul") else "")
        out.append(f'<{tag} class="{name}">{inside}</{tag}>' + rng.choice(["", " tail,\n"]))
    return "".join(out)


def walked(html):
    """Every block by itself, from a whole tree."""
    root = ElementTree.fromstring(html)

    def prune(e):
        for child in list(e):
            name = f"{child.get('class', '')} {child.get('id', '')}"
            out = child.tag in M.STRIPPED + M.FRAME or (name.strip() and M.AGAINST.search(name) and not M.FOR.search(name))
            if out:
                before = list(e).index(child)
                if before:
                    e[before - 1].tail = (e[before - 1].tail or "") + (child.tail or "")
                else:
                    e.text = (e.text or "") + (child.tail or "")
                e.remove(child)
            else:
                prune(child)

    prune(root)
    best, chosen = 0.0, None
    for e in root.iter():
        text = "".join(e.itertext())
        n = len(text.strip())
        if e.tag in M.BLOCKS and n >= M.LEAST:
            score = n / 100 + 3 * len(e.findall(".//p")) + text.count(",")
            score *= 0.2 if M.AGAINST.search(e.get("class", "")) else 1
            score *= 1.5 if M.FOR.search(e.get("class", "")) else 1
            score *= 0.3 if sum(len("".join(a.itertext())) for a in e.findall(".//a")) / n > 0.5 else 1
            if score > best:
                best, chosen = score, e
    chosen = root.find(".//body") if chosen is None else chosen
    return "\n".join(x.strip() for x in "".join(chosen.itertext()).splitlines() if x.strip())


def test_blocks_are_those_of_a_walk():
    rng = random.Random(3)
    texts = set()
    for _ in range(300):
        html = f"<html><head></head><body>{page(rng)}</body></html>"
        assert M.main_text(html) == walked(html), html
        texts.add(M.main_text(html))
    assert len(texts) > 250


def test_pages_as_they_are_written(spark):
    article = "<p>One, two and three." + " More words follow here." * 12 + "</p>"
    html = f"<html><body><nav>Home</nav><div class=menu>links</div><div id=story>{article}<p>open<p>paragraphs</div><div class='box'>{'<a href=x>link text</a> ' * 60}</div><footer>end</footer>"
    text = M.main_text(html)
    assert text.startswith("One, two") and text.endswith("openparagraphs") and "Home" not in text and "link text" not in text
    assert M.main_text("<p>short</p>") == "short" and M.main_text(None) == "" == M.main_text(" ") and M.main_text("<<<>") is not None
    pages = spark.createDataFrame([(1, html, "t"), (2, None, "t"), (None, "<b>x", "t")], "page_id bigint, html string, text string")
    assert {(r.page_id, r.text) for r in M.main_texts(pages).collect()} == {(1, text), (2, ""), (None, "x")}
    deep = "<div>" * 3000 + "words, " * 200 + "</div>" * 3000
    assert M.main_text(deep).startswith("words,")
