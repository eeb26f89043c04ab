"""Page parts by name: what holds the article stays, and so does every part of it."""

import pytest

from quillspark.llm import html_extract
from quillspark.llm.html_extract import ARTICLE, PRINTED_LINE, SURGE, WINDOW, lines_of, main_text

TEXT = "<h1>Title</h1><p>First paragraph of the text.</p><p>Second paragraph of the text.</p>"
WANTED = "Title\n\nFirst paragraph of the text.\n\nSecond paragraph of the text."
WRAPPERS = ['<div class="layout has-sidebar">', '<div id="form-page">', '<section class="social-science">', '<div class="no-comments">', '<div class="page-header-fixed"><div class="widget wide">', '<span class="ad-free">']


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("article", ["article", "main", "div"])
def test_wrappers_stay(wrapper, article):
    shut = "".join(f"</{x.split()[0]}>" for x in reversed(wrapper.strip("<>").split("><")))
    furniture = '<div class="sidebar">Side</div><div class="related"><a href="/x">Other</a></div><footer>End</footer>'
    for page in (f"<{article}>{TEXT}</{article}>", f'<{article}>{TEXT}<div class="share">Share</div></{article}>'):
        assert main_text(f"<body><nav>Menu</nav>{wrapper}{page}{furniture}{shut}</body>") == WANTED
    assert main_text(f"<body><{article}>{wrapper}{TEXT}{shut}</{article}></body>") == WANTED


def test_parts_go():
    comments = '<section class="comments">' + "<p>What a reader has to say on all of this.</p>" * 9 + "</section>"
    related = '<div class="related-posts"><article>Other one</article><article>Other two</article></div>'
    assert main_text(f"<body><article>{TEXT}{comments}</article>{related}</body>") == WANTED
    assert main_text(f"<body><div>{TEXT}</div>{comments}</body>") == WANTED
    assert main_text(f'<body class="no-comments"><main>{TEXT}</main></body>') == WANTED


def test_every_part_of_the_article_stays():
    links = "".join(f'<p><a href="/{i}">Link {i}</a></p>' for i in range(7))
    shown = [f"Link {i}" for i in range(7)]
    long = "Long text. " * 40
    menu = "<ul>" + "".join(f'<li><a href="/m{i}">Menu {i}</a></li>' for i in range(7)) + "</ul>"
    page = f"<body>{menu}<div><p>Intro.</p>{links}<p>{long}</p>{links}<p>End.</p><p><a href='/n'>Next</a></p></div>{menu}</body>"
    assert main_text(page).split("\n\n") == ["Intro.", *shown, long.strip(), *shown, "End.", "Next"]
    assert main_text(f"<body><p>Intro.</p>{menu}<p>{long}</p></body>").split("\n\n") == ["Intro.", long.strip()]


def test_names_count_as_a_whole():
    kept = ["<div class='share-price-table'>Prices of today</div>", "<p id='related-work'>Related work is here.</p>", "<ul class='menu-of-day'><li>Soup</li></ul>"]
    assert main_text(f"<body><article>{TEXT}{''.join(kept)}</article></body>") == WANTED + "\n\nPrices of today\n\nRelated work is here.\n\nSoup"
    assert main_text(f"<body><article>{TEXT}<div class='ad'>Buy it now, it is cheap.</div></article></body>") == WANTED


LONG = "<p>" + "A sentence of the text. " * 12 + "</p>"
LINKS = "<ul>" + "".join(f'<li><a href="/m{i}">Menu {i}</a></li>' for i in range(7)) + "</ul>"
PAGES = [
    f"<body>{LINKS}<div>{LONG}{LONG}</div>{LINKS}<div>&copy; Example</div></body>",
    f"<body>{LINKS}<div>{LONG}{LONG}</div>{LINKS}<p>A last paragraph.</p></body>",
    f"<body><div>{LONG}{LONG}<p>Short.</p></div>{LINKS}<article><h2>A teaser</h2></article>{LINKS}<div>&copy; Example</div></body>",
    f"<body>{LINKS}<div>&copy; Example</div>{LINKS}<article>{LONG}<p>Short.</p>{LINKS}<p>End.</p></article></body>",
    f"<body><article><h2>One</h2></article><article><h2>Two</h2></article>{LINKS}<div>&copy; Example</div></body>",
    "<body><div>x</div></body>",
    f"<body>{LINKS}</body>",
    "",
    LONG * 500 + LINKS * 50 + "<div>tail</div>",
]


def by_hand(page):
    """The rule once more, line by line."""
    lines = lines_of(page)

    def inside(weight):
        known = sorted(w for w in weight if w)
        if not known:
            return set()
        half = len(known) // 2
        bound = min(PRINTED_LINE, SURGE * (known[half] if len(known) % 2 else (known[half - 1] + known[half]) / 2))
        windows = {i: sum(weight[j] for j in range(i, i + WINDOW) if 0 <= j < len(weight)) for i in range(1 - WINDOW, len(weight))}
        near = [windows[i] > 0 or windows[i - WINDOW + 1] > 0 for i in range(len(weight))]
        out, i = set(), 0
        while i < len(weight):
            j = i
            while j < len(weight) and near[j]:
                j += 1
            held = [k for k in range(i, j) if weight[k]]
            if held and max(windows[k] for k in range(held[0] - WINDOW + 1, held[-1] + 1)) >= bound:
                out |= set(range(held[0], held[-1] + 1))
            i = j + 1
        return out

    weight = [x.own + (PRINTED_LINE if x.paragraph and x.own else 0) for x in lines]
    outside = {i for i in inside([0 if x.main else w for x, w in zip(lines, weight)]) if not lines[i].main}
    main = [x for x in lines if x.main]
    if main and sum(len(x.text) for x in main) >= ARTICLE * sum(lines[i].own for i in outside):
        return "\n\n".join(x.text for x in main)
    kept = outside | inside(weight)
    boxes = {lines[i].box for i in kept if lines[i].own} - {0}
    return "\n\n".join(x.text for i, x in enumerate(lines) if i in kept or (not x.own and x.box in boxes))


def test_the_distribution_decides(monkeypatch):
    got = [main_text(p) for p in PAGES]
    assert got == [by_hand(p) for p in PAGES]
    long = ("A sentence of the text. " * 12).strip()
    assert got[0] == f"{long}\n\n{long}" and got[1] == f"{long}\n\n{long}\n\nA last paragraph." and got[3].startswith(long) and got[3].endswith("End.")
    assert got[2].startswith(f"{long}\n\n{long}\n\nShort.") and "Example" not in got[2] and got[7] == ""
    monkeypatch.setattr(html_extract, "stretches", lambda weight, window=WINDOW: [(0, len(weight))])
    off = [main_text(p) for p in PAGES]
    assert off[0] != got[0] and off[2] != got[2] and off[3] == got[3]
