"""Pages without article or main whose blocks are in elements of their own."""

from inkwell.llm import html


def page(*sizes, before="", after=""):
    texts = [f"{i} " + "word " * (n // 5) for i, n in enumerate(sizes)]
    return before + "".join(f"<div><p>{t}</p></div>" for t in texts) + after, "\n".join(t.strip() for t in texts)


def test_short_blocks_before_and_after_long_ones():
    for sizes in ((60, 40, 40, *[600] * 8), (*[400] * 6, 40, 40), (*[600] * 4, 20, 20, 20, 20, *[600] * 4)):
        got, want = page(*sizes)
        assert html.main_text(got) == want


def test_lists_of_links_bound_the_text():
    links = "<div>Site</div><div><a href=1>Home</a> | <a href=2>News</a></div>"
    got, want = page(60, 40, 40, *[600] * 8, before=links, after="<div><a href=3>One</a></div><div><a href=4>Two</a></div><div>End</div>")
    assert html.main_text(got) == want


def test_an_authors_link_is_no_list():
    got, want = page(*[600] * 8, before="<div><h1>Title</h1></div><div>By <a href=1>Some Author</a></div>")
    assert html.main_text(got) == "Title\nBy Some Author\n" + want


FRAME_PAGE = "<body><nav><a href=1>Home</a> <a href=2>News</a></nav><div class=ad>Buy this now, it is cheap today.</div><article><h1>Title</h1><p>{}</p><p>Short.</p><p>{}</p></article><footer>&copy; somebody, all rights reserved, and so on and on.</footer></body>"


def test_the_ratios_choose(monkeypatch):
    """Frames reach the clustering as lines and lose there; an article or main is no condition."""
    page = FRAME_PAGE.format("word " * 60, "more " * 40)
    want = "Title\n" + ("word " * 60).strip() + "\nShort.\n" + ("more " * 40).strip()
    assert html.main_text(page) == want
    for tag in ("div", "main", "section"):
        assert html.main_text(page.replace("article", tag)) == want
    monkeypatch.setattr(html, "chosen", lambda lines: lines)
    assert html.main_text(page) == f"Home News\nBuy this now, it is cheap today.\n{want}\n© somebody, all rights reserved, and so on and on."


def test_a_line_at_the_threshold_is_in():
    """Equal ratios all lie at the mean, with no spread: all regions tie and all stay."""
    got, want = page(*[300] * 5)
    assert html.main_text(got) == want
    assert html.main_text("<div>abc</div><div>abc</div>") == "abc\nabc"


def test_frames_alone_are_no_main_text():
    assert html.main_text("<nav>a</nav><footer>some words of a footer</footer><div class='ad'>text</div><article></article>") == ""
