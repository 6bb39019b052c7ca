"""Long prose outweighs a name that an article's own parts may have, and none that tells of something else."""

from __future__ import annotations

import pytest

from bitvane.llm.html_text import main_text

LONG = "Prose about rivers and the bridges over them that goes on for a good while, as articles do. " * 4
PARA = f"<p>{LONG}</p>"


def page(inner: str, before: str = "") -> str:
    return f"<body><nav><a href='/'>Home</a></nav>{before}<article><h1>Title</h1>{PARA}{inner}{PARA}</article><footer>Imprint</footer></body>"


@pytest.mark.parametrize(
    "html,paragraphs",
    [
        (page(f"<div class='related'>{PARA * 4}</div>"), 6),
        (page(f"<fieldset>{PARA * 3}</fieldset>"), 5),
        (page(f"<section class='share-block'>{PARA * 3}</section>"), 5),
        (page("", before=PARA), 3),
        # short ones go, and so do kinds of containers that tell
        (page("<div class='related'><p>Read on: bridges of the north.</p></div>"), 2),
        (page(f"<div class='related'>{PARA * 2}</div>"), 2),
        (page(f"<div class='comments'>{PARA * 4}</div>"), 2),
        (page(f"<div class='advert related'>{PARA * 4}</div>"), 2),
        (page(f"<aside class='related'>{PARA * 4}</aside>"), 2),
        (page(f"<div class='related' hidden>{PARA * 4}</div>"), 2),
        (page("", before=f"<div class='cookie-notice'>{PARA}</div>"), 2),
    ],
)
def test_prose_and_names(html, paragraphs):
    assert main_text(html) == "\n".join(["Title", *[LONG.strip()] * paragraphs]) or main_text(html) == "\n".join([LONG.strip(), "Title", *[LONG.strip()] * (paragraphs - 1)])
