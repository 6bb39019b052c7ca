"""HTML extraction by line-block distribution.

Markup is stripped into lines, one for each block of the page. A line weighs what it has of text
outside links, up to 240 characters, and weights are summed over sliding windows of lines; between
containers that don't hold one another lie blank lines. Where the sums rise from nothing is a surge
point, where they fall to nothing a dive point, and the text between the two is a run. A run is dense
if a window of it reaches the threshold, a share of the page's typical sum (the mean of the sums, each
weighted by itself). Kept is the text from the first dense run's surge to the last one's dive, but
for runs of links; a run before that has the page's only heading; and runs that go on in containers of
the same element and class.

Elements and names weigh in. On a page with an article element of some size they mostly decide: there the
result is the text in it, less what stands in containers of the kinds below, as their weights are far below
what the threshold asks. Only these cases are open to the text itself:

* Containers of a kind or name that holds no article text (menus, page headers, footers, sidebars,
  notices, adverts, forms, reader comments) weigh a five-hundredth, or a quarter where the name only has
  such a word in it. Each is taken out of its parent's lines and judged as a distribution of its own, against
  the page's threshold. Where only a word that an article's own parts may have says so (related, share, banner, ...), or a
  fieldset, three paragraphs of 240 characters outweigh it. A wrapper around the page's article, a form around most of
  the page, and a container of nearly all its text, count as any other container.
* Where article and main elements have a tenth of the page's text or more, text in one weighs four times as
  much and text outside a twenty-fifth, but for paragraphs of 240 characters that stand right in what the article is in. Where they have less, they are teasers, and count for nothing.

Scripts, styles and the like hold no lines. Character references are decoded, white space inside a
block becomes one space, blocks are trimmed and joined by a line feed.

Defined results: null or empty html, and html without text outside links, give the empty string; text
outside all markup is a run like any other; tags that are never closed end with their parent, a list
item or table cell with the next one of its list or table at the latest; svg and math that close
themselves are empty; an unterminated tag at the end of the page is dropped; a very long page, or one
nested deeply, is read whole, by one task; repeated rows give the same text; equal sums are both
dense. No rows, no rows. Columns that clash with the output are replaced by it; others pass.
"""

from __future__ import annotations

import html as html_entities
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?:svg|math)(?=[\s/])(?:[^>\"'/]++|/(?!>)|\"[^\"]*\"|'[^']*')*+/>"
    r"|<(script|style|noscript|template|textarea|title|svg|iframe|object|math|select|canvas|audio|video)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Of these, the ones whose nesting matters here.
CONTAINERS = frozenset("article aside blockquote body button details dialog div dl fieldset figure footer form head header li main menu nav ol section span table td ul".split())
#: The parts of a table that end an open cell.
CELL_ENDS = frozenset("caption tbody td tfoot th thead tr".split())
#: Containers without article text, by element.
DROPPED = frozenset("nav footer aside form menu head button dialog fieldset".split())
#: Containers without article text, by a part of their class, id or role.
DROPPED_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations sidebar sidenav navigation nav navbar menu breadcrumb breadcrumbs "
    "pagination pager toolbar footer masthead topbar copyright disclaimer comment comments commentlist disqus respond replies reply "
    "discussion responses complementary contentinfo search".split()
)
#: Of these, the ones of readers' talk; a container of it is no wrapper of the page's article.
TALK = frozenset("comment comments commentlist disqus respond replies reply discussion responses".split())
#: Those that tell even of a few words inside a line.
ADVERTS = frozenset("ad ads adbox adslot advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted".split())
#: Those that may as well be on a part of the article: three long paragraphs outweigh them.
CHANCE = frozenset("related recommended recommendations share sharing social search banner masthead topbar toolbar pager pagination promo promotion alert".split())
#: Parts of names that say where or how, and not what.
STRUCTURE = frozenset(
    "area bar block body bottom box button buttons c col column component container content desktop div el fixed global group holder id inner item items js large layout "
    "left link links list mobile module outer panel primary right row secondary section site slot small sticky text the thread top unit widget widgets wp wrap wrapper zone".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_THE_REST_IS_OF_ANOTHER = frozenset("has with without no not is".split())

#: Weights of containers that hold no article text, by element or name, and by a name that has such a word in it.
SURELY, MAYBE = 0.002, 0.25
#: Characters of a line that count at most; weights in and out of an article, where there is one.
LINE_CHARS, INSIDE, OUTSIDE = 240, 4.0, 0.04
#: What link text weighs in an article, and which share of it makes a run one of links.
LINK, MOST_LINKS = 0.03, 0.5
#: The threshold, as a share of the typical sum: with an article, and without.
DENSE_INSIDE, DENSE = 0.05, 0.15
#: Long paragraphs that outweigh a name of CHANCE.
LONG_PROSE = 3
#: The share of the text in article and main elements from which on they count.
LEAST_INSIDE = 0.1


@dataclass(slots=True, eq=False)
class Box:
    """A container, with the numbers of itself and of the last one in it."""

    first: int = 0
    last: float = 0
    up: Box | None = None
    name: str = ""
    shape: str = ""  # element and classes, where it has classes
    inside: bool = False  # of an article or main element, or one
    weight: float = 1.0
    talk: bool = False
    home: Box | None = None  # the innermost container, itself counted, that blank lines lie between and the next
    chars: int = 0  # outside links, and outside containers that weigh less
    prose: int = 0  # lines of 80 such characters or more
    long: int = 0  # lines of LINE_CHARS such characters or more
    title: bool = False  # an h1 is in it
    chance: bool = False  # it weighs less by words of CHANCE, or as a fieldset, alone

    def holds(self, other: Box) -> bool:
        return self.first <= other.first <= self.last


@dataclass
class Line:
    text: str
    inside: bool  # an article or main element
    links: int  # characters of it in links
    box: Box = field(default_factory=Box)
    heading: bool = False
    weight: float = -1.0
    block: int = -1  # parts of one block, of which an advert in a sentence is one, have the same number

    def __post_init__(self):
        if self.weight < 0:
            self.weight = float(len(self.text))


def _named(word: str, inside: bool) -> tuple[float, bool]:
    """(weight, whether it is readers' talk) of a container by one word of its class, id or role."""
    parts = [p.lower() for p in _PART.findall(word)]
    parts = list(itertools.takewhile(lambda p: p not in _THE_REST_IS_OF_ANOTHER, parts))
    if not parts or DROPPED_NAMES.isdisjoint(parts) and "header" not in parts:
        return 1.0, False
    what = [p for p in parts if p not in STRUCTURE and not p.isdigit()]
    if what == ["header"] and not inside:
        return SURELY, False
    if what and what[-1] in DROPPED_NAMES:
        return SURELY, what[-1] in TALK
    return (MAYBE, False) if not DROPPED_NAMES.isdisjoint(what) else (1.0, False)


def _hint(name: str, attributes: str, inside: bool) -> tuple[float, bool, str]:
    """(weight, whether it is readers' talk, shape) of a container."""
    weight, talk, shape = (SURELY if name in DROPPED or name == "header" and not inside else 1.0), False, ""
    if not attributes or attributes.isspace():
        return weight, talk, shape
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "class" and value.strip():
            shape = f"{name} {' '.join(sorted(value.split()))}"
        if name in ("html", "body", "main"):
            continue
        if key == "hidden" and value.lower() not in ("false", "until-found") or key == "aria-hidden" and value.lower() == "true" or key == "style" and _UNSEEN.search(value):
            weight = SURELY
        elif key in ("class", "id", "role"):
            for word in value.split():
                w, t = _named(word, inside)
                if name in ("span", "article") and w < 1 and not t and ADVERTS.isdisjoint(p.lower() for p in _PART.findall(word)):
                    continue  # a span of a sentence, or an article about it
                if name == "span" and t:
                    continue
                weight, talk = min(weight, w), talk or t
    return weight, talk, shape


def _by_chance(name: str, attributes: str, inside: bool) -> bool:
    """Of a container that weighs less: whether nothing but words of CHANCE, or its being a fieldset, says so."""
    if name in DROPPED and name != "fieldset" or name == "header" and not inside:
        return False
    for m in _ATTRIBUTE.finditer(attributes or ""):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("hidden", "aria-hidden", "style") and _hint("div", f' {key}="{value}"', inside)[0] < 1:
            return False
        if key in ("class", "id", "role") and any(_named(w, inside)[0] < 1 and not CHANCE.intersection(p.lower() for p in _PART.findall(w)) for w in value.split()):
            return False
    return True


def lines_of(page: str) -> tuple[list[Line], list[Box]]:
    """The page's lines, and its containers, both in order."""
    out: list[Line] = []
    boxes = [Box()]
    boxes[0].home = boxes[0]
    text: list[str] = []
    links = [0]
    stack: list[tuple[str, Box]] = []  # (element, the container that it is in)
    ends: list[tuple[int, int]] = [(-1, -1)]  # under each depth: of the item, and of the cell, that the next one ends
    opened: dict[str, int] = defaultdict(int)  # how often an element is on the stack
    box = boxes[0]
    block: Box | None = None  # of a paragraph that weighs less by its name
    heading = ""
    in_link = number = 0

    def end_line(part: bool = False) -> None:
        nonlocal block, number
        if text:
            got = " ".join(html_entities.unescape("".join(text)).split())
            if got:
                own = block or box
                out.append(Line(got, own.inside, min(links[0], len(got)), own, bool(heading), block=number))
                if heading == "h1":
                    own.title = True
            text.clear()
        links[0] = 0
        if not part:
            number, block = number + 1, None

    def open_box(name: str, attributes: str) -> Box:
        weight, talk, shape = _hint(name, attributes, box.inside)
        inside = box.inside or name in ("article", "main")
        hard = name in ("div", "article", "main", "body") or name == "section" and box.name in ("", "body", "main", "html")
        made = Box(len(boxes), len(boxes), box, name, shape, inside, weight, talk)
        made.home = made if hard else box.home
        made.chance = weight < 1 and not talk and _by_chance(name, attributes, box.inside)
        boxes.append(made)
        return made

    def close(depth: int) -> None:
        nonlocal box
        for name, outer in reversed(stack[depth:]):
            opened[name] -= 1
            box.last = len(boxes) - 1
            box = outer
        del stack[depth:], ends[depth + 1 :]

    def say(s: str) -> None:
        if s:
            text.append(s)
            if in_link:
                links[0] += len(s)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        raw, closing, name, attributes = m[1], m[2] or m[5], (m[3] or m[6] or "").lower(), m[4] or m[7] or ""
        if raw:
            if raw.lower() in ("title", "textarea", "select", "iframe", "object", "video", "audio", "svg"):
                say(" ")
            continue
        if not name:
            continue
        if name == "br":
            say(" ")
            continue
        if name == "a":
            in_link = 0 if closing else 1
        if name in BLOCKS:
            end_line()
            heading = name if not closing and name in HEADINGS else ""
        item, cell = ends[-1]
        if name == "li" and not closing and item >= 0:
            close(item)
        elif name in CELL_ENDS and cell >= 0 and not (closing and name in ("td", "th", "caption")):
            close(cell)
        if name not in CONTAINERS or attributes.endswith("/"):
            if name in BLOCKS and not closing and attributes and not attributes.isspace() and _hint(name, attributes, box.inside)[0] < 1:
                block = open_box(name, attributes)
            continue
        if not closing:
            item, cell = ends[-1]
            item = len(stack) if name == "li" else item if name in ("div", "span") else -1
            cell = len(stack) if name == "td" else -1 if name == "table" else cell
            if name in ("span", "button"):
                plain = _hint(name, attributes, box.inside)[0] == 1
                if plain and not opened[name]:
                    continue
                end_line(part=True)
            ends.append((item, cell))
            opened[name] += 1
            stack.append((name, box))
            box = open_box(name, attributes)
            continue
        if not opened[name]:
            continue
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] == name:
                end_line(part=name in ("span", "button"))
                close(depth)
                break
    if at < len(page):
        say(page[at:])
    end_line()
    for outer in (box, *(b for _, b in stack)):
        outer.last = len(boxes) - 1
    return out, boxes


def _plain(boxes: list[Box]) -> list[bool]:
    """Of each container: whether neither it nor one around it weighs less."""
    out = [boxes[0].weight == 1]
    for b in boxes[1:]:
        out.append(b.weight == 1 and out[b.up.first])
    return out


def _weigh(lines: list[Line], boxes: list[Box]) -> bool:
    """Settle what containers and lines weigh; whether the page has an article."""
    for line in lines:
        chars = max(len(line.text) - line.links, 0)
        line.box.chars += chars
        line.box.prose += chars >= 80
        line.box.long += chars >= LINE_CHARS
    for b in reversed(boxes[1:]):
        b.up.title = b.up.title or b.title
        if b.chance and b.long >= LONG_PROSE:
            b.weight = 1.0
        if b.weight == 1:
            b.up.chars += b.chars
            b.up.prose += b.prose
            b.up.long += b.long
    root, article, plain, talked = boxes[0], None, _plain(boxes), [False] * len(boxes)
    for b in boxes[1:]:
        talked[b.first] = b.talk or talked[b.up.first]
    for b in sorted((b for b in boxes if b.name in ("article", "main") and b.weight == 1 and b.chars and not talked[b.first]), key=lambda b: -b.chars):
        if plain[b.first] or 2 * b.chars >= root.chars + b.chars:
            article = b
            break
    within = sum(max(len(x.text) - x.links, 0) for x in lines if x.box.inside and not x.box.talk)
    if article is not None and within < LEAST_INSIDE * root.chars:
        article = None
    for b in boxes:
        if b.weight == 1 or b.talk:
            continue
        most = b.chars / (root.chars + b.chars) if b.chars else 0.0
        if article is not None:
            around = b.holds(article) or article.holds(b) and most >= 0.85 and b.prose >= 3 and (b.title or b.weight > SURELY)
        elif b.name == "form":
            around = most >= 0.6
        else:
            around = b.name not in DROPPED and b.name != "header" and (most >= 0.5 and b.title or most >= 0.85 and b.prose >= 3)
        if around:
            b.weight = 1.0
    plain = _plain(boxes)
    for line in lines:
        chars, inside = max(len(line.text) - line.links, 0), line.box.inside
        # a long paragraph right in what the article is in, and in nothing that weighs less, is part of it
        inside = inside or article is not None and chars >= LINE_CHARS and line.box.holds(article) and plain[line.box.first]
        line.inside = inside
        if article is not None and inside:
            chars += LINK * line.links
            chars *= INSIDE if plain[line.box.first] else 1.0
        line.weight = min(float(chars), LINE_CHARS) * (OUTSIDE if article is not None and not inside else 1.0)
    return article is not None


def _parts(lines: list[Line], boxes: list[Box]) -> tuple[list[Line], list[list[Line]]]:
    """(the lines of no container that weighs less; those of each that does, weighed)."""
    factor, of = {}, {}
    for b in boxes:
        outer = factor.get(id(b.up), 1.0)
        factor[id(b)] = outer * b.weight
        of[id(b)] = b.first if b.weight < 1 else of.get(id(b.up), -1)
    rest: list[Line] = []
    apart: dict[int, list[Line]] = defaultdict(list)
    for line in lines:
        line.weight *= factor[id(line.box)]
        key = of[id(line.box)]
        (rest if key < 0 else apart[key]).append(line)
    return rest, list(apart.values())


def _of_links(lines: list[Line]) -> bool:
    return sum(x.links for x in lines) > MOST_LINKS * sum(len(x.text) for x in lines)


def blanked(lines: list[Line], window: int) -> list[Line | None]:
    """The lines, with a window of blanks where text doesn't go on in the same container.

    It goes on in one that holds the other, but there not from or to link text.
    """
    stretches: list[tuple[Box, list[Line]]] = []
    for line in lines:
        own = line.box.home
        if stretches and stretches[-1][0] is own:
            stretches[-1][1].append(line)
        else:
            stretches.append((own, [line]))
    out: list[Line | None] = []
    before: tuple[Box, bool] | None = None
    for own, part in stretches:
        linked = _of_links(part)
        if before is not None and (before[1] or linked or not (before[0].holds(own) or own.holds(before[0]))):
            out.extend([None] * window)
        out.extend(part)
        before = own, linked
    return out


def runs(lines: list[Line | None], window: int = 3) -> list[tuple[int, int, float]]:
    """(surge, dive, highest window sum) of each run of lines: sums over windows that start at each line.

    A run begins where text follows a blank, and ends where a whole window holds none.
    """
    there = np.array([x is not None for x in lines], np.int64)
    if not there.any():
        return []
    # lines that weigh nothing are there still
    weights = np.array([x.weight if x else 0.0 for x in lines])
    full = (_sums(there, window) > 0).astype(np.int8)
    sums, edge = _sums(weights, window), np.diff(np.concatenate(([0], full, [0])))
    return [(int(a), int(b), float(sums[a:b].max())) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def _sums(weights: np.ndarray, window: int) -> np.ndarray:
    """Of lines i .. i + window - 1, for each i."""
    return np.convolve(weights, np.ones(window, weights.dtype))[window - 1 :]


def threshold_of(lines: list[Line | None], share: float, window: int) -> float:
    """A share of the typical window sum."""
    sums = _sums(np.array([x.weight if x else 0.0 for x in lines] or [0.0]), window)
    total = sums.sum()
    return share * float((sums**2).sum() / total) if total > 0 else 0.0


def main_text(page: str | None, window: int = 3) -> str:
    if not page:
        return ""
    lines, boxes = lines_of(page)
    anchored = _weigh(lines, boxes)
    rest, apart = _parts(lines, boxes)
    blocks = blanked(rest, window)
    least = threshold_of(blocks, DENSE_INSIDE if anchored else DENSE, window)
    kept: list[Line] = []
    if least > 0:
        found = [([x for x in blocks[surge:dive] if x], peak >= least) for surge, dive, peak in runs(blocks, window)]
        dense = [i for i, (_, is_dense) in enumerate(found) if is_dense]
        keep = set(dense)
        for i in range(dense[0], dense[-1]):
            part = found[i][0]
            if not _of_links(part) and (not anchored or part[0].inside):
                keep.add(i)
        for step, edge in ((-1, dense[0]), (1, dense[-1])):
            # paragraphs in containers of their own, alike
            at = edge + step
            while 0 <= at < len(found) and _alike(found[at][0], found[at - step][0]):
                keep.add(at)
                at += step
        if not any(line.heading for line in found[dense[0]][0]):
            titled = [i for i in range(dense[0]) if any(line.heading for line in found[i][0]) and not _of_links(found[i][0])]
            keep.update(titled[-1:])
        kept = [line for i in sorted(keep) for line in found[i][0]]
    for part in apart:
        if least <= 0:
            continue
        sums = _sums(np.array([line.weight for line in part]), window)
        if sums.max() >= least:
            kept += part
    order = {id(line): i for i, line in enumerate(lines)}
    return _joined(sorted(kept, key=lambda line: order[id(line)]))


def _joined(lines: list[Line]) -> str:
    return "\n".join(" ".join(line.text for line in block) for _, block in itertools.groupby(lines, key=lambda line: line.block))


def _alike(a: list[Line], b: list[Line]) -> bool:
    one, two = a[0].box.home, b[0].box.home
    return bool(one.shape) and one.shape == two.shape and one.up is two.up and not _of_links(a)


def plain_text(page: str | None) -> str:
    """All text that a reader sees, a line for each block."""
    return _joined(lines_of(page or "")[0])


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """df with the main text of each page."""

    @F.pandas_udf("string")
    def main(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages], dtype=object)

    return df.withColumn(out, main(F.col(f"`{html}`")))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


QUERIES = {"op3_html_text": op3_html_text}
ORACLE_SQL: dict[str, str] = {}
