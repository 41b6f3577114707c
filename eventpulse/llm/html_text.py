"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass judges each block by itself, from its link density,
length and stop-word density, and from the containers it stands in; short blocks stay undecided. In the second
pass undecided blocks take the label of the nearest decided neighbours.

Some elements (nav, footer, aside, ...) never hold main text. Words in classes, ids and roles (sidebar, cookie, comments,
...) and forms make a container a side one too, but not if it holds the page's principal article, or most of
the text of a page without one. Articles bound the main text only where they hold most of what is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import refuse_clashes
from .wordblocks import released

_REST = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|textarea)\b{_REST}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<title\b{_REST}>.*?(?:</title\s*>|(?=<(?:/head|body|meta|link|script|style)\b)|\Z)"
    rf"|<(?P<closed>noscript|template|svg|math|iframe|select|object|datalist)\b{_REST}(?<!/)>.*?</(?P=closed)\s*>"
    rf"|<(?P<close>/?)(?P<name>[a-z][a-z0-9-]*)(?P<rest>{_REST})>"
    r"|<[!?/a-z][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: HTML's block-level elements, those of them that hold no article text, and those that stand in a head.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
SIDE_TAGS = frozenset("nav footer aside menu dialog button search".split())
SOFT_TAGS = frozenset("form fieldset".split())
MAIN_TAGS = frozenset({"article", "main"})
HEAD_TAGS = frozenset("head html meta link base title style script noscript template".split())
CONTAINERS = BLOCK_TAGS - frozenset("p hr h1 h2 h3 h4 h5 h6 li dt dd option tr td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Words of names and roles that mark menus, headers, notices, adverts, sidebars, reader comments and the like.
SIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising advertorial alert alerts banner banners breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie "
    "cookies dialog disqus footer footers gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup "
    "promo promos promoted promotion recommended recommendation recommendations related replies respond search share sharebar sharing sidebar sidebars signup skip social sponsor sponsored "
    "subscribe subscription teaser teasers toolbar widget widgets".split()
)
SIDE_PAIRS = frozenset({("pop", "up"), ("side", "bar"), ("sign", "up"), ("log", "in"), ("site", "header"), ("page", "header"), ("global", "header"), ("top", "header"), ("main", "header")})
#: Words that turn a name into one of a page's states or of a link to something.
STATE_WORDS = frozenset("has with without no not is hide show open closed enabled disabled count".split())
COMMENT_NAME = re.compile(r"(?:^|[-_])(?:comment|reply)(?:$|[-_])", re.I)
#: Frequent function words.
STOP_WORDS = {
    "en": frozenset("the of and a in to is was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their that it he she you i if do will up other about out many then them these so some her would".split()),
    "de": frozenset("der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man".split()),
    "fr": frozenset("de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son lui nous comme mais on si leur elle aux y d l n s qu c je tu ils elles été cette ces sa ses".split()),
    "es": frozenset("de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde".split()),
}
WORD = re.compile(r"[^\W\d_]+")




class Container:
    __slots__ = ("parent", "name", "strict", "soft", "main", "size", "side", "inside")

    def __init__(self, parent: Container | None, name: str, strict: bool, soft: bool, main: bool):
        self.parent, self.name, self.soft, self.main = parent, name, soft, main
        self.strict = strict or parent is not None and parent.strict
        self.size, self.side, self.inside = 0, False, False


class Block:
    __slots__ = ("text", "links", "where", "kind", "side", "main", "label")

    def __init__(self, text: str, links: int, where: Container | None, kind: str):
        self.text, self.links, self.where, self.kind = text, links, where, kind
        self.side = self.main = False
        self.label: bool | None = None


def named_side(names: list[str]) -> bool:
    """Whether a class, id or role token marks a side container; words of a token are parted by - and _."""
    for token in (t for n in names for t in n.lower().split()):
        words = re.split(r"[-_]+", token)
        if not STATE_WORDS & set(words) and (SIDE_WORDS & set(words) or SIDE_PAIRS & set(zip(words, words[1:], strict=False))):
            return True
    return False


def page_blocks(html: str) -> tuple[list[Block], list[Container]]:
    """The page's non-empty blocks in order, white space already single, and its containers, outer ones first."""
    blocks: list[Block] = []
    containers: list[Container] = []
    open_: list[Container] = []
    parts: list[str] = []
    links = depth = at = 0
    kind, in_head = "", False

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text and not in_head:
            blocks.append(Block(text, min(links, len(text)), open_[-1] if open_ else None, kind))
        parts.clear()
        links = 0

    def add(piece: str) -> None:
        nonlocal links
        piece = unescape(piece) if "&" in piece else piece
        parts.append(piece)
        if depth:
            links += len(" ".join(piece.split()))

    for m in TAG.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        closing = bool(m["close"])
        if in_head and (closing and name == "head" or not closing and name not in HEAD_TAGS):
            parts.clear()
            in_head = False
        if name == "head":
            parts.clear()
            in_head = not closing
            continue
        if name == "a":
            depth = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        if name not in BLOCK_TAGS:
            continue
        flush()
        depth = 0
        kind = "" if closing else name
        if name not in CONTAINERS:
            continue
        if closing:
            if any(c.name == name for c in open_):
                while open_.pop().name != name:
                    pass
        elif not m["rest"].endswith("/"):
            parent = open_[-1] if open_ else None
            found = ATTRIBUTE.findall(m["rest"]) if m["rest"] else []
            values = [next((x for x in v if x), "") for _, *v in found]
            main = name in MAIN_TAGS or any(k.lower() == "role" and v.lower() == "main" for (k, *_), v in zip(found, values, strict=True))
            within = any(c.main for c in open_)
            if name in ("html", "body", "main"):
                soft = False
            elif name == "article":
                soft = any(COMMENT_NAME.search(t) for v in values for t in v.split() if not STATE_WORDS & set(re.split(r"[-_]+", t.lower())))
            else:
                soft = name in SOFT_TAGS or named_side(values) or not within and "header" in " ".join(values).lower().split()
            containers.append(Container(parent, name, name in SIDE_TAGS or name == "header" and not within, soft, main))
            open_.append(containers[-1])
    if at < len(html):
        add(html[at:])
    flush()
    return blocks, containers


def _up(where: Container | None) -> Iterator[Container]:
    while where is not None:
        yield where
        where = where.parent


def place(blocks: list[Block], containers: list[Container]) -> bool:
    """Sets side and main of each block; whether articles bound the main text."""
    total = unmarked = 0
    for b in blocks:
        if b.where is None or not b.where.strict:
            total += len(b.text)
            unmarked += 0 if any(c.soft for c in _up(b.where)) and not any(c.main for c in _up(b.where)) else len(b.text)
            for c in _up(b.where):
                c.size += len(b.text)
    articles = [c for c in containers if c.main and not c.strict]
    principal = max(articles, key=lambda c: c.size, default=None)
    if principal is not None and principal.size < 0.3 * unmarked:
        principal = None
    shielded = set(map(id, _up(principal)))
    for c in containers:
        soft = c.soft and id(c) not in shielded and not (principal is None and 2 * c.size > total)
        c.side = c.strict or soft or c.parent is not None and c.parent.side
        c.inside = c.main or c.parent is not None and c.parent.inside
    bounded = left = 0
    for b in blocks:
        b.side, b.main = (b.where.side, b.where.inside and not b.where.side) if b.where else (False, False)
        left += 0 if b.side else len(b.text)
        bounded += len(b.text) if b.main else 0
    if 2 * bounded < left or not bounded:
        for b in blocks:
            b.main = False
        return False
    return True


def stop_words(text: str) -> tuple[int, int]:
    """(stop words, words) by the best list."""
    words = [w.lower() for w in WORD.findall(text)]
    return max(sum(w in s for w in words) for s in STOP_WORDS.values()), len(words)


def classify(blocks: list[Block], bounded: bool, short: int = 70, most_links: float = 0.33, least_stop_words: float = 0.1) -> None:
    """Sets each block's label: True for main text. On pages whose text as a whole fits no stop-word list, length and link
    density decide alone. Of decided neighbours at equal distance with different labels the main one counts."""
    for b in blocks:
        density = b.links / len(b.text)
        if b.side or bounded and not b.main:
            b.label = False
        elif density > most_links and (b.kind == "li" or not b.main or len(b.text) >= short and density > 0.8):
            b.label = False
        elif b.main and len(b.text) >= short:
            b.label = True
    waiting = [b for b in blocks if b.label is None and len(b.text) >= short]
    found = [stop_words(b.text) for b in waiting]
    listed = sum(n for n, _ in found) >= least_stop_words * sum(n for _, n in found)
    for b, (n, words) in zip(waiting, found, strict=True):
        b.label = not listed or n >= least_stop_words * max(words, 1)
    decided = [i for i, b in enumerate(blocks) if b.label is not None]
    given: dict[int, bool] = {}
    k = 0
    for i, b in enumerate(blocks):
        while k < len(decided) and decided[k] < i:
            k += 1
        if b.label is None:
            before = blocks[decided[k - 1]] if k else None
            after = blocks[decided[k]] if k < len(decided) else None
            near = [x for x in (before, after) if x is not None and x.main == b.main and x.side == b.side]
            if b.main or not near:
                given[i] = b.main or not decided  # short blocks of an article are its text, as are those of a page without others
            elif len(near) == 2 and near[0].label != near[1].label:
                left, right = i - decided[k - 1], decided[k] - i
                given[i] = after.label if b.kind in HEADINGS or right < left else before.label if left < right else True
            else:
                given[i] = bool(near[0].label)
    for i, label in given.items():
        blocks[i].label = label


def main_text(html: str | None) -> str:
    """The main text of a page, its blocks joined by line breaks; empty if there is none."""
    if not html:
        return ""
    blocks, containers = page_blocks(html)
    classify(blocks, place(blocks, containers))
    return "\n".join(b.text for b in blocks if b.label)


def extract_main_text(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """Per row of pages: keep's columns, text and n_chars (its code points). Null and empty html give an empty text;
    repeated rows give repeated results; a very long page is read whole in one task; an empty table gives an empty
    result. Columns to keep must not be named text or n_chars."""
    refuse_clashes(keep, ["text", "n_chars"])
    source = pages.select(*keep, F.col(html).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h.as_py()) for h in part.column("_html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"]
                )

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.select(*keep).schema)
    return source.mapInArrow(released(run), f"{kept}text string, n_chars long")
