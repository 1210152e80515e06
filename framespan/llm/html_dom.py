"""A small forgiving HTML reader: elements in page order, and the text runs that they own."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""(?<![^\s=/"'>])([^\s=/"'>]++)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that never show text of the page's own.
HIDDEN = frozenset("head script style title noscript template iframe object svg math canvas audio video textarea select button option datalist noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = BLOCK - {"br", "body", "html", "caption", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
#: A start tag of the key ends an open element of the value, unless one of the fences stands between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
_P_FENCE = frozenset("article aside section div td th table blockquote li main nav header footer form button body".split())
#: An end tag of an inner element does not reach over these.
_SCOPE = frozenset("article main table body html".split())
_NAMED = frozenset("class id role itemprop aria-label name".split())


@dataclass
class Dom:
    """Elements in page order; ``after[i]`` is the number after the last element of i's subtree."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    after: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    mark: list[str | None] = field(default_factory=list)
    #: (element, text) runs in page order; text None is the edge of a block.
    runs: list[tuple[int, str | None]] = field(default_factory=list)


def attribute_tokens(text: str) -> tuple[tuple[str, ...], str | None]:
    """Lower-case words of class, id, role and similar attributes; and the training mark, if there is one."""
    found, mark = [], None
    for name, a, b, c in _ATTRIBUTE.findall(text):
        name = name.lower()
        if name in _NAMED:
            found += [w.lower() for w in _WORD.findall(html.unescape(a or b or c))]
        elif name == "data-train":
            mark = a
    return tuple(dict.fromkeys(found)), mark


def parse(page: str) -> Dom:
    dom = Dom(["#root"], [-1], [0], [0], [()], [None])
    stack = [0]
    #: levels of the stack at which each name stands, so that no tag has to look through the stack
    levels: defaultdict[str, list[int]] = defaultdict(list)
    hidden = 0
    at = 0

    def text(until: int) -> None:
        if until > at and not hidden:
            dom.runs.append((stack[-1], page[at:until]))

    def close_to(level: int) -> None:
        nonlocal hidden
        while len(stack) > level:
            done = stack.pop()
            levels[dom.tag[done]].pop()
            dom.after[done] = len(dom.tag)
            if dom.tag[done] in HIDDEN:
                hidden -= 1
            elif dom.tag[done] in BLOCK and not hidden:
                dom.runs.append((stack[-1], None))

    def highest(names) -> int:
        return max((levels[n][-1] for n in names if levels[n]), default=0)

    def end_open(names, fences) -> None:
        level = highest(names)
        if level and level >= highest(fences):
            close_to(level)

    end = len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            text(end)
            break
        text(found.start())
        at = found.end()
        if found[1]:
            name = found[1].lower()
            end_open({name}, () if name in _SCOPE else _SCOPE)
        elif found[2]:
            name = found[2].lower()
            if name in _CLOSES_P:
                end_open({"p"}, _P_FENCE)
            if name in _ENDS:
                names, fences = _ENDS[name]
                for _ in range(len(names)):
                    before = len(stack)
                    end_open(names, fences)
                    if len(stack) == before:
                        break
            if name in BLOCK and not hidden:
                dom.runs.append((stack[-1], None))
            rest = found[3]
            tokens, mark = attribute_tokens(rest) if rest and "=" in rest else ((), None)
            number = len(dom.tag)
            dom.tag.append(name)
            dom.parent.append(stack[-1])
            dom.after.append(number + 1)
            dom.depth.append(len(stack))
            dom.tokens.append(tokens)
            dom.mark.append(mark)
            if name in VOID or rest.endswith("/"):
                continue
            levels[name].append(len(stack))
            stack.append(number)
            hidden += name in HIDDEN
            if name in RAW:
                closing = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                raw_end = closing.start() if closing else end
                at = closing.end() if closing else end
                close_to(len(stack) - 1)
                del raw_end
    close_to(0 + 1)
    dom.after[0] = len(dom.tag)
    return dom


def joined(dom: Dom, keep) -> str:
    """Text of the kept elements' runs: blocks in page order, white space collapsed, joined by a space."""
    blocks, now = [], []
    for element, run in dom.runs:
        if run is None:
            if now:
                blocks.append("".join(now))
                now = []
        elif keep[element]:
            now.append(html.unescape(run))
    if now:
        blocks.append("".join(now))
    return " ".join(b for b in (" ".join(block.split()) for block in blocks) if b)
