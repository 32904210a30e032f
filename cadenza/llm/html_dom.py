"""A forgiving reader of HTML into a node table: parents, tags, attribute words and text runs in page order."""

from __future__ import annotations

import html
import re

#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup"
    " hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: An opening tag of the first kind ends an open element of the second, looked for up to the third.
CLOSES_P = BLOCK - {"html", "body", "dd", "dt", "li", "tbody", "tfoot", "thead", "tr", "legend", "summary", "figcaption"}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Never part of a text, whatever stands around them.
SILENT = RAW | frozenset("head button select option svg canvas object audio video datalist input".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORDS = re.compile(r"[a-z]+")
#: A capital inside a name starts a new word.
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
NAMING = frozenset(("class", "id", "role", "itemprop", "aria-label", "data-component"))


class Page:
    """Nodes in page order (0 is the root above all), and text runs: node, text, number of the block that it belongs to.

    silent: the node's text never counts; ends: one past the last node below it.
    """

    __slots__ = ("tags", "parents", "words", "marked", "silent", "ends", "runs")

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.words, self.marked, self.silent = ["#root"], [-1], [()], [False], [False]
        self.runs: list[tuple[int, str, int]] = []
        stack, block, at, n = [0], 0, 0, len(source)
        while at < n:
            m = _TAG.search(source, at)
            stop = m.start() if m else n
            if stop > at:
                self.runs.append((stack[-1], html.unescape(source[at:stop]), block))
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag = name.lower()
            closing = m[1] or m[4]
            if tag in BLOCK:
                block += 1
            elif tag == "br" or tag in ("td", "th"):
                self.runs.append((stack[-1], " ", block))
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[k]] == tag:
                        del stack[k:]
                        break
                continue
            if tag in CLOSES_P:
                self._end(stack, {"p"}, BLOCK - {"p"})
            if tag in ENDS:
                self._end(stack, *ENDS[tag])
            node = len(self.tags)
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.silent.append(tag in SILENT or self.silent[stack[-1]])
            words, marked = (), False
            raw = m[3] or m[6]
            if raw and "=" in raw:
                found: list[str] = []
                for key, *value in _ATTRIBUTE.findall(raw):
                    key = key.lower()
                    if key in NAMING:
                        found += _WORDS.findall(_HUMP.sub(" ", "".join(value)).lower())
                    elif key == "data-main":
                        marked = True
                words = tuple(found)
            self.words.append(words)
            self.marked.append(marked)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(source, at)
                at = end.start() if end else n
                if end:
                    close = source.find(">", at)
                    at = close + 1 if close >= 0 else n
            elif tag not in VOID and not (raw and raw.endswith("/") and tag not in BLOCK):
                stack.append(node)
        self.ends = list(range(1, len(self.tags) + 1))
        for k in range(len(self.tags) - 1, 0, -1):
            if self.ends[k] > self.ends[self.parents[k]]:
                self.ends[self.parents[k]] = self.ends[k]

    def _end(self, stack: list[int], which: set[str], limit: frozenset[str] | set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[k]]
            if tag in which:
                del stack[k:]
                return
            if tag in limit:
                return
