"""A small DOM: parsing, boilerplate marks, skeletons, simple tree matching, and text blocks."""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import blake2b
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that part blocks of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
#: Elements that never hold article text.
NEVER = frozenset(
    "head title nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu audio video datalist".split()
)
#: Names (class, id or role) of menus, notices, adverts, comments and the like.
HINTS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal "
    "overlay newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs crumb crumbs footer masthead "
    "comment comments commentlist disqus replies respond social share sharing related recommended recommendations widget toolbar pagination pager "
    "complementary contentinfo search alert alertdialog".split()
)
#: Words that may stand beside a hint in a name made of several words.
_BESIDE = frozenset(
    "area article articles bar block blog bottom box button buttons container content entry footer form global group header holder inner item "
    "items left link links list main message outer page panel post posts right section site stories story top wrap wrapper".split()
)


@lru_cache(maxsize=4096)
def named_boilerplate(names: str) -> bool:
    """Whether one of the names is a hint, or is made of hints and words beside them alone."""
    for name in names.lower().split():
        words = [w for w in re.split(r"[-_]+|[0-9]+$", name) if w]
        if any(w in HINTS for w in words) and all(w in HINTS or w in _BESIDE or w.isdigit() for w in words):
            return True
    return False


_ENDS_P = BLOCKS - {"head", "html", "body", "title", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
#: A start tag ends the open element of one of these kinds, unless one of the others stands between.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "body": ({"head"}, set()),
}


NAMED, SURE = 1, 2


class Node:
    """An element; mark is 0, NAMED (boilerplate by its name) or SURE (by its kind); children are nodes and strings."""

    __slots__ = ("tag", "label", "mark", "children")

    def __init__(self, tag: str, label: str = "", mark: int = 0):
        self.tag, self.label, self.mark, self.children = tag, label or tag, mark, []


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.stack = [self.root]

    def _close(self, kinds, walls) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in kinds:
                del self.stack[k:]
                return
            if self.stack[k].tag in walls:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._close({"p"}, {"td", "th", "button", "object", "caption"})
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        names, name, sure = [], "", tag in NEVER or tag == "header" and not any(n.tag in ("article", "main", "section") for n in self.stack)
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                names.append(value)
                if key == "class":
                    name = value
            elif key == "hidden" or key == "aria-hidden" and value == "true":
                sure = True
        named = names and tag not in ("html", "body", "article", "main") and named_boilerplate(" ".join(names))
        node = Node(tag, f"{tag}.{name}" if name else tag, SURE if sure else NAMED if named else 0)
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "span", "li", "article", "main", "section", "a", "b", "i"):
            self.handle_endtag(tag)  # others aren't ended by the slash in HTML

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def blocks(node: Node, skip=lambda n: False, least: int = NAMED) -> list[str]:
    """Texts of the blocks below a node, without elements marked at least so: white space is one blank, empty blocks go."""
    out: list[str] = []
    parts: list[str] = []

    def end() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(text)

    # Depth first with a stack of its own: pages may nest more deeply than Python allows.
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x is None:
            end()
        elif x.tag == "br":
            parts.append(" ")
        elif x is node or x.mark < least and not skip(x):
            if x.tag in BLOCKS:
                end()
                todo.append(None)
            todo.extend(reversed(x.children))
    end()
    return out


class Slot:
    """A run of like siblings in a page's skeleton: shape, the run's nodes, and slots of what all of them hold."""

    __slots__ = ("label", "shape", "nodes", "slots", "mark", "index")

    def __init__(self, label, shape, nodes, slots, mark):
        self.label, self.shape, self.nodes, self.slots, self.mark, self.index = label, shape, nodes, slots, mark, -1

    def take(self, other: Slot) -> None:
        """Add the nodes of a slot of the same shape, at all levels."""
        todo = [(self, other)]
        while todo:
            mine, theirs = todo.pop()
            mine.nodes.extend(theirs.nodes)
            todo.extend(zip(mine.slots, theirs.slots, strict=True))

    def text(self) -> str:
        """What the run's nodes hold themselves, without block elements of their own."""
        return "\n".join(" ".join("".join(_own(n)).split()) for n in self.nodes)

    def plain(self) -> int:
        """Characters of that text outside of links."""
        return sum(len(" ".join("".join(_own(n, {"a"})).split())) for n in self.nodes)


def _own(node: Node, without=frozenset()):
    todo = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        elif x.tag not in BLOCKS and not x.mark and x.tag not in without:
            todo.extend(reversed(x.children))


def skeleton(root: Node) -> Slot:
    """Slots of a page's block elements; neighbours of one shape make one slot. Shapes are equal where their digests are."""

    def add(slots: list[Slot], found: list[Slot]) -> None:
        for s in found:
            if slots and slots[-1].shape == s.shape:
                slots[-1].take(s)
            else:
                slots.append(s)

    # Post-order with a stack of its own: pages may nest more deeply than Python allows.
    stack: list[tuple[Node, list[Slot], object]] = [(root, [], iter(root.children))]
    while True:
        node, slots, rest = stack[-1]
        for child in rest:
            if not isinstance(child, str) and child.tag not in VOID and (child.tag in BLOCKS or not child.mark):
                stack.append((child, [], iter(child.children)))
                break
        else:
            stack.pop()
            if stack and node.tag not in BLOCKS:
                add(stack[-1][1], slots)  # blocks inside an inline element
                continue
            digest = blake2b(node.label.encode("utf-8", "replace"), digest_size=12)
            for s in slots:
                digest.update(s.shape)
            done = Slot(node.label, digest.digest(), [node], slots, node.mark)
            if not stack:
                return done
            add(stack[-1][1], [done])


def numbered(root: Slot) -> list[Slot]:
    """All slots in document order, with their numbers set."""
    out, todo = [], [root]
    while todo:
        s = todo.pop()
        s.index = len(out)
        out.append(s)
        todo.extend(reversed(s.slots))
    return out


def simple_tree_matching(a: Slot, b: Slot) -> list[tuple[int, int]]:
    """Numbers of the slots matched in a largest order- and level-keeping match of two skeletons with equal roots."""
    if a.label != b.label:
        return []
    # Pairs of equal label and place, level by level; then their match sizes from the deepest up.
    pairs, at = [(a, b)], 0
    while at < len(pairs):
        x, y = pairs[at]
        pairs.extend((p, q) for p in x.slots for q in y.slots if p.label == q.label)
        at += 1
    sizes: dict[tuple[int, int], int] = {}
    tables: dict[tuple[int, int], list[list[int]]] = {}
    for x, y in reversed(pairs):
        table = [[0] * (len(y.slots) + 1)]
        for p in x.slots:
            above, row = table[-1], [0]
            for j, q in enumerate(y.slots):
                row.append(max(row[j], above[j + 1], above[j] + sizes.get((p.index, q.index), 0)))
            table.append(row)
        tables[x.index, y.index] = table
        sizes[x.index, y.index] = 1 + table[-1][-1]
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x.index, y.index))
        table = tables[x.index, y.index]
        i, j = len(x.slots), len(y.slots)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                todo.append((x.slots[i - 1], y.slots[j - 1]))
                i, j = i - 1, j - 1
    return out
