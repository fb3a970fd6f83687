"""Tree edit score of HTML: documents become ordered trees in flat arrays, and a score is 1 - distance / larger size.

A node is an element (no label, but its row and column span) or a stretch of text without white space.  Inserting or
removing a node costs 1; changing one into another costs the normalised edit distance of their labels if the spans are
equal, else 1.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Tags of inline style that carry no structure, and elements of HTML that have no content or end on their own.
STYLE_TAGS = ["br", "a", "b", "strong", "i", "em", "u", "ins", "s", "del", "sub", "sup", "q", "blockquote", "cite", "mark", "code", "samp", "kbd", "var", "pre"]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDED_BY = {"li": {"li"}, "p": {"p", "div", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "section"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot", "tr"}, "tbody": {"tbody", "tfoot"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
HEAD = {"html", "head", "title", "meta", "link", "base", "body"}
MAX_DEPTH = 100
#: A style tag with attributes that hold no white space of their own, as one match without a repeated group.
_STYLE = re.compile(r"<(?:%s)(?:\s[^<>]*)?/?>|</(?:%s)>" % ("|".join(STYLE_TAGS), "|".join(STYLE_TAGS)))


class _Builder(HTMLParser):
    """Nested lists of (spans, children) or texts, with the tags closed that HTML lets authors leave open."""

    def __init__(self, keep: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.root: tuple = (("1", "1"), [])
        self.open: list[tuple[str, tuple]] = [("body", self.root)]
        self.keep, self.kept, self.skipped = keep, [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("head", "title", "script", "style"):
            self.skipped += tag not in VOID
            return
        if tag in HEAD or self.skipped:
            return
        while len(self.open) > 1 and tag in ENDED_BY.get(self.open[-1][0], ()):
            self.open.pop()
        if tag == "tr" and self.open[-1][0] == "table":
            self._push("tbody", ("1", "1"))
        found = dict(attrs)
        self._push(tag, (found.get("rowspan") or "1", found.get("colspan") or "1"))
        if tag in VOID:
            self.open.pop()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1][0] == tag:
            self.open.pop()

    def _push(self, tag: str, spans: tuple) -> None:
        node = (spans, [])
        self.open[-1][1][1].append(node)
        if tag == self.keep and all(t != tag for t, _ in self.open):
            self.kept.append(node)
        self.open.append((tag, node))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("head", "title", "script", "style"):
            self.skipped = max(0, self.skipped - 1)
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i][0] == tag), None)
        if at is not None and tag not in HEAD:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        text = re.sub(r"\s+", "", data)
        if text and not self.skipped:
            self.open[-1][1][1].append(text)


def fenced(text: str) -> str:
    """What stands in the first ``html`` fence, if anything; else the text."""
    inside = text.partition("```html")[2].partition("```")[0].strip()
    return inside or text


class Tree:
    """Labels, spans and leftmost leaves of the nodes in postorder."""

    def __init__(self, html: str, keep: str | None = None) -> None:
        builder = _Builder(keep)
        builder.feed(_STYLE.sub("", fenced(html)))
        builder.close()
        root = (("1", "1"), builder.kept) if keep else builder.root
        self.labels: list[str] = []
        self.spans: list[tuple] = []
        self.first: list[int] = []
        # Postorder without recursion: a frame is a node with its children left to do and the place of its first leaf.
        stack = [[root, iter(root[1]), 0, 1, None]]  # node, children, first, depth, only child so far
        while stack:
            node, children, first, depth, _ = frame = stack[-1]
            child = next(children, None)
            if child is None:
                stack.pop()
                only = self._only(len(self.labels), first)
                # An element with one child of the same kind is that child.
                if not (only is not None and self.labels[only] == "" and self.spans[only] == node[0]):
                    self._add("", node[0], first)
            elif depth < MAX_DEPTH:
                if isinstance(child, str):
                    self._add(child, ("", ""), len(self.labels))
                else:
                    stack.append([child, iter(child[1]), len(self.labels), depth + 1, None])
        self.first_of = np.array(self.first, np.int64)
        n = len(self.labels)
        last = {f: i for i, f in enumerate(self.first)}  # key roots: the last node of each leftmost leaf
        self.roots = sorted(last.values())
        self.size = n

    def _only(self, end: int, first: int) -> int | None:
        """The only child of a node whose subtree's nodes are first .. end - 1, if it has one child."""
        return end - 1 if end > first and self.first[end - 1] == first else None

    def _add(self, label: str, spans: tuple, first: int) -> None:
        self.labels.append(label)
        self.spans.append(spans)
        self.first.append(first)


def _changes(a: Tree, b: Tree) -> np.ndarray:
    """Cost of changing each node of ``a`` into each of ``b``; equal labels are compared once, each with all others at once."""
    kinds_a, at_a = _kinds(a)
    kinds_b, at_b = _kinds(b)
    cost = np.ones((len(kinds_a), len(kinds_b)))
    for spans in {k for _, k in kinds_a} & {k for _, k in kinds_b}:
        rows, columns = ([i for i, (_, k) in enumerate(kinds) if k == spans] for kinds in (kinds_a, kinds_b))
        cost[np.ix_(rows, columns)] = _label_costs([kinds_a[i][0] for i in rows], [kinds_b[j][0] for j in columns])
    return cost[np.ix_(at_a, at_b)]


def _label_costs(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised edit distances of all pairs, for a text of ``b`` those from all of ``a`` in one go.

    The texts of ``a`` lie side by side in one number with a free bit after each, so that no carry reaches the next one;
    their columns of distances are held as the bits of rises and falls.
    """
    sizes = np.array([len(x) for x in a], np.int64)
    ends = np.cumsum(sizes + 1)
    points = np.frombuffer("\0".join([*a, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    free = np.zeros(len(points), bool)
    free[ends - 1] = True
    number = lambda bits: int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    every, heads = number(~free), number(np.concatenate(([True], free[:-1])) & ~free)
    places = {w: number((points == ord(w)) & ~free) for w in set().union(*b)}
    out = np.empty((len(a), len(b)))
    for j, text in enumerate(b):
        rises, falls = every, 0
        for w in text:
            same = places[w]
            level = (((same & rises) + rises) ^ rises) & every | same
            up, down = falls | ~(level | rises) & every, rises & level
            up, down, same = (up << 1 | heads) & every, down << 1 & every, same | falls
            rises, falls = down | ~(same | up) & every, up & same
        steps = [np.unpackbits(np.frombuffer(x.to_bytes(len(points) // 8 + 1, "little"), np.uint8), bitorder="little") for x in (rises, falls)]
        rest = np.concatenate(([0], np.cumsum(steps[0].astype(np.int64) - steps[1])))
        out[:, j] = (len(text) + rest[ends] - rest[ends - 1 - sizes]) / np.maximum(np.maximum(sizes, len(text)), 1)
    return out


def _kinds(tree: Tree) -> tuple[list, np.ndarray]:
    seen: dict = {}
    at = np.array([seen.setdefault(k, len(seen)) for k in zip(tree.labels, tree.spans, strict=True)], np.int64)
    return list(seen), at


def _shapes(tree: Tree) -> list[tuple[np.ndarray, list[int]]]:
    """Key roots of equal subtrees that do not lie within each other, inner ones first: (places of first leaves, shape)."""
    found: dict[tuple, list[int]] = {}
    level = _level(tree)
    for root in tree.roots:
        lo = tree.first[root]
        found.setdefault((level[root], tuple(f - lo for f in tree.first[lo : root + 1])), []).append(lo)
    return [(np.array(found[k], np.int64), list(k[1])) for k in sorted(found, key=lambda k: k[0])]


def _level(tree: Tree) -> dict[int, int]:
    """Key roots with how many lie within each other up to them."""
    level: dict[int, int] = {}
    inside: list[tuple[int, int]] = []  # key roots that no later one has covered yet, with the highest level among them
    for root in tree.roots:
        most = 0
        while inside and inside[-1][0] >= tree.first[root]:
            most = max(most, inside.pop()[1])
        level[root] = most + 1
        inside.append((root, most + 1))
    return level


def _levels(tree: Tree) -> list[tuple[np.ndarray, ...]]:
    """Key roots in groups that do not lie within each other, inner ones first, each group as flat arrays.

    A group holds, one subtree after another: its nodes; where the forest before each node's subtree ends, and where the
    node itself stands, among the columns (one more a subtree, for the empty forest); whether that forest is empty; the
    place of each column in its subtree; and the number of the subtree.
    """
    level = _level(tree)
    out = []
    for k in range(1, max(level.values(), default=0) + 1):
        nodes, ends, columns, whole, place, part, base = [], [], [], [], [], [], 0
        for n, root in enumerate(r for r in tree.roots if level[r] == k):
            mine = np.arange(tree.first[root], root + 1)
            before = tree.first_of[mine] - mine[0]
            nodes.append(mine)
            ends.append(base + before)
            columns.append(base + 1 + mine - mine[0])
            whole.append(before == 0)
            place.append(np.arange(len(mine) + 1))
            part.append(np.full(len(mine) + 1, n))
            base += len(mine) + 1
        out.append(tuple(np.concatenate(x) for x in (nodes, ends, columns, whole, place, part)))
    return out


def distance(a: Tree, b: Tree) -> float:
    """Least cost of turning one ordered tree into the other, by the shapes of ``a``'s key roots and level by level of ``b``."""
    if not a.size or not b.size:
        return float(max(a.size, b.size))
    if (a.labels, a.spans, a.first) == (b.labels, b.spans, b.first):
        return 0.0
    change, trees = _changes(a, b), np.zeros((a.size, b.size))
    apart = float(2 * (a.size + b.size + 1))  # more than any cost, so that one subtree's values never reach the next
    levels = _levels(b)
    for lefts, shape in _shapes(a):
        for nodes, ends, columns, whole, place, part in levels:
            shift = place + apart * part
            forest = np.empty((len(shape) + 1, len(lefts), len(place)))
            forest[0] = place
            for x, before in enumerate(shape):
                at = (lefts + x)[:, None]
                option = forest[before][:, ends] + trees[at, nodes]
                if before == 0:  # both are whole trees from the forest's left edge: a node may be changed
                    option = np.where(whole, forest[x][:, columns - 1] + change[at, nodes], option)
                best = np.full((len(lefts), len(place)), float(x + 1))
                best[:, columns] = np.minimum(forest[x][:, columns] + 1, option)
                # Insertions: each place takes the least of what is left of it, plus the steps to it.
                forest[x + 1] = np.minimum.accumulate(best - shift, axis=1) + shift
                if before == 0:
                    trees[at, nodes[whole]] = forest[x + 1][:, columns[whole]]
    return float(trees[-1, -1])


def score(label: str | None, prediction: str | None, keep: str | None = None) -> float | None:
    """1 - distance over the larger tree, at least 0."""
    a, b = Tree(label or "", keep), Tree(prediction or "", keep)
    return max(1.0 - distance(b, a) / max(_from_nothing(a), _from_nothing(b), 1.0), 0.0)


def _from_nothing(tree: Tree) -> float:
    """Distance from the tree of an empty document, a bare element: all nodes but one, which may have to be changed."""
    bare = any(not x and s == ("1", "1") for x, s in zip(tree.labels, tree.spans, strict=True))
    return float(max(tree.size, 1) - (bare and tree.size > 0))


#: What is kept of both sides by kind of sample.
KEEP = {"table": "table", "equation": "math"}


@F.pandas_udf(T.DoubleType())
def tree_edit_score(labels: pd.Series, prediction: pd.Series, kind: pd.Series) -> pd.Series:
    """Best score over the labels; null without a label or with an empty prediction.  ``kind``: table, equation or null."""

    def best(labels, prediction: str | None, kind: str | None) -> float | None:
        if labels is None or not len(labels) or not prediction:
            return None
        return max(score(x, prediction, KEEP.get(kind)) for x in labels)

    return pd.Series([best(*row) for row in zip(labels, prediction, kind, strict=True)], dtype="float64")


def tree_edit_mean(score: Column) -> Column:
    """Mean of the scores there are; 0 without any."""
    return F.coalesce(F.avg(score), F.lit(0.0))
