"""Union-free regular expressions over element trees: inference, matching, text forms.

An expression is a sequence of items: an element (label, and an expression for
its children), a text slot, or a group of items; each may be optional and may
repeat.  Two streams are aligned by their longest common subsequence of labels;
what one lacks becomes optional, neighbours of one label become a repeated
item, and neighbouring runs of equal labels, as ``dt dd dt dd``, a repeated
group.  Every page that went into an expression is in its language, so a page
is matched against it exactly, by the positions that can follow each other.

Nothing here recurses over the depth of a page.  Groups within groups nest at
most as often as their items can be halved.
"""

from __future__ import annotations

import json

import numpy as np

SLOT = "#"


class Item:
    """``label`` is an element's name, ``#`` or, for a group, the tuple of its members' labels; ``kids`` are the
    children or members; ``parts``, while an expression is built, the elements whose children are still to be aligned."""

    __slots__ = ("label", "repeats", "optional", "kids", "parts")

    def __init__(self, label, repeats=0, optional=0, kids=(), parts=None):
        self.label, self.repeats, self.optional, self.kids, self.parts = label, repeats, optional, list(kids), parts

    @property
    def group(self) -> bool:
        return isinstance(self.label, tuple)


def _opened(item: Item) -> Item:
    """An item whose children are still to be aligned with others'."""
    if item.group:
        return Item(item.label, item.repeats, item.optional, [_opened(k) for k in item.kids])
    return Item(item.label, item.repeats, item.optional, parts=None if item.label == SLOT else [item])


def _joined(items: list[Item], repeats: int, optional: int) -> Item:
    """One item for several of one label."""
    first = items[0]
    if len(items) == 1:
        first.repeats, first.optional = repeats, optional
        return first
    out = Item(first.label, repeats, optional)
    if first.group:
        out.kids = [_joined(list(column), max(k.repeats for k in column), max(k.optional for k in column))
                    for column in zip(*[x.kids for x in items])]
    elif first.label != SLOT:
        out.parts = [p for x in items for p in x.parts or ()]
    return out


def _neighbours(items: list[Item]) -> list[Item]:
    """Neighbours of one label as one repeated item (texts just as one)."""
    out, at = [], 0
    while at < len(items):
        end = at + 1
        while end < len(items) and items[end].label == items[at].label:
            end += 1
        run = items[at:end]
        if len(run) > 1:
            run = [_joined(run, int(run[0].label != SLOT), min(x.optional for x in run))]
        out += run
        at = end
    return out


def _tandem(items: list[Item]) -> tuple[int, int, int] | None:
    """(start, period, times) of the shortest run of labels that is repeated next to itself."""
    n = len(items)
    if n < 4:
        return None
    names: dict = {}
    ids = np.array([names.setdefault(x.label, len(names)) for x in items])
    for period in range(2, n // 2 + 1):
        differ = np.flatnonzero(ids[:-period] != ids[period:])
        starts = np.concatenate(([0], differ + 1))
        lengths = np.append(differ, n - period) - starts
        found = np.flatnonzero(lengths >= period)
        if len(found):
            start, length = int(starts[found[0]]), int(lengths[found[0]])
            return start, period, length // period + 1
    return None


def collapse(items: list[Item]) -> list[Item]:
    """Repeated neighbours, single or in runs, as one item each."""
    items = _neighbours(items)
    while (found := _tandem(items)) is not None:
        start, period, times = found
        end = start + period * times
        group = [Item(tuple(x.label for x in items[at:at + period]), 0, 0, items[at:at + period])
                 for at in range(start, end, period)]
        items = _neighbours(items[:start] + [_joined(group, 1, 0)] + items[end:])
    return items


def _regrouped(items: list[Item], groups: set[tuple]) -> list[Item]:
    """Runs of labels that are a group on the other side, as that group."""
    for g in sorted(groups, key=len, reverse=True):
        out, at = [], 0
        while at < len(items):
            run = items[at:at + len(g)]
            if len(run) == len(g) and all(x.label == name for x, name in zip(run, g)):
                out.append(Item(g, 0, 0, run))
                at += len(g)
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def _common(a: np.ndarray, b: np.ndarray, at: int = 0, bt: int = 0) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence, in linear space."""
    out: list[tuple[int, int]] = []
    todo = [(at, len(a), bt, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            hit = np.flatnonzero(b[b0:b1] == a[a0])
            if len(hit):
                out.append((a0, b0 + int(hit[0])))
            continue
        mid = (a0 + a1) // 2
        front = _scores(a[a0:mid], b[b0:b1])
        back = _scores(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = b0 + int(np.argmax(front + back))
        todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
    return sorted(out)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and every prefix of ``b``."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """One sequence for two: common labels join, what one side lacks is optional."""
    if [x.label for x in a] != [x.label for x in b]:
        a, b = _regrouped(a, {x.label for x in b if x.group}), _regrouped(b, {x.label for x in a if x.group})
        a, b = _neighbours(a), _neighbours(b)
    names: dict = {}
    ia, ib = (np.array([names.setdefault(x.label, len(names)) for x in s], dtype=np.int64) for s in (a, b))
    out, i, j = [], 0, 0
    for p, q in [*_common(ia, ib), (len(a), len(b))]:
        for x in a[i:p] + b[j:q]:
            x.optional = 1
            out.append(x)
        if p < len(a):
            out.append(_joined([a[p], b[q]], a[p].repeats | b[q].repeats, a[p].optional | b[q].optional))
        i, j = p + 1, q + 1
    return collapse(out)


def merged(*trees: Item) -> Item:
    """The expression of several elements of one label, level by level from the top."""
    root = Item(trees[0].label, max(t.repeats for t in trees), max(t.optional for t in trees), parts=list(trees))
    todo = [root]
    while todo:
        item = todo.pop()
        if item.parts is not None:
            kids: list[Item] | None = None
            for part in item.parts:
                one = collapse([_opened(k) for k in part.kids])
                kids = one if kids is None else align(kids, one)
            item.kids, item.parts = kids or [], None
        todo += [k for k in item.kids if k.group or k.parts is not None]
    return root


def tree_item(node: list) -> Item:
    """A parsed page ([label, children], texts as ``#``) as nested items."""
    root = Item(node[0])
    todo = [(node, root)]
    while todo:
        source, item = todo.pop()
        for kid in source[1]:
            one = Item(kid if kid == SLOT else kid[0])
            item.kids.append(one)
            if kid != SLOT:
                todo.append((kid, one))
    return root


# ------------------------------------------------------------------ text forms
def encoded(root: Item, prune: bool = False) -> str:
    """JSON of the items in document order, each with its number of children; ``prune`` leaves out what is marked."""
    rows, todo = [], [root]
    while todo:
        item = todo.pop()
        kids = [] if prune and not item.group and item.label.endswith("!") else item.kids
        rows.append([None if item.group else item.label, item.repeats, item.optional, len(kids)])
        todo += reversed(kids)
    return json.dumps(rows, ensure_ascii=False, separators=(",", ":"))


def decoded(text: str) -> Item:
    rows = json.loads(text)
    root, stack, items = None, [], []
    for label, repeats, optional, n in rows:
        item = Item(label, repeats, optional)
        items.append(item)
        if stack:
            parent = stack[-1]
            parent[0].kids.append(item)
            parent[1] -= 1
        else:
            root = item
        if n:
            stack.append([item, n])
        while stack and stack[-1][1] == 0:
            stack.pop()
    for item in reversed(items):  # members before their group
        if item.label is None:
            item.label = tuple(k.label for k in item.kids)
    return root


def expression(root: Item) -> str:
    """The regular expression over tags and text slots."""
    out: list[str] = []
    todo: list = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        loose = x.repeats or x.optional
        tail = (")" + ("+" if x.repeats else "") + ("?" if x.optional else "")) if loose else ""
        head = "(" if loose else ""
        if x.group:
            head, tail = head or "(", tail or ")"
            parts = [head]
        elif x.label == SLOT:
            parts = [head + SLOT]
        elif x.label:
            parts = [f"{head}<{x.label}>"]
            tail = "</>" + tail
        else:
            parts = [head]
        todo.append(tail)
        todo += reversed(x.kids)
        todo.append(parts[0])
    text = " ".join(p for p in out if p)
    return text.replace("( ", "(").replace(" )", ")").replace("# )", "#)")


def regions_of(root: Item) -> set[str]:
    """Kinds of article regions (``@kind``) that hold text slots outside what is marked."""
    found, todo = set(), [(root, ())]
    while todo:
        item, within = todo.pop()
        if not item.group and item.label.endswith("!"):
            continue
        if item.label == SLOT:
            found |= set(within)
        elif not item.group and "@" in item.label:
            within = within if (kind := item.label.partition("@")[2]) in within else (*within, kind)
        todo += [(k, within) for k in item.kids]
    return found


# ------------------------------------------------------------------ matching
class Matcher:
    """The children of one element as positions: which stand for a label, and which may follow which."""

    def __init__(self, items: list[Item]):
        self.targets: list[Item] = []
        self.by_label: dict[str, int] = {}
        self.follow: list[int] = []
        self.first, self.last, self.empty = self._sequence(items)

    def _sequence(self, items: list[Item]) -> tuple[int, int, bool]:
        """(positions it may start with, may end with, whether it may be empty), as bit sets."""
        first, last, empty = 0, 0, True
        for x in items:
            if x.group:
                f, end, none = self._sequence(x.kids)
            else:
                bit = 1 << len(self.targets)
                self.by_label[x.label] = self.by_label.get(x.label, 0) | bit
                self.targets.append(x)
                self.follow.append(0)
                f, end, none = bit, bit, False
            if x.repeats:
                self._link(end, f)
            self._link(last, f)
            first |= f if empty else 0
            none = none or bool(x.optional)
            last = end | (last if none else 0)
            empty = empty and none
        return first, last, empty

    def _link(self, ends: int, starts: int) -> None:
        while ends:
            low = ends & -ends
            self.follow[low.bit_length() - 1] |= starts
            ends ^= low

    def _next(self, states: int) -> int:
        out = 0
        while states:
            low = states & -states
            out |= self.follow[low.bit_length() - 1]
            states ^= low
        return out

    def masks(self, labels: list[str]) -> list[int]:
        """For every label the positions that stand for it."""
        return [self.by_label.get(x, 0) for x in labels]

    def _reached(self, masks: list[int]) -> list[int]:
        """For every child the positions that it can be at; none where the expression has none for it."""
        reach, now, memo = [], self.first, {}
        for mask in masks:
            states = now & mask
            reach.append(states)
            if states:
                if states not in memo:
                    memo[states] = self._next(states)
                now = memo[states]
        return reach

    def accepts(self, masks: list[int]) -> bool:
        reach = self._reached(masks)
        return all(reach) and bool(reach[-1] & self.last) if reach else self.empty

    def place(self, masks: list[int]) -> list[int]:
        """One position for every child, each able to follow the one before; -1 where there is none."""
        reach = self._reached(masks)
        out, wanted = [-1] * len(masks), None
        for k in range(len(masks) - 1, -1, -1):
            states = reach[k]
            if not states:
                continue
            if wanted is None:
                fit = states & self.last or states
            else:
                fit, rest = 0, states
                while rest and not fit:
                    low = rest & -rest
                    if self.follow[low.bit_length() - 1] >> wanted & 1:
                        fit = low
                    rest ^= low
                fit = fit or states
            wanted = (fit & -fit).bit_length() - 1
            out[k] = wanted
        return out


class Wrapper:
    """An expression with the matchers of its elements, made when a page first needs them."""

    def __init__(self, text: str):
        self.root, self.matchers, self.elements = decoded(text), {}, None

    def matcher(self, item: Item) -> Matcher:
        if id(item) not in self.matchers:
            self.matchers[id(item)] = Matcher(item.kids)
        return self.matchers[id(item)]

    def _by_label(self) -> dict[str, list[Item]]:
        """The expression's elements by label."""
        if self.elements is None:
            self.elements = {}
            todo = [self.root]
            while todo:
                item = todo.pop()
                if not item.group and item.label != SLOT:
                    self.elements.setdefault(item.label, []).append(item)
                todo += item.kids
        return self.elements

    def _fitting(self, tree: list) -> dict[int, set[int]]:
        """For every element of a page the items whose whole expression it matches, from the leaves up."""
        order, todo = [], [tree]
        while todo:
            node = todo.pop()
            order.append(node)
            if not node[0].endswith("!"):
                todo += [k for k in node[1] if k != SLOT]
        fits: dict[int, set[int]] = {}
        for node in reversed(order):
            items = self._by_label().get(node[0], [])
            if not node[0].endswith("!"):
                items = [x for x in items if self.matcher(x).accepts(self._masks(x, node, fits))]
            fits[id(node)] = {id(x) for x in items}
        return fits

    def _masks(self, item: Item, node: list, fits: dict[int, set[int]] | None) -> list[int]:
        matcher = self.matcher(item)
        masks = matcher.masks([k if k == SLOT else k[0] for k in node[1]])
        if fits is not None:
            for i, kid in enumerate(node[1]):
                if kid != SLOT and masks[i] & (masks[i] - 1):
                    masks[i] = sum(1 << p for p, x in enumerate(matcher.targets) if masks[i] >> p & 1 and id(x) in fits[id(kid)])
                elif kid != SLOT and masks[i] and id(matcher.targets[masks[i].bit_length() - 1]) not in fits[id(kid)]:
                    masks[i] = 0
        return masks

    def locate(self, tree: list) -> dict[tuple[int, int], str]:
        """The slot of each text of a page, by (identity of its element, position there).  A slot is named by the
        positions of the expression on the way to it; what the expression lacks by its label.

        Labels alone mostly decide.  Where they led to an element that lacks a child of the page, one label stands at
        several positions with different children, and the page is matched again by whole elements."""
        at, whole = self._located(tree, None)
        return at if whole else self._located(tree, self._fitting(tree))[0]

    def _located(self, tree: list, fits: dict[int, set[int]] | None) -> tuple[dict[tuple[int, int], str], bool]:
        at: dict[tuple[int, int], str] = {}
        todo: list[tuple[list, Item | None, str]] = [(tree, self.root, "")]
        whole = True
        while todo:
            node, item, address = todo.pop()
            if not node[1]:
                continue
            places = self.matcher(item).place(self._masks(item, node, fits)) if item is not None else [-1] * len(node[1])
            whole &= min(places) >= 0
            for i, (kid, p) in enumerate(zip(node[1], places)):
                label = kid if kid == SLOT else kid[0]
                here = f"{address}/{p if p >= 0 else label}"
                if kid == SLOT:
                    at[id(node), i] = here
                elif not label.endswith("!"):
                    todo.append((kid, self.matcher(item).targets[p] if p >= 0 else None, here))
        return at, whole
