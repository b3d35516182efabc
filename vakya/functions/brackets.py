"""Bracketed trees as nested tuples: (label, [children]) for phrases, (label, word) for preterminals."""

from __future__ import annotations

import re

_PIECE = re.compile(r"\(|\)|[^\s()]+")


def parse(text: str | None):
    """The tree of a bracketed string; None where it is null, empty or not balanced."""
    stack, done, fresh = [], None, False
    for piece in _PIECE.findall(text or ""):
        if done is not None:
            return None
        if piece == "(":
            stack.append(["", []])
            fresh = True
        elif piece == ")":
            if not stack:
                return None
            label, kids = stack.pop()
            node = (label, kids[0] if len(kids) == 1 and isinstance(kids[0], str) else kids)
            if any(isinstance(k, str) for k in kids) and not isinstance(node[1], str):
                return None
            if stack:
                stack[-1][1].append(node)
            else:
                done = node
            fresh = False
        elif fresh:
            stack[-1][0], fresh = piece, False
        elif stack:
            stack[-1][1].append(piece)
        else:
            return None
    return None if stack else done


def show(node) -> str:
    label, kids = node
    return f"({label} {kids})" if isinstance(kids, str) else f"({label} {' '.join(map(show, kids))})"


def spans(node) -> list[tuple[str, int, int, int]]:
    """(label, first leaf, last leaf, depth) of every phrase, preterminals left out; leaves count from 0."""
    out = []

    def walk(n, at, depth):
        if isinstance(n[1], str):
            return at + 1
        slot, end = len(out), at
        out.append(None)
        for kid in n[1]:
            end = walk(kid, end, depth + 1)
        out[slot] = (n[0], at, end - 1, depth)
        return end

    walk(node, 0, 0)
    return out


def without_unaries(node):
    """A phrase over a single phrase takes that one's place; labels of the upper one stay."""
    label, kids = node
    while not isinstance(kids, str) and len(kids) == 1:
        kids = kids[0][1]
    return (label, kids if isinstance(kids, str) else [without_unaries(k) for k in kids])


def binary(node):
    """Right-branching binarisation; what a label made is marked with a bar."""
    label, kids = node
    if isinstance(kids, str):
        return node
    kids = [binary(k) for k in kids]
    bar = label if label.endswith("|") else label + "|"
    while len(kids) > 2:
        kids[-2:] = [(bar, kids[-2:])]
    return (label, kids)


def right_branching(words: list[str]):
    """Baseline tree of a sentence; None without words."""
    if not words:
        return None
    tree = ("1", words[-1])
    for w in reversed(words[:-1]):
        tree = ("1", [("1", w), tree])
    return tree


def rules(node) -> list[tuple[str, str, str, str]]:
    """(kind, parent, left, right) of a binary tree: Cr root, CC binary, Cu unary, X lexical; '-' where absent."""
    out = [("Cr", "T", node[0], "-")]
    todo = [node]
    while todo:
        label, kids = todo.pop()
        if isinstance(kids, str):
            out.append(("X", label, kids, "-"))
        elif len(kids) == 1:
            out.append(("Cu", label, kids[0][0], "-"))
        else:
            out.append(("CC", label, kids[0][0], kids[1][0]))
        if not isinstance(kids, str):
            todo += kids
    return out


def of_dependencies(words: list[str], tags: list[str], heads: list[int | None]):
    """Flat phrases: a token with dependents becomes (TAGP left... (TAG word) right...); tokens that reach no root are left out."""
    kids: dict[int, list[int]] = {}
    for i, h in enumerate(heads, 1):
        kids.setdefault(-1 if h is None else h, []).append(i)
    roots = kids.get(0, [])
    if not roots:
        return None

    def build(i):
        leaf = (tags[i - 1], words[i - 1])
        below = kids.get(i, [])
        if not below:
            return leaf
        return (tags[i - 1] + "P", [build(k) for k in below if k < i] + [leaf] + [build(k) for k in below if k > i])

    return ("S", [build(r) for r in roots])
