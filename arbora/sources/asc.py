"""Neurolucida ASC: lexer, parser and conversion to nodes.

A file is a list of trees in parentheses. A tree opens with its colour, type and other properties,
goes on with points, and splits at a nested block whose alternatives are parted by bars.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

TYPES = {"CELLBODY": 1, "AXON": 2, "DENDRITE": 3, "APICAL": 4}


@dataclass
class Token:
    kind: str  # one of ( ) | , float literal comment
    value: object
    line: int
    column: int


class AscError(ValueError):
    """What was found where something else must stand, with line and column."""

    def __init__(self, expected: str, token: Token | None):
        at = f"line {token.line}, column {token.column}: {token.value!r}" if token else "the end of the text"
        super().__init__(f"expected {expected} at {at}")
        self.token = token


@dataclass
class Node:
    """TREE, COLOR, COMMENT or POINT (value x, y, z, r) with what it holds; a split is a TREE of TREEs."""

    kind: str
    value: object = None
    children: list[Node] = field(default_factory=list)


def tokens(text: str) -> Iterator[Token]:
    """Parentheses, bars, commas, numbers, words, quoted strings and ``;`` comments."""
    i, line, start, n = 0, 1, 0, len(text)
    while i < n:
        c = text[i]
        if c == "\n":
            line, start, i = line + 1, i + 1, i + 1
        elif c.isspace():
            i += 1
        elif c in "()|,<>":
            yield Token(c, c, line, i - start + 1)
            i += 1
        elif c == ";":
            e = text.find("\n", i)
            e = n if e < 0 else e
            yield Token("comment", text[i + 1 : e].strip(), line, i - start + 1)
            i = e
        elif c == '"':
            e = text.find('"', i + 1)
            if e < 0:
                raise AscError("a closing quote", Token("literal", text[i:], line, i - start + 1))
            yield Token("literal", text[i + 1 : e], line, i - start + 1)
            i = e + 1
        else:
            e = i
            while e < n and not text[e].isspace() and text[e] not in '()|,;"<>':
                e += 1
            word = text[i:e]
            try:
                yield Token("float", float(word), line, i - start + 1)
            except ValueError:
                yield Token("literal", word, line, i - start + 1)
            i = e


class Parser:
    def __init__(self, text: str):
        self.all = list(tokens(text))
        self.at = 0

    def _peek(self, ahead: int = 0) -> Token | None:
        return self.all[self.at + ahead] if self.at + ahead < len(self.all) else None

    def _next(self, kind: str | None = None) -> Token:
        t = self._peek()
        if t is None or kind is not None and t.kind != kind:
            raise AscError(kind or "more", t)
        self.at += 1
        return t

    def parse(self) -> list[Node]:
        """The trees and comments of the text."""
        out = []
        while (t := self._peek()) is not None:
            if t.kind == "comment":
                out.append(Node("COMMENT", self._next().value))
            elif t.kind == "(":
                self._next()
                out.append(self._block())
            else:
                raise AscError("( or a comment", t)
        return out

    def _block(self) -> Node:
        """What follows an opening parenthesis, up to its end: a TREE (type or None)."""
        tree, kind = Node("TREE"), None
        branch = tree.children
        alternatives: list[Node] = []
        # nested blocks have no loop of their own in Python: `stack` holds the open ones
        stack: list[tuple] = []
        while True:
            t = self._next()
            if t.kind == ")":
                if alternatives:
                    alternatives.append(Node("TREE", None, branch))
                    tree.children = alternatives
                tree.value = kind
                if not stack:
                    return tree
                done = tree
                tree, kind, branch, alternatives = stack.pop()
                branch.append(done)
            elif t.kind == "|":
                alternatives.append(Node("TREE", None, branch))
                branch = []
            elif t.kind == "comment":
                branch.append(Node("COMMENT", t.value))
            elif t.kind == "literal":
                word = str(t.value).upper()
                if word in TYPES:
                    kind = word
                elif word not in ("NORMAL", "INCOMPLETE", "LOW", "HIGH", "GENERATED", "MIDPOINT"):
                    raise AscError("a point, a block or an ending", t)
            elif t.kind == "(":
                a = self._peek()
                if a is not None and a.kind == "float":
                    branch.append(self._point())
                elif a is not None and a.kind == "literal":
                    word = str(a.value).upper()
                    if word == "COLOR":
                        self._next()
                        branch.append(Node("COLOR", self._colour()))
                    elif word in TYPES and self._peek(1) is not None and self._peek(1).kind == ")":
                        self._next()
                        self._next(")")
                        kind = word
                    else:
                        self._skip()  # another property
                else:
                    stack.append((tree, kind, branch, alternatives))
                    tree, kind = Node("TREE"), None
                    branch, alternatives = tree.children, []
            elif t.kind in ("<", ">", ","):
                continue  # spines and separators
            else:
                raise AscError("a parenthesis, a bar or a comment", t)

    def _point(self) -> Node:
        v = []
        while (t := self._next()).kind in ("float", ","):
            if t.kind == "float":
                v.append(t.value)
        while t.kind == "literal":  # a mark such as S1
            t = self._next()
        if t.kind != ")" or len(v) < 3:
            raise AscError("x y z r and )", t)
        return Node("POINT", (v[0], v[1], v[2], v[3] if len(v) > 3 else 0.0))

    def _colour(self) -> str:
        t = self._next()
        if t.kind != "literal":
            raise AscError("a colour", t)
        value = str(t.value).upper()
        if (n := self._peek()) is not None and n.kind == "(":
            self._next()
            parts = []
            while (t := self._next()).kind in ("float", ","):
                if t.kind == "float":
                    parts.append(str(int(t.value)))
            if t.kind != ")":
                raise AscError(")", t)
            value += f" ({', '.join(parts)})"
        self._next(")")
        return value

    def _skip(self) -> None:
        depth = 1
        while depth:
            k = self._next().kind
            depth += (k == "(") - (k == ")")


def nodes_of(text: str) -> list[tuple[int, int, float, float, float, float, int]]:
    """(id, type, x, y, z, r, pid) in preorder; each top-level tree starts with pid -1."""
    out: list[tuple] = []
    for top in Parser(text).parse():
        if top.kind != "TREE":
            continue
        todo: list[tuple[Node, int, int]] = [(top, -1, 0)]
        while todo:
            node, pid, kind = todo.pop()
            kind = TYPES.get(node.value, kind) if isinstance(node.value, str) else kind
            later = []
            for c in node.children:
                if c.kind == "POINT":
                    out.append((len(out), kind, *c.value, pid))
                    pid = len(out) - 1
                elif c.kind == "TREE":
                    later.append((c, pid, kind))
            todo += reversed(later)
    return out


SCHEMA = "tree_id string, id int, type int, x double, y double, z double, r double, pid int"


def asc_nodes(texts: DataFrame) -> DataFrame:
    """Node table of rows (tree_id, text)."""

    def run(batches):
        for pdf in batches:
            rows = [(t, *n) for t, x in zip(pdf.tree_id, pdf.text) for n in nodes_of(x or "")]
            yield pd.DataFrame(rows, columns=["tree_id", "id", "type", "x", "y", "z", "r", "pid"])

    return texts.select("tree_id", "text").mapInPandas(run, SCHEMA)


def read_asc(spark: SparkSession, path: str) -> DataFrame:
    """Node table of ASC files."""
    from pyspark.sql import functions as F

    return asc_nodes(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("tree_id"), F.col("value").alias("text")))
