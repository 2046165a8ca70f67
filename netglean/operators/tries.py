"""Signature tables that are walked instead of compared one by one: a trie of header lists, and an automaton of tokens. Both are built from bounded tables and sent to all tasks."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "STRUCT<dist: INT, kind: STRING, class: STRING, name: STRING, flavor: STRING, signature: STRING>"
_MATCH = pa.struct([("dist", pa.int32()), *((n, pa.string()) for n in ("kind", "class", "name", "flavor", "signature"))])
#: More errors than this are incompatible; classes of errors by their greatest number.
MOST_ERRORS, CLASSES = 11, (2, 5, 8, 11)
#: Results of so many observations are kept by a worker.
KEPT = 100_000

Header = tuple[bool, str, "str | None"]  # optional, name, value


def error_class(errors: int) -> int | None:
    return next((c for c, most in enumerate(CLASSES) if errors <= most), None)


def list_errors(observed: list[tuple[str, str | None]], signature: tuple[Header, ...]) -> int:
    """Errors of an observed header list against a signature's, the rule of http.distance."""
    at = errors = 0
    for optional, name, value in signature:
        same = at < len(observed) and observed[at][0] == name
        if not optional and not (same and observed[at][1] == value):
            errors += 1
        at += same
    return errors + len(observed) - at


class _Node:
    __slots__ = ("children", "depth", "least", "signatures")

    def __init__(self):
        self.children: dict[Header, _Node] = {}
        self.signatures: list[tuple] = []  # (rank, absent, software, label...) of the lists that end here
        self.depth, self.least = 0, None  # longest way below, and the least rank here and below


class HeaderTrie:
    """Signatures of one direction and version by their header lists. A prefix that many share is walked once.

    The walk is depth first, equal headers first, and bounded: a branch is left when its errors, with those that observed headers beyond its longest way will add, make a
    distance greater than the best so far, or an equal one while all of its ranks are greater.
    """

    def __init__(self):
        self.root = _Node()

    def add(self, headers: list[Header], rank: tuple[int, int], absent: list[Header], software: str | None, label: tuple) -> None:
        node, path = self.root, [self.root]
        for h in headers:
            node = node.children.setdefault(h, _Node())
            path.append(node)
        node.signatures.append((rank, tuple(absent), software, label))
        for left, n in enumerate(reversed(path)):
            n.depth = max(n.depth, left)
            n.least = rank if n.least is None else min(n.least, rank)

    def best(self, observed: list[tuple[str, str | None]], absent: list[tuple[str, str | None]], software: str, corrected: bool) -> tuple[int, tuple] | None:
        """Distance and label of the nearest signature, the first of the file among equals."""
        best, rank, label, size, seen = 1 << 30, None, None, len(observed), {}
        stack = [(self.root, 0, 0)]
        while stack:
            node, at, errors = stack.pop()
            least = error_class(errors + max(0, size - at - node.depth))
            if least is None or least > best or least == best and node.least >= rank:
                continue
            if node.signatures and (own := error_class(errors + size - at)) is not None:
                for r, missing, text, told in node.signatures:
                    if missing not in seen:
                        seen[missing] = error_class(list_errors(absent, missing))
                    if seen[missing] is not None:
                        hit = text is not None and (text in software if corrected else software in text)
                        d = own + seen[missing] + (0 if hit else 3)
                        if rank is None or (d, r) < (best, rank):
                            best, rank, label = d, r, told
            name, value = observed[at] if at < size else (None, None)
            equal = []
            for (optional, n, v), child in node.children.items():
                if n == name:
                    equal.append((child, at + 1, errors + (not optional and v != value)))
                elif errors + (not optional) <= MOST_ERRORS:
                    stack.append((child, at, errors + (not optional)))
            stack += sorted(equal, key=lambda e: -e[2])
        return None if label is None else (best, label)


def header_matcher(signatures: list[tuple], versions: dict[str, tuple[str, ...]], corrected: bool = False) -> Callable[[Column, Column, Column], Column]:
    """A function of direction, version and a JSON text of the observation (horder, habsent, software) that gives MATCH.

    signatures: (label_idx, sig_idx, kind, class, name, flavor, direction, version, horder, habsent, software, text). versions: what a wildcard stands for. Equal observations of a batch are
    matched once, and a worker keeps what it found.
    """
    tries: dict[tuple[str, str], HeaderTrie] = {}
    for label, sig, kind, class_, name, flavor, direction, version, horder, habsent, software, text in signatures:
        for v in versions.get(version, (version,)):
            tries.setdefault((direction, v), HeaderTrie()).add([tuple(h) for h in horder], (label, sig), [tuple(h) for h in habsent], software, (kind, class_, name, flavor, text))
    kept: dict[tuple, dict | None] = {}

    def one(direction: str | None, version: str | None, text: str | None) -> dict | None:
        trie = tries.get((direction, version))
        if trie is None or text is None:
            return None
        o = json.loads(text)
        headers = lambda k: [(h.get("name"), h.get("value")) for h in o.get(k) or []]
        found = trie.best(headers("horder"), headers("habsent"), o.get("software", "???"), corrected)
        return None if found is None else dict(zip(("dist", "kind", "class", "name", "flavor", "signature"), (found[0], *found[1])))

    def match(direction: pa.Array, version: pa.Array, text: pa.Array) -> pa.Array:
        seen: dict[tuple, int] = {}
        out, at = [], []
        for key in zip(direction.to_pylist(), version.to_pylist(), text.to_pylist()):
            i = seen.setdefault(key, len(out))
            if i == len(out):
                if key not in kept:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[key] = one(*key)
                out.append(kept[key])
            at.append(i)
        return pa.array(out, _MATCH).take(pa.array(at, pa.int64()))

    match.__annotations__ = {"direction": pa.Array, "version": pa.Array, "text": pa.Array, "return": pa.Array}
    return F.arrow_udf(match, MATCH)


class Tokens:
    """An Aho-Corasick automaton: one pass over a text finds the least number of all tokens that it contains. Of equal tokens the first counts; an empty one is in every text."""

    def __init__(self, tokens: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.least: list[int | None] = [None]
        for number, token in enumerate(tokens):
            state = 0
            for c in token:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.least.append(None)
                state = self.next[state][c]
            if self.least[state] is None:
                self.least[state] = number
        self.fail, queue = [0] * len(self.next), deque(self.next[0].values())
        while queue:
            state = queue.popleft()
            for c, to in self.next[state].items():
                queue.append(to)
                back = self.fail[state]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[to] = self.next[back].get(c, 0)
            numbers = [n for n in (self.least[state], self.least[self.fail[state]], self.least[0]) if n is not None]
            self.least[state] = min(numbers, default=None)

    def first(self, text: str) -> int | None:
        state, found = 0, self.least[0]
        for c in text:
            while state and c not in self.next[state]:
                state = self.fail[state]
            state = self.next[state].get(c, 0)
            n = self.least[state]
            if n is not None and (found is None or n < found):
                found = n
        return found


def first_token(tokens: list[str], values: list[str]) -> Callable[[Column], Column]:
    """A function of texts that gives the value of the first token that a text contains; each distinct text of a batch is read once."""
    automaton = Tokens(tokens)

    def look(texts: pa.Array) -> pa.Array:
        d = texts.dictionary_encode()
        found = [None if (n := automaton.first(t)) is None else values[n] for t in d.dictionary.to_pylist()]
        return pa.array(found, pa.string()).take(d.indices)

    look.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(look, "string")
