"""Splits texts into pieces that a byte-level tokenizer treats apart from each other, so that work on equal pieces is done once."""

from __future__ import annotations

import re

import regex

#: As public_tokenizers.PATTERN; white space is the Unicode property, as in the tokenizer libraries.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def compiled(pattern: str = PATTERN) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


_UNSAFE = regex.compile(r"\p{White_Space} (?:\p{White_Space}|$)")


def spaced(text: str) -> list[str] | None:
    """The text cut before each space, or None where a cut might fall inside a match.

    A match never spans a space at which the text before ends in a non-space or the text after begins with one:
    a match takes a space only as its first character, or in a run of white space that goes on.
    """
    if _UNSAFE.search(text):
        return None
    first, *rest = text.split(" ")
    return [first] * bool(first) + [f" {x}" for x in rest]


#: One run of letters, all in the blocks Basic Latin to Latin Extended-B, with at most one mark after it.
_PLAIN = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,]?)")


def matches(piece: str, pattern: regex.Pattern) -> list[str]:
    """The pattern's matches in a piece; the usual ones, a word with or without a stop or comma, need no search."""
    if m := _PLAIN.fullmatch(piece):
        return [m[1], m[2]] if m[2] else [piece]
    return pattern.findall(piece)


class Memory:
    """What is known of pieces: the newest of them, two generations of at most limit entries and one batch each."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, need: set[str]) -> list[str]:
        """Those of need that are unknown; the others are kept."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        out, old = [], self.old
        for x in need.difference(self.young):
            if x in old:
                self.young[x] = old[x]
            else:
                out.append(x)
        return out
