"""Cutting a text into the pieces that are merged one by one."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

# The pattern that cuts a text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A class of the pattern, and a character of that class alone in any Unicode version.
CLASSES = ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\t"))
OTHER = "!"


def _ranges(points: list[int]) -> str:
    """A character class of sorted code points."""
    out, at = [], 0
    while at < len(points):
        end = at
        while end + 1 < len(points) and points[end + 1] == points[end] + 1:
            end += 1
        out.append(f"\\U{points[at]:08x}-\\U{points[end]:08x}")
        at = end + 1
    return f"[{''.join(out)}]"


class Splitter:
    """``split`` gives the matches of the pattern as a library's own regex engine would.

    Engines know different versions of Unicode. ``members(pattern, text)`` asks the library
    which characters belong to a class. Where it differs from the engine used here, the text is
    matched with a stand-in of the library's class and the pieces are cut from the original.
    """

    def __init__(self, members: Callable[[str, str], str]):
        everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        ours, theirs = {}, {}
        for pattern, stand_in in CLASSES:
            ours |= dict.fromkeys("".join(regex.findall(pattern, everything)), stand_in)
            theirs |= dict.fromkeys(members(pattern, everything), stand_in)
        self.stand_ins = {
            ord(c): theirs.get(c, OTHER)
            for c in ours.keys() | theirs.keys()
            if ours.get(c) != theirs.get(c)
        }
        points = sorted(self.stand_ins)
        self.differs = re.compile(_ranges(points)).search if points else lambda text: None
        self.find = regex.compile(PIECES).findall

    def split(self, text: str) -> list[str]:
        if text.isascii() or not self.differs(text):
            return self.find(text)
        pieces, at = [], 0
        for piece in self.find(text.translate(self.stand_ins)):
            pieces.append(text[at : at + len(piece)])
            at += len(piece)
        return pieces
