"""Splitting text into pre-tokens, with character classes built from Unicode categories."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import regex

#: Code points with the Unicode property White_Space.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WHITE_SPACE = re.escape("".join(map(chr, SPACES)))
#: The pre-token patterns of the two tokenizer files, over the classes L, N and S.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"
#: Longer texts are split into blocks of so many pre-tokens, which bounds memory.
LONG_TEXT, BLOCK = 1_000_000, 200_000


@lru_cache
def _ranges(major: str, top: int, newest: bool) -> str:
    """The code points up to ``top`` whose category starts with ``major``, as regex ranges.

    ``newest``: by the installed ``regex`` module, whose Unicode version is later than Python's.
    """
    known = set(map(ord, regex.findall(rf"\p{{{major}}}", "".join(map(chr, range(top + 1)))))) if newest else {c for c in range(top + 1) if unicodedata.category(chr(c))[0] == major}
    out, start = [], None
    for c in range(top + 2):
        inside = c in known
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache
def compiled(pattern: str, top: int) -> re.Pattern:
    newest = pattern == WORD_LEVEL
    classes = {"L": _ranges("L", top, newest), "N": _ranges("N", top, newest), "S": WHITE_SPACE}
    return re.compile(re.sub(r"\{([LNS])\}", lambda m: classes[m[1]], pattern))


def latin(text: str) -> bool:
    """Whether all code points are below 256; such text is in normal form C."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def matcher(pattern: str, text: str) -> re.Pattern:
    """The pattern over the Basic Multilingual Plane if ``text`` needs no more, which runs faster."""
    wide = not latin(text) and re.search("[\U00010000-\U0010ffff]", text)
    return compiled(pattern, sys.maxunicode if wide else 0xFFFF)


def blocks(pattern: str, text: str) -> Iterator[list[str]]:
    """The pre-tokens of a text, in lists."""
    split = matcher(pattern, text)
    if len(text) <= LONG_TEXT:
        yield split.findall(text)
        return
    found = (m.group() for m in split.finditer(text))
    while block := list(islice(found, BLOCK)):
        yield block
