"""Splitting a text into the pieces that a tokenizer's pattern asks for."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable

import regex

# Texts without a character from here on are split by the standard library's faster engine.
NARROW = 0x250
# A list of all pieces of a huge text would take many times its size.
LISTED = 1 << 20


def _members(kind: str) -> str:
    """Ranges of the characters below ``NARROW`` that the class holds."""
    found = [i for i in range(NARROW) if regex.match(kind, chr(i))]
    starts = [i for i in found if i - 1 not in found]
    ends = [i for i in found if i + 1 not in found]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))


def narrow_pattern(pattern: str) -> str:
    """The pattern with its Unicode classes spelt out for characters below ``NARROW``."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        kind = next((c for c in (r"\p{L}", r"\p{N}", r"\s", r"\S") if pattern.startswith(c, k)), pattern[k])
        if len(kind) > 1:
            members = _members(kind)
            out.append(members if inside else f"[{members}]")
        else:
            if kind == "\\":
                kind = pattern[k : k + 2]
            inside = kind == "[" or (inside and kind != "]")
            out.append(kind)
        k += len(kind)
    return "".join(out)


@functools.lru_cache(maxsize=4)
def splitter(pattern: str) -> Callable[[str], Iterable[str]]:
    """All matches of the pattern in a text, in order."""
    wide, narrow, other = regex.compile(pattern), re.compile(narrow_pattern(pattern)), re.compile(f"[^\\0-{chr(NARROW - 1)}]")

    def split(text: str) -> Iterable[str]:
        engine = wide if other.search(text) else narrow
        return engine.findall(text) if len(text) < LISTED else (m.group() for m in engine.finditer(text))

    return split
