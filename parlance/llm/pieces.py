"""Splitting of text into the pieces that byte-level BPE merges within."""

from __future__ import annotations

import re

import regex

#: White space as Unicode's White_Space property has it. Python's own \s also takes 0x1C-0x1F.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters and numbers up to 0xFF; for these the standard library's faster engine will do.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBER = "0-9²³¹¼½¾"


def _pattern(space: str, letter: str, number: str) -> str:
    return (
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )


_LATIN = re.compile(_pattern(_SPACE, _LETTER, _NUMBER))
_ANY = regex.compile(_pattern(_SPACE, r"\p{L}", r"\p{N}"))


def split(text: str) -> list[str]:
    """The pieces of ``text`` in order; together they are the text."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _ANY.findall(text)
    return _LATIN.findall(text)
