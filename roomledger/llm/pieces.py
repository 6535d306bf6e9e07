"""Pre-tokens of a byte-level BPE tokenizer, cut as its library cuts them.

The library's own pre-tokenizer says which characters are letters, digits, spaces or others; the
classes become one pattern of the standard ``re`` module, which scans much faster than a call per text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from tokenizers import Tokenizer

CHUNK = 1 << 20  # characters of a long text that are cut into pre-tokens at a time
CEILINGS = (0x100, 0x10000, 0x110000)
_BREAK = re.compile(r"[^\s](?= [^\s])")


def _charset(runs: list[tuple[int, int]], ceiling: int) -> str:
    return "".join(f"\\U{a:08x}-\\U{min(b, ceiling - 1):08x}" for a, b in runs if a < ceiling)


@lru_cache(maxsize=4)
def piece_patterns(path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Patterns of a pre-token for texts below U+0100, below U+10000 and any, and the added tokens' texts.

    Every code point is put in its class by the library: a run of one class comes out as one piece,
    and one probe per run tells which class that is. Narrow texts get a narrow pattern, since a
    class of few ranges is matched several times faster.
    """
    tokenizer = Tokenizer.from_file(path)
    cut = tokenizer.pre_tokenizer.pre_tokenize_str
    known = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    classes: dict[str, list[tuple[int, int]]] = {"a": [], "1": [], "!": [], " ": []}
    for _, (start, end) in cut(known):
        start += known[start] == " " and end - start > 1  # a space that leads a piece
        first = known[start]
        kind = next((probe for probe in "a1!" if not first.isspace() and len(cut(probe + first)) == 1), " ")
        classes[kind].append((ord(first), ord(known[end - 1])))
    classes[" "].append((0x20, 0x20))
    patterns = []
    for ceiling in CEILINGS:
        letter, digit, other, space = (_charset(classes[k], ceiling) for k in "a1! ")
        patterns.append(
            f" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{digit}]+| ?[{other}]+"
            f"|[{space}]+(?![^{space}])|[{space}]+"
        )
    added = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    return tuple(patterns), tuple(added)


def chunks(text: str, chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive parts of a text; a cut is made only where a pre-token ends for certain.

    A single space between two visible characters always begins a pre-token. A text without one is
    one part.
    """
    start = 0
    while len(text) - start > chunk:
        found = _BREAK.search(text, start + chunk)
        if not found:
            break
        yield start, found.end()
        start = found.end()
    yield start, len(text)


def _width(text: str) -> int:
    """Which of the patterns is wide enough for a text."""
    if text.isascii():
        return 0
    try:
        text.encode("latin-1")
        return 0
    except UnicodeEncodeError:
        return 1 if len(text.encode("utf-16-le")) == 2 * len(text) else 2


class Cutter:
    """Cuts whole texts into lists of pre-tokens; added tokens come out as pieces of their own."""

    def __init__(self, patterns: tuple[str, ...], added: tuple[str, ...], chunk: int = CHUNK):
        self.find = [re.compile(pattern).findall for pattern in patterns]
        self.added = frozenset(added)
        self.split = re.compile("(" + "|".join(map(re.escape, added)) + ")").split if added else None
        self.chunk = chunk

    def parts(self, text: str) -> Iterator[list[str]]:
        """Lists of pre-tokens, one for each bounded part of the text."""
        find = self.find[_width(text)]
        plain = self.split is None or not any(a in text for a in self.added)
        for part in [text] if plain else self.split(text):
            if part in self.added:
                yield [part]
            elif len(part) <= self.chunk:
                yield find(part)
            else:
                for start, end in chunks(part, self.chunk):
                    yield find(part, start, end)
