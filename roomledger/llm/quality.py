"""Quality rules: lines are judged first, then the document by how much of it the lines lost.

A line fails when it is punctuation rather than prose, when it is a navigation bar, or when it is
boilerplate. Failing lines are removed; a document that loses too much of its text is rejected.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.llm.arrow import bounded_batches, in_batches

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of words
MOST_LOST = 50  # percent of a document's word characters that removed lines may hold
MOST_SYMBOLS = 20  # percent of a line's word characters
SHORT_LINE = 4  # words; a shorter line without an end mark is a menu entry or caption

_ENDS = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*[\s]*$")
SEPARATORS = frozenset(w.encode() for w in "› » · • > /".split())  # as words of their own; a | counts anywhere
_LETTER = re.compile(r"[^\W\d_]")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
# Phrases of notices that pages repeat.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "accept cookies", "subscribe to our newsletter", "sign up for our newsletter", "click here to",
    "javascript is disabled", "enable javascript", "powered by", "share this", "lorem ipsum",
    "licensed under", "permission is hereby granted",
)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_LONG = 200_000  # words from which windows are compared as sorted numbers instead of a set


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five which occurs at least twice in the list."""
    count = len(words) - WINDOW + 1
    if count < 2:
        return 0
    if count < _LONG:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(windows)) == count:
            return 0
        number: dict = {}
        ids = np.array([number.setdefault(w, len(number)) for w in windows])
    else:
        number = {}
        one = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        two = _ranks(one[:-1] * len(number) + one[1:])
        four = _ranks(two[:-2] * len(two) + two[2:])
        ids = _ranks(four[:-1] * len(number) + one[4:])
    again = np.bincount(ids)[ids] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def line_fails(line: str, words: list[bytes], letters: int) -> str | None:
    """Rule that a line with words breaks: punctuation, navigation, boilerplate, or None."""
    symbols = sum(line.count(c) for c in SYMBOLS)
    if not _LETTER.search(line) or symbols * 100 > letters * MOST_SYMBOLS:
        return "punctuation"
    bars = line.count("|") + sum(w in SEPARATORS for w in words if len(w) < 4)
    if bars >= 2 and len(words) <= 4 * (bars + 1):
        return "navigation"
    if len(words) < SHORT_LINE and not _ENDS.search(line):
        return "navigation"
    if _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    return None


def judge(text: str | None) -> dict:
    """Counts, lines removed and verdict of one whole text; null counts as empty."""
    text = text or ""
    words = text.encode().split()  # splits at the six ASCII spaces only
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    seen: set[str] = set()
    duplicates = lost = removed = 0
    for line in text.split("\n"):
        parts = line.encode().split()
        if not parts:
            continue
        letters = len(line) - sum(line.count(c) for c in SPACES)
        if again := line in seen:
            duplicates += 1
        seen.add(line)
        if again or line_fails(line, parts, letters):
            removed += 1
            lost += letters
    repeat = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeat > MOST_REPEATED * len(words)
    return {
        "n_words": len(words), "word_chars": word_chars, "n_symbols": sum(text.count(c) for c in SYMBOLS),
        "n_dup_lines": duplicates, "n_repeat_words": repeat, "n_removed_lines": removed, "lost_chars": lost,
        "base_failed": failed, "kept": not failed and 100 * lost <= MOST_LOST * word_chars,
    }


def cleaned(text: str | None) -> str | None:
    """The text without failing lines and repeated lines; lines without words stay."""
    if text is None:
        return None
    seen: set[str] = set()
    lines = []
    for line in text.split("\n"):
        parts = line.encode().split()
        if parts:
            letters = len(line) - sum(line.count(c) for c in SPACES)
            if line in seen or line_fails(line, parts, letters):
                continue
            seen.add(line)
        lines.append(line)
    return "\n".join(lines)


_FIELDS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "n_removed_lines": pa.int64(), "lost_chars": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(),
}


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row.

    A null or empty text has no words and fails. Repeated rows come out repeated, a null id stays
    null, other columns are ignored.
    """

    def judge_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [judge(text) for text in batch.column(1).to_pylist()]
        columns = [pa.array([r[name] for r in rows], kind) for name, kind in _FIELDS.items()]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *_FIELDS])

    bounded_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"{n} {'boolean' if t == pa.bool_() else 'long'}" for n, t in _FIELDS.items())
    return chosen.mapInArrow(in_batches(judge_batch), f"doc_id {kind}, {fields}")


def cleaned_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with failing lines removed from the text; other columns stay as they are."""
    at = docs.columns.index(text_col)

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([cleaned(text) for text in batch.column(at).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(in_batches(clean), docs.schema)
