"""Byte-level BPE encoding and decoding by dynamic programming over byte prefixes.

A sequence of tokens is what merging by rank gives if, and only if, merging the bytes of every two
neighbours gives those two back. So the encoding of every prefix of a byte string ends in one token that
depends on the bytes alone: the token that ends there and goes with the last token of the prefix before
it. One number per prefix is then enough for the whole string, for strings that go on from it, and for
the same string edited somewhere: behind an edit the numbers come out as they were after a while.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.llm.arrow import bounded_batches, in_batches

STORE = 500_000  # pieces a worker keeps encoded, some 200 bytes each
CHUNK = 1 << 20  # characters of a text that are cut into pieces in one go
PIECES = 1 << 16  # pieces of a longer text that are held at once
ENDLESS = 1 << 62


class Ranks:
    """A vocabulary of byte strings by rank, as tiktoken merges them: lowest rank first, leftmost first."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.text = {rank: token for token, rank in self.rank.items()}
        self.longest = max(map(len, self.rank), default=0)
        missing = [b for b in range(256) if bytes([b]) not in self.rank]
        if missing:
            raise ValueError(f"{len(missing)} bytes have no token")
        self._parts = self._merged_from()
        self._left = {t: self._spine(t, 0) for t in self._parts}
        self._right = {t: self._spine(t, 1) for t in self._parts}
        self._fits: dict[int, bool] = {}
        self._find = ahocorasick.Automaton()
        for token in self._parts:  # tokens that no merge makes never end a prefix
            self._find.add_word(self.text[token].decode("latin-1"), (token, len(self.text[token])))
        self._find.make_automaton()

    def _merged_from(self) -> dict[int, tuple[int, int] | None]:
        """For each token that merging makes, the two tokens it is made of last; None for bytes."""
        parts: dict[int, tuple[int, int] | None] = {}
        for token, rank in sorted(self.rank.items(), key=lambda item: item[1]):
            if len(token) == 1:
                parts[rank] = None
                continue
            pieces = self._merge(token, rank)
            if len(pieces) == 2:
                parts[rank] = (self.rank[pieces[0]], self.rank[pieces[1]])
        return parts

    def _merge(self, token: bytes, below: int) -> list[bytes]:
        """The token's bytes merged by all ranks below its own."""
        pieces, rank = [token[i : i + 1] for i in range(len(token))], self.rank.get
        while len(pieces) > 1:
            best, at = below, -1
            for i in range(len(pieces) - 1):
                if (r := rank(pieces[i] + pieces[i + 1], ENDLESS)) < best:
                    best, at = r, i
            if at < 0:
                break
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        return pieces

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The token and what it is made of along one edge, each with the rank at which it is merged away."""
        spine, until = [], ENDLESS
        while True:
            spine.append((self.text[token], until))
            if self._parts[token] is None:
                return spine
            until, token = token, self._parts[token][side]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' bytes gives these two tokens.

        Merges go up in rank, so a merge across the border happens if its rank comes before those that
        take its two sides away. A merge of the same rank goes first if it is further left.
        """
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            rank = self.rank.get
            known = not any(
                (r := rank(x + y, ENDLESS)) < x_until and r <= y_until and r != ENDLESS
                for x, x_until in self._right[left]
                for y, y_until in self._left[right]
            )
            if len(self._fits) > STORE:
                self._fits.clear()
            self._fits[key] = known
        return known

    def ends(self, data: bytes) -> Iterator[tuple[int, tuple[int, int]]]:
        """(last place, (token, length)) of all tokens in the data, in order of their ends, longest first."""
        return self._find.iter(data.decode("latin-1"))


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    """A worker's vocabulary; read once per process."""
    return Ranks(path)


class Prefixes:
    """A byte string with the last token of the encoding of each of its prefixes."""

    def __init__(self, words: Ranks, data: bytes = b""):
        self.words, self.data, self.last = words, bytearray(), array("q")
        self.append(data)

    def _fill(self, start: int, stop: Callable[[int, int], bool] | None = None) -> int:
        """Find last tokens from a place on, to the end or until ``stop`` says so; where it ended."""
        words, last, fits = self.words, self.last, self.words.fits
        back = max(0, start - words.longest + 1)
        place = start
        for end, (token, size) in words.ends(bytes(memoryview(self.data)[back:])):
            at = back + end
            if at < place:
                continue
            before = at - size
            if before < -1 or (before >= 0 and not fits(last[before], token)):
                continue
            last[at] = token
            place = at + 1
            if stop is not None and stop(at, token):
                break
        return place

    def append(self, more: bytes) -> None:
        """Go on with more bytes; what is known of the prefixes stays."""
        start = len(self.data)
        self.data += more
        self.last.extend([0] * len(more))
        if more:
            self._fill(start)

    def truncate(self, size: int) -> None:
        """Go back to a prefix."""
        del self.data[size:]
        del self.last[size:]

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace data[start:end]; returns how many prefixes were looked at anew.

        Behind the new bytes, as many equal last tokens in a row as the longest token has bytes settle
        all that follow, because a last token depends on no more than those.
        """
        old = self.last[end:]
        self.data[start:end] = new
        self.last[start:] = array("q", bytes(8 * len(new))) + old
        agreed, behind = 0, start + len(new)

        def same(at: int, token: int) -> bool:
            nonlocal agreed
            agreed = agreed + 1 if at >= behind and token == old[at - behind] else 0
            return agreed >= self.words.longest

        return self._fill(start, same) - start if start < len(self.data) else 0

    def tokens(self, size: int | None = None) -> array:
        """Ids of the whole string, or of its prefix of that many bytes."""
        out, at, text = array("q"), len(self.last) if size is None else size, self.words.text
        while at > 0:
            token = self.last[at - 1]
            out.append(token)
            at -= len(text[token])
        out.reverse()
        return out


def encode_pieces(words: Ranks, pieces: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
    """Each piece with its ids; what ``Prefixes`` does, for very many short strings.

    A piece that is a token as a whole is that token, as in tiktoken, even where merging wouldn't make it.
    """
    whole, ends, fits = words.rank.get, words.ends, words.fits
    for piece in pieces:
        token = whole(piece)
        if token is not None:
            yield piece, [token]
            continue
        last: list[int] = []
        sizes: list[int] = []
        place = 0
        for end, (token, size) in ends(piece):
            if end < place:
                continue  # a longer token fitted here
            if end >= size and not fits(last[end - size], token):
                continue
            last.append(token)
            sizes.append(size)
            place = end + 1
        ids, at = [], len(last) - 1
        while at >= 0:
            ids.append(last[at])
            at -= sizes[at]
        ids.reverse()
        yield piece, ids


@lru_cache(maxsize=4)
def piece_pattern(pattern: str) -> str:
    r"""The pattern for Python's ``re``, with \p{L}, \p{N}, \s and \S as tiktoken's own engine sees them.

    An encoding whose pattern is one class gives back only the characters of that class.
    """
    single = {bytes([b]): b for b in range(256)}
    known = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)

    def members(one: str) -> str:
        probe = tiktoken.Encoding("probe", pat_str=one, mergeable_ranks=single, special_tokens={})
        points = sorted(map(ord, probe.decode(probe.encode_ordinary(known))))
        runs: list[list[int]] = []
        for p in points:
            if runs and p == runs[-1][1] + 1:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)

    out, inside, at = [], False, 0
    for found in re.finditer(r"\\p\{\w+\}|\\[sS]|\\.|\[\^?|\]", pattern):
        out.append(pattern[at : found.start()])
        at, part = found.end(), found.group()
        if part.startswith("\\p") or part in ("\\s", "\\S"):
            listed = members(part.lower() if part == "\\S" else part)
            if part == "\\S":
                if inside:
                    raise ValueError("\\S inside brackets")
                out.append(f"[^{listed}]")
            else:
                out.append(listed if inside else f"[{listed}]")
        else:
            inside = part[0] == "[" if part[0] in "[]" else inside
            out.append(part)
    return "".join([*out, pattern[at:]])


@lru_cache(maxsize=4)
def _narrow(pattern: str, ceiling: int) -> re.Pattern:
    """The pattern without the ranges that a text below the ceiling can't reach; fewer ranges match faster."""
    def cut(found: re.Match) -> str:
        a, b = (int(x, 16) for x in found.groups())
        return f"\\U{a:08x}-\\U{min(b, ceiling - 1):08x}" if a < ceiling else ""

    return re.compile(re.sub(r"\\U([0-9a-f]{8})-\\U([0-9a-f]{8})", cut, pattern))


def cut_text(pattern: str, text: str) -> Iterator[list[str]]:
    """The matches of a pattern from ``piece_pattern``, in bounded lists."""
    matcher = _narrow(pattern, 0x100 if text.isascii() or max(text) < "\u0100" else 0x110000)
    if len(text) <= CHUNK:
        yield matcher.findall(text)
        return
    found = (m.group() for m in matcher.finditer(text))
    while part := list(islice(found, PIECES)):
        yield part


class Store:
    """Bounded store of pieces encoded by this worker, their ids as bytes."""

    def __init__(self, words: Ranks):
        self.words = words
        self.ids: dict[str, bytes] = {}

    def learn(self, parts: list[list[str]]) -> None:
        """Encode the pieces of the parts that the store doesn't hold."""
        new = list(set().union(*parts).difference(self.ids))
        for piece, (_, ids) in zip(new, encode_pieces(self.words, [p.encode() for p in new]), strict=True):
            self.ids[piece] = array("I", ids).tobytes()

    def keep(self, pieces: set[str]) -> None:
        """Forget all other pieces."""
        self.ids = {p: self.ids[p] for p in pieces}


@lru_cache(maxsize=2)
def store(path: str) -> Store:
    return Store(ranks(path))


class _Digest:
    """Digests of one document, fed part by part."""

    def __init__(self):
        self.size, self.ids, self.decoded = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, parts: list[str], known: Store) -> None:
        ids = b"".join(map(known.ids.__getitem__, parts))
        self.size += len(ids)
        self.ids.update(ids)
        self.decoded.update(b"".join(map(known.words.text.__getitem__, memoryview(ids).cast("I"))))


def encode_texts(path: str, pattern: str, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
    """Number of ids and the digests of ids and decoded bytes, for each text of a batch."""
    known = store(path)
    digests = [_Digest() for _ in texts]
    waiting: list[tuple[int, list[str]]] = []
    size = 0

    def feed() -> None:
        known.learn([part for _, part in waiting])
        for at, part in waiting:
            digests[at].add(part, known)
        if len(known.ids) > STORE:  # the latest texts' pieces have the frequent ones among them
            known.keep(set().union(*(part for _, part in waiting)))
        waiting.clear()

    for at, text in enumerate(texts):
        for part in cut_text(pattern, text) if text else ():
            waiting.append((at, part))
            size += len(part)
            if size > PIECES:
                feed()
                size = 0
    feed()
    for d in digests:
        yield d.size // 4, d.ids.hexdigest(), d.decoded.hexdigest()


def encode_ids(path: str, pattern: str, text: str | None) -> list[int]:
    """Ids of one text; null counts as empty."""
    words, out = ranks(path), []
    for part in cut_text(piece_pattern(pattern), text) if text else ():
        got = dict(encode_pieces(words, list({p.encode() for p in part})))
        out += [i for p in part for i in got[p.encode()]]
    return out


def decode_ids(path: str, ids: list[int]) -> bytes:
    """The bytes that ids stand for."""
    text = ranks(path).text
    return b"".join([text[i] for i in ids])


def encoded_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit integers) and decoded_sha256 of every row.

    Texts are cut into matches of the pattern, each encoded by itself by the ranks of the file at
    ``path``; no special tokens. A null text counts as empty: no ids, both digests those of nothing.
    Repeated rows come out repeated, a null id stays null, other columns are ignored. A text is cut in
    lists of bounded size; a single match of the pattern is held as a whole, with 8 bytes per byte.
    """
    matched = piece_pattern(pattern)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        gc.disable()  # very many small objects, none of them in a cycle
        try:
            rows = list(encode_texts(path, matched, batch.column(1).to_pylist()))
        finally:
            gc.enable()
        return pa.RecordBatch.from_arrays([
            batch.column(0),
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.string()),
            pa.array([r[2] for r in rows], pa.string()),
        ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(
        in_batches(encode), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
