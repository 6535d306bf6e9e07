"""BPE encoding and decoding with an index from each pair to all its positions.

Pre-tokens that are new to a worker are laid out side by side as one sequence of symbols. Every
adjacent pair that has a merge is indexed with all positions at which it occurs. The active ranks are
applied in ascending order; a merge touches only the listed positions and the lists of the neighbours
it changes. Encoded pre-tokens are kept in a bounded store, so a word is merged once, not per document.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.llm.arrow import bounded_batches, in_batches, once_per_worker
from roomledger.llm.pieces import Cutter, piece_patterns

STORE = 50_000  # pre-tokens, some 400 bytes each, after which a worker's store begins anew, keeping those as its older half
CHUNK = 1 << 19  # characters whose pre-tokens are merged at once
_GAP = -1  # symbol between two pre-tokens


def byte_symbols() -> dict[int, str]:
    """Printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges and byte strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        to_byte = {c: b for b, c in byte_symbols().items()}
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.byte_id = [vocab[c] for _, c in sorted(byte_symbols().items())]
        self.rank_of: dict[int, int] = {}  # left * size + right: rank
        self.merges: list[tuple[int, int, int]] = []  # by rank: left, right, new symbol
        made: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (vocab[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            new = vocab["".join(merge.split(" ") if isinstance(merge, str) else merge)]
            if max(made.get(left, -1), made.get(right, -1)) >= rank:
                raise ValueError("a merge comes before the merges that make its parts")
            made.setdefault(new, rank)
            self.rank_of[left * self.size + right] = rank
            self.merges.append((left, right, new))
        self.pairs = np.array(sorted(self.rank_of), np.int64)
        self.pair_rank = np.array([self.rank_of[k] for k in self.pairs.tolist()], np.int32)
        self.text = [b""] * self.size
        for symbol, i in vocab.items():
            self.text[i] = bytes(to_byte[c] for c in symbol)
        self.digits = [str(i) for i in range(self.size)]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.text[i] = content.encode()

    def _places(self, symbols: np.ndarray) -> list[list[int] | None]:
        """By rank, all positions of its pair, ascending; None where it doesn't occur."""
        places: list[list[int] | None] = [None] * len(self.merges)
        pair = symbols[:-1] * self.size + symbols[1:]
        found = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        at = np.flatnonzero((self.pairs[found] == pair) & (symbols[:-1] >= 0) & (symbols[1:] >= 0))
        rank = self.pair_rank[found[at]]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for first, group in zip(rank[np.r_[0, cuts]].tolist() if len(rank) else [], np.split(at, cuts), strict=False):
            places[first] = group.tolist()
        return places

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token, all merged together through the pair index.

        A merge only makes pairs of higher ranks (checked when the vocabulary is read), so one pass
        over the ranks applies every active one in ascending order.
        """
        if not pieces or not self.merges:
            return [[self.byte_id[b] for b in piece] for piece in pieces]
        size, find = self.size, self.rank_of.get
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        start = np.cumsum([0, *map(len, pieces)])
        flat = np.full(len(raw) + len(pieces) + 1, _GAP, np.int64)
        flat[np.arange(len(raw)) + np.repeat(np.arange(len(pieces)), np.diff(start))] = np.array(self.byte_id)[raw]
        places = self._places(flat)
        symbols = flat.tolist()
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        for rank, (left, right, new) in enumerate(self.merges):
            listed = places[rank]
            if listed is None:
                continue
            listed.sort()  # left to right, as overlapping pairs demand
            new_key = new * size
            for i in listed:
                if symbols[i] != left:
                    continue  # an earlier merge took it
                j = after[i]
                if symbols[j] != right:
                    continue
                symbols[i] = new
                symbols[j] = _GAP
                k = after[i] = after[j]
                before[k] = i
                follower = symbols[k]
                if follower >= 0 and (hit := find(new_key + follower)) is not None:
                    if places[hit] is None:
                        places[hit] = [i]
                    else:
                        places[hit].append(i)
                h = before[i]
                if h >= 0 and (leader := symbols[h]) >= 0 and (hit := find(leader * size + new)) is not None:
                    if places[hit] is None:
                        places[hit] = [h]
                    else:
                        places[hit].append(h)
            places[rank] = None
        out, at = [], 0
        for piece in pieces:
            end = at + len(piece)
            out.append([s for s in symbols[at:end] if s >= 0])
            at = end + 1
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes that the ids stand for."""
        text = self.text
        return b"".join([text[i] for i in ids])


@once_per_worker
def vocabulary(path: str) -> Vocabulary:
    """A worker's vocabulary; read once per process."""
    return Vocabulary(path)


class Store:
    """Bounded store of pre-tokens encoded by this worker: ids as text and as decoded bytes.

    What is met again moves from the older half to the newer one, so frequent pre-tokens stay.
    """

    def __init__(self, words: Vocabulary):
        self.words = words
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}
        self.age()

    def age(self) -> None:
        """Forget the older half; the newer one takes its place."""
        self.older = self.ids, self.decoded
        self.ids, self.decoded = {}, {}
        for content, i in self.words.added.items():
            self.ids[content], self.decoded[content] = str(i), self.words.decode([i])

    def learn(self, parts: list[list[str]]) -> None:
        """Have all pre-tokens of the parts in the newer half, and encode those that the store doesn't hold."""
        known, decoded = self.ids, self.decoded
        older_ids, older_decoded = self.older
        missing = set().union(*parts).difference(known)
        for piece in older_ids.keys() & missing:
            known[piece], decoded[piece] = older_ids[piece], older_decoded[piece]
        new = list(missing.difference(older_ids))
        digits, text = self.words.digits, self.words.text
        for piece, ids in zip(new, self.words.encode([p.encode() for p in new]), strict=True):
            known[piece] = ",".join([digits[i] for i in ids])
            decoded[piece] = b"".join([text[i] for i in ids])


@once_per_worker
def store(path: str) -> Store:
    return Store(vocabulary(path))


class _Digest:
    """Digests of one document, fed part by part."""

    def __init__(self):
        self.count, self.ids, self.decoded = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, parts: list[str], encoded: dict[str, str], decoded: dict[str, bytes]) -> None:
        if not parts:
            return
        joined = ",".join(map(encoded.__getitem__, parts))
        self.ids.update(("," + joined if self.count else joined).encode())
        self.count += joined.count(",") + 1
        self.decoded.update(b"".join(map(decoded.__getitem__, parts)))


def encode_texts(path: str, cutter: Cutter, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
    """Number of ids and the digests of ids and decoded text, for each text of a batch.

    Short texts are gathered until their pre-tokens fill a chunk, so that pre-tokens are merged many
    at a time; a long text is fed to its digests chunk by chunk.
    """
    known = store(path)
    digests = [_Digest() for _ in texts]
    waiting: list[tuple[int, list[str]]] = []
    size = 0

    def feed() -> None:
        known.learn([part for _, part in waiting])
        for at, part in waiting:
            digests[at].add(part, known.ids, known.decoded)
        if len(known.ids) > STORE:
            known.age()
        waiting.clear()

    for at, text in enumerate(texts):
        for part in cutter.parts(text or ""):
            waiting.append((at, part))
            size += len(part)
            if size > cutter.chunk:
                feed()
                size = 0
    feed()
    for d in digests:
        yield d.count, d.ids.hexdigest(), d.decoded.hexdigest()


def encode_ids(path: str, text: str | None) -> list[int]:
    """Ids of one text; null counts as empty."""
    words, ids = vocabulary(path), []
    for part in Cutter(*piece_patterns(path)).parts(text or ""):
        todo = [p for p in dict.fromkeys(part) if p not in words.added]
        got = dict(zip(todo, words.encode([p.encode() for p in todo]), strict=True))
        got |= {content: [i] for content, i in words.added.items()}
        ids += [i for p in part for i in got[p]]
    return ids


def decode_ids(path: str, ids: list[int]) -> str:
    """Text of ids; bytes that are no UTF-8 become the replacement character."""
    return vocabulary(path).decode(ids).decode("utf-8", "replace")


def encoded_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row.

    A null text counts as empty: no ids, both digests those of nothing. Repeated rows come out
    repeated, a null id stays null, other columns are ignored.
    """
    patterns, added = piece_patterns(path)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        gc.disable()  # millions of small lists, none of them in a cycle
        try:
            rows = list(encode_texts(path, Cutter(patterns, added, CHUNK), batch.column(1).to_pylist()))
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
