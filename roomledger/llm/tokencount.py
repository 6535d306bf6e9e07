"""Token counts: pre-tokens that are a vocabulary entry count as one, only the rest is merged.

The shortcut is proved before any text is read: each vocabulary string is encoded on its own, and those
that come out as exactly one token are the ones a pre-token may be looked up in.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roomledger.llm.arrow import bounded_batches, in_batches
from roomledger.llm.bpe import byte_symbols
from roomledger.llm.pieces import Cutter, piece_patterns

CONTEXT = 1024  # tokens a document may have before it is over the limit
STORE = 500_000  # merged pre-tokens a worker keeps


@lru_cache(maxsize=2)
def single_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that the library encodes, alone, as exactly one token."""
    tokenizer = Tokenizer.from_file(path)
    decode = {c: b for b, c in byte_symbols().items()}
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    texts = set(added)
    for symbol in tokenizer.get_vocab(with_added_tokens=False):
        try:
            texts.add(bytes(decode[c] for c in symbol).decode())
        except UnicodeDecodeError:
            continue  # part of a character, never a whole pre-token
    order = sorted(texts)
    encoded = tokenizer.encode_batch(order, add_special_tokens=False)
    return frozenset(text for text, e in zip(order, encoded, strict=True) if len(e.ids) == 1)


class TokenLengths(dict):
    """Tokens of each pre-token: proven ones at once, others merged when first met."""

    def __init__(self, path: str):
        super().__init__()
        self.proven = single_tokens(path)
        self.merge = Tokenizer.from_file(path).model.tokenize
        self.symbols = {b: c for b, c in byte_symbols().items()}
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.update(dict.fromkeys(self.proven, 1))

    def __missing__(self, piece: str) -> int:
        if len(self) > STORE:
            self.clear()
        count = len(self.merge(piece.encode().decode("latin-1").translate(self.symbols)))
        self[piece] = count
        return count


@lru_cache(maxsize=2)
def token_lengths(path: str) -> TokenLengths:
    """A worker's store of lengths; made once per process."""
    return TokenLengths(path)


def count_text(path: str, cutter: Cutter, text: str | None) -> int:
    """Tokens of one whole text; null counts as empty."""
    length = token_lengths(path).__getitem__
    return sum(sum(map(length, part)) for part in cutter.parts(text or ""))


def token_counts(
    docs: DataFrame, path: str, limit: int = CONTEXT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    A null text counts as empty: 0 bytes, 0 tokens, not over the limit. Repeated rows come out
    repeated, a null id stays null, other columns are ignored.
    """
    patterns, added = piece_patterns(path)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        cutter = Cutter(patterns, added)
        counts = [count_text(path, cutter, text) for text in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    chosen = docs.select(
        F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    counted = chosen.mapInArrow(in_batches(count), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
