"""What a Python worker still holds when it goes on to the next batch, task or stage."""

import re
from pathlib import Path

import public_tokenizers
import pyarrow as pa

from roomledger.llm import arrow, bpe, langid
from roomledger.llm.pieces import Cutter, piece_patterns

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _held_mb() -> float:
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_store_is_bounded_and_keeps_frequent_pieces(monkeypatch):
    cutter = Cutter(*piece_patterns(PATH))
    known = bpe.store(PATH)
    encode, seen = known.words.encode, []
    monkeypatch.setattr(known.words, "encode", lambda pieces: seen.extend(pieces) or encode(pieces))
    for batch in range(25):
        texts = [" ".join(["frequentword", *(f"x{chr(97 + n % 26) * (1 + n % 7)}{n}q" for n in range(k, k + 500))])
                 for k in range(batch * 10_000, (batch + 1) * 10_000, 500)]
        list(bpe.encode_texts(PATH, cutter, texts))
    halves = [known.ids, *getattr(known, "older", ({},))[:1]]
    assert sum(map(len, halves)) < 150_000
    assert seen.count(b"frequentword") == 1


def test_model_and_store_are_not_held_together():
    first, store = langid._model((("en", ("some words",)),)), bpe.store(PATH)
    assert bpe.store(PATH) is store
    assert langid._model((("en", ("some words",)),)) is not first
    assert bpe.store(PATH) is not store


def test_a_task_gives_back_what_its_batches_took():
    def work(batch):
        columns = [pa.array([b"x" * 3000] * 3000) for _ in range(20)]
        texts = [column.to_pylist() for column in columns]
        held.append([own[::997] for own in texts])  # what stays lies between what goes
        return pa.RecordBatch.from_arrays([pa.array([len(texts)])], names=["n"])

    held: list = []
    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["n"])
    before = _held_mb()
    assert [b.num_rows for b in arrow.in_batches(work)(iter([batch] * 3))] == [1, 1, 1]
    assert _held_mb() - before < 30
