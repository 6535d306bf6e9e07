"""Token counts and BPE against the library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from roomledger.llm import bpe, tokencount
from roomledger.llm.pieces import Cutter, chunks, piece_patterns

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
POOL = [chr(c) for c in [*range(0x80), 0x1C, 0x1F, 0x85, 0xA0, 0x1680, 0x2000, 0x2028, 0x3000, 0x200B, 0xFEFF, 0x4E00,
                         0x3007, 0xB2, 0x2160, 0x1F600, 0x20000, 0x10FFFF, 0x212A, 0x17F, 0x301, 0xE9]]
POOL += ["'s", "'t", "'re", "<|endoftext|>", " ", " ", "\n", "the", "tion", "    "]


def odd_texts(count):
    pick = random.Random(7)
    return ["".join(pick.choice(POOL) for _ in range(pick.randint(0, 25))) for _ in range(count)]


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 3000, " " * 2000, "ha" * 1500, "\n" * 500 + "x", "<|endoftext|>" * 3, "é́" * 200])
def test_repetitive_texts(text):
    ids, decoded = expected(text)
    assert bpe.encode_ids(PATH, text) == ids
    assert bpe.decode_ids(PATH, ids) == decoded
    assert tokencount.count_text(PATH, Cutter(*piece_patterns(PATH)), text) == len(ids)


def test_odd_texts():
    cutter = Cutter(*piece_patterns(PATH))
    for text in odd_texts(3000):
        ids, _ = expected(text)
        assert bpe.encode_ids(PATH, text) == ids, repr(text)
        assert tokencount.count_text(PATH, cutter, text) == len(ids), repr(text)


def test_long_texts_are_cut_where_a_piece_ends():
    patterns, added = piece_patterns(PATH)
    whole, small = Cutter(patterns, added), Cutter(patterns, added, chunk=5)
    for text in [" ".join(odd_texts(200)), "no spaces at all" * 3, "x" * 50, "a  b   c \n d " * 20]:
        assert [p for part in small.parts(text) for p in part] == [p for part in whole.parts(text) for p in part]
    assert list(chunks("aaaa bbbb cccc", 5)) == [(0, 9), (9, 14)]


def test_single_tokens_are_proven():
    proven = tokencount.single_tokens(PATH)
    assert " the" in proven and "<|endoftext|>" in proven
    for text in sorted(proven)[::997]:
        assert len(LIBRARY.encode(text, add_special_tokens=False).ids) == 1


def test_decode_of_broken_bytes():
    first = bpe.encode_ids(PATH, "é")[:1]
    assert bpe.decode_ids(PATH, first * 2) == LIBRARY.decode(first * 2, skip_special_tokens=False)


def test_documents(spark):
    rows = [(1, "Hello  world's end", "x"), (1, "Hello  world's end", "x"), (2, None, None), (3, "", "y"), (None, "tail", "z"),
            (4, "word " * 30000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encoded_documents(docs, PATH).collect()
    counts = tokencount.token_counts(docs, PATH, limit=4).collect()
    want = []
    for doc_id, text, _ in rows:
        ids, decoded = expected(text)
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, counts), key=str) == sorted(
        [(d, len((t or "").encode()), w[1], w[1] > 4) for (d, t, _), w in zip(rows, want)], key=str)
    assert bpe.encoded_documents(docs.limit(0), PATH).count() == tokencount.token_counts(docs.limit(0), PATH).count() == 0


def test_store_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "STORE", 50)
    monkeypatch.setattr(tokencount, "STORE", 0)
    cutter = Cutter(*piece_patterns(PATH), chunk=20)
    texts = odd_texts(200)
    for text, (count, digest, _) in zip(texts, bpe.encode_texts(PATH, cutter, texts), strict=True):
        ids, _ = expected(text)
        assert (count, digest) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert tokencount.count_text(PATH, cutter, text) == len(ids)
