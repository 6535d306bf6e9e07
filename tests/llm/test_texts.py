"""Secret scan, quality rules and language identification on small inputs."""

import base64
import hashlib
import json
import random
import re
import zlib

import brute
import pytest

from roomledger.llm import langid, quality, secretscan


def der(tag, body):
    size = len(body)
    length = bytes([size]) if size < 128 else bytes([0x80 | (size.bit_length() + 7) // 8]) + size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([tag]) + length + body


def rsa_key():
    return der(0x30, der(2, b"\0") + b"".join(der(2, bytes([i + 1]) * 40) for i in range(8)))


def ssh_key():
    field = lambda b: len(b).to_bytes(4, "big") + b
    return b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 40) + field(b"s" * 80)


def token(header, claims):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    return f"{part(header)}.{part(claims)}.c2lnbmF0dXJl"


def kinds(text):
    return [k for _, _, k in secretscan.confirmed_spans(text)]


def test_structures():
    key = base64.b64encode(rsa_key()).decode()
    assert kinds(f"x {key} y") == ["der_key"]
    assert kinds(f"x {rsa_key().hex()} y") == ["der_key"]
    assert kinds(f"{base64.b64encode(ssh_key()).decode()}") == ["ssh_key"]
    lines = "\n".join(key[i : i + 64] for i in range(0, len(key), 64))
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{lines}\n-----END RSA PRIVATE KEY-----"
    assert secretscan.confirmed_spans(f"a {pem} b") == [(2, 2 + len(pem), "der_key")]
    assert kinds(token({"alg": "HS256", "typ": "JWT"}, {"sub": "1"})) == ["signed_token"]


@pytest.mark.parametrize("text", [
    token({"typ": "JWT"}, {"sub": "1"}), token({"alg": "HS256"}, [1]), "abcdefgh.ijkl.mn",
    base64.b64encode(rsa_key()[:-1]).decode(), base64.b64encode(rsa_key() + b"\0").decode(),
    base64.b64encode(ssh_key()[:-3]).decode(), "M" * 80, "a" * 64, base64.b64encode(b"\x30\x84" + b"\xff" * 60).decode(),
    "-----BEGIN X-----\nnot base64\n-----END X-----",
])
def test_what_only_looks_like_a_key(text):
    assert kinds(text) == []


def brute_base(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def test_base_spans(spark):
    pick = random.Random(2)
    parts = ["password", "PassWd", "ſecret", "Key", "api_key", "APIKEY", "token", "secret", ":", "=", " ", '"', "'", "abcdef0123456789",
             "AKIA", "ABCDEFGH12345678", "x" * 12, "é", "\n", ".", "token=token=abcdefghijkl", "password: secret: abcdefghijklmnop"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 14))) for _ in range(400)] + [None, "", "a" * 200_000]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "AKIA" * 9, "c")], "doc_id long, text string, spans string")
    rows = secretscan.secret_spans(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = brute_base((texts[r.doc_id] if r.doc_id is not None else "AKIA" * 9) or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k + ":") for k in ("assign", "access", "hex"))
        assert not want or set(want.split(",")) <= set(r.spans.split(","))
    assert secretscan.secret_spans(docs.limit(0)).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame(
        [(1, "a password=abcdef0123456789ab z", 31, None), (2, None, 0, "k"), (3, "clean", 5, "k")], "doc_id long, text string, n_chars long, more string")
    rows = {r.doc_id: r for r in secretscan.redacted(docs).collect()}
    assert rows[1].text == "a [assign] z" and rows[1].n_chars == 12
    assert rows[2].text is None and rows[3] == (3, "clean", 5, "k")


def test_quality_counts(spark):
    pick = random.Random(4)
    words = ["one", "two", "three", "#", "a|b", "é%", "|", "x.", "menu"]
    texts = ["".join(pick.choice(words) + pick.choice([" ", " ", "\n", "\t", " ", "\r\n"]) for _ in range(pick.randint(0, 60))) for _ in range(200)]
    texts += [None, "", " \n\t", "word " * 5000, "same line here.\nsame line here.\n\n\n", "a b c d e a b c d e", "a b c d e f g h i j k"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    for r in quality.judged(docs).collect():
        text = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        repeated = brute.repeated_words(w)
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == repeated
        assert r.base_failed == (len(w) < 10 or 100 * repeated > 20 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality.judged(docs.limit(0)).count() == 0


def test_quality_equals_its_sql(spark):
    from oracle import compare, connect

    from roomledger.llm.oracles import ORACLES
    from roomledger.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    assert compare(QUERIES["op7_quality_rules"](spark, sf_dir), connect(sf_dir), ORACLES["op7_quality_rules"]) is None


def test_many_words_are_compared_the_same_way(monkeypatch):
    pick = random.Random(1)
    lists = [[bytes([pick.choice(b"abc")]) for _ in range(n)] for n in (5, 6, 30, 200)]
    few = [quality.repeated_words(x) for x in lists]
    monkeypatch.setattr(quality, "_LONG", 0)
    assert [quality.repeated_words(x) for x in lists] == few


PROSE = "The quick brown fox jumps over the lazy dog near the river bank today."


@pytest.mark.parametrize(("line", "rule"), [
    ("%%% *** $$$ ###", "punctuation"), ("Home | About us | Contact | Help", "navigation"), ("Home > Shop > Tea and coffee", "navigation"), ("Read more", "navigation"),
    ("Copyright 2020. All rights reserved.", "boilerplate"), (PROSE, None), ("Yes, it is.", None),
])
def test_line_rules(line, rule):
    assert quality.line_fails(line, line.encode().split(), len(line.replace(" ", ""))) == rule


def test_documents_that_lose_their_lines_are_rejected():
    nav = "\n".join(f"Home{c} | About{c} | Contact{c} | Help{c}" for c in "abcdefghij")
    assert not quality.judge(nav)["kept"] and not quality.judge(nav)["base_failed"]
    assert quality.judge(f"{PROSE}\nRead more")["kept"]
    assert quality.cleaned(f"{PROSE}\nRead more\n\n{PROSE}") == f"{PROSE}\n"
    assert quality.cleaned(None) is None


def test_automaton_knows_exactly_the_substrings():
    pick = random.Random(3)
    text = [pick.randint(0, 2) for _ in range(60)]
    edges = langid.suffix_automaton(text)
    inside = {tuple(text[i:j]) for i in range(60) for j in range(i, 61)}

    def known(word):
        state = 0
        for c in word:
            if c not in edges[state]:
                return False
            state = edges[state][c]
        return True

    for n in range(9):
        for _ in range(50):
            word = tuple(pick.randint(0, 2) for _ in range(n))
            assert known(word) == (word in inside)


def plain_phrases(model, sample, language, symbols):
    train = "".join(map(chr, model.symbols(" ".join(sample[language]).lower())[0].tolist()))
    part, at, count = "".join(map(chr, symbols.tolist())), 0, 0
    while at < len(part):
        size = 1
        while at + size < len(part) and part[at : at + size + 1] in train:
            size += 1
        at += size
        count += 1
    return count


@pytest.mark.parametrize("lanes", [1, 3, 100])
@pytest.mark.parametrize("columns", [2, 200])
def test_phrases_match_a_plain_parse(monkeypatch, lanes, columns):
    monkeypatch.setattr(langid, "LANES", lanes)
    monkeypatch.setattr(langid, "COLUMNS", columns)
    sample = {"a": ["the cat sat on the mat with the hat"], "b": ["der hund sitzt auf der matte mit dem hut"], "c": ["猫は帽子の上に座った"]}
    model = langid.Model(sample)
    texts = ["the dog sat", "der hut", "zzz qqq", "x", "the cat sat on the mat with the hat " * 30, "ein hund, der sitzt", "", "猫 der 帽子 xx"]
    coded = [model.symbols(t)[0] for t in texts]
    got = model.phrases(coded)
    for row, symbols in zip(got, coded, strict=True):
        assert row.tolist() == [plain_phrases(model, sample, language, symbols) for language in model.languages]
    assert got[0].tolist()[:2] == [5, 8]


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.language_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_language_edges(spark):
    rows = [(1, "the house and the garden of the king", "en", "a"), (2, "das haus und der garten des koenigs", "de", "b"), (3, None, None, "c"),
            (4, "", "en", "d"), (5, "12 %% 34", "de", "e"), (None, "the king", None, "f"), (1, "the house and the garden of the king", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = langid.language_predictions(docs).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and by[3].score == 0
    assert by[None].lang_pred == "en" and not by[None].held_out
    kept = langid.known_language(docs)
    assert kept.columns == docs.columns and sorted(r.lang_pred for r in kept.collect()) == ["a", "a", "b", "f"]
    empty = docs.limit(0)
    assert langid.language_predictions(empty).count() == langid.known_language(empty).count() == 0
