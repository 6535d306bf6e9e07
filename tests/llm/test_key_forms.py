"""Encrypted keys, PGP blocks, keys in short lines, in hex lines, after a slash and encoded twice."""

import base64
import textwrap
import time

import pytest
from test_texts import der, rsa_key, ssh_key

from roomledger.llm import secretscan

PASSWORD = der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")) + der(0x30, b"\5\0"))
ENCRYPTED = der(0x30, PASSWORD + der(4, b"\7" * 320))
DIGEST = der(0x30, der(0x30, der(6, bytes.fromhex("608648016503040201")) + b"\5\0") + der(4, b"\7" * 32))
RSA = base64.b64encode(rsa_key()).decode()
SSH = base64.b64encode(ssh_key()).decode()
PGP = b"\x95" + (200).to_bytes(2, "big") + b"\4" + b"k" * 199 + b"\xb4\4name"


def wrapped(text, width, between="\n"):
    return between.join(textwrap.wrap(text, width))


def pem(label, body, width=64):
    return f"-----BEGIN {label}-----\n{wrapped(body, width)}\n-----END {label}-----"


def armoured(data, checksum=None, label="PGP PRIVATE KEY BLOCK"):
    checksum = secretscan._checksum24(data) if checksum is None else checksum
    body = wrapped(base64.b64encode(data).decode(), 64)
    return f"-----BEGIN {label}-----\nVersion: X 1 (no-such)\nComment: a--b\n\n{body}\n={base64.b64encode(checksum.to_bytes(3, 'big')).decode()}\n-----END {label}-----"


@pytest.mark.parametrize("around", [("", ""), ("k: ", " and more"), ("see\n", "\nend")])
@pytest.mark.parametrize(("key", "kind"), [
    (pem("ENCRYPTED PRIVATE KEY", base64.b64encode(ENCRYPTED).decode()), "der_key"),
    (base64.b64encode(ENCRYPTED).decode(), "der_key"), (ENCRYPTED.hex(), "der_key"),
    (wrapped(base64.b64encode(ENCRYPTED).decode(), 64), "der_key"), (wrapped(ENCRYPTED.hex(), 64), "der_key"),
    *[(wrapped(RSA, n), "der_key") for n in (16, 20, 32, 39)], *[(wrapped(SSH, n), "ssh_key") for n in (20, 32, 39)],
    (wrapped(RSA, 32, "\\n"), "der_key"),
    *[(wrapped(rsa_key().hex(), n), "der_key") for n in (16, 32, 48, 64, 80)], (wrapped(rsa_key().hex().upper(), 60), "der_key"),
    (base64.b64encode(RSA.encode()).decode(), "der_key"), (base64.b64encode(SSH.encode()).decode(), "ssh_key"),
    (base64.b64encode((pem("RSA PRIVATE KEY", RSA) + "\n").encode()).decode(), "der_key"),
])
def test_forms(key, kind, around):
    text = around[0] + key + around[1]
    assert secretscan.confirmed_spans(text) == [(len(around[0]), len(around[0]) + len(key), kind)]


def test_after_a_slash():
    assert secretscan.confirmed_spans("key/" + RSA) == [(4, 4 + len(RSA), "der_key")]
    assert secretscan.confirmed_spans("a/path/" + wrapped(SSH, 64)) == [(7, 7 + len(wrapped(SSH, 64)), "ssh_key")]


def test_pgp_blocks():
    for data in (PGP, b"\xc5\xc0\x08" + b"\4" + b"k" * 199, b"\xc5\xff\0\0\0\x20\6" + b"k" * 31):
        text = f"a {armoured(data)} b"
        assert secretscan.confirmed_spans(text) == [(2, len(text) - 2, "pgp_key")]
    public = b"\x99" + PGP[1:]
    for text in (armoured(PGP, 1), armoured(public), armoured(PGP[:100]), armoured(PGP[:3] + b"\x63" + PGP[4:])):
        assert secretscan.confirmed_spans(text) == []


def test_no_keys():
    for text in (base64.b64encode(DIGEST).decode(), DIGEST.hex(), rsa_key().hex()[:-2], wrapped(rsa_key().hex() + "00", 64), "30" * 400,
                 "key/M" + "A" * 80, "TQ" * 60, base64.b64encode(b"M" * 90).decode(), pem("PRIVATE KEY", RSA[:-8])):
        assert secretscan.confirmed_spans(text) == []


def test_a_block_without_end_hides_no_other():
    block = pem("PRIVATE KEY", RSA)
    text = "-----BEGIN PRIVATE KEY-----\nnothing " + block + " and " + block
    at = text.index(block)
    assert [s[0] for s in secretscan.confirmed_spans(text)] == [at, at + len(block) + 5]


def test_time_grows_with_the_text():
    """Ten times as many blocks, with and without an end, take some ten times as long."""
    for one in (pem("PRIVATE KEY", RSA) + " x ", "-----BEGIN PRIVATE KEY----- x ", "M" * 40 + " ", RSA[:36] + "\n"):
        seconds = []
        for n in (400, 4000):
            start = time.process_time()
            secretscan.confirmed_spans(one * n)
            seconds.append(time.process_time() - start)
        assert seconds[1] < 40 * max(seconds[0], 0.01), one
