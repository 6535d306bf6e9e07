"""Keys whose line breaks are escaped, and keys wrapped without BEGIN and END lines."""

import base64
import json
import textwrap

import pytest
from test_texts import rsa_key, ssh_key

from roomledger.llm import secretscan

KEYS = [("der_key", base64.b64encode(rsa_key()).decode()), ("ssh_key", base64.b64encode(ssh_key() ).decode())]


def lines(body, width, between="\n"):
    return between.join(textwrap.wrap(body, width))


@pytest.mark.parametrize(("kind", "body"), KEYS)
def test_escaped_breaks_in_pem(kind, body):
    pem = f"-----BEGIN PRIVATE KEY-----\n{lines(body, 64)}\n-----END PRIVATE KEY-----\n"
    forms = [json.dumps({"private_key": pem}), json.dumps(json.dumps({"k": pem})), json.dumps({"k": pem}).replace("/", "\\/"),
             "KEY=" + pem.replace("\n", "\\n"), json.dumps({"k": pem.replace("\n", "\r\n")})]
    for form in forms:
        ((start, end, found),) = secretscan.confirmed_spans(form)
        assert found == kind and form[start:].startswith("-----BEGIN") and form[:end].endswith("-----END PRIVATE KEY-----")
        assert body[:40] not in secretscan.redact(form) and body[-20:] not in secretscan.redact(form)


@pytest.mark.parametrize(("kind", "body"), KEYS)
@pytest.mark.parametrize("between", ["\n", "\r\n", "\n    ", "\\n", "\\\\n", "\\r\\n"])
@pytest.mark.parametrize("width", [64, 76])
def test_wrapped_without_marks(kind, body, between, width):
    key = lines(body, width, between)
    for before, after in (("", ""), ("k: ", "\nThe next line"), ("a line\n", " and more"), ('{"k": "\\n', '\\n"}'), ("", "\n" + "A" * 64)):
        text = before + key + after
        spans = [s for s in secretscan.confirmed_spans(text)]
        assert spans == [(len(before), len(before) + len(key), kind)]


def test_wrapped_lines_that_are_no_keys():
    body = KEYS[0][1]
    for text in (lines("M" * 700, 64), lines("MIIE" + "A" * 700, 64), lines(body[:-8], 64), lines(body[4:], 64), lines("b3BlbnNzaC1rZXktdjEA" + "A" * 200, 64)):
        assert secretscan.confirmed_spans(text) == []
