"""Keys wrapped over lines, without PEM lines or with written-out line breaks."""

import json
import random

from clickloom.llm import secrets
from tests.llm.test_secrets import EC, PKCS8, PUBLIC, RSA, SSH, b64, kinds, url


def wrap(text, width, end="\n"):
    return end.join(text[i : i + width] for i in range(0, len(text), width))


def test_wrapped_without_pem_lines():
    for data, kind in ((RSA, "der_key"), (PKCS8, "der_key"), (EC, "der_key"), (SSH, "ssh_key")):
        for digits in (b64(data), url(data), data.hex(), data.hex().upper()):
            for width in (32, 64, 76):
                for end in ("\n", "\r\n", "\n    ", "\\n", "\\r\\n", "\\\\n"):
                    body = wrap(digits, width, end)
                    text = f"see {body} there and more"
                    assert (4, 4 + len(body), kind) in secrets.spans(text), (kind, width, end)
                    assert kind in kinds(f'"key: \\n{body}\\n"'), (kind, width, end)


def test_neighbours():
    text = wrap(b64(RSA), 64) + "\n" + wrap(b64(PKCS8), 64) + "\nnotes\n" + wrap(b64(SSH), 76)
    assert kinds(text) == ["der_key", "der_key", "ssh_key"]


def test_pem_with_written_out_breaks():
    for name, data in (("RSA ", RSA), ("", PKCS8), ("OPENSSH ", SSH)):
        pem = f"-----BEGIN {name}PRIVATE KEY-----\n{wrap(b64(data), 64)}\n-----END {name}PRIVATE KEY-----\n"
        for text in (pem, json.dumps({"private_key": pem}), json.dumps(json.dumps({"private_key": pem})), pem.replace("\n", "\\r\\n")):
            # A body of one line is a run of its own as well.
            assert [k for k in kinds(text) if k.endswith("_key")] in (["pem_key"], ["pem_key", "der_key"][: 1 + (data == PKCS8)]), text


def test_wrapped_digits_that_are_no_key():
    noise = random.Random(1).randbytes(600)
    for data in (PUBLIC, RSA[:-1], noise, b"\x30\x82\x02\x00" + noise):
        for digits in (b64(data), data.hex().upper()):
            assert [k for k in kinds(f"see {wrap(digits, 64)} there") if k.endswith("_key")] == []


def test_repeated_starts_of_keys_cost_time_in_proportion():
    import base64
    import time

    from clickloom.llm import secrets

    ssh = "b3BlbnNzaC1rZXktdjEAAAAA"
    der = "MIL" + base64.b64encode(bytes(range(60))).decode().rstrip("=").replace("+", "a").replace("/", "b")
    for line in (ssh, der):
        took = []
        for n in (20_000, 40_000):
            text = "\n".join([line] * n)
            began = time.process_time()
            assert [s for s in secrets.spans(text) if s[2] not in secrets.BASE] == []
            took.append(time.process_time() - began)
        assert took[1] < 3.5 * took[0] + 0.5 and took[1] < 12, took
