from __future__ import annotations

import base64
import hashlib
import json
import re

from emberline.llm import licences as L
from emberline.llm import secrets as S


def der(tag, body):
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([128 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


def integer(n):
    return der(0x02, bytes(range(1, 1 + n)))


RSA = der(0x30, der(0x02, b"\0") + b"".join(integer(n) for n in (65, 3, 64, 32, 32, 32, 32, 32)))
PKCS8 = der(0x30, der(0x02, b"\0") + der(0x30, der(0x06, b"\x2a\x86\x48")) + der(0x04, RSA))
EC = der(0x30, der(0x02, b"\1") + der(0x04, bytes(32)) + der(0xA0, der(0x06, b"\x2b\x81")))


def b64(data):
    return base64.b64encode(data).decode()


def token(head, body, sign="c2lnbmF0dXJl"):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    return f"{part(head)}.{part(body)}.{sign}"


def test_structure():
    assert S.is_key(RSA) and S.is_key(PKCS8) and S.is_key(EC)
    assert not S.is_key(RSA[:-1]) and not S.is_key(RSA + b"\0") and not S.is_key(b"") and not S.is_key(b"\x30\x80")
    broken = bytearray(PKCS8)
    broken[8] += 1  # a nested length
    assert not S.is_key(bytes(broken))
    assert not S.is_key(der(0x30, der(0x02, b"\0") + der(0x0C, b"only text here")))


def test_confirmed_spans():
    pem = "\n".join(b64(RSA)[i : i + 64] for i in range(0, len(b64(RSA)), 64))
    openssh = b64(b"openssh-key-v1\0" + bytes(40))
    cases = [(pem, "der_base64"), (b64(EC), "der_base64"), (RSA.hex(), "der_hex"), (RSA.hex().upper(), "der_hex"), (openssh, "openssh"),
             (token({"alg": "HS256", "typ": "JWT"}, {"sub": "x"}), "signed_token")]
    for secret, kind in cases:
        text = f"é before {secret} after"
        assert S.confirmed_spans(text) == [(9, 9 + len(secret), kind)], kind
    for clean in (token({"typ": "JWT"}, {"sub": "x"}), b64(RSA)[4:], b64(bytes(60)), "00" * 40, "30" * 40, "a.b.c", "eyJhbGciOiJub25lIn0.x.y"):
        assert S.confirmed_spans(f"x {clean} y") == []


KIND = (("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))


def test_digests(spark):
    texts = [
        None, "", "password: short", 'Password = "longenough1" token=abcdefgh', "secret:secret:abcdefghij", "api-key=12345678", "APIKEY:12345678 api_key = 'x.y/z+w=='",
        "AKIA" + "A1" * 8 + " AKIAIOSF", "f" * 31 + " " + "0a" * 16, "ſecret=abcdefghij toKen=12345678", "token = \"" + "ab" * 20 + "\"", "x" * 200_000 + " passwd=12345678",
        f"token={token({'alg': 'RS256'}, {})} {b64(RSA)}", "中文 token:abcdefgh\nsecret \n= abcdefgh",
    ]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, texts[3], 1), (3, texts[3], 1)], "doc_id long, text string, base int")
    got = S.secret_digests(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = texts[3 if r.doc_id is None else r.doc_id] or ""
        found = sorted((m.start(), i, k, m.end()) for i, (k, p, g, n) in enumerate(KIND) for m in re.finditer(p, text) if len(m[g]) >= n)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(f[2] == k for f in found) for k, *_ in KIND]
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert {s.split(":")[0] for r in got if r.doc_id == 12 for s in r.spans.split(",")} == {"assign", "signed_token", "der_base64"}
    assert S.secret_digests(docs.limit(0)).count() == 0


def test_licences(spark):
    prose = "thon ereand the of in that onha thwhou ering"
    texts = {
        1: ("Released under the MIT License.", "mit"), 2: (f"{prose}.\nLicensed under the Apache License, Version 2.0.", "apache"),
        3: (f"{prose} This work is licensed under the GNU General Public License, version 2. {prose}", "gpl"),
        4: ("Licensed under CC BY-NC 4.0.\nlicensed under cc by-sa 3.0", "cc-by-nc,cc-by-sa"), 5: (prose, ""), 6: ("The license of the driver is in the car.", ""),
        7: (f"{prose} " * 300 + "Subject to the terms of the Mozilla Public License, v. 2.0. " + f"{prose} " * 30, "mpl"), 8: ("", ""), 9: (None, ""),
        10: ("Licensed under the GNU Lesser General Public License version 3\n" * 3, "lgpl"), 11: ("public public public version of the of the", ""),
    }
    rows = [(k, t, "x") for k, (t, _) in texts.items()]
    docs = spark.createDataFrame([*rows, (None, "Released under the MIT License", "x"), rows[0]], "doc_id long, text string, family string")
    got = L.licence_families(docs).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert r.families == ("mit" if r.doc_id is None else texts[r.doc_id][1]), r
        for f in r.found:
            assert 0.5 <= f.probability <= 1 and f.start < f.end
    assert L.licence_families(docs.limit(0)).count() == 0


def test_licence_accuracy_on_variations():
    import random

    rng = random.Random(99)
    model = L.fit([["er", "thon", "and", "the", "of", str(k)] for k in range(300)])
    wrong = n = 0
    for words, label in L._examples([["thing", "thon", "the", "of", "this"]], rng):
        family = model.family(words)[0]
        n += 1
        wrong += family != L.FAMILIES[label]
    assert wrong <= 0.1 * n
