"""Secrets against plain patterns and a plain check of all pairs of parts."""

import hashlib
import random
import re

from panelloom.llm import secret_links
from panelloom.llm.queries import QUERIES
from tests.llm.conftest import EDGES

SF = "/root/testdata/sf0.001"
HEX = "0123456789abcdef" * 2
TOKEN = "abcdEFGH1234abcdEFGH1234abcdEFGH1234"


def plain_base(text):
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(kind, start, stop) for start, kind, stop in sorted(found)]


def plain_spans(text, reach=secret_links.REACH):
    base = plain_base(text)
    weak = secret_links.weak_parts(text, base)
    blank = [m.end() for m in re.finditer(r"\n[ \t\r\x0b\x0c]*\n", text)]
    scope = lambda start: sum(b <= start for b in blank)
    every = weak + [((1, 0, 1)[kind], start, stop) for kind, start, stop in base]
    spans = list(base)
    for role, start, stop in weak:
        roles = {r for r, s, e in every if scope(s) == scope(start) and (abs(e - start) <= reach or abs(stop - s) <= reach)}
        if {0: 1 in roles, 1: 0 in roles or 2 in roles, 2: {0, 1} <= roles}[role]:
            spans.append((3 + role, start, stop))
    return sorted(spans, key=lambda s: (s[1], s[0], s[2]))


def written(spans):
    return ",".join(f"{secret_links.KINDS[kind]}:{start}:{stop}" for kind, start, stop in spans)


def plain_result(doc_id, text):
    base = plain_base(text or "")
    counts = [sum(kind == i for kind, _, _ in base) for i in range(3)]
    return (doc_id, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(plain_spans(text or "")))


def test_base_patterns():
    text = f"Token = 'abcdef' token=ab API_KEY:{HEX} AKIA{'A' * 16} AKIA{'B' * 15} xAKIAAKIA{'C' * 16} ſecret=abcdefg {HEX[:23]} token=token: abcdef 日本 passwd=\"日\" apikey = zzzzzz"
    assert secret_links.base_spans(text) == plain_base(text)
    assert [text[s:e] for k, s, e in plain_base(text) if k == 1] == ["AKIA" + "A" * 16, "AKIAAKIA" + "C" * 16]


def kinds(text):
    return [secret_links.KINDS[k] for k, _, _ in plain_spans(text)]


def test_weak_parts_need_company():
    assert kinds("user: alice and later nothing") == []
    assert kinds(f"see {TOKEN} alone") == []
    assert kinds(f"user: alice {TOKEN} alone") == ["identifier", "secret"]
    assert kinds(f"user: alice\n \n{TOKEN} in another paragraph") == []
    assert kinds("user: alice " + "word " * 60 + TOKEN) == []
    assert kinds(f"login=bob pwd=hunter2 https://db.example.org/x {HEX}") == ["identifier", "secret", "endpoint", "hex"]
    assert kinds(f"https://example.org/{HEX}") == ["hex"]
    assert kinds("mail us at https://example.org or user: bob") == []


def test_query_matches_plain_pairs(sp, documents, tmp_path):
    rng = random.Random(2)
    bits = ["user: bob", "login = 'ann'", "pwd=xy12", TOKEN, HEX, HEX[:18], "token=ab", "https://a.b/c", "10.0.0.1:80", "host=db1", f"AKIA{'Z' * 16}", "ASIA12345678", "\n\n", "\n", "日本"]
    texts = ["".join(rng.choice(bits) + " " + "word " * rng.choice([0, 1, 5, 39, 40, 50]) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    texts += ["https://" + "a/" * 500 + " user: bob " + TOKEN, f"user: ann {TOKEN} " * 3000, "https://" + "pwd=abcdef&" * 100, "pwd=zzz " * 2000]
    rows = [*EDGES, *[(100 + i, t, "en", "a") for i, t in enumerate(texts)], (100, texts[0], None, None)]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["op11_secret_links"](sp, str(tmp_path)).collect()), key=str)
    want = sorted((plain_result(r[0], r[1]) for r in rows if len(r[1] or "") < 50_000 or "user" not in r[1]), key=str)
    skipped = {100 + i for i, t in enumerate(texts) if len(t) >= 50_000}
    assert [g for g in got if g[0] not in skipped] == [w for w in want if w[0] not in skipped]
    assert all(g[5].count("identifier") == g[5].count("secret") == 3000 for g in got if g[0] in skipped)
    clash = documents(rows).withColumnsRenamed({"start": "base", "path": "row", "kind": "spans", "lang": "parts"})
    assert sorted(map(str, secret_links.find_secrets(clash).select("row.doc_id", "spans").collect())) == sorted(map(str, secret_links.find_secrets(documents(rows)).select("row.doc_id", "spans").collect()))
    assert secret_links.find_secrets(documents(rows).limit(0)).count() == 0


def test_query_on_documents(sp):
    docs = sp.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted(map(tuple, QUERIES["op11_secret_links"](sp, SF).collect()), key=str)
    assert got == sorted((plain_result(r.doc_id, r.text) for r in docs), key=str)
