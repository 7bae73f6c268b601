"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelloom.llm import periodic_runs
from panelloom.llm.periodic_runs import kept_words, word_runs
from panelloom.llm.queries import QUERIES
from tests.llm.conftest import EDGES

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    """Every longest stretch with a period of which no smaller one holds, by trying all periods."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length, part = j + q - i, words[i : j + q]
            if length >= max(6, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_result(doc_id, text):
    words = text.encode().split() if text else []
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    shown = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    collapsed = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.integers(1, 9), st.integers(0, 40)), max_size=5), max_size=3))
def test_runs_match_plain_search(drawn):
    texts = [[w for unit, times, most in parts for w in (unit * times)[:most]] for parts in drawn]
    want, before = [], 0
    for words in texts:
        want += [(s + before, length, q) for s, length, q in plain_runs(words)]
        before += len(words)
    got = word_runs(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts], np.int64))
    assert [tuple(r) for r in got.tolist()] == want


def test_long_periods_and_multiples():
    unit = list(range(1000, 1300))
    got = word_runs(np.array([5, *unit * 5, 6, *[7] * 6]), np.array([1 + 1500 + 7]))
    assert got.tolist() == [[1, 1500, 300], [1502, 6, 1]]
    assert kept_words(10, np.array([[2, 6, 1]])).tolist() == [True] * 3 + [False] * 5 + [True] * 2
    fibonacci = ["a", "b"]
    while len(fibonacci[-1]) < 5000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert len(word_runs(np.frombuffer(fibonacci[-1].encode(), np.uint8).astype(np.int64), np.array([len(fibonacci[-1])]))) == 0


def test_query_on_edges_and_repetitions(sp, documents, tmp_path):
    rng = random.Random(3)
    rows = [*EDGES, (11, "a b " * 3 + "c", None, "runs"), (11, "a b " * 4 + "c " + "a b " * 4, None, None), (12, "x y z " * 5 + "x y z", "en", "row")]
    rows += [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(1, 150))), "en", "a") for i in range(100, 400)]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["op13_periodic_runs"](sp, str(tmp_path)).collect()), key=str)
    assert got == sorted((plain_result(r[0], r[1]) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 10
    whole = periodic_runs.periodic_runs(documents(rows))
    assert whole.columns == ["row", "n_words", "runs", "collapsed"]
    assert whole.select("row.*").columns == [c for c in documents(rows).columns if c != "text"]
    clash = documents(rows).withColumnsRenamed({"start": "runs", "path": "row", "kind": "collapsed"})
    assert periodic_runs.periodic_runs(clash).filter("size(runs) > 0").count() == whole.filter("size(runs) > 0").count()
    assert periodic_runs.periodic_runs(documents(rows).limit(0)).count() == 0


def test_query_on_documents(sp):
    docs = {r.doc_id: r.text for r in sp.read.parquet(f"{SF}/documents.parquet").collect()}
    short = {i for i, t in docs.items() if len(t or "") < 6000}
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](sp, SF).collect()}
    assert set(got) == set(docs)
    assert all(got[i] == plain_result(i, docs[i]) for i in short)
