"""Quality rules, personal data and token files against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from panelloom.llm import pii_bootstrap, quality_outliers, token_files
from panelloom.llm.common import shared_folder, tokenizer_path
from panelloom.llm.queries import QUERIES
from tests.llm.conftest import EDGES

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w in windows if windows.count(w) > 1} if len(set(windows)) < len(windows) and len(windows) < 3000 else set()
    repeated = {k for i, w in enumerate(windows) if w in often for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_text_counts_match_plain_counts():
    texts = ["", None, "a b c d e a b c d e", "x\nx\n\n \ny", "é#b $c\x0bd", "a " * 7, "one\x1ctwo"]
    for text in texts:
        assert quality_outliers.text_counts(text)[:5] == plain_counts(text)


def test_chi_square_quantiles():
    assert quality_outliers.chi_square_quantile(0.975, 6) == pytest.approx(14.449, abs=1e-3)
    assert quality_outliers.chi_square_quantile(0.5, 2) == pytest.approx(1.3863, abs=1e-4)


def test_quality_edges(documents):
    rows = quality_outliers.quality_verdicts(documents(EDGES)).collect()
    assert len(rows) == len(EDGES)
    assert {r.doc_id for r in rows if r.base_failed} == {1, 2, 3, 6, 7, None}
    assert quality_outliers.quality_verdicts(documents([])).count() == 0
    kept = quality_outliers.keep_good(documents(EDGES))
    assert kept.columns == documents(EDGES).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)


def test_planted_outliers_go_and_the_rest_stays(documents):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(20, 200))), "en", f"s{i % 3}") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "***" for w in rng.choice(vocabulary, 80)), "en", f"s{i % 3}") for i in range(40)]
    verdict = {r.doc_id: r.kept for r in quality_outliers.quality_verdicts(documents(rows)).collect()}
    assert all(verdict[i] for i in range(300))
    assert not any(verdict[1000 + i] for i in range(40))


def plain_mcd(x, pool):
    """The concentration steps in numpy, from the classical and the pooled start."""
    q = quality_outliers
    best = None
    for start in (0, 1):
        mean, covariance = (x.mean(0), np.cov(x.T, bias=True)) if start == 0 else pool
        if start == 0:
            w = len(x) / (len(x) + q.PRIOR_ROWS)
            mean, covariance = w * mean + (1 - w) * pool[0], w * covariance + (1 - w) * pool[1]
        for _ in range(q.STEPS):
            whole = covariance + np.diag(np.square(q.FLOOR))
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(whole), x - mean)
            bucket = np.floor(16 * np.log2(d + 1e-6))
            below = np.array([(bucket < b).sum() for b in bucket])
            near = x[below < q.KEPT_SHARE * len(x)]
            w = len(near) / (len(near) + q.PRIOR_ROWS)
            mean = w * near.mean(0) + (1 - w) * pool[0]
            covariance = w * q.CONSISTENCY * np.cov(near.T, bias=True) + (1 - w) * pool[1]
        det = np.linalg.slogdet(covariance + np.diag(np.square(q.FLOOR)))[1]
        if best is None or det < best[0]:
            best = det, mean, covariance
    return best


def test_group_estimate_matches_numpy(sp):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)) @ np.diag([1, 0.2, 0.05, 0.1, 0.1, 0.05])
    x[:60] += 2
    vectors = sp.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"{f} double" for f in quality_outliers.FEATURES))
    pool = x.mean(0), np.cov(x.T, bias=True)
    moments = vectors.groupBy("grp").agg(*quality_outliers._moments())
    import pyspark.sql.functions as F

    own = quality_outliers._estimates(moments.withColumn("start", F.lit(0)), pool, 1.0)
    whole = pool[1] + np.diag(np.square(quality_outliers.FLOOR))
    other = sp.createDataFrame([("g", 1, pool[0].tolist(), np.linalg.inv(whole).ravel().tolist(), pool[1].ravel().tolist(), 0.0)], own.schema)
    got = quality_outliers._settled(vectors, own.unionByName(other), pool).first()
    _, mean, covariance = plain_mcd(x, pool)
    assert np.allclose(got.mean, mean, atol=1e-6)
    assert np.allclose(np.reshape(got.covariance, (6, 6)), covariance, atol=1e-6)


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_match_plain_search(documents):
    texts = [
        "a@b.co_x@y.org z@@b.c a@b..c .@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0004 12.3.4", "4111 1111 1111 1111 4111111111111112 1 2 3",
        "+1 (555) 123-4567, +12 +1234567890123456 +1 2 3", "😀é a@b.cd 😀 10.0.0.1", "12345 " * 300, "1" * 20_000, "a" * 20_000 + "@x.yz", "1 " * 9_000,
    ]
    rows = [*EDGES, *[(100 + i, t, "en", "a") for i, t in enumerate(texts)]]
    found = pii_bootstrap.find_spans(documents(rows))
    got = sorted((r.doc_id or 0, r.b) for r in found.select("doc_id", pii_bootstrap.spans_text(found["base"]).alias("b")).collect())
    assert got == sorted((r[0] or 0, plain_spans(r[1])) for r in rows)
    assert pii_bootstrap.find_spans(documents([])).count() == 0


def test_patterns_discover_unseen_identifiers(documents):
    seeds = [(i, f"hello reach me at mail{i}@host{i}.com today", "en", "a") for i in range(12)]
    unseen = [(100, "please reach me at carla@localhost today", "en", "a")]
    clean = [(200 + i, f"in the year {1900 + i} there were {i} of them", "en", "a") for i in range(10)]
    found = pii_bootstrap.find_spans(documents(seeds + unseen + clean))
    got = {r.doc_id: r.s for r in found.select("doc_id", pii_bootstrap.spans_text(found["spans"]).alias("s")).collect()}
    assert got[100] == "email:19:34"
    assert all(got[200 + i] == "" for i in range(10))


def test_redaction(documents):
    rows = [*EDGES, (50, "call +1 (555) 123-4567 or a.b@c.de now", "en", "a"), (51, "10.0.0.1", "en", "a"), (51, "10.0.0.1", "en", "a")]
    got = pii_bootstrap.redact(documents(rows))
    assert got.columns == documents(rows).columns
    texts = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
    want = {50: "call [PHONE] or [EMAIL] now", 51: "[IP]", None: "é 日本 😀 [EMAIL] [IP]"}
    assert texts == sorted((r[0] or 0, want.get(r[0], r[1]) or "") for r in rows)


def test_pii_query_counts(sp):
    rows = QUERIES["op6_pii_bootstrap"](sp, SF).collect()
    text = {r.doc_id: r.text for r in sp.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(text)
    for r in rows:
        base = plain_spans(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [base.count(f"{k}:") for k in PLAIN]
        assert set(base.split(",")) <= set(r.spans.split(","))


def test_variable_length_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 1000):
        ranks = (rng.random(n) * 2.0 ** rng.integers(0, 33, n)).astype(np.uint64).clip(0, 2**32 - 1).astype(np.uint32)
        assert np.array_equal(token_files.unpack(*token_files.pack(ranks), n), ranks)


def test_word_encoder_matches_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    encode, whole = token_files.WordEncoder(path), Tokenizer.from_file(path)
    texts = ["It's 12ab_c naïve ß ẞ", "a<|endoftext|>b", "İstanbul ﬁ é\x1cx\x85y\xa0z", "中文 日本 'S'T's", "", "A\x00B \xad-\xad ª²½", "é x ́y"]
    for text in texts:
        assert encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_token_files(sp, documents):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    folder = shared_folder(sp, "test-tokens")
    token_files.write_token_files(documents(EDGES), folder, path, block_ids=20)
    got = token_files.read_token_files(sp, folder, token_files.ids_crc32, "ids_crc32 long").collect()
    start, want = 0, []
    for doc_id, text, *_ in sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    # one ranking for all blocks: falling frequency over the whole corpus, ties by id
    counts = {}
    for _, text, *_ in EDGES:
        for i in [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, 2]:
            counts[i] = counts.get(i, 0) + 1
    ranking = [r.id for r in sp.read.parquet(f"{folder}/ranking").orderBy("rank").collect()]
    assert ranking == sorted(counts, key=lambda i: (-counts[i], i))
    blocks = sp.read.parquet(f"{folder}/blocks").collect()
    assert len(blocks) > 3 and sum(b.n_ids for b in blocks) == sum(counts.values())
    assert all(max(token_files.unpack(b.control, b.data, b.n_ids)) < len(ranking) for b in blocks)
    token_files.write_token_files(documents([]), f"{folder}-none", path)
    assert token_files.read_token_files(sp, f"{folder}-none").count() == 0
