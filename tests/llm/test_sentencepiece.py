"""SentencePiece encoding against the library's own ids, for a BPE and a unigram file, in chunks of any size."""

import random
import struct

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelloom.llm import sentencepiece_scan
from panelloom.llm.common import tokenizer_path
from panelloom.llm.queries import QUERIES
from panelloom.llm.sentencepiece_scan import PieceModel
from tests.llm.conftest import EDGES

SF = "/root/testdata/sf0.001"
BPE = tokenizer_path("piece_bpe_32k.model")
LONG = ["ab" * 300, "日本語" * 100, "the of and " * 60, "a  b   c " * 40, "x\ny\t" * 50, "😀é" * 70, "aaaaaaa" * 40 + " the" * 9, "international" * 150]
ALPHABET = "abcdeé日 \n\t▁the"


def normal(text):
    return "▁" + text.replace(" ", "▁") if text else ""


def _varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _bytes(number, data):
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _int(number, n):
    return _varint(number << 3) + _varint(n)


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """A unigram model file with byte pieces and scores in steps that sum exactly."""
    rng = random.Random(4)
    words = {"▁", "▁▁", *"abcdethx"} | {"".join(rng.choice("▁abcdethé") for _ in range(rng.randint(2, 6))) for _ in range(300)}
    words = sorted(w for w in words if "▁" not in w.lstrip("▁"))
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(w, -rng.randint(1000, 12_000) / 1024, 1) for w in words]
    data = b"".join(_bytes(1, _bytes(1, p.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", s) + _int(3, kind)) for p, s, kind in pieces)
    data += _bytes(2, _int(3, 1) + _int(35, 1)) + _bytes(3, _bytes(1, b"identity") + _int(3, 1) + _int(4, 0) + _int(5, 1))
    path = tmp_path_factory.mktemp("unigram") / "unigram.model"
    path.write_bytes(data)
    return str(path)


@pytest.fixture(params=["bpe", "unigram"])
def path(request):
    return BPE if request.param == "bpe" else request.getfixturevalue("unigram")


def own_scan(model, text, chunk):
    """The chunks of a text through matrices, states and traces, without Spark."""
    parts = model.cut(normal(text), chunk)
    assert "".join(part for _, part, _ in parts) == normal(text)
    states = sentencepiece_scan.states_along([model.transfer(*p) for p in parts], 0, 0)
    return np.concatenate([model.trace(*p, enter, leave) for p, enter, leave in zip(parts, states[:-1], states[1:], strict=True)])


def score_of(model, ids):
    return model.id_scores[ids].sum()


@settings(max_examples=150, deadline=None)
@given(text=st.text(st.sampled_from(ALPHABET), max_size=60), chunk=st.integers(1, 20))
def test_bpe_ids_are_those_of_the_library(text, chunk):
    model, library = sentencepiece_scan.piece_model(BPE), sentencepiece.SentencePieceProcessor(model_file=BPE)
    assert model.encode(normal(text)).tolist() == library.encode(text)
    if text:
        assert own_scan(model, text, chunk).tolist() == library.encode(text)


def test_unigram_ids_are_those_of_the_library(unigram):
    model, library, rng = PieceModel(unigram), sentencepiece.SentencePieceProcessor(model_file=unigram), random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80)))
        assert model.encode(normal(text)).tolist() == library.encode(text)
        if text:
            chunked = own_scan(model, text, rng.randint(1, 20))
            assert score_of(model, chunked) == score_of(model, model.encode(normal(text)))
            assert sentencepiece_scan.decode_ids(chunked, sentencepiece_scan.surfaces(unigram)).decode() == normal(text).replace("▁", " ")


def test_documents_get_the_ids_of_the_library(sp):
    texts = [r.text or "" for r in sp.read.parquet(f"{SF}/documents.parquet").collect()] + LONG
    model, library = sentencepiece_scan.piece_model(BPE), sentencepiece.SentencePieceProcessor(model_file=BPE)
    assert [i.tolist() for i in model.encode_all([normal(t) for t in texts])] == library.encode(texts)


def test_long_units_are_merged_alike():
    model, rng = sentencepiece_scan.piece_model(BPE), random.Random(3)
    library = sentencepiece.SentencePieceProcessor(model_file=BPE)
    for size in (2, 3, 65, 400, 1023, 1024, 3000):
        unit = "".join(rng.choice("aeinrst") for _ in range(size))
        assert model.encode(normal(unit)).tolist() == library.encode(unit) == own_scan(model, unit, 50).tolist()
    assert len(model.cut(normal("x" * 5000), 50)) == 1


def test_the_cache_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(sentencepiece_scan, "CACHE_BYTES", 60_000)
    model, whole, rng = PieceModel(BPE), sentencepiece_scan.piece_model(BPE), random.Random(5)
    merged = []
    many = model.merged_many
    monkeypatch.setattr(model, "merged_many", lambda units: merged.extend(units) or many(units))
    for _ in range(60):
        text = normal(" ".join(["often", *("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))]))
        assert np.array_equal(model.encode(text), whole.encode(text))
        assert model.unit_ids.held <= 30_000 and len(model.unit_ids) + len(model.unit_ids.older) < 300
    assert merged.count("▁often") == 1 and len(merged) > 2000


def test_files_of_other_kinds_are_refused(tmp_path):
    piece = _bytes(1, _bytes(1, b"a") + _int(3, 1))
    for name, data in {"word": _bytes(2, _int(3, 3)) + _bytes(3, _int(4, 0)), "nfkc": _bytes(3, _bytes(2, b"x")), "spaces": b"", "user": _bytes(1, _bytes(1, b"b") + _int(3, 4)) + _bytes(3, _int(4, 0))}.items():
        (tmp_path / name).write_bytes(piece + data)
        with pytest.raises(ValueError):
            sentencepiece_scan.model_kind(str(tmp_path / name))


@pytest.mark.parametrize(("chunk", "fan"), [(1 << 15, 64), (37, 3), (20, 2)])
def test_scan_in_spark(sp, documents, path, chunk, fan):
    model, library = PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [r for r in EDGES if len(r[1] or "") < 1000] + [(100 + i, t, "en", "a") for i, t in enumerate(LONG)]
    docs = documents(rows).withColumnsRenamed({"start": "ids", "path": "row", "kind": "chunk", "source": "giant", "n_chars": "part"})
    encoded = sentencepiece_scan.encode(docs, path, chunk, fan).cache()
    assert encoded.columns == ["row", "giant", "chunk", "n_chunks", "ids"]
    found = {}
    for r in encoded.orderBy("chunk").collect():
        found.setdefault((r.row.doc_id, r.giant), []).extend(r.ids)
    for doc_id, text, *_ in rows:
        if doc_id == 4:
            continue
        (ids,) = [v for k, v in found.items() if k[0] == doc_id]
        if path == BPE:
            assert ids == library.encode(text or "")
        else:
            assert score_of(model, np.array(ids, int)) == score_of(model, np.array(library.encode(text or ""), int))
    back = sorted((r.row.doc_id or 0, r.text) for r in sentencepiece_scan.decode(encoded, path).collect())
    assert back == sorted((r[0] or 0, r[1] or "") for r in rows)
    encoded.unpersist()


def test_query(sp):
    rows = QUERIES["op3_sentencepiece"](sp, SF).collect()
    assert rows and all(r.round_trip for r in rows)
    assert sentencepiece_scan.encode(sp.createDataFrame([], "text string"), BPE).filter(F.col("n_chunks") > 0).count() == 0


def test_max_plus_products_associate():
    rng = np.random.default_rng(2)
    a, b, c = (np.where(rng.random((5, 5)) < 0.3, -np.inf, rng.integers(-9, 9, (5, 5)).astype(float)) for _ in range(3))
    product = sentencepiece_scan.product
    assert np.array_equal(product(product(a, b), c), product(a, product(b, c)))
