"""The pipeline on documents with planted junk, copies and personal data."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from panelloom.llm.common import shared_folder


def test_stages_take_effect(sp, documents):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(500)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(40, 120))) for _ in range(120)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(500 + i, t, "en", "s0") for i, t in enumerate(texts[:20])]  # exact copies
    rows += [(600 + i, " ".join(w + "###" for w in rng.choice(vocabulary, 60)), "en", "s1") for i in range(10)]  # junk
    rows += [(700, texts[50] + " zz mail me@host.org now " + texts[51], "en", "s2"), (None, None, None, None), (701, "", "en", None)]
    docs, columns = documents(rows), documents(rows).columns
    folder = shared_folder(sp, "test-pipeline")
    seen = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(sp, docs, "").write.parquet(f"{folder}/{number}")
        docs = sp.read.parquet(f"{folder}/{number}")
        seen.append(docs)
    assert all(s.columns == columns for s in seen[:4])
    good, single, private, mixed, coded = seen
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    assert kept == set(range(120)) | set(range(500, 520)) | {700}
    assert {r.doc_id for r in single.select("doc_id").collect()} == set(range(120)) | {700}
    assert private.count() == single.count()
    assert private.filter(F.col("text").contains("[EMAIL]")).count() == 1
    assert {r.doc_id for r in mixed.select("doc_id").collect()} <= {r.doc_id for r in private.select("doc_id").collect()}
    assert coded.groupBy().agg(F.sum(F.size("ids"))).first()[0] > 0


def test_run_on_empty_documents(sp, tmp_path):
    sp.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(sp, str(tmp_path)).count() == 0
