"""SimHash, KD-tree search, votes, mixing, sharding and the url cascade against plain versions."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.llm import mixing, pii_bootstrap, quality_knn, quality_outliers, sharding, simhash, topk_kdtree, url_cascade
from panelloom.llm.common import n_words
from panelloom.llm.components import connected_components, contractions
from panelloom.llm.queries import LISTED, ORACLES, QUERIES, URL_RULES
from tests.llm.conftest import EDGES
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(sp, name):
    outcome = compare(sp, connect(SF), SF, name, QUERIES[name], ORACLES[name])
    assert outcome.startswith("ok"), outcome


def plain_components(fps, radius):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    labels = np.arange(len(fps))
    while True:
        new = np.where(near, labels[None, :], len(fps)).min(axis=1)
        if (new == labels).all():
            return labels
        labels = new


@pytest.mark.parametrize("radius", range(8))
def test_sliced_links(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = base[rng.integers(0, 30, 400)]
    for _ in range(4):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    fps = np.unique(fps)
    cuts = np.array([1, 65, 200, len(fps)])
    ends = cuts[np.searchsorted(cuts, np.arange(len(fps)), "right")]
    got = {(int(i), int(j)) for a, b in simhash.sliced_links(fps, ends, radius) for i, j in zip(a, b, strict=True)}
    distance = np.bitwise_count(fps[:, None] ^ fps[None, :])
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, ends[i]) if distance[i, j] <= radius}


@pytest.mark.parametrize("bucket", [4096, 8])
def test_near_links_find_all_components(sp, bucket):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = base[rng.integers(0, 12, 300)]
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    fps = np.unique(fps)
    links = simhash.near_links(sp.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), 4, bucket)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    got = [roots.get(int(x), int(x)) for x in fps.view(np.int64)]
    want = plain_components(fps, 4)
    pairs = {(g, w) for g, w in zip(got, want.tolist(), strict=True)}
    assert len(pairs) == len({g for g, _ in pairs}) == len({w for _, w in pairs})


@pytest.mark.parametrize(("size", "most"), [(40, 4), (1000, 7), (10_000, 9)])
@pytest.mark.parametrize("order", ["ascending", "descending", "random"])
def test_components_of_a_long_chain(sp, size, most, order):
    """The rounds grow with the logarithm of the chain, whatever the order of its ids."""
    ids = np.arange(size + 1) * (1 if order == "ascending" else -1)
    if order == "random":
        ids = np.random.default_rng(size).permutation(ids)
    edges = [*zip(ids[:-1].tolist(), ids[1:].tolist(), strict=True), (10**6, 10**6 + 1), (10**6, 10**6)]
    rounds = contractions(sp.createDataFrame(edges, "a long, b long"))
    assert len(rounds) <= most
    roots = {r.node: r.root for r in rounds[0].collect()}
    assert len(roots) == size + 3 and len({roots[i] for i in ids.tolist()}) == 1
    assert roots[10**6] == roots[10**6 + 1] != roots[0]


def test_components_of_stars_and_random_graphs(sp):
    star = sp.createDataFrame([(7, i) for i in range(8, 3000)], "a long, b long")
    rounds = contractions(star)
    assert len(rounds) == 1 and rounds[0].select("root").distinct().count() == 1
    rng = np.random.default_rng(3)
    edges = rng.integers(0, 1500, (1000, 2)).tolist()
    labels = np.arange(1500)
    for a, b in edges:
        labels[labels == labels[a]] = labels[b]
    roots = {r.node: r.root for r in connected_components(sp.createDataFrame(edges, "a long, b long")).collect()}
    groups = {}
    for node, root in roots.items():
        groups.setdefault(labels[node], set()).add(root)
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)
    assert connected_components(sp.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_simhash_edges(documents):
    found = simhash.near_duplicates(documents(EDGES)).collect()
    assert len(found) == len(EDGES)
    ids = {r.doc_id: r.component_id for r in found}
    assert ids[1] == ids[2] == ids[3] == 1 and ids[4] == ids[5] == 4
    kept = simhash.keep_one(documents(EDGES))
    assert kept.columns == documents(EDGES).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 6, 7]
    assert simhash.near_duplicates(documents([])).count() == 0


def test_topk_edges(sp):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(600)]
    rows += [(1000, None), (1001, [None, 1.0, 1.0, 1.0, 1.0]), (1002, [float("nan")] * 5), (None, [9.0] * 5), (1003, [1.0, 2.0]), (50, [0.5, 0.5])]
    rows += [(2000 + i, [0.25] * 5) for i in range(300)] + [(2000, [0.25] * 5), (3000, [])]
    df = sp.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = topk_kdtree.top_k(topk_kdtree.usable(df), F.col("id") % 50 == 0, 5)
    found = sorted((r.query_id, r["rank"], r.score, r.id) for r in got.collect())
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for i, q in good:
        if i % 50 == 0:
            scored = sorted((-int(q @ v), j) for j, v in good if len(v) == len(q) and j != i)[:5]
            want += [(i, n + 1, -s, j) for n, (s, j) in enumerate(scored)]
    assert found == sorted(want)
    assert topk_kdtree.top_k(topk_kdtree.usable(df.limit(0)), F.col("id") % 50 == 0).count() == 0


def test_topk_sends_clustered_queries_to_few_shards(sp):
    """Queries meet the shards whose box can reach their k-th score; a hot vector is dealt out in pieces."""
    rng = np.random.default_rng(7)
    centres = np.eye(8) * 20
    rows = [(i, (centres[i % 8] + rng.normal(size=8) * 0.05).tolist()) for i in range(4000)]
    rows += [(10_000 + i, [30.0] + [0.0] * 7) for i in range(3000)]  # one vector three thousand times
    df = sp.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    usable = topk_kdtree.usable(df)
    plan = topk_kdtree.ShardPlan(usable, 500)
    dealt = plan.dealt(usable).cache()
    plan.measure(dealt, 500)
    sizes = {r["s"]: r["count"] for r in dealt.groupBy(plan.shard(F.col("_leaf"), F.col("_row")).alias("s")).count().collect()}
    assert plan.shards >= 14 and set(sizes) <= set(range(plan.shards)) and max(sizes.values()) <= 1000
    queries = dealt.filter(F.col("id") % 50 == 0).drop("_leaf").withColumn("_floor", F.lit(19.0 * 20 * 256 * 256))
    first, rest = plan.sent(queries, False).count(), plan.sent(queries, True).count()
    assert first == queries.count() == 140
    # the seven other clusters cannot reach the score; the pieces of the hot vector and its cluster can
    assert rest < 0.5 * first * (plan.shards - 1)
    got = sorted((r.query_id, r["rank"], r.score, r.id) for r in topk_kdtree.top_k(usable, F.col("id") % 50 == 0, 5, 500).collect())
    whole = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    ids = np.array([i for i, _ in rows])
    want = []
    for at in np.flatnonzero(ids % 50 == 0):
        scores = whole @ whole[at]
        best = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[at]][:5]
        want += [(int(ids[at]), n + 1, int(scores[j]), int(ids[j])) for n, j in enumerate(best)]
    assert got == sorted(want)


def test_topk_bounds_hold_for_large_sums():
    rng = np.random.default_rng(8)
    for size in (1.0, 2.0**30, 1e100):
        vectors = np.floor(rng.normal(size=(200, 6)) * size * 1000)
        queries = np.floor(rng.normal(size=(20, 6)) * size * 1000)
        bounds = topk_kdtree.box_bounds(queries, vectors.min(axis=0)[None], vectors.max(axis=0)[None])[:, 0]
        exact = [max(sum(int(a) * int(b) for a, b in zip(v, q, strict=True)) for v in vectors) for q in queries]
        assert all(b >= e for b, e in zip(bounds.tolist(), exact, strict=True))


def test_topk_with_huge_components(sp):
    df = sp.createDataFrame([(0, [1e30, 1.0]), (1, [1e3, 2.0]), (2, [-1e30, 0.0]), (50, [3.0, 4.0])], "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in topk_kdtree.top_k(topk_kdtree.usable(df), F.col("id") % 50 == 0).collect()}
    assert got[(50, 1)] == (0, 2**63 - 1) and got[(50, 3)] == (2, -(2**63)) and got[(50, 2)][0] == 1


def test_votes_learn_from_labels_that_are_not_held_out(sp):
    df = QUERIES["op5_quality_votes"](sp, "/root/testdata/sf0.01")
    labels = {r.doc_id: r.quality for r in sp.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = df.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = (np.array([r.score for r in held if labels[r.doc_id] == side]) for side in (1, 0))
    area = np.mean((good[:, None] > bad) + 0.5 * (good[:, None] == bad))
    caught = [np.mean([r.predicted == side for r in held if labels[r.doc_id] == side]) for side in (0, 1)]
    assert len(good) > 20 and len(bad) > 5 and area > 0.9 and np.mean(caught) > 0.85


def test_votes_edges(sp, documents):
    docs = documents(EDGES).select("doc_id", "text")
    labels = sp.createDataFrame([(4, 1), (6, 0), (7, None), (9, 1), (5, 7)], "doc_id bigint, label int")
    model = quality_knn.fit(docs, labels)
    scored = quality_knn.score(docs, model).collect()
    assert len(scored) == len(EDGES) and all(0 <= r.score <= 1 for r in scored)
    got = {r.row.doc_id: r.score for r in scored}
    assert got[1] == got[2] == 0.5 and got[4] > 0.5 > got[6]
    # plain: cosines to all labelled vectors, votes of the nearest
    texts = {r[0]: r[1] for r in EDGES}
    counts = np.stack([quality_knn.term_counts(texts[i]) for i in (5, 7)])
    latent = quality_knn.weights(counts, model.idf) @ model.basis
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    votes = np.maximum(latent @ model.known.T, 0) ** quality_knn.SHARPNESS * model.class_weight[model.labels]
    total = votes.sum(axis=1)
    want = np.where(total > 0, votes @ (model.labels == 1) / np.where(total > 0, total, 1), 0.5)
    assert np.allclose([got[5], got[7]], want, atol=1e-6)
    empty = quality_knn.fit(docs.limit(0), labels)
    assert {r.score for r in quality_knn.score(docs, empty).collect()} == {0.5}


CLASHES = ["spans", "row", "_id", "_th", "_copies", "target", "source_no", "score", "listed", "ids", "taken", "kept_id", "key", "text_hash", "size", "copies", "base", "start", "path", "kind", "_row", "component_id"]


def test_own_columns_of_any_name_and_kind_come_through(sp):
    """Stages and operators keep columns whose names they use themselves, and columns of maps."""
    extra = [F.lit(f"own {c}").alias(c) for c in CLASHES] + [F.create_map(F.lit("a"), F.col("doc_id")).alias("m")]
    texts = ["one two three four five six seven eight nine ten a@b.org", "one two three four five six seven eight nine ten a@b.org", "other words stand here and go on for some time to be read", None, ""]
    docs = sp.createDataFrame([(i, t, "en", "s", 5) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").select("*", *extra)
    own = [f"own {c}" for c in CLASHES]
    for stage in (simhash.keep_one, pii_bootstrap.redact, mixing.mixed_documents, quality_outliers.keep_good):
        out = stage(docs)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, stage
        assert all([r[c] for c in CLASHES] == own and r.m == {"a": r.doc_id} for r in out.collect()), stage
    sized = docs.drop("size").withColumn("size", F.lit(70))
    rows = mixing.taken_words(sized).collect()
    assert len(rows) == 5 and all(r.row.target == "own target" and r.row.taken == "own taken" for r in rows)
    scored = quality_knn.score(docs, quality_knn.fit(docs, sp.createDataFrame([(0, 1), (2, 0)], "doc_id bigint, label int"))).collect()
    assert all(r.row.score == "own score" and 0 <= r.score <= 1 for r in scored)


def test_mix(sp, documents):
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(rng.integers(1, 200)), "en", [None, "a", "b", "c", "d"][min(4, int(rng.integers(0, 12)))]) for i in range(800)] + EDGES
    docs = documents(rows).select("doc_id", "source", n_words(F.col("text")).alias("size"))
    got = mixing.taken_words(docs, bucket_rows=50).collect()
    assert len(got) == len(rows)
    sizes, targets, taken = {}, {}, {}
    for r in got:
        assert r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        targets[r.source] = r.target
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            want[s] = 2.0 * sizes[s]
        left -= sum(want[s] for s in full)
        open_ -= full
    want |= {s: weight[s] * level for s in open_}
    for s in names:
        assert targets[s] == pytest.approx(want[s])
        assert abs(taken[s] - targets[s]) <= 4 * mixing.BLOCK_WORDS
    again = mixing.taken_words(docs, bucket_rows=50).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(documents(rows))
    assert mixed.columns == documents(rows).columns
    assert mixing.taken_words(docs.limit(0)).count() == 0


def test_schedule_prefixes_follow_the_shares(sp):
    targets = sp.createDataFrame([("a", 0, 10, 5.0, 50.0), ("b", 1, 10, 2.0, 30.0), ("c", 2, 10, 1.0, 20.0)], "source string, source_no int, source_size long, weight double, target double")
    rows = sorted(mixing.schedule(sp, targets, 1000, stretch=64).collect(), key=lambda r: r.slot)
    counts = np.zeros(3)
    for n, r in enumerate(rows, 1):
        assert r.rank == counts[r.source_no]
        counts[r.source_no] += 1
        assert np.abs(counts - n * np.array([0.5, 0.3, 0.2])).max() < 6


def test_sharding(sp, documents):
    docs = documents([(i % 7, "t", "en", "a") for i in range(1000)]).select("doc_id").repartition(9)
    rows = sharding.shuffle_into_shards(docs, 16, bucket_rows=20).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 1000 and set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) and len(s) in (62, 63) for s in slots.values())
    assert sharding.shuffle_into_shards(docs.limit(0), 16).count() == 0


def test_communication_matrix_law():
    counts = [5, 0, 3, 4]
    draws = np.array([sharding.draw_matrix(counts, 3, seed) for seed in range(4000)])
    assert (draws.sum(axis=2) == counts).all() and (draws.sum(axis=1) == [4, 4, 4]).all()
    assert np.allclose(draws.mean(axis=0), np.outer(counts, [1 / 3] * 3), atol=0.08)
    # variance of a hypergeometric count: n K (N - K) (N - n) / (N^2 (N - 1))
    assert draws[:, 0, 0].var() == pytest.approx(5 * 4 * 8 * 7 / (144 * 11), rel=0.1)


def test_large_hypergeometric_draws():
    rng = np.random.Generator(np.random.PCG64(1))
    got = np.array([sharding._hypergeometric(rng, 3 * 10**9, 7 * 10**9, 1000) for _ in range(2000)])
    assert abs(got.mean() - 300) < 2 and got.var() == pytest.approx(210, rel=0.15)


def test_url_rules_and_cascade(sp):
    urls = [None, "", "nohost", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "https://a.example.com/en/", "http://x.net/es/a", "http://x.net/fr", "://com", "http://com/", "http://spam-farm.org#x", "http://É.org/a?b"]
    pages = sp.createDataFrame([(i, u, "extra") for i, u in enumerate(urls + [f"http://h{i}.org/{i}" for i in range(500)] + [f"http://spam-{i}.org/" for i in range(200)])], "page_id bigint, url string, key string")
    def on_list(host, path):
        return host.rlike(LISTED)

    rows = {r.row.page_id: r for r in url_cascade.judge_urls(pages, URL_RULES, on_list).collect()}
    assert [(rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) for i in range(len(urls))] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("a.example.com", "/en/", "example.com/en/", "block"), ("x.net", "/es/a", "net/es/", "block"),
        ("x.net", "/fr", None, "allow"), ("com", "", None, "allow"), ("com", "/", "com/", "allow"), ("spam-farm.org", "", None, "block"), ("É.org", "/a", None, "allow"),
    ]
    assert all(rows[i].verdict == "allow" for i in range(12, 512)) and all(rows[i].verdict == "block" for i in range(512, 712))
    assert url_cascade.judge_urls(pages.limit(0), URL_RULES, on_list).count() == 0
    assert url_cascade.judge_urls(pages.union(pages), URL_RULES, on_list).count() == 2 * len(rows)


@pytest.mark.parametrize("part_bits", [1 << 28, 900])
def test_addresses_listed_by_content_in_any_number_of_cascades(sp, monkeypatch, part_bits):
    monkeypatch.setattr(url_cascade, "PART_BITS", part_bits)
    rows = [(i, f"http://h{i % 7}.org/{i % 450}?{i}", None if i % 11 == 0 else "junk" if i % 450 % 3 == 0 and i < 450 else "fine", "own", "column") for i in range(900)]
    pages = sp.createDataFrame(rows, "page_id bigint, url string, html string, host string, listed string")
    listed = {f"h{i % 7}.org/{i % 450}" for i, _, html, *_ in rows if html == "junk"}
    judged = url_cascade.judge_urls(pages, (), lambda host, path: host == "h3.org", lambda host, path: F.col("html") == "junk").collect()
    assert len(judged) == len(rows)
    assert all((r.verdict == "block") == (r.host == "h3.org" or r.host + r.path in listed) for r in judged)
    assert {r.row.host for r in judged} == {"own"} and {r.row.listed for r in judged} == {"column"}
    if part_bits == 900:
        keys = sp.createDataFrame([(f"k{i}", i % 2 == 0) for i in range(600)], "key string, listed boolean")
        assert url_cascade.PartedCascade(keys).parts == 4


def test_cascade_is_exact_with_many_levels(sp, monkeypatch):
    monkeypatch.setattr(url_cascade, "BITS_PER_KEY", 2)
    keys = sp.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 3 == 0).alias("listed")).cache()
    cascade = url_cascade.BloomCascade(keys)
    assert len(cascade.levels) > 3
    assert keys.filter(cascade.contains(sp, F.col("key")) != F.col("listed")).count() == 0
