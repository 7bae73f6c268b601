"""The registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import mixing, periodic_runs, pii_bootstrap, quality_knn, quality_outliers, rotated_kmeans, secret_links, sentencepiece_scan, sharding, simhash, token_files, topk_kdtree, url_cascade
from panelloom.llm.common import WORD, importable, n_words, read, shared_folder, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(importable(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_quality_outliers")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_outliers.quality_verdicts(read(spark, sf_dir, "documents"))
    names = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", "n_words", *names, "base_failed", "kept", "distance")


@query("op2_simhash")
def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op3_sentencepiece")
def sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text; ``round_trip`` says that the text came back (with spaces for ``▁``)."""
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.replace(text, F.lit("▁"), F.lit(" "))).alias("text_crc32"))
    model = tokenizer_path("piece_bpe_32k.model")
    back = sentencepiece_scan.decode_parts(*sentencepiece_scan.encode_parts(docs, model), model)
    return back.select(
        "row.doc_id", "n_chunks", "n_tokens", "ids_crc32", "row.text_crc32", (F.crc32("text") == F.col("row.text_crc32")).alias("round_trip")
    )


@query(
    "op4_topk_kdtree",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk_kdtree.usable(read(spark, sf_dir, "embeddings"))
    found = topk_kdtree.top_k(rows, F.col("id") % 50 == 0, 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op5_quality_votes")
def quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    labels = read(spark, sf_dir, "labels").filter(~held_out).select("doc_id", F.col("quality").cast("int").alias("label"))
    scored = quality_knn.score(docs, quality_knn.fit(docs, labels))
    return scored.select("row.doc_id", "row.held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def _only(number: int):
    return lambda kind: F.when(kind == number, kind)


@query("op6_pii_bootstrap")
def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_bootstrap.find_spans(read(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, _only(i)))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(pii_bootstrap.KINDS)]
    base, spans = pii_bootstrap.spans_text(F.col("base")), pii_bootstrap.spans_text(F.col("spans"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


@query("op7_mix_sources")
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mixing.taken_words(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_shard")
def shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = sharding.shuffle_into_shards(docs, 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op9_token_files")
def token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    token_files.write_token_files(docs, folder, tokenizer_path("word_bpe_49k.json"))
    return token_files.read_token_files(spark, folder, token_files.ids_crc32, "ids_crc32 long")


# Verdict, host and path of the contract's rules.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Hosts with one of these words in a label, between dots or hyphens, stand on the block list.
LISTED = r"(^|[.-])(spam|pills|casino|adult|bets|ads)([.-]|$)"
#: So does the address of a page whose title holds a run of marks.
JUNK = r"<title>[^<]*(###|%%%|[*][*][*]|[$][$][$])"


@query(
    "op10_url_filter",
    rf"""
    WITH p AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
    h AS (SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
    r AS (SELECT *, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM h),
    l AS (SELECT host || path AS address, bool_or(coalesce(regexp_matches(html, '{JUNK}'), FALSE)) AS junk FROM h GROUP BY 1)
    SELECT page_id, host, path, rule, CASE
        WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
        WHEN regexp_matches(host, '{LISTED}') OR junk THEN 'block' ELSE 'allow' END AS verdict
    FROM r JOIN l ON l.address = r.host || r.path
    """,
)
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    judged = url_cascade.judge_urls(pages, URL_RULES, lambda host, path: host.rlike(LISTED), lambda host, path: F.col("html").rlike(JUNK))
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


@query("op11_secret_links")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_links.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, _only(i)))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(secret_links.KINDS[:3])]
    base, spans = secret_links.spans_text(F.col("base")), secret_links.spans_text(F.col("spans"))
    return found.select("row.doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


def _lloyd_sql(clusters: int, rounds: int, scale: int, components: int) -> str:
    """Lloyd's rounds written out, over a row for each vector and component."""
    squares = "SELECT x.rid, c.cluster, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{0} c USING (i) GROUP BY ALL"
    nearest = "SELECT rid, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM ({}) GROUP BY rid"
    ctes = [
        f"""e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
            WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""x AS MATERIALIZED (SELECT rid, i, floor({scale} * embedding[i]::DOUBLE)::HUGEINT AS v FROM e, range(1, {components + 1}) r(i))""",
        f"""s AS (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, vec_id NULLS LAST, embedding) - 1 AS cluster FROM e
            QUALIFY cluster < {clusters})""",
        "c0 AS MATERIALIZED (SELECT s.cluster, x.i, x.v FROM s JOIN x USING (rid))",
    ]
    for n in range(rounds):
        ctes += [
            f"a{n} AS MATERIALIZED ({nearest.format(squares.format(n))})",
            f"m{n} AS (SELECT a.cluster, x.i, sum(x.v)::HUGEINT AS t, count(*)::HUGEINT AS n FROM a{n} a JOIN x USING (rid) GROUP BY ALL)",
            f"""c{n + 1} AS MATERIALIZED (SELECT c.cluster, c.i, CASE WHEN m.n IS NULL THEN c.v ELSE (m.t - ((m.t % m.n) + m.n) % m.n) // m.n END AS v
                FROM c{n} c LEFT JOIN m{n} m USING (cluster, i))""",
        ]
    ctes += [
        f"a AS MATERIALIZED ({nearest.format(squares.format(rounds))})",
        f"h AS (SELECT cluster, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)",
    ]
    return f"""WITH {", ".join(ctes)}
        SELECT e.vec_id, a.cluster::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
            (sum(a.d) OVER ())::BIGINT AS inertia, h.centroid_sha256
        FROM a JOIN e USING (rid) JOIN h USING (cluster)"""


@query("op12_rotated_kmeans", _lloyd_sql(8, 10, 1024, 64))
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = rotated_kmeans.usable(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    found = rotated_kmeans.cluster(vectors, F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")), 256), 8, 10, 1024, 64)
    total = min(sum(found.inertia), rotated_kmeans.LONGEST)
    about = [(c, min(found.inertia[c], rotated_kmeans.LONGEST), total, rotated_kmeans.centroid_sha256(v)) for c, v in enumerate(found.centroids)]
    per_cluster = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # 8 rows
    return found.rows.join(F.broadcast(per_cluster), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the contract's repetition written into every tenth text by the checksum of its id.

    From word ``a`` on, the first ``p`` words repeat. A null id has no checksum, so its text stays.
    """
    number = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", "text", F.floor(number / 10).alias("g"), F.when(number % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    n = F.size("words")
    docs = docs.withColumn("a", F.when(n > 0, F.col("g") % n))
    docs = docs.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))

    def word(i: Column) -> Column:
        return F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))

    repeated = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(repeated_stretches(read(spark, sf_dir, "documents").select("doc_id", "text")))
    best = periodic_runs.strongest(F.col("runs"))
    found = found.withColumn("best", best)
    return found.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(periodic_runs.runs_text(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
