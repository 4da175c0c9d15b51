"""The registered queries of this package, and the SQL that checks them."""

from __future__ import annotations

import importlib.util
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import golay_simhash, hilbert_centroids, id_files, itq_dedup, line_crf, minimax_shards, pair_index_bpe
from siftline.llm import resync_tokens, scatter_fim, systematic_mix, toxicity, url_aliases
from siftline.llm.common import read_table
from siftline.llm.cover_tree import top_k


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.toxicity(documents, labels, ["doc_id"]).select("doc_id", "held_out", "score", "predicted")


def op2_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


def op3_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_dedup.vector_groups(read_table(spark, sf_dir, "embeddings"))


def op4_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = golay_simhash.simhash_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "fingerprint", "component_id")


def op5_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_aliases.url_verdicts(read_table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resync_tokens.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return line_crf.quality(documents, labels, ["doc_id"]).select("doc_id", "held_out", "score", "predicted")


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = systematic_mix.mixed_sizes(read_table(spark, sf_dir, "documents"))
    return sizes.select("doc_id", "size", "source_size", "target", "taken")


def op9_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards.shards(read_table(spark, sf_dir, "documents"))


def op10_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_index_bpe.encoded(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = id_files.write_ids(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end=1)
    return id_files.read_ids(spark, folder, as_bytes=True).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_scatter_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scatter_fim.restore(scatter_fim.fill_in_middle(read_table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op13_hilbert_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_centroids.with_inertia(*hilbert_centroids.clusters(read_table(spark, sf_dir, "embeddings")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline.py`` at the top of the repository."""
    place = Path(__file__).resolve().parents[2] / "corpus_pipeline.py"
    spec = importlib.util.spec_from_file_location("corpus_pipeline", place)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_cover_tree_topk,
        op3_itq_near_dedup,
        op4_golay_simhash,
        op5_url_verdicts,
        op6_token_counts,
        op7_line_quality,
        op8_systematic_mix,
        op9_minimax_shards,
        op10_pair_index_bpe,
        op11_id_files,
        op12_scatter_fim,
        op13_hilbert_centroids,
        pipeline,
    )
}

def _centroid_sql(rounds: int = 10) -> str:
    """The rounds of op13 as a chain of tables: assignment a<i> to centroids c<i>, which give c<i + 1>."""
    apart = "list_inner_product(v.v, v.v) - 2 * list_inner_product(v.v, c.c) + list_inner_product(c.c, c.c)"
    assigned = lambda i: (
        f"a{i} AS MATERIALIZED (SELECT n, any_value(vec_id) AS vec_id, any_value(v.v) AS v, arg_min(k, CAST({apart} AS BIGINT) * 8 + k) AS k, "
        f"CAST(min({apart}) AS BIGINT) AS d FROM v, c{i} c GROUP BY n)"
    )
    moved = lambda i: (
        f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (SELECT k, list(x ORDER BY i) AS c FROM ("
        f"SELECT k, i, floor(sum(v[i]) / count(*)) AS x FROM a{i}, (SELECT unnest(range(1, 65)) AS i) GROUP BY k, i) GROUP BY k) m USING (k))"
    )
    steps = [step for i in range(rounds) for step in (assigned(i), moved(i))] + [assigned(rounds)]
    return f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS MATERIALIZED (
    SELECT CAST(row_number() OVER (ORDER BY h, vec_id NULLS FIRST, v) - 1 AS INTEGER) AS k, v AS c
    FROM (SELECT *, sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h FROM v) QUALIFY k < 8
),
{(","+chr(10)).join(steps)}
SELECT vec_id, k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(list_transform(c.c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (k)
"""


ORACLE_SQL = {
    "op2_cover_tree_topk": """
WITH v AS (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT q.n, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
    FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.n <> d.n
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
""",
    "op3_itq_near_dedup": """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
),
ok AS (
    SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_inner_product(e, e) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
),
reach(a, b) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)
""",
    "op5_url_verdicts": """
WITH u AS (
    SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
        html
    FROM pages
),
r(verdict, rule, on_host, start) AS (
    VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
        ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
),
f AS (
    SELECT page_id, host, path, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS nth
    FROM u LEFT JOIN r ON (host = on_host OR host LIKE '%.' || on_host) AND starts_with(path, start)
)
-- the pages hold no canonical link and no refresh, so no alias changes a verdict
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE nth = 1
""",
    "op8_systematic_mix": r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
    FROM d GROUP BY source
),
lv(n, level) AS (
    SELECT 0, CAST(sum(source_size) AS DOUBLE) / sum(weight) FROM s
    UNION ALL
    SELECT n + 1, (SELECT CAST(sum(source_size) - sum(CASE WHEN 3 * source_size <= weight * lv.level THEN 3 * source_size ELSE 0 END) AS DOUBLE)
        / nullif(sum(CASE WHEN 3 * source_size <= weight * lv.level THEN 0 ELSE weight END), 0) FROM s)
    FROM lv WHERE n < 30
),
t AS (
    SELECT source, source_size, least(weight * (SELECT max(level) FROM lv), CAST(3 * source_size AS DOUBLE)) AS target FROM s
),
k AS (
    SELECT d.*, t.source_size, t.target, coalesce('=' || d.source, '') AS of_source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key,
        floor(log2(greatest(size, 1)))::INTEGER AS power
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
p AS (
    SELECT *, power * 16 + floor(size * 16 / pow(2.0, power))::INTEGER % 16 AS class,
        CAST('0x' || substr(md5('mix:' || of_source), 1, 12) AS BIGINT) / pow(16.0, 12) AS off
    FROM k
),
o AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY of_source ORDER BY class, key, doc_id) AS DOUBLE) AS pos,
        coalesce(target / nullif(source_size, 0), 0.0) AS each_doc
    FROM p
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
    CAST(CASE WHEN size > 0 THEN least(floor(pos * each_doc + off) - floor((pos - 1) * each_doc + off), 3) ELSE 0 END * size AS BIGINT) AS taken
FROM o
""",
    "op12_scatter_fim": r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
    FROM documents
),
n AS (
    SELECT doc_id, t, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
            WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM d
),
p AS (
    SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
        array_to_string(u[greatest(a, b) + 1:], '') AS s
    FROM n
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p
""",
    "op13_hilbert_centroids": _centroid_sql(),
}
