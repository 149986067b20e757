"""The operators over the supplied tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import top_neighbours
from .binary_codes import near_vectors
from .brown import brown_scores
from .common import read_table
from .decontaminate import contaminated_pairs
from .fill_middle import fill_in_middle, restored
from .mixing import mix_documents
from .secrets import scan_secrets
from .sharding import shard_documents
from .simhash import simhash_duplicates
from .suffix_dedup import remove_repeats
from .toxicity import toxicity_scores
from .url_filters import judge_urls
from .yinyang import yinyang_clusters

URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("removed")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "keep")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(read_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


def op8_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_scores(read_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_neighbours(read_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang_clusters(read_table(spark, sf_dir, "embeddings"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def queries() -> dict:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_toxicity": op2_toxicity,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_secret_scan": op4_secret_scan,
        "op5_mixing": op5_mixing,
        "op6_simhash": op6_simhash,
        "op7_sharding": op7_sharding,
        "op8_brown": op8_brown,
        "op9_decontamination": op9_decontamination,
        "op10_ann": op10_ann,
        "op11_yinyang": op11_yinyang,
        "op12_embedding_dedup": op12_embedding_dedup,
        "op13_fill_middle": op13_fill_middle,
    }


def clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """Assignment and floored means, round by round, over one row a component."""
    steps = [f"""
        kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        x AS MATERIALIZED (SELECT r, i, CAST(floor(256 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, 65) AS t(i)),
        c0 AS MATERIALIZED (SELECT j, i, x AS c FROM x JOIN (
          SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS j FROM kept QUALIFY j < {k}) USING (r))"""]
    for n in range(rounds + 1):
        steps.append(f"""
        d{n} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, j := j)) AS best FROM (
          SELECT r, j, sum((x - c) * (x - c)) AS d FROM x JOIN c{n} USING (i) GROUP BY r, j) GROUP BY r)""")
        if n < rounds:
            steps.append(f"""
        c{n + 1} AS MATERIALIZED (SELECT j, i, CASE WHEN n > 0 THEN (s - (s % n + n) % n) // n ELSE c END AS c FROM c{n} LEFT JOIN (
          SELECT best.j AS j, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN d{n} USING (r) GROUP BY ALL) USING (j, i))""")
    return f"""WITH {",".join(steps)}
        SELECT vec_id, CAST(best.j AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.j) AS BIGINT) AS cluster_inertia,
          CAST(sum(best.d) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM kept JOIN d{rounds} USING (r) JOIN (SELECT j, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY j) AS h ON h.j = best.j"""


ORACLES = {
    "op11_yinyang": clusters_sql(),
    "op12_embedding_dedup": """
        WITH RECURSIVE sound AS (
          SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
          WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
        reach(a, b) AS (
          SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN counted USING (vec_id)""",
    "op13_fill_middle": r"""
        WITH units AS (
          SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
        drawn AS (
          SELECT *, len(u) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) for i in range(0, 4)] AS d FROM units),
        cut AS (
          SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
        parts AS (
          SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
        FROM parts""",
    "op1_url_filter": """
        WITH cut AS (
          SELECT page_id,
            CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
          FROM pages),
        parts AS (
          SELECT page_id,
            translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            substr(regexp_extract(coalesce(rest, ''), '^[^?#]*'), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1) AS path
          FROM cut),
        rules(rule, rule_host, rule_path, action) AS (VALUES
          ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
          ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
        best AS (
          SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
          FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
          GROUP BY page_id)
        SELECT parts.page_id, host, path, best.rule, coalesce(best.action, 'allow') AS verdict
        FROM parts LEFT JOIN best ON parts.page_id = best.page_id""",
}
