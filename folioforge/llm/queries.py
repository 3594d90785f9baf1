"""The queries of this subpackage, with production parameters over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import arrow_tokens, decontaminate, html_density, importance, kneser_ney, mixture, prefix_join, rule_ensemble, stream_dedup, threshold_search, transducer, url_cascade, vertical_search
from folioforge.llm.common import LOWER, UPPER, table
from folioforge.llm.url_cascade import Rule

#: The URL rules of op1.
URL_RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.taken_words(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (kneser_ney.fold(F.col("doc_id")) == 0).alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    model = rule_ensemble.train(docs, labels, lambda doc_id: kneser_ney.fold(doc_id) != 0)
    return rule_ensemble.score(docs, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_tokens.read(arrow_tokens.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 512)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (kneser_ney.fold(F.col("doc_id")) == 0).alias("held_out"))
    model = kneser_ney.train(docs.where("not held_out"))
    return kneser_ney.predict(docs, model, ("doc_id", "held_out"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return scores.select("doc_id", "n_features", "weight", "score", "rank")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertical_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_mixture": op2_mixture,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_html_text": op4_html_text,
    "op5_quality": op5_quality,
    "op6_prefix_join": op6_prefix_join,
    "op7_token_files": op7_token_files,
    "op8_token_counts": op8_token_counts,
    "op9_language": op9_language,
    "op10_decontaminate": op10_decontaminate,
    "op11_importance_resample": op11_importance_resample,
    "op12_ranked_search": op12_ranked_search,
    "op13_exact_top_k": op13_exact_top_k,
}

_words = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format
_lower = f"translate({{}}, '{UPPER}', '{LOWER}')".format
_fit = "(CASE WHEN (host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}') THEN '{0}{1}' END)".format

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": f"""
        WITH cut AS (
          SELECT page_id, coalesce({_lower("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host,
                 coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        fit AS (
          SELECT *, coalesce({", ".join(_fit(r.host, r.path) for r in sorted(URL_RULES, key=lambda r: -len(r.key)))}) AS rule FROM cut)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ({", ".join(f"'{r.key}'" for r in URL_RULES if r.verdict == "block")}) THEN 'block' ELSE 'allow' END AS verdict
        FROM fit""",
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        WINDOW same AS (PARTITION BY t)""",
    "op10_decontaminate": f"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (
          SELECT item_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        bw AS (
          SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g
          FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
                FROM (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0))),
        dw AS (
          SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
                FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
        hit AS (SELECT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw USING (k, g)),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
        its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY 1)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    # CRC-32 of a feature's UTF-8 bytes: each byte is two digits of h, and takes one step by the table of remainders.
    "op11_importance_resample": f"""
        WITH crc AS (
          SELECT list(t ORDER BY n) AS t FROM (
            SELECT n, list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(n))),
        texts AS (
          SELECT true AS own, doc_id, row_number() OVER () AS row, {_words(_lower("coalesce(text, '')"))} AS w FROM documents
          UNION ALL SELECT false, NULL, row_number() OVER (), {_words(_lower("coalesce(text, '')"))} FROM benchmark),
        runs AS (
          SELECT own, row, array_to_string(w[i : i + k - 1], ' ') AS f
          FROM (SELECT own, row, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM texts, range(1, 4) r(k) WHERE len(w) >= k)),
        counted AS (SELECT own, row, f, count(*) AS c FROM runs GROUP BY ALL),
        hashed AS (
          SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(len(h) // 2), lambda i:
                   16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)),
                   lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)])), 4294967295) % 10000 AS bucket
          FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)), crc),
        sums AS (
          SELECT bucket, coalesce(sum(c) FILTER (own), 0)::BIGINT AS s, coalesce(sum(c) FILTER (NOT own), 0)::BIGINT AS t FROM counted JOIN hashed USING (f) GROUP BY 1),
        gain AS (
          SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE)))::BIGINT AS g FROM sums),
        weighed AS (SELECT row, sum(c)::BIGINT AS n, sum(c * g)::BIGINT AS weight FROM counted JOIN hashed USING (f) JOIN gain USING (bucket) WHERE own GROUP BY 1),
        scored AS (
          SELECT doc_id, row, len(w) >= 20 AS long, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                 coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
          FROM texts LEFT JOIN weighed USING (row) WHERE own),
        placed AS (SELECT *, row_number() OVER (PARTITION BY long ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER (PARTITION BY long) // 100 AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN long AND place <= n THEN place END::BIGINT AS rank FROM placed""",
    "op12_ranked_search": f"""
        WITH d AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM (SELECT doc_id, {_words(_lower("coalesce(text, '')"))} AS w FROM documents) WHERE len(w) > 0),
        c AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM d),
        q AS (SELECT item_id, unnest({_words(_lower("coalesce(text, '')"))}) AS term FROM benchmark),
        tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        wt AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, c GROUP BY term),
        post AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // l))) AS impact FROM tf JOIN wt USING (term), c),
        s AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM q JOIN post USING (term) GROUP BY ALL HAVING sum(impact) > 0)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
    "op13_exact_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
}
