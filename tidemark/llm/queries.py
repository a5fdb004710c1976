"""The registered queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination, filter_audit, importance_resampling, jaccard_join, language, mixing, quality, secrets, sentencepieces, token_files,
    url_filter, va_file, warc,
)
from .common import crc32_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query(
    "op6_warc",
    """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
    g AS (SELECT *, CASE WHEN payload_bytes >= 1000
                    THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS kept FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to
    FROM g
    """,
)
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.round_trip(spark, table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_token_files")
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.round_trip(spark, table(spark, folder, "documents"), public_tokenizer())


@query(
    "op9_va_file",
    """
    WITH sound AS (
        SELECT vec_id, embedding FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0
          AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    v AS (SELECT DISTINCT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM sound),
    s AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
    SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5
    """,
)
def op9_va_file(spark: SparkSession, folder: str) -> DataFrame:
    found = va_file.search(spark, table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return found.withColumn("score", F.col("score").cast("long"))


URL_RULES = [
    url_filter.Rule("net/", allow=False),
    url_filter.Rule("example.net/en/", allow=True),
    url_filter.Rule("example.com/de/", allow=False),
    url_filter.Rule("org/fr/", allow=True),
]


@query(
    "op1_url_filter",
    r"""
    WITH RECURSIVE u AS (
        SELECT page_id, html,
               CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (
        SELECT page_id, html,
               translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    j AS (
        SELECT page_id, host, path, CASE
            WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h),
    seed AS (
        SELECT host, avg(CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 1 ELSE 0 END) > 0.5 AS trusted,
               avg(CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1 ELSE 0 END) > 0.5 AS blocked
        FROM j WHERE host <> '' GROUP BY host),
    start AS (
        SELECT 'trust' AS kind, host, CAST(0.15 AS DOUBLE) AS score FROM seed WHERE trusted
        UNION ALL SELECT 'distrust', host, CAST(0.15 AS DOUBLE) FROM seed WHERE blocked),
    pair AS (
        SELECT DISTINCT page_id, host AS src, unnest(regexp_extract_all(
            translate(html, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '<a\s[^<>]*?href\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)) AS dst FROM h),
    link AS (SELECT src, dst, count(*) AS pages FROM pair WHERE src <> '' AND src <> dst GROUP BY ALL),
    step AS (
        SELECT 'trust' AS kind, src AS host, dst AS next, 0.85 * pages / sum(pages) OVER (PARTITION BY src) AS share FROM link
        UNION ALL SELECT 'distrust', dst, src, 0.85 * pages / sum(pages) OVER (PARTITION BY dst) FROM link),
    walk AS (
        SELECT 0 AS round, kind, host, score FROM start
        UNION ALL
        SELECT round + 1, step.kind, next, sum(score * share) FROM walk JOIN step ON walk.kind = step.kind AND walk.host = step.host
        WHERE round < 30 GROUP BY ALL),
    score AS (
        SELECT host, sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END) AS trust,
               sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END) AS distrust FROM walk GROUP BY host)
    SELECT page_id, j.host, path, rule, CASE
        WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
        WHEN distrust >= 0.02 AND distrust > trust THEN 'block' ELSE 'allow' END AS verdict
    FROM j LEFT JOIN score ON j.host = score.host
    """,
)
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, folder, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op7_mixing")
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(spark, table(spark, folder, "documents"))


@query(
    "op10_decontamination",
    r"""
    WITH b AS (
        SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
    p AS (
        SELECT DISTINCT item_id, CASE WHEN len(w) < 10 THEN w ELSE w[i:i + 9] END AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
    d AS (
        SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
        FROM documents),
    n AS (SELECT DISTINCT len(g) AS n FROM p),
    s AS (SELECT r, i, n, w[i:i + n - 1] AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
    o AS (SELECT r, i, n, item_id FROM s JOIN p USING (g)),
    h AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM o) GROUP BY r),
    t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM o WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
    """,
)
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return decontamination.report(found)


@query("op2_quality")
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = table(spark, folder, "documents"), crc32_of("doc_id") % 5 == 0
    model = quality.fit(docs, table(spark, folder, "labels").filter(~held_out))
    return quality.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


@query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.link_documents(table(spark, folder, "documents"))


@query("op4_language")
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = table(spark, folder, "documents"), crc32_of("doc_id") % 4 == 2
    model = language.fit(docs.filter(~held_out))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents")).select(
        "doc_id", F.col("place").cast("long").alias("place"), F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"),
        F.col("label").cast("int").alias("label"), F.round("score", 6).alias("score"), "is_secret",
    )


@query(
    "op12_filter_audit",
    r"""
    WITH w AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
    d AS (
        SELECT part, coalesce(good, false) AS good, coalesce(l.toxic, false) AS toxic,
               CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
            || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
            || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END
            || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
            || CASE WHEN min(w.doc_id) OVER (PARTITION BY t) < w.doc_id THEN 'E' ELSE '' END AS fails
        FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
    c AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM d GROUP BY part, fails),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
    o AS (
        SELECT v.f || w.f || x.f || y.f || z.f AS filter_order FROM x v, x w, x, x y, x z
        WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5),
    s AS (
        SELECT filter_order, step, filter_order[step] AS f, '[' || filter_order[1:step - 1] || '0]' AS earlier
        FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
    r AS (
        SELECT part, filter_order, step, f, n, good, toxic, fails = f AS alone, contains(fails, f) AS failing,
               regexp_matches(fails, earlier) AS gone FROM c, s),
    g AS (
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, f,
               CAST(coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0) AS BIGINT) AS kept,
               CAST(coalesce(sum(n) FILTER (failing AND NOT gone), 0) AS BIGINT) AS removed,
               CAST(coalesce(sum(n) FILTER (failing AND gone), 0) AS BIGINT) AS redundant,
               CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
               CAST(coalesce(sum(good) FILTER (failing AND NOT gone), 0) AS BIGINT) AS good_lost,
               CAST(coalesce(sum(toxic) FILTER (failing AND NOT gone), 0) AS BIGINT) AS toxic_lost
        FROM r GROUP BY part, filter_order, step, f)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g
    """,
)
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return filter_audit.audit(docs, labels, filter_audit.text_rules(), copies="E", part=F.col("lang"))


@query(
    "op13_importance_resampling",
    r"""
    WITH RECURSIVE step AS (
        SELECT 0 AS round, i, i AS c FROM (SELECT unnest(range(256)) AS i)
        UNION ALL SELECT round + 1, i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE round < 8),
    crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE round = 8),
    both_ AS (
        SELECT true AS own, doc_id, row_number() OVER () AS r, text FROM documents
        UNION ALL SELECT false, NULL, row_number() OVER (), text FROM benchmark),
    w AS (
        SELECT own, doc_id, r, coalesce(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
        FROM both_),
    f AS (SELECT own, r, f, count(*) AS n FROM (SELECT own, r, unnest(words) AS f FROM w) GROUP BY own, r, f),
    b AS (
        SELECT f, xor(list_reduce(list_prepend(4294967295, [CAST('0x' || p AS BIGINT) for p in regexp_extract_all(hex(encode(f)), '..')]),
                                  lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket
        FROM (SELECT DISTINCT f FROM f), crc),
    n AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM f JOIN b USING (f) GROUP BY bucket),
    a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM n),
    g AS (
        SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain
        FROM n, a),
    weights AS (SELECT r, sum(n * gain) AS weight FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE own GROUP BY r),
    d AS (
        SELECT doc_id, r, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
               CAST('0x' || left(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) AS h
        FROM w LEFT JOIN weights USING (r) WHERE own),
    e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d),
    k AS (
        SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS all_
        FROM e WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * all_ // 100 THEN place END AS rank FROM e LEFT JOIN k USING (r)
    """,
)
def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance_resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op11_sentencepieces")
def op11_sentencepieces(spark: SparkSession, folder: str) -> DataFrame:
    pieces = sentencepieces.round_trip(table(spark, folder, "documents"), public_tokenizer("piece_bpe_32k.model"))
    return pieces.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.array_max("ends"), F.lit(0)).cast("long").alias("n_bytes"),
    )


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
