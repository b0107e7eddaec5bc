"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusindex.llm import codes, jaccard, licenses, merkle, mixing, packing, pii, planted, secrets, spans, topk, toxicity, urls, vectors
from corpusindex.llm.common import table


def queries() -> dict:
    return {
        "op1_secret_scan": lambda spark, d: secrets.secret_digest(table(spark, d, "documents")),
        "op2_license_scan": lambda spark, d: licenses.scan_licenses(table(spark, d, "documents")),
        "op3_pack_documents": lambda spark, d: packing.pack_documents(table(spark, d, "documents")),
        "op4_toxicity": lambda spark, d: toxicity.score_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
        "op5_near_vectors": lambda spark, d: vectors.near_vectors(table(spark, d, "embeddings")),
        "op6_jaccard_join": lambda spark, d: jaccard.jaccard_join(table(spark, d, "documents")),
        "op7_mix_sources": lambda spark, d: mixing.mix_digest(table(spark, d, "documents")),
        "op9_sentence_spans": lambda spark, d: spans.dedup_sentence_spans(table(spark, d, "documents")),
        "op10_top_inner_products": lambda spark, d: topk.top_inner_products(table(spark, d, "embeddings")),
        "op8_personal_data": lambda spark, d: pii.personal_data_digest(table(spark, d, "documents")),
        "op11_vector_codes": lambda spark, d: codes.vector_codes(table(spark, d, "embeddings")),
        "op12_dataset_manifest": lambda spark, d: merkle.dataset_manifest(table(spark, d, "documents")),
        "op13_url_filter": lambda spark, d: urls.filter_urls(table(spark, d, "pages")),
        "secrets_planted": lambda spark, d: planted.secrets_planted(table(spark, d, "documents")),
        "licenses_planted": lambda spark, d: planted.licenses_planted(table(spark, d, "documents")),
        "mention_report": lambda spark, d: toxicity.mention_report(table(spark, d, "documents"), table(spark, d, "labels")),
        # columns of the above that SQL can express
        "secret_counts": lambda spark, d: secrets.secret_digest(table(spark, d, "documents")).select("doc_id", "n_assign", "n_access", "n_hex"),
        "mix_targets": lambda spark, d: mixing.mix_digest(table(spark, d, "documents")).select("doc_id", "size", "source_size", F.round("target", 4).alias("target")),
        "personal_data_counts": lambda spark, d: pii.personal_data_digest(table(spark, d, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone"),
    }


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
JACCARD_SQL = f"""
    WITH RECURSIVE w AS (SELECT doc_id, [x for x in string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+') if x <> ''] AS ws FROM documents),
    g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]
                                              WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    overlap AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM overlap JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id,
           (SELECT count(*) FROM links WHERE links.a = d.doc_id) AS n_links
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""
TOPK_SQL = """
    WITH raw AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i, len(embedding) AS dim FROM embeddings WHERE vec_id IS NOT NULL),
    v AS (SELECT vec_id, dim, i, CAST(floor(256 * x) AS BIGINT) AS x FROM raw
          WHERE vec_id NOT IN (SELECT vec_id FROM raw WHERE x IS NULL OR NOT isfinite(x))),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.i = c.i AND q.dim = c.dim AND q.vec_id <> c.vec_id
               WHERE q.vec_id % 50 = 0 GROUP BY ALL)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


NEAR_SQL = """
    WITH RECURSIVE raw AS (SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS x FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0),
    v AS (SELECT vec_id, label, x, sqrt(list_sum([y * y for y in x])) AS norm FROM raw WHERE len([y for y in x if y IS NULL OR NOT isfinite(y)]) = 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
              WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.98),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
    FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
SECRETS_SQL = """
    SELECT doc_id, len([x for x in regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) if length(x) >= 6]) AS n_assign,
        len([x for x in regexp_extract_all(t, 'AKIA[A-Z0-9]+') if length(x) >= 20]) AS n_access, len([x for x in regexp_extract_all(t, '[0-9a-f]+') if length(x) >= 24]) AS n_hex
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
PERSONAL_SQL = """
    WITH found AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+') AS emails, regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)') AS ips,
            [regexp_replace(x, '[^0-9]', '', 'g') for x in regexp_extract_all(t, '[0-9]([\\x20-]?[0-9])+')] AS cards,
            [regexp_replace(x, '[^0-9]', '', 'g') for x in regexp_extract_all(t, '\\+[0-9][\\x20().0-9-]+[0-9]')] AS phones
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
    luhn AS (SELECT doc_id, d, i, CAST(substr(d, length(d) - i, 1) AS INTEGER) * (1 + i % 2) AS v FROM (
        SELECT doc_id, d, unnest(range(length(d))) AS i FROM (SELECT doc_id, row_number() OVER () || ':' AS row, unnest(cards) AS d FROM found) WHERE length(d) BETWEEN 13 AND 19)),
    good AS (SELECT DISTINCT d FROM (SELECT doc_id, d, i, any_value(v) AS v FROM luhn GROUP BY ALL) GROUP BY doc_id, d HAVING sum(CASE WHEN v > 9 THEN v - 9 ELSE v END) % 10 = 0),
    n_good AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(cards) AS d FROM found) WHERE d IN (SELECT d FROM good) GROUP BY doc_id)
    SELECT f.doc_id, len(emails) AS n_email, len([x for x in ips if len([p for p in string_split(x, '.') if length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255')]) = 0]) AS n_ip,
        coalesce(n, 0) AS n_card, len([x for x in phones if length(x) BETWEEN 9 AND 15]) AS n_phone
    FROM found f LEFT JOIN n_good g ON g.doc_id = f.doc_id
"""
TARGETS_SQL = """
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
    w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, 3.0 * source_size AS cap FROM s),
    -- with sources in the order in which they reach their caps, the first that its share leaves below its cap sets the level
    o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, place) AS turn, sum(cap) OVER (ORDER BY cap / weight, place) - cap AS capped,
            sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, place) + weight AS open FROM w),
    l AS (SELECT CAST(((SELECT sum(source_size) FROM w) - capped) AS DOUBLE) / CAST(open AS DOUBLE) AS level FROM o WHERE ((SELECT sum(source_size) FROM w) - capped) / open <= cap / weight ORDER BY turn LIMIT 1)
    SELECT doc_id, size, source_size, round(least(CAST(cap AS DOUBLE), CAST(weight AS DOUBLE) * level), 4) AS target FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source, l
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": licenses.license_sql(),
        "op5_near_vectors": NEAR_SQL,
        "op6_jaccard_join": JACCARD_SQL,
        "op10_top_inner_products": TOPK_SQL,
        "op11_vector_codes": codes.codes_sql(),
        "op12_dataset_manifest": merkle.manifest_sql(),
        "op13_url_filter": urls.urls_sql(),
        "secrets_planted": planted.SECRETS_SQL,
        "licenses_planted": planted.LICENSES_SQL,
        "secret_counts": SECRETS_SQL,
        "mix_targets": TARGETS_SQL,
        "personal_data_counts": PERSONAL_SQL,
    }
