"""Registered queries of the subpackage: each applies its operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .op1_url_filter import host_and_path, judge_urls
from .op2_jaccard_join import near_duplicates
from .op3_pii import pii_digest
from .op4_warc import warc_digest
from .op5_mixing import mix
from .op6_decontamination import leaks
from .op7_substring_dedup import passages_by_document, repeated_passages
from .op8_quality import quality_digest
from .op9_secrets import secrets_digest
from .op10_lm_scoring import lm_scores
from .op11_collocations import collocations
from .op12_divergence import divergences
from .op13_embedding_dedup import near_vectors

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Host labels that put a host on the block list where no rule fits.
BLOCKED_WORDS = "spam|pills|casino|adult"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    host = host_and_path(F.col("url"))[0]
    listed = pages.select(host.alias("host")).where(F.col("host").rlike(BLOCKED_WORDS)).distinct()
    return judge_urls(pages, URL_RULES, listed).drop("listed_host")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_digest(_table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages_by_document(repeated_passages(_table(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(_table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(_table(spark, sf_dir, "documents"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_jaccard_join, op3_pii, op4_warc, op5_mixing, op6_decontamination,
                            op7_substring_dedup, op8_quality, op9_secrets, op10_lm_scoring, op11_collocations, op12_divergence,
                            op13_embedding_dedup)}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = " UNION ALL ".join(
    f"SELECT '{v}' AS v, '{h}' AS rh, '{p}' AS rp" for v, h, p in URL_RULES)

ORACLES: dict[str, str] = {
    "op1_url_filter": rf"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') AS rest FROM pages),
p AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS ({_FITS}),
hit AS (SELECT page_id, v, rh || rp AS rule,
               row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS n
        FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, host, path, rule,
       coalesce(v, CASE WHEN regexp_matches(host, '{BLOCKED_WORDS}') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN hit ON p.page_id = hit.page_id AND n = 1""",
    "op4_warc": r"""
WITH x AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
y AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM x)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM y""",
    "op11_collocations": rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
runs AS (SELECT lang, size, ws, unnest(range(1, len(ws) - size + 2)) AS i
         FROM w, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(ws) >= size),
f AS (SELECT lang, size, ws[i:i + size - 1] AS ph, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30),
cut AS (SELECT c.lang, c.ph, c.f AS a, k, l.f AS l, r.f AS r,
               (2000000::HUGEINT * c.f // (l.f + r.f))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1) c
        JOIN f l ON l.lang = c.lang AND l.ph = c.ph[1:k] JOIN f r ON r.lang = c.lang AND r.ph = c.ph[k + 1:c.size]),
worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
around AS (SELECT lang, ph[i:i + m - 1] AS ph, max(f) AS longer
           FROM (SELECT *, unnest(range(1, size - m + 2)) AS i
                 FROM (SELECT *, unnest(range(2, size)) AS m FROM f WHERE size > 2)) GROUP BY ALL),
kept AS (SELECT c.*, array_to_string(c.ph, ' ') AS phrase FROM worst c LEFT JOIN around o ON o.lang = c.lang AND o.ph = c.ph
         WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN total USING (lang) WHERE rank <= 2000""",
    "op12_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
full_c AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM grp g JOIN kept k USING (lang)
           LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, c,
             1 + 1000000000::HUGEINT * (c + 5) // (sum(c) OVER (PARTITION BY lang, source) + 5 * v) AS p
      FROM full_c JOIN size USING (lang)),
whole AS (SELECT lang, term, sum(c) AS c FROM full_c GROUP BY ALL),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (c + 5) // (sum(c) OVER (PARTITION BY lang) + 5 * v) AS q
      FROM whole JOIN size USING (lang)),
gap AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
part AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
         FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN gap ON gap.lang = a.lang AND gap.source = a.source AND gap.item = b.source
         UNION ALL
         SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
place AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM part)
SELECT lang, source, part, item, value, rank FROM place WHERE part = 'pair' OR rank <= 50""",
    "op13_embedding_dedup": r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS i, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.i AS a, b.i AS b FROM u a JOIN u b ON a.i <> b.i AND len(a.e) = len(b.e)
         WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT i AS a, i AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least AS (SELECT reach.a, min(vec_id) AS component_id FROM reach JOIN v ON v.i = reach.b GROUP BY reach.a),
many AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN least ON least.a = i LEFT JOIN many ON many.a = i""",
}
