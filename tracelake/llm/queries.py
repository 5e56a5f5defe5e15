"""The queries of the operators and of the pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extraction, importance, kd_clusters, mixing, ngram_jaccard, periodic_runs, pii, quality_rules, secret_scan, token_output, toxicity, url_filters
from .common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = quality_rules.score_documents(read(spark, sf_dir, "documents"))
    return marks.select("doc_id", *quality_rules.FIGURES, "base_failed", "kept", "removed_words")


OP1_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, host, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
grams AS (
  SELECT doc_id, i, words[i : i + 7] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT doc_id, gram FROM grams GROUP BY ALL HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT g.doc_id, unnest(range(i, i + 8)) AS p FROM grams g JOIN twice USING (doc_id, gram)) GROUP BY doc_id),
lines AS (
  SELECT doc_id, host, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    trim(regexp_replace(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g'), '\p{Nd}', '0', 'g')) AS k
  FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM t)),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE n > 0 GROUP BY doc_id),
hosts AS (SELECT host, count(*) AS host_docs FROM t GROUP BY host),
often AS (SELECT host, k FROM lines JOIN hosts USING (host) WHERE k <> '' GROUP BY host, k, host_docs HAVING count(DISTINCT doc_id) > greatest(4, host_docs * 0.005)),
gone AS (SELECT doc_id, sum(n)::BIGINT AS removed_words FROM lines JOIN often USING (host, k) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - removed_words >= 0.5 * n_words AS kept
FROM f
"""


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_text(read(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.find_leaks(docs, read(spark, sf_dir, "benchmark")).drop("text")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(read(spark, sf_dir, "documents"))


OP4_SQL = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE * (SELECT sum(n) FROM n) * 1.0 / (SELECT count(*) FROM n) / n AS rate FROM n),
p AS (
  SELECT source, k, -rate + k * ln(rate) - lgamma(k + 1) AS log_p
  FROM (SELECT *, unnest(range(greatest(0, floor(rate - 12 * sqrt(rate) - 16))::BIGINT, ceil(rate + 12 * sqrt(rate) + 17)::BIGINT)) AS k FROM r)),
c AS (SELECT source, k, sum(exp(log_p)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
d AS (
  SELECT *, ((('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
m AS (SELECT d.doc_id, min(k) + count(*) FILTER (cdf < u) AS copies FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source GROUP BY d.doc_id)
SELECT documents.*, unnest(range(1, copies + 1))::INTEGER AS copy_no FROM documents JOIN m USING (doc_id) WHERE copies > 0
"""


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(u,) for u in url_filters.LISTED], "url string")
    return url_filters.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), listed).drop("url")


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM p),
r AS (
  SELECT *, CASE
    WHEN regexp_matches(host, '(^|\.)example\.net$') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN regexp_matches(host, '(^|\.)example\.com$') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN regexp_matches(host, '(^|\.)org$') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN regexp_matches(host, '(^|\.)net$') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM h)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|\.)(cheap-pills|casino-win|spam-farm)\.example\.(com|net|org)$') AND starts_with(path, '/') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    params = token_output.TokenParams(public_tokenizers.path("word_bpe_49k.json"))
    return token_output.read_digests(token_output.write_shards(read(spark, sf_dir, "documents"), params))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return rows.select(
        "doc_id", *counts, F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"),
        pii.digest(F.array_sort(F.concat("base", "terms"))).alias("spans"), F.size("terms").cast("long").alias("n_terms"),
    )


OP7_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS (
  SELECT doc_id, text, 'email' AS kind, 0 AS rank, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS ms, string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS gs FROM t
  UNION ALL SELECT doc_id, text, 'ip', 1, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), string_split_regex(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') FROM t
  UNION ALL SELECT doc_id, text, 'card', 2, regexp_extract_all(text, '[0-9](?:[\x20-]?[0-9])+'), string_split_regex(text, '[0-9](?:[\x20-]?[0-9])+') FROM t
  UNION ALL SELECT doc_id, text, 'phone', 3, regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]') FROM t),
u AS (SELECT doc_id, text, kind, rank, unnest(ms) AS m, unnest(gs[: len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM k WHERE len(ms) > 0),
placed AS (SELECT *, (sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i))::BIGINT AS e, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM u),
base AS (
  SELECT doc_id, text, kind, rank, m, e - length(m) AS s, e FROM placed
  WHERE CASE kind WHEN 'email' THEN true WHEN 'phone' THEN length(d) BETWEEN 10 AND 15
    WHEN 'ip' THEN coalesce(list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) <= 255)), true)
    ELSE length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(d)), lambda j: CASE
      WHEN j % 2 = 0 THEN reverse(d)[j + 1]::INTEGER
      WHEN reverse(d)[j + 1]::INTEGER > 4 THEN 2 * reverse(d)[j + 1]::INTEGER - 9 ELSE 2 * reverse(d)[j + 1]::INTEGER END)) % 10 = 0 END),
ctx AS (
  SELECT doc_id, kind, kind || ':' || lower(m) AS entity, CASE kind WHEN 'email' THEN 'email:@' || lower(split_part(m, '@', 2)) END AS domain,
    CASE WHEN s > 80 THEN regexp_replace(substr(text, s - 80, 81), '^(\p{L}+|\P{L})', '') ELSE substr(text, 1, s) END || ' ' ||
    CASE WHEN length(text) - e > 80 THEN regexp_replace(substr(text, e + 1, 81), '(\p{L}+|\P{L})$', '') ELSE substr(text, e + 1) END AS beside
  FROM base),
ents AS (SELECT doc_id, entity, beside FROM ctx UNION ALL SELECT doc_id, domain, beside FROM ctx WHERE domain IS NOT NULL),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '\p{L}+')) AS m, unnest(string_split_regex(text, '\p{L}+')[: len(regexp_extract_all(text, '\p{L}+'))]) AS g, generate_subscripts(regexp_extract_all(text, '\p{L}+'), 1) AS i FROM t),
dt AS (SELECT DISTINCT doc_id, lower(m) AS term FROM runs WHERE length(m) >= 3),
own AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(lower(m), '\p{L}+')) AS term FROM base)),
near AS (
  SELECT DISTINCT doc_id, entity, term FROM (SELECT doc_id, entity, unnest(regexp_extract_all(lower(beside), '\p{L}+')) AS term FROM ents) WHERE length(term) >= 3
  UNION ALL SELECT doc_id, kind, term FROM (SELECT DISTINCT doc_id, kind FROM base) JOIN (SELECT * FROM dt ANTI JOIN own USING (doc_id, term)) USING (doc_id)),
n_et AS (SELECT entity, term, count(*) AS n_et FROM near GROUP BY ALL),
n_e AS (SELECT entity, count(DISTINCT doc_id) AS n_e FROM (SELECT doc_id, entity FROM ents UNION ALL SELECT doc_id, kind FROM base) GROUP BY ALL),
n_t AS (SELECT term, count(*) AS n_t FROM dt GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n FROM t),
told AS (
  SELECT term FROM n_et JOIN n_e USING (entity) JOIN n_t USING (term), n WHERE n_e < n
  GROUP BY term HAVING max(ln(n_et * n / (n_e::DOUBLE * n_t)) / ln(n / n_e) * n_et / (n_et + 1)) >= 0.7),
terms AS (
  SELECT doc_id, 'term' AS kind, 4 AS rank, e - length(m) AS s, e FROM (
    SELECT *, (sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e FROM runs) r
  WHERE lower(m) IN (SELECT term FROM told)
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.s < r.e AND r.e - length(r.m) < b.e)),
spans AS (SELECT doc_id, kind, rank, s, e FROM base UNION ALL SELECT doc_id, kind, rank, s, e FROM terms),
b AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
    count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (kind = 'term') AS n_terms,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind <> 'term') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_terms, 0) AS n_terms
FROM t LEFT JOIN b USING (doc_id)
"""


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = ngram_jaccard.JaccardParams(n=3, percent=90)
    return ngram_jaccard.link_components(read(spark, sf_dir, "documents"), params).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(words[i : i + 2], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
    UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 2)),
n AS (SELECT w.doc_id, count(g) AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n_shingles + q.n_shingles - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = other)
SELECT n.doc_id, n_shingles, min(other) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY ALL
"""


def op9_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, read(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    rows = toxicity.score(docs, model)
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda x: x["rank"] < len(secret_scan.BASE))
    counts = [pii.count_of(F.col("secrets"), k).alias(f"n_{k}") for k in secret_scan.BASE]
    n_keys = (F.size("secrets") - F.size(base)).cast("long").alias("n_confirmed")
    return rows.select("doc_id", *counts, F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("secrets")).alias("spans"), n_keys)


def op12_kd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kd_clusters.cluster(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    told = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256")
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", told)


def _assigned(name: str, centroids: str) -> str:
    """SQL for (vec_id, v, no, d): the nearest centroid of each vector and its squared distance."""
    return f"""{name} AS (SELECT rid, vec_id, v, min_by(no, (d, no)) AS no, min(d) AS d FROM (
    SELECT rid, vec_id, v, no, list_inner_product(v, v)::BIGINT - 2 * list_inner_product(v, c)::BIGINT + list_inner_product(c, c)::BIGINT AS d FROM kept, {centroids}) GROUP BY ALL)"""


def _moved(name: str, assigned: str, before: str) -> str:
    """SQL for (no, c): the floors of the means, components in their order."""
    return f"""{name} AS (SELECT no, coalesce(m.c, {before}.c) AS c FROM {before} LEFT JOIN (
    SELECT no, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS c FROM (
      SELECT no, i, sum(x::BIGINT)::BIGINT AS s, count(*) AS n FROM (SELECT no, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {assigned}) GROUP BY ALL) GROUP BY no) m USING (no))"""


OP12_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS no, v AS c FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept) ORDER BY h, v LIMIT 16),
{", ".join(x for r in range(3) for x in (_assigned(f"a{r}", f"c{r}"), _moved(f"c{r + 1}", f"a{r}", f"c{r}")))},
{_assigned("last", "c3")}
SELECT vec_id, no::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY no))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM last JOIN c3 USING (no)
"""


def planted_places(ids: list[str | None], counts: np.ndarray) -> np.ndarray:
    """Which word stands at each place: a tenth of the documents, by the hash of their identifiers, repeat a stretch of
    their words from some word on. A null identifier has no hash, its text stays."""
    found = []
    for i, n in zip(ids, counts.tolist()):
        places = np.arange(n)
        h = zlib.crc32(i.encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + g % 8))
        found.append(places)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = periodic_runs.find_runs(docs, periodic_runs.RunParams(order=planted_places))
    rows = rows.withColumn("best", periodic_runs.longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_html_extraction": op2_html_extraction,
        "op3_decontamination": op3_decontamination,
        "op4_source_mixing": op4_source_mixing,
        "op5_url_filters": op5_url_filters,
        "op6_token_output": op6_token_output,
        "op7_pii": op7_pii,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_importance": op9_importance,
        "op10_toxicity": op10_toxicity,
        "op11_secret_scan": op11_secret_scan,
        "op12_kd_clusters": op12_kd_clusters,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op4_source_mixing": OP4_SQL, "op5_url_filters": OP5_SQL, "op7_pii": OP7_SQL, "op8_ngram_jaccard": OP8_SQL, "op12_kd_clusters": OP12_SQL}
