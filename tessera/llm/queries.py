"""One query per operator, over its whole table, and the pipeline; SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import branch_merge, exact_dedup, filter_audit, fingerprints, language_id, line_dedup, minhash, mixing, packing, quality, sharding, simhash, warc

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: report(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_classifier": _over("documents", quality.quality_report),
        "op2_line_dedup": _over("documents", line_dedup.line_report),
        "op3_exact_dedup": _over("documents", exact_dedup.exact_report),
        "op4_language_id": _over("documents", language_id.language_report),
        "op5_warc": _over("pages", warc.warc_report_digest),
        "op6_simhash": _over("documents", simhash.simhash_report),
        "op7_packing": _over("documents", packing.packing_report),
        "op8_fingerprints": _over("documents", fingerprints.fingerprint_report),
        "op9_mixing": _over("documents", mixing.mix_report),
        "op10_sharding": _over("documents", sharding.shard_report),
        "op11_filter_audit": lambda spark, sf_dir: filter_audit.audit_report(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))),
        "op12_minhash": _over("documents", minhash.minhash_report),
        "op13_branch_merge": _over("documents", branch_merge.merge_report),
        "pipeline": corpus_pipeline.run,
    }


_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_LINES = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS stays FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.stays AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_EXACT = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), f AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY body) ELSE page_id END AS first FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat('mix|', CAST(doc_id AS VARCHAR), '|', md5(coalesce(text, '')))) AS key
  FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), s1 AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         source_size * 2 AS cap,
         CAST(CAST(sum(source_size) OVER () AS BIGINT) AS DOUBLE) * CAST(1.5 AS DOUBLE) AS total
  FROM s0
), s2 AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM s1
), s3 AS (
  SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS nth,
         CAST(coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS below,
         CAST(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS above
  FROM s2
), s4 AS (
  SELECT *, (total - below) / above AS level, ratio <= (total - below) / above AS filled FROM s3
), s5 AS (
  SELECT source, source_size,
         CASE WHEN filled THEN CAST(cap AS DOUBLE) ELSE weight * (SELECT level FROM s4 WHERE NOT filled ORDER BY nth LIMIT 1) END AS target
  FROM s4
), placed AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, CAST(floor(s.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS earlier
  FROM sized d JOIN s5 s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - earlier)) END AS taken
FROM placed
"""


_AUDIT = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), told AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), f AS (
  SELECT w.part, coalesce(told.good, 0) AS good, coalesce(told.bad, 0) AS bad,
         len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, w.doc_id > min(w.doc_id) OVER (PARTITION BY t) AS e
  FROM w LEFT JOIN told ON w.doc_id = told.doc_id
), fails AS (
  SELECT part, good, bad, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
         || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed, count(*) AS n
  FROM f GROUP BY ALL
), letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT p.l || q.l || r.l || s.l || u.l AS filter_order
  FROM letters p JOIN letters q ON q.l <> p.l JOIN letters r ON r.l NOT IN (p.l, q.l)
  JOIN letters s ON s.l NOT IN (p.l, q.l, r.l) JOIN letters u ON u.l NOT IN (p.l, q.l, r.l, s.l)
), steps AS (
  SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, CAST(k AS INTEGER), 1) AS l, substr(filter_order, 1, CAST(k AS INTEGER) - 1) AS before
  FROM orders, range(1, 6) AS r(k)
), each AS (
  SELECT part, filter_order, step, l, n, good, bad, failed, contains(failed, l) AS fails,
         translate(before, failed, '') <> before AS earlier
  FROM fails, steps
), counted AS (
  SELECT part, filter_order, step, any_value(l) AS l,
         CAST(coalesce(sum(n) FILTER (WHERE NOT fails AND NOT earlier), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (WHERE fails AND NOT earlier), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (WHERE fails AND earlier), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (WHERE failed = l), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(n) FILTER (WHERE fails AND NOT earlier AND good = 1), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(n) FILTER (WHERE fails AND NOT earlier AND bad = 1), 0) AS BIGINT) AS toxic_lost
  FROM each GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
FROM counted
"""

#: A checksum is a fold over the bytes of a name, with the table of its polynomial.
_MERGE = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), base AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), items AS (
  SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS x, '' AS name FROM base
  UNION ALL SELECT doc_id, -1, '', 'row' FROM base
  UNION ALL SELECT doc_id, -2, lang, 'lang' FROM base
  UNION ALL SELECT doc_id, -3, source, 'source' FROM base
), named AS (
  SELECT doc_id, i, x, side, side || ':' || doc_id || ':' || (CASE WHEN i < 0 THEN name ELSE CAST(i AS VARCHAR) END) AS element
  FROM items, (VALUES ('L'), ('R')) AS s(side)
), coded AS (
  SELECT doc_id, i, x, side,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(element) + 1), lambda k: CAST(ascii(substr(element, CAST(k AS INTEGER), 1)) AS BIGINT))),
                         lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 7 AS code
  FROM named, crc
), paired AS (
  SELECT doc_id, i, any_value(x) AS x, max(CASE WHEN side = 'L' THEN code END) AS l, max(CASE WHEN side = 'R' THEN code END) AS r
  FROM coded GROUP BY doc_id, i
), valued AS (
  SELECT doc_id, i, x, l, r,
         CASE WHEN l = 0 AND i >= 0 THEN NULL WHEN l = 0 THEN '' WHEN l = 1 THEN x || '!' WHEN l = 2 THEN x || '?' ELSE x END AS lv,
         CASE WHEN r = 0 AND i >= 0 THEN NULL WHEN r = 0 THEN '' WHEN r = 1 THEN x || '!' WHEN r = 2 THEN x || '?' ELSE x END AS rv,
         CASE WHEN l = 3 THEN '!' WHEN l = 4 THEN '?' END AS lg, CASE WHEN r = 3 THEN '!' WHEN r = 4 THEN '?' END AS rg
  FROM paired WHERE i <> -1
), merged AS (
  SELECT doc_id, i, x, lv, rv, lg, rg, lv IS DISTINCT FROM x AS lc, rv IS DISTINCT FROM x AS rc,
         CASE WHEN rv IS DISTINCT FROM x THEN rv ELSE lv END AS v, CASE WHEN i >= 0 THEN coalesce(rg, lg) END AS g
  FROM valued
), told AS (
  SELECT *, (lc OR rc) AND NOT (lc AND rc AND lv IS DISTINCT FROM rv) AS clean, lc AND rc AND lv <> rv AS ee,
         lc AND rc AND lv IS DISTINCT FROM rv AND (lv IS NULL OR rv IS NULL) AS ed,
         i >= 0 AND (lg IS NOT NULL OR rg IS NOT NULL) AND coalesce(lg = rg, true) AS gap_clean, i >= 0 AND coalesce(lg <> rg, false) AS ii,
         lc OR (i >= 0 AND lg IS NOT NULL) AS l_any, rc OR (i >= 0 AND rg IS NOT NULL) AS r_any
  FROM merged
), docs AS (
  SELECT doc_id, bool_or(l_any) AS l_any, bool_or(r_any) AS r_any,
         sum(CAST(clean AS INTEGER) + CAST(gap_clean AS INTEGER)) AS clean, sum(CAST(coalesce(ee, false) AS INTEGER)) AS ee, sum(CAST(ed AS INTEGER)) AS ed, sum(CAST(ii AS INTEGER)) AS ii,
         max(CASE WHEN i = -2 THEN v END) AS lang, max(CASE WHEN i = -3 THEN v END) AS source,
         max(CASE WHEN i = -2 THEN rv END) AS r_lang, max(CASE WHEN i = -3 THEN rv END) AS r_source,
         coalesce(string_agg(concat_ws(chr(10), v, g), chr(10) ORDER BY i) FILTER (WHERE i >= 0 AND (v IS NOT NULL OR g IS NOT NULL)), '') AS text,
         coalesce(string_agg(concat_ws(chr(10), rv, rg), chr(10) ORDER BY i) FILTER (WHERE i >= 0 AND (rv IS NOT NULL OR rg IS NOT NULL)), '') AS r_text
  FROM told GROUP BY doc_id
), rows AS (
  SELECT d.*, p.l = 0 AS l_gone, p.r = 0 AS r_gone, (p.l = 0 AND p.r <> 0 AND r_any) OR (p.r = 0 AND p.l <> 0 AND l_any) AS lost
  FROM docs d JOIN paired p ON d.doc_id = p.doc_id AND p.i = -1
), added AS (
  SELECT -1 - p.doc_id AS doc_id, b.lang, b.source, CASE WHEN p.l = 3 THEN '!' WHEN p.l = 4 THEN '?' END AS a, CASE WHEN p.r = 3 THEN '!' WHEN p.r = 4 THEN '?' END AS z
  FROM paired p JOIN base b ON p.doc_id = b.doc_id WHERE p.i = -1 AND (p.l IN (3, 4) OR p.r IN (3, 4))
)
SELECT doc_id, CASE WHEN l_gone AND NOT r_gone AND lost THEN r_lang WHEN NOT l_gone AND NOT r_gone THEN lang END AS lang,
       CASE WHEN l_gone AND NOT r_gone AND lost THEN r_source WHEN NOT l_gone AND NOT r_gone THEN source END AS source,
       CASE WHEN l_gone AND NOT r_gone AND lost THEN sha256(r_text) WHEN NOT l_gone AND NOT r_gone THEN sha256(text) END AS text_sha256,
       CAST(CASE WHEN l_gone OR r_gone THEN 1 - CAST(lost AS INTEGER) ELSE clean END AS BIGINT) AS n_clean,
       CAST(CASE WHEN l_gone OR r_gone THEN 0 ELSE ee END AS BIGINT) AS n_edit_edit,
       CAST(CASE WHEN l_gone OR r_gone THEN CAST(lost AS INTEGER) ELSE ed END AS BIGINT) AS n_edit_delete,
       CAST(CASE WHEN l_gone OR r_gone THEN 0 ELSE ii END AS BIGINT) AS n_insert_insert
FROM rows
UNION ALL
SELECT doc_id, lang, source, sha256(coalesce(z, a)), CAST(CASE WHEN a <> z THEN 0 ELSE 1 END AS BIGINT), 0, 0, CAST(CASE WHEN a <> z THEN 1 ELSE 0 END AS BIGINT)
FROM added
"""


def oracle_sql() -> dict[str, str]:
    out = {"op2_line_dedup": _LINES, "op3_exact_dedup": _EXACT, "op5_warc": _WARC, "op9_mixing": _MIX, "op11_filter_audit": _AUDIT, "op13_branch_merge": _MERGE}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
