"""DuckDB SQL equivalents of the registered queries (same column names and
types). Tables are the driver's pre-registered views."""

from __future__ import annotations

# sample vectors and the stand-in class dimension, shared by the vector family
_S = """s AS (SELECT vec_id AS key, CAST(label AS INTEGER) AS class_id,
                 CAST(embedding AS DOUBLE[]) AS f FROM embeddings),
cd AS (SELECT 'src' || CAST(i AS VARCHAR) AS class_name, CAST(i AS INTEGER) AS class_id
       FROM range(15) t(i))"""

# exploded elements: one row per (sample, dim)
_E = """e AS (SELECT key, class_id, unnest(range(0, len(f))) AS dim, unnest(f) AS v FROM s)"""

_CENT = """c AS (SELECT class_id, dim, avg(v) AS m FROM e GROUP BY class_id, dim),
d AS (SELECT e.key, e.class_id, sqrt(sum((e.v - c.m) * (e.v - c.m))) AS dist
      FROM e JOIN c USING (class_id, dim) GROUP BY e.key, e.class_id)"""

_QD = """q AS (SELECT f AS qf FROM s WHERE key = 0),
qd AS (SELECT key, class_id, list_distance(f, qf) AS dist FROM s, q)"""

ORACLE_SQL = {
    "class_stats": f"""
WITH {_S}, {_E}, {_CENT},
st AS (SELECT class_id, count(*) AS n, avg(dist) AS dm, var_pop(dist) AS dv FROM d GROUP BY class_id)
SELECT cd.class_id, cd.class_name, CAST(coalesce(st.n, 0) AS BIGINT) AS n_samples,
       round(st.dm, 8) AS dist_mean, round(st.dv, 8) AS dist_var
FROM cd LEFT JOIN st USING (class_id)""",

    "class_centroids": f"""
WITH {_S}, {_E},
per_class AS (SELECT class_id, dim, avg(v) AS m FROM e GROUP BY class_id, dim),
cnt AS (SELECT class_id, count(*) AS n FROM s GROUP BY class_id),
gl AS (SELECT CAST(-1 AS INTEGER) AS class_id, dim, avg(v) AS m FROM e GROUP BY dim)
SELECT p.class_id, CAST(cnt.n AS BIGINT) AS n, CAST(p.dim AS INTEGER) AS dim, round(p.m, 6) AS mean
FROM per_class p JOIN cnt USING (class_id)
UNION ALL
SELECT g.class_id, CAST((SELECT count(*) FROM s) AS BIGINT) AS n, CAST(g.dim AS INTEGER) AS dim,
       round(g.m, 6) AS mean FROM gl g""",

    "inter_class_distance": f"""
WITH {_S}, {_E},
m AS (SELECT class_id, dim, avg(v) AS m FROM e GROUP BY class_id, dim
      UNION ALL SELECT CAST(-1 AS INTEGER), dim, avg(v) FROM e GROUP BY dim)
SELECT a.class_id AS class_i, b.class_id AS class_j,
       round(sqrt(sum((a.m - b.m) * (a.m - b.m))), 6) AS dist
FROM m a JOIN m b USING (dim) GROUP BY a.class_id, b.class_id""",

    "closest_to_mean": f"""
WITH {_S}, {_E}, {_CENT},
r AS (SELECT class_id, key, dist,
             row_number() OVER (PARTITION BY class_id ORDER BY round(dist, 6), key) AS rk FROM d)
SELECT class_id, CAST(rk AS INTEGER) AS rank, key, round(dist, 6) AS dist FROM r WHERE rk <= 5""",

    "class_outliers": f"""
WITH {_S}, {_E}, {_CENT},
r AS (SELECT class_id, key, dist,
             row_number() OVER (PARTITION BY class_id ORDER BY round(dist, 6) DESC, key DESC) AS rk
      FROM d)
SELECT class_id, CAST(rk AS INTEGER) AS rank, key, round(dist, 6) AS dist FROM r WHERE rk <= 5""",

    "knn_top10": f"""
WITH {_S}, {_QD}
SELECT CAST(row_number() OVER (ORDER BY round(dist, 6), key) - 1 AS INTEGER) AS rank,
       key, class_id, round(dist, 6) AS dist
FROM qd ORDER BY round(dist, 6), key LIMIT 10""",

    "query_rank": f"""
WITH {_S}, {_QD}
SELECT CAST(0 AS BIGINT) AS query_key,
       CAST(count(*) FILTER (WHERE round(dist, 6) < 0 OR (round(dist, 6) = 0 AND key < 0)) AS BIGINT)
         AS query_rank,
       CAST(count(*) AS BIGINT) AS n_samples
FROM qd""",

    "closest_by_class": f"""
WITH {_S}, {_QD}
SELECT class_id, arg_min(key, (round(dist, 6), key)) AS key,
       round(arg_min(dist, (round(dist, 6), key)), 6) AS dist
FROM qd GROUP BY class_id""",
}

# catalogue records: artist = source, key = md5 of the text; label lines in doc order
_D = """docs AS (SELECT doc_id, source AS artist, md5(text) AS key FROM documents),
cd AS (SELECT 'src' || CAST(i AS VARCHAR) AS class_name, CAST(i AS INTEGER) AS class_id
       FROM range(15) t(i)),
lines AS (SELECT doc_id AS line_no, CASE WHEN doc_id % 11 = 3 THEN key || ':' || artist
                 WHEN doc_id % 11 = 5 THEN key || '::' || artist || '::x'
                 ELSE key || '::' || artist END AS value FROM docs),
parsed AS (SELECT line_no, value, string_split(trim(value), '::') AS p FROM lines),
ok AS (SELECT line_no, p[1] AS key, p[2] AS artist FROM parsed WHERE len(p) = 2),
lab AS (SELECT ok.line_no, ok.key, cd.class_id FROM ok JOIN cd ON ok.artist = cd.class_name),
dedup AS (SELECT key, arg_max(class_id, line_no) AS class_id, count(*) AS n_lines
          FROM lab GROUP BY key),
feats AS (SELECT l.doc_id, d.key, l.quality, l.toxic FROM labels l JOIN docs d USING (doc_id))"""

ORACLE_SQL.update({
    "artist_filter": """
SELECT doc_id, source FROM documents
WHERE source IN (SELECT 'src' || CAST(i AS VARCHAR) FROM range(15) t(i))""",

    "label_dedup": f"""
WITH {_D}
SELECT key, class_id, CAST(n_lines AS BIGINT) AS n_lines FROM dedup""",

    "label_rejects": f"""
WITH {_D}
SELECT line_no, value, 'bad_format' AS reason FROM parsed WHERE len(p) <> 2
UNION ALL
SELECT ok.line_no, lines.value, 'unknown_artist' AS reason
FROM ok JOIN lines USING (line_no)
WHERE ok.artist NOT IN (SELECT class_name FROM cd)""",

    "label_join": f"""
WITH {_D}
SELECT f.doc_id, f.key, d.class_id, f.quality, f.toxic FROM feats f JOIN dedup d USING (key)""",

    "label_counts": f"""
WITH {_D}
SELECT 'lines_read' AS metric, CAST(count(*) AS BIGINT) AS value FROM lines
UNION ALL SELECT 'rejected_bad_format', CAST(count(*) AS BIGINT) FROM parsed WHERE len(p) <> 2
UNION ALL SELECT 'rejected_unknown_artist', CAST(count(*) AS BIGINT) FROM ok
          WHERE artist NOT IN (SELECT class_name FROM cd)
UNION ALL SELECT 'labels_kept', CAST(count(*) AS BIGINT) FROM dedup
UNION ALL SELECT 'samples_read', CAST(count(*) AS BIGINT) FROM feats
UNION ALL SELECT 'samples_kept', CAST(count(*) AS BIGINT) FROM feats JOIN dedup USING (key)""",

    "has_image_filter": """
SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS key FROM events
WHERE CAST(json_extract(props, '$.k') AS INTEGER) >= 10""",

    "checksum_key": """
SELECT doc_id, 'full/' || md5(CAST(doc_id AS VARCHAR)) || '.jpg' AS path,
       md5(CAST(doc_id AS VARCHAR)) AS key, 'jpg' AS ext FROM documents""",

    "prefix_shard": """
SELECT doc_id, md5(text) AS key FROM documents WHERE starts_with(md5(text), 'a')""",

    "manifest_filter": """
SELECT doc_id, CAST(doc_id AS VARCHAR) || '.jpg' AS name, CAST(doc_id AS VARCHAR) AS key
FROM documents
WHERE CAST(doc_id AS VARCHAR) || '.jpg' IN (SELECT CAST(doc_id AS VARCHAR) || '.jpg' FROM labels)""",

    "incremental_pending": """
SELECT doc_id, CAST(doc_id AS VARCHAR) AS key FROM documents
WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT CAST(item_id AS VARCHAR) FROM benchmark WHERE item_id % 3 <> 0)""",

    "vector_rejects": """
SELECT vec_id AS key, CAST(label AS INTEGER) AS class_id,
       CASE vec_id % 7 WHEN 1 THEN 'width_mismatch' ELSE 'no_vector' END AS reason
FROM embeddings WHERE vec_id % 7 IN (1, 2)""",

    "text_fields": """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' (Japan) ' || source ELSE source END AS artist,
       CASE WHEN doc_id % 3 = 1 AND lang <> '' THEN lang ELSE source END AS title,
       CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS VARCHAR) ELSE 'Unknown' END AS date
FROM documents""",

    "label_lines": "SELECT md5(text) AS key, source AS artist FROM documents",

    "value_list": """
SELECT source AS value, count(*) AS n FROM documents WHERE doc_id % 4 <> 0 GROUP BY source""",

    "keyed_shard": """
SELECT DISTINCT md5(text) AS key, substr(md5(text), 1, 1) AS shard FROM documents""",

    "vector_files": """
SELECT md5(CAST(vec_id AS VARCHAR)) AS key, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS dim,
       round(CAST(unnest(embedding) AS DOUBLE), 6) AS value
FROM embeddings WHERE vec_id % 6 <> 5 AND vec_id % 10 NOT IN (3, 7)""",

    "vector_file_rejects": """
SELECT md5(CAST(vec_id AS VARCHAR)) AS key,
       CASE vec_id % 10 WHEN 3 THEN 'width_mismatch' ELSE 'unreadable' END AS reason
FROM embeddings WHERE vec_id % 6 <> 5 AND vec_id % 10 IN (3, 7)""",

    "keypoint_files": """
WITH k AS (SELECT vec_id, label, embedding, vec_id // 20 AS image,
                  row_number() OVER (PARTITION BY vec_id // 20 ORDER BY vec_id) - 1 AS kp FROM embeddings)
SELECT md5(CAST(image AS VARCHAR)) AS key, CAST(kp AS INTEGER) AS kp_id, vec_id, CAST(label AS DOUBLE) AS response,
       CAST(unnest(range(0, len(embedding))) AS INTEGER) AS dim, round(CAST(unnest(embedding) AS DOUBLE), 6) AS value
FROM k""",

    "catalogue_rejects": """
SELECT doc_id, CASE doc_id % 9 WHEN 4 THEN 'bad_json' ELSE 'no_artist' END AS reason
FROM documents WHERE doc_id % 9 IN (4, 7)""",

    "descriptor_job": """
SELECT doc_id AS key, length(text) AS size,
       length(text) - length(replace(text, 'a', '')) AS n_a, length(text) - length(replace(text, 'e', '')) AS n_e,
       length(text) - length(replace(text, 'i', '')) AS n_i, length(text) - length(replace(text, 'o', '')) AS n_o
FROM documents WHERE text <> ''""",
})

# md5-ordered split (train = first floor(n * 0.75)) and nearest-centroid predictions
_SPLIT = """r AS (SELECT key, class_id, f,
             row_number() OVER (ORDER BY md5(CAST(key AS VARCHAR)), key) - 1 AS rk,
             count(*) OVER () AS n FROM s),
sp AS (SELECT key, class_id, f,
              CASE WHEN rk < floor(n * 0.75) THEN 'train' ELSE 'test' END AS split FROM r)"""

_PRED = """te AS (SELECT class_id, unnest(range(0, len(f))) AS dim, unnest(f) AS v
       FROM sp WHERE split = 'train'),
tc AS (SELECT class_id, dim, avg(v) AS m FROM te GROUP BY class_id, dim),
cl AS (SELECT class_id, list(m ORDER BY dim) AS cf FROM tc GROUP BY class_id),
pr AS (SELECT t.key, t.class_id AS label,
              arg_min(cl.class_id, (round(list_distance(t.f, cl.cf), 6), cl.class_id)) AS prediction
       FROM sp t, cl WHERE t.split = 'test' GROUP BY t.key, t.class_id),
conf AS (SELECT label, prediction, count(*) AS n FROM pr GROUP BY label, prediction)"""

ORACLE_SQL.update({
    "train_test_split": f"""
WITH {_S}, {_SPLIT}
SELECT key, class_id, split FROM sp""",

    "strat_folds": f"""
WITH {_S}
SELECT key, class_id,
       CAST((row_number() OVER (PARTITION BY class_id ORDER BY md5(CAST(key AS VARCHAR)), key) - 1)
            % 3 AS INTEGER) AS fold
FROM s""",

    "class_weights": f"""
WITH {_S}, c AS (SELECT class_id, count(*) AS n_c FROM s GROUP BY class_id)
SELECT class_id, CAST(n_c AS BIGINT) AS n_c,
       round((SELECT sum(n_c) FROM c) / ((SELECT count(*) FROM c) * n_c), 8) AS weight
FROM c""",

    "confusion_matrix": f"""
WITH {_S}, {_SPLIT}, {_PRED}
SELECT label, prediction, CAST(n AS BIGINT) AS n FROM conf""",

    "confusion_normalised": f"""
WITH {_S}, {_SPLIT}, {_PRED}
SELECT label, prediction, CAST(n AS BIGINT) AS n,
       round(n / sum(n) OVER (PARTITION BY label), 8) AS frac FROM conf""",

    "accuracy_summary": f"""
WITH {_S}, {_SPLIT}, {_PRED},
cls AS (SELECT label AS c FROM conf UNION SELECT prediction FROM conf),
pl AS (SELECT label, sum(n) AS support, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS hits
       FROM conf GROUP BY label),
rc AS (SELECT coalesce(pl.hits / pl.support, 0.0) AS recall, coalesce(pl.support, 0) AS support,
              coalesce(pl.hits, 0) AS hits FROM cls LEFT JOIN pl ON cls.c = pl.label)
SELECT CAST(sum(support) AS BIGINT) AS n_test, CAST(sum(hits) AS BIGINT) AS n_correct,
       round(sum(hits) / sum(support), 8) AS accuracy, round(avg(recall), 8) AS balanced_accuracy
FROM rc""",
})

_KP = """kp AS (SELECT l_orderkey AS key, l_partkey, l_suppkey, l_linenumber,
               l_extendedprice AS response FROM lineitem)"""

# codebook: 16 points with the lowest md5('0:' || key), coded in that order
_C0 = """c0 AS (SELECT CAST(row_number() OVER (ORDER BY md5('0:' || CAST(key AS VARCHAR)), key) - 1
                    AS INTEGER) AS code, f AS cf
       FROM s ORDER BY md5('0:' || CAST(key AS VARCHAR)), key LIMIT 16)"""

_ASSIGN = """asg AS (SELECT e.vec_id % 25 AS key, e.vec_id AS kp_id,
                arg_min(c0.code, (round(list_distance(CAST(e.embedding AS DOUBLE[]), c0.cf), 6), c0.code))
                  AS code,
                arg_min(list_distance(CAST(e.embedding AS DOUBLE[]), c0.cf),
                        (round(list_distance(CAST(e.embedding AS DOUBLE[]), c0.cf), 6), c0.code)) AS dist
         FROM embeddings e, c0 GROUP BY e.vec_id)"""


def _lloyd_sql(steps: int = 3) -> str:
    ctes = [_S, _C0]
    prev = "c0"
    for i in range(1, steps + 1):
        ctes.append(f"""a{i} AS (SELECT s.key, arg_min(c.code, (round(list_distance(s.f, c.cf), 6), c.code)) AS code
        FROM s, {prev} c GROUP BY s.key)""")
        ctes.append(f"""e{i} AS (SELECT a.code, unnest(range(0, len(s.f))) AS dim, unnest(s.f) AS v
        FROM a{i} a JOIN s USING (key))""")
        ctes.append(f"""m{i} AS (SELECT code, list(m ORDER BY dim) AS cf, max(n) AS n FROM
        (SELECT code, dim, avg(v) AS m, count(*) AS n FROM e{i} GROUP BY code, dim) GROUP BY code)""")
        ctes.append(f"""c{i} AS (SELECT c.code, coalesce(m.cf, c.cf) AS cf, coalesce(m.n, 0) AS n
        FROM {prev} c LEFT JOIN m{i} m USING (code))""")
        prev = f"c{i}"
    body = ",\n".join(ctes)
    return f"""
WITH {body}
SELECT code, CAST(n AS BIGINT) AS n, CAST(dim AS INTEGER) AS dim, round(value, 6) AS value
FROM (SELECT code, n, unnest(range(0, len(cf))) AS dim, unnest(cf) AS value FROM {prev})"""


ORACLE_SQL.update({
    "keypoint_topk": f"""
WITH {_KP},
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY response DESC, l_partkey, l_suppkey,
                                   l_linenumber) AS kp_rank FROM kp)
SELECT key, CAST(kp_rank AS INTEGER) AS kp_rank, l_partkey, l_suppkey, l_linenumber, response
FROM r WHERE kp_rank <= 3""",

    "keypoint_sample": f"""
WITH {_KP},
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY
          md5(CAST(key AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) || ':' ||
              CAST(l_suppkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':0'),
          l_partkey, l_suppkey, l_linenumber) AS sample_rank FROM kp)
SELECT key, CAST(sample_rank AS INTEGER) AS sample_rank, l_partkey, l_suppkey, l_linenumber
FROM r WHERE sample_rank <= 3""",

    "codeword_assign": f"""
WITH {_S}, {_C0}, {_ASSIGN}
SELECT key, kp_id, code, round(dist, 6) AS dist FROM asg""",

    "bow_histogram": f"""
WITH {_S}, {_C0}, {_ASSIGN},
keys AS (SELECT DISTINCT key FROM asg),
cnt AS (SELECT key, code, count(*) AS n FROM asg GROUP BY key, code)
SELECT k.key, CAST(c.i AS INTEGER) AS code, CAST(coalesce(cnt.n, 0) AS BIGINT) AS cnt
FROM keys k CROSS JOIN range(16) c(i)
LEFT JOIN cnt ON cnt.key = k.key AND cnt.code = c.i""",

    "lloyd_steps": _lloyd_sql(3),
})


def _site(col: str) -> str:
    parts = [f"CASE WHEN instr({col}, '{h}') > 0 THEN substr({col}, 1, instr({col}, '{h}') + {len(h) - 1}) END"
             for h in ("example.com", "example.net", "example.org")]
    return "coalesce(" + ", ".join(parts) + ")"


def _unescape(expr: str) -> str:
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                    ("&nbsp;", " "), ("&amp;", "&")]:
        expr = f"replace({expr}, '{ent}', '{ch}')"
    return expr


_LINKS = f"""lk AS (SELECT page_id, {_site('url')} AS site,
               regexp_extract_all(html, '<a\\s[^>]*>') AS tags FROM pages),
hr AS (SELECT page_id, site, list_filter(list_transform(tags, lambda t: coalesce(
               nullif(regexp_extract(t, '\\shref\\s*=\\s*"([^"]*)"', 1), ''),
               nullif(regexp_extract(t, '\\shref\\s*=\\s*''([^'']*)''', 1), ''))), lambda h: h IS NOT NULL) AS l FROM lk),
links AS (SELECT page_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS pos, unnest(l) AS raw, site FROM hr),
links1 AS (SELECT page_id, pos, {_unescape('raw')} AS href, site FROM links),
links2 AS (SELECT page_id, pos, href,
                  CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href
                       ELSE site || href END AS link FROM links1),
web AS (SELECT * FROM links2 WHERE NOT regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:')
        OR regexp_matches(lower(href), '^https?://'))"""

ORACLE_SQL.update({
    "page_key": """
WITH u AS (SELECT page_id, CASE WHEN page_id % 10 = 1
                  THEN url || '/' || repeat('segment-', 30) || CAST(page_id AS VARCHAR) ELSE url END AS url
           FROM pages),
k AS (SELECT page_id, string_split(url, '/')[-1] AS page_key FROM u)
SELECT page_id, page_key,
       CASE WHEN length(page_key) > 200
            THEN string_split(page_key, '-')[1] || '-TRUNC-' || string_split(page_key, '-')[-1]
            ELSE page_key END AS short_key
FROM k""",

    "page_site": f"""SELECT page_id, {_site('url')} AS site FROM pages""",

    "page_links": f"""WITH {_LINKS} SELECT page_id, pos, href, link FROM links2""",

    "page_frontier": f"""
WITH {_LINKS}
SELECT DISTINCT link FROM web
WHERE link IS NOT NULL AND link NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)
  AND link NOT IN (SELECT link FROM web WHERE page_id % 5 = 0 AND link IS NOT NULL)""",

    "listing_links": """
WITH p AS (SELECT doc_id AS page_id, 'http://collections.example.org' AS site, CAST(doc_id AS VARCHAR) AS i FROM documents)
SELECT page_id, site || '/o/' || i || '?a=1&b=2' AS link FROM p
UNION ALL SELECT page_id, site || '/p/' || i FROM p
UNION ALL SELECT page_id, site || '/s?page=' || i FROM p WHERE page_id % 4 <> 0""",

    "crawl_closure": """
WITH RECURSIVE e AS (
  SELECT doc_id AS src, unnest([2 * doc_id, 2 * doc_id + 1, doc_id // 3]) AS dst FROM documents WHERE doc_id % 7 <> 6),
r(i, depth) USING KEY (i) AS (
  SELECT CAST(1 AS BIGINT), CAST(0 AS INTEGER)
  UNION
  SELECT e.dst, CAST(min(r.depth) + 1 AS INTEGER) FROM r JOIN e ON e.src = r.i
  WHERE NOT EXISTS (SELECT 1 FROM recurring.r AS k WHERE k.i = e.dst) GROUP BY e.dst)
SELECT 'http://collections.example.org/p/' || i AS url, depth,
       i IN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 6) AS stored FROM r""",

    "site_a_records": """
SELECT CAST(doc_id AS VARCHAR) AS page_key, 'Work & ' || doc_id AS title_EN, lang AS title_JP,
       CASE WHEN doc_id % 7 <> 2 THEN source END AS artist, CAST(n_chars AS VARCHAR) AS date,
       n_chars || ' cm' AS dimensions, source AS series,
       CASE WHEN doc_id % 3 = 0 THEN 'http://collections.example.org/dl/' || doc_id || '.tif'
            WHEN doc_id % 5 <> 1 THEN 'http://img/' || doc_id || '.jpg' END AS image_url,
       CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 = 1 THEN 'no_image' END AS reject_reason
FROM documents""",

    "site_b_records": """
SELECT CAST(doc_id AS VARCHAR) AS page_key, 'Work ' || doc_id AS title_EN, lang AS title_JP, source AS artist,
       lang AS publisher, CASE WHEN doc_id % 4 <> 1 THEN 'Edo ' || n_chars ELSE 'Unknown' END AS date,
       'ink ' || n_chars AS medium, n_chars || ' mm' AS format, CAST(doc_id AS VARCHAR) AS acc_num,
       CAST(n_chars AS VARCHAR) AS mfa_dups, source AS signed,
       CASE WHEN doc_id % 2 = 0 THEN 'mark ' || doc_id END AS markings,
       CASE WHEN doc_id % 9 <> 5 THEN 'http://img/' || doc_id || '.jpg' END AS image_url,
       CASE WHEN doc_id % 6 = 4 THEN 'no_origin' WHEN doc_id % 6 = 2 THEN 'other_origin'
            WHEN doc_id % 5 = 3 THEN 'other_class' WHEN doc_id % 9 = 5 THEN 'no_image' END AS reject_reason
FROM documents""",

    "page_record": f"""
WITH c AS (SELECT page_id, url, html,
                  nullif(regexp_extract(html, '(?s)<!--(.*?)-->', 1), '') AS comment,
                  regexp_extract(html, '<p(?:\\s[^>]*)?>(?s:(.*?))(?:<p[\\s>]|</p[\\s>]|$)', 1) AS first_p
           FROM pages)
SELECT page_id, string_split(url, '/')[-1] AS page_key,
       nullif({_unescape("regexp_extract(html, '<title(?:\\s[^>]*)?>([^<]*)', 1)")}, '') AS title,
       nullif({_unescape("regexp_extract(html, '<h1(?:\\s[^>]*)?>([^<]*)', 1)")}, '') AS h1,
       comment,
       nullif(regexp_extract(comment, 'src="(\\S*)"', 1), '') AS image_url,
       coalesce(nullif({_unescape("regexp_extract(first_p, '<br\\s*/?>([^\\n]*)<br\\s*/?>', 1)")}, ''), 'Unknown') AS date
FROM c""",
})


def _kmeans_sql(k: int = 16, attempts: int = 10, iterations: int = 10, tol: float = 1e-4) -> str:
    """Every attempt's Lloyd iterations, unrolled; an attempt stands still once
    no centre of it moved more than ``tol``."""
    ctes = [_S, f"""h AS (SELECT a.att, s.f, row_number() OVER (PARTITION BY a.att
              ORDER BY md5(CAST(a.att AS VARCHAR) || ':' || CAST(s.key AS VARCHAR)), s.key) - 1 AS code
       FROM s, (SELECT CAST(i AS INTEGER) AS att FROM range({attempts}) t(i)) a)""",
            f"c0 AS MATERIALIZED (SELECT att, CAST(code AS INTEGER) AS code, f AS cf, TRUE AS live FROM h WHERE code < {k})"]
    for i in range(iterations):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT s.key, c.att,
              arg_min(c.code, (round(list_distance(s.f, c.cf), 6), c.code)) AS code
       FROM s, c{i} c WHERE c.live GROUP BY s.key, c.att)""")
        ctes.append(f"""m{i} AS MATERIALIZED (SELECT att, code, list(m ORDER BY dim) AS cf FROM (
              SELECT att, code, dim, avg(v) AS m FROM (
                SELECT a.att, a.code, unnest(range(0, len(s.f))) AS dim, unnest(s.f) AS v
                FROM a{i} a JOIN s USING (key)) GROUP BY att, code, dim) GROUP BY att, code)""")
        ctes.append(f"""n{i} AS MATERIALIZED (SELECT c.att, c.code, coalesce(m.cf, c.cf) AS cf, c.live,
              list_distance(c.cf, coalesce(m.cf, c.cf)) AS shift FROM c{i} c LEFT JOIN m{i} m USING (att, code))""")
        ctes.append(f"""c{i + 1} AS MATERIALIZED (SELECT att, code, cf,
              live AND max(shift) OVER (PARTITION BY att) > {tol!r} AS live FROM n{i})""")
    last = f"c{iterations}"
    ctes.append(f"""cost AS (SELECT att, sum(d * d) AS cost FROM (
              SELECT c.att, s.key, arg_min(list_distance(s.f, c.cf), (round(list_distance(s.f, c.cf), 6), c.code)) AS d
              FROM s, {last} c GROUP BY c.att, s.key) GROUP BY att),
best AS (SELECT att, cost FROM cost ORDER BY cost, att LIMIT 1)""")
    return f"""
WITH {', '.join(ctes)}
SELECT code, CAST(dim AS INTEGER) AS dim, round(value, 6) AS value, round(cost, 6) AS cost
FROM (SELECT code, unnest(range(0, len(cf))) AS dim, unnest(cf) AS value, cost FROM {last} JOIN best USING (att))"""


SVM_C = 0.01


def _svm_sql(C: float = SVM_C, steps: int = 60) -> str:
    """``svm(class_id, w)``: the one-vs-rest squared-hinge optimum, the bias
    last, by accelerated gradient steps (fixed momentum; step sizes from the
    Frobenius norm of the Gram matrix, for the bias from the number of rows).
    At this C the steps end at the optimum to the last digits."""
    return f"""tr AS MATERIALIZED (SELECT class_id, list_append(f, CAST(1 AS DOUBLE)) AS x FROM sp WHERE split = 'train'),
nc AS (SELECT class_id AS c, count(*) AS n FROM tr GROUP BY class_id),
cls AS MATERIALIZED (SELECT c, (SELECT count(*) FROM tr) / ((SELECT count(*) FROM nc) * n) AS s FROM nc),
ex AS (SELECT row_number() OVER () AS r, x FROM tr),
el AS MATERIALIZED (SELECT r, unnest(range(1, len(x))) AS d, unnest(x[:-2]) AS v FROM ex),
size AS (SELECT (SELECT count(*) FROM tr) AS n, (SELECT greatest(1, max(s)) FROM cls) AS s,
                sqrt(sum(m * m)) AS fro FROM (SELECT sum(a.v * b.v) AS m FROM el a JOIN el b USING (r) GROUP BY a.d, b.d)),
lip AS MATERIALIZED (SELECT 1 + 4 * {C} * s * fro AS lf, 1 + 4 * {C} * s * n AS lb FROM size),
it AS (
  SELECT 0 AS i, c, list_transform(range(0, (SELECT max(len(x)) FROM tr)), lambda d: CAST(0 AS DOUBLE)) AS w,
         list_transform(range(0, (SELECT max(len(x)) FROM tr)), lambda d: CAST(0 AS DOUBLE)) AS v FROM cls
  UNION ALL
  SELECT i + 1, c, w2, list_transform(list_zip(w2, w), lambda t: t[1] + (1 - sqrt(1 / lf)) / (1 + sqrt(1 / lf)) * (t[1] - t[2]))
  FROM (SELECT i, c, w, lf, list_transform(list_zip(v, g, range(1, len(v) + 1)),
               lambda t: t[1] - (t[1] + t[2]) / CASE WHEN t[3] = len(v) THEN lb ELSE lf END) AS w2
        FROM (SELECT i, c, any_value(w) AS w, any_value(v) AS v, list(g ORDER BY d) AS g
              FROM (SELECT i, c, d, any_value(w) AS w, any_value(v) AS v, sum(k * e) AS g
                    FROM (SELECT i, c, w, v, k, unnest(range(1, len(x) + 1)) AS d, unnest(x) AS e
                          FROM (SELECT it.i, it.c, it.w, it.v, tr.x,
                                       CASE WHEN tr.class_id = it.c THEN -2 * {C} * cls.s * greatest(0, 1 - list_dot_product(tr.x, it.v))
                                            ELSE 2 * {C} * greatest(0, 1 + list_dot_product(tr.x, it.v)) END AS k
                                FROM it JOIN cls USING (c), tr WHERE it.i < {steps}))
                    GROUP BY i, c, d) GROUP BY i, c), lip)),
svm AS MATERIALIZED (SELECT c AS class_id, w FROM it WHERE i = {steps})"""


PCA_K = 3


def _pca_sql(k: int = PCA_K, squarings: int = 16) -> str:
    """Leading eigenvectors of the covariance one after the other: a matrix
    squared again and again (scaled each time) ends as the outer product of its
    first eigenvector; that component is taken out, and so on."""
    ctes = ["""m AS (SELECT dim, avg(v) AS m FROM e GROUP BY dim),
z AS MATERIALIZED (SELECT key, class_id, dim, v - m AS v FROM e JOIN m USING (dim)),
a0 AS MATERIALIZED (SELECT a.dim AS i, b.dim AS j, sum(a.v * b.v) AS v FROM z a JOIN z b USING (key) GROUP BY a.dim, b.dim)"""]
    for c in range(k):
        last = f"a{c}"
        for t in range(squarings):
            ctes.append(f"""q{c}_{t} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v
       FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY a.i, b.j)""")
            ctes.append(f"s{c}_{t} AS MATERIALIZED (SELECT i, j, v / (SELECT max(abs(v)) FROM q{c}_{t}) AS v FROM q{c}_{t})")
            last = f"s{c}_{t}"
        ctes.append(f"""u{c} AS MATERIALIZED (SELECT i, v / sqrt(sum(v * v) OVER ()) AS v FROM {last}
       WHERE j = (SELECT j FROM {last} WHERE i = j ORDER BY v DESC, j LIMIT 1))""")
        ctes.append(f"""a{c + 1} AS MATERIALIZED (SELECT a.i, a.j, a.v - x.v * y.v * (
         SELECT sum(p.v * b.v * r.v) FROM a{c} b JOIN u{c} p ON p.i = b.i JOIN u{c} r ON r.i = b.j) AS v
       FROM a{c} a JOIN u{c} x ON x.i = a.i JOIN u{c} y ON y.i = a.j)""")
    parts = ", ".join(f"round(power(sum(z.v * u{c}.v), 2), 6) AS sq_{c}" for c in range(k))
    joins = " ".join(f"JOIN u{c} ON u{c}.i = z.dim" for c in range(k))
    return f"""
WITH {_S}, {_E}, {", ".join(ctes)}
SELECT key, class_id, {parts} FROM z {joins} GROUP BY key, class_id"""


ORACLE_SQL.update({
    "pca_project": _pca_sql(),

    "kmeans_codebook": _kmeans_sql(),

    "svm_ovr": f"""
WITH {_S}, {_SPLIT}
SELECT DISTINCT class_id, TRUE AS optimal FROM sp WHERE split = 'train'""",

    "svm_grid": f"""
WITH {_S}, {_SPLIT}, k AS (SELECT count(DISTINCT class_id) AS k FROM sp WHERE split = 'train')
SELECT CAST(i AS INTEGER) AS log_c, CAST(4 * k AS INTEGER) AS n_models, CAST(0 AS INTEGER) AS n_unconverged,
       TRUE AS consistent
FROM range(-2, 11) t(i), k""",

    "svm_top_weights": f"""
WITH RECURSIVE {_S}, {_SPLIT}, {_svm_sql()},
l AS (SELECT class_id, unnest(range(0, len(w) - 1)) AS dim, unnest(w[:-2]) AS v FROM svm)
SELECT class_id, CAST(row_number() OVER (PARTITION BY class_id ORDER BY abs(v) DESC, dim) AS INTEGER) AS rank,
       CAST(dim AS INTEGER) AS dim, 'feature ' || dim AS name, round(v, 6) AS weight
FROM l QUALIFY rank <= 5""",

    "model_roundtrip": f"""
WITH RECURSIVE {_S}, {_SPLIT}, {_svm_sql()},
z AS (SELECT key, sp.class_id AS label, svm.class_id AS c, list_dot_product(list_append(f, CAST(1 AS DOUBLE)), w) AS z
      FROM sp, svm WHERE split = 'test')
SELECT key, label, arg_max(c, (z, -c)) AS prediction, round(max(z), 6) AS margin FROM z GROUP BY key, label""",
})

# the same results by other means: counts taken in passing, bucketed joins, SQL table functions
ORACLE_SQL.update({
    "ingest_counts": ORACLE_SQL["label_counts"],
    "bucketed_label_join": ORACLE_SQL["label_join"],
    "bucketed_pending": ORACLE_SQL["incremental_pending"],
    "descriptor_sql": ORACLE_SQL["descriptor_job"],
})
