"""Queries of sections 2.6 and 2.10: boxes on pages, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from factforge.operators import components, geo, search, sheets
from factforge.plans.base import query, stored_bytes, table, view
from factforge.sources.tables import durable, in_shares

C = F.col
REG = "reg AS (SELECT page_id, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.5::DOUBLE AS width, 0.6::DOUBLE AS height FROM (SELECT DISTINCT page_id FROM v_block)), oth AS (SELECT page_id, 0.3::DOUBLE AS x, 0.3::DOUBLE AS y, 0.4::DOUBLE AS width, 0.4::DOUBLE AS height FROM (SELECT DISTINCT page_id FROM v_block))"
CENTER = "b.x + b.width / 2 BETWEEN {r}.x AND {r}.x + {r}.width AND b.y + b.height / 2 BETWEEN {r}.y AND {r}.y + {r}.height"


def _regions(spark, d, x, y, w, h):
    return view(spark, d, "v_block").select("page_id").distinct().select("page_id", F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("width"), F.lit(h).alias("height"))


@query("geo_region_filter", f"WITH {REG} SELECT b.page_id, b.block_no FROM v_block b JOIN reg r ON r.page_id = b.page_id WHERE b.x >= r.x AND b.y >= r.y AND b.x + b.width <= r.x + r.width AND b.y + b.height <= r.y + r.height")
def geo_region_filter(spark, d):
    return geo.in_region(view(spark, d, "v_block"), _regions(spark, d, 0.0, 0.0, 0.5, 0.6)).select("page_id", "block_no")


@query("geo_region_exclusive", f"WITH {REG} SELECT b.page_id, b.block_no FROM v_block b JOIN reg r ON r.page_id = b.page_id JOIN oth o ON o.page_id = b.page_id WHERE {CENTER.format(r='r')} AND NOT ({CENTER.format(r='o')})")
def geo_region_exclusive(spark, d):
    return geo.region_exclusive(view(spark, d, "v_block"), _regions(spark, d, 0.0, 0.0, 0.5, 0.6), _regions(spark, d, 0.3, 0.3, 0.4, 0.4)).select("page_id", "block_no")


RATIO = "greatest(least(p.x + p.width, q.x + q.width) - greatest(p.x, q.x), 0) * greatest(least(p.y + p.height, q.y + q.height) - greatest(p.y, q.y), 0) / least(p.width * p.height, q.width * q.height)"


@query("geo_overlap_dedupe", f"WITH RECURSIVE e AS (SELECT p.page_id, p.block_no AS a, q.block_no AS b FROM v_block p JOIN v_block q ON p.page_id = q.page_id AND p.text = q.text WHERE {RATIO} >= 0.7), r AS (SELECT page_id, block_no AS a, block_no AS b FROM v_block UNION SELECT r.page_id, r.a, e.b FROM r JOIN e ON e.page_id = r.page_id AND e.a = r.b), g AS (SELECT page_id, a AS block_no, min(b) AS grp FROM r GROUP BY 1, 2) SELECT page_id, grp AS \"group\", count(*) AS n, round(min(x), 9) AS x, round(max(x + width), 9) AS \"right\" FROM g JOIN v_block USING (page_id, block_no) GROUP BY 1, 2")
def geo_overlap_dedupe(spark, d):
    b = view(spark, d, "v_block")
    groups = components.connected(geo.overlap_edges(b, 0.7), b, ["page_id"], "block_no")
    return b.join(groups, ["page_id", "block_no"]).groupBy("page_id", "group").agg(F.count("*").alias("n"), F.round(F.min("x"), 9).alias("x"), F.round(F.max(C("x") + C("width")), 9).alias("right"))


GAP = "round(p.x - q.x - q.width, 9)"


@query("geo_row_label", f"""WITH n AS (SELECT p.page_id, p.block_no, q.block_no AS label_no, {GAP} AS gap, p.x, p.y + p.height / 2 AS mid, q.x + q.width AS edge FROM v_block p JOIN v_block q ON p.page_id = q.page_id WHERE p.block_no % 2 = 0 AND q.block_no % 2 = 1
  AND abs(p.y + p.height / 2 - q.y - q.height / 2) <= greatest(0.003::DOUBLE, least(p.height, q.height) * 0.6::DOUBLE) AND {GAP} BETWEEN -0.005 AND 0.18), r AS (SELECT *, row_number() OVER (PARTITION BY page_id, block_no ORDER BY gap, label_no) AS k FROM n)
  SELECT page_id, block_no, label_no, gap FROM r WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM v_block b WHERE b.page_id = r.page_id AND b.block_no <> r.block_no AND b.x > r.edge + 0.003 AND b.x < r.x - 0.003 AND abs(r.mid - b.y - b.height / 2) < 0.004)""")
def geo_row_label(spark, d):
    b = view(spark, d, "v_block")
    return geo.row_label(b.where("block_no % 2 = 0"), b.where("block_no % 2 = 1"), b)


@query("geo_column_label", "WITH n AS (SELECT p.page_id, p.block_no, q.block_no AS h, q.x, q.y FROM v_block p JOIN v_block q ON p.page_id = q.page_id WHERE p.block_no % 2 = 0 AND q.block_no % 2 = 1 AND least(p.x + p.width, q.x + q.width) - greatest(p.x, q.x) >= 0.5 * least(p.width, q.width) AND q.y < p.y) SELECT page_id, block_no, arg_max(h, (y, h)) AS header_no FROM n GROUP BY 1, 2 HAVING max(x) - min(x) < 0.02")
def geo_column_label(spark, d):
    b = view(spark, d, "v_block")
    return geo.column_label(b.where("block_no % 2 = 0"), b.where("block_no % 2 = 1"))


@query("geo_nearest", "WITH n AS (SELECT p.page_id, p.block_no, q.block_no AS partner_no, round(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), 9) AS distance, q.text AS partner_text FROM v_block p JOIN v_block q ON p.page_id = q.page_id AND p.block_no <> q.block_no AND abs(p.y - q.y) <= 0.1), r AS (SELECT *, row_number() OVER (PARTITION BY page_id, block_no ORDER BY distance, partner_no) AS k FROM n WHERE distance <= 0.24) SELECT page_id, block_no, partner_no, distance, partner_text FROM r WHERE k = 1")
def geo_nearest(spark, d):
    b = view(spark, d, "v_block")
    return geo.nearest(b, b, 0.24, 0.1)


@query("geo_nominal_with_tolerance", f"""WITH b AS (SELECT *, TRY_CAST(text AS DOUBLE) AS value FROM v_dim), n AS (SELECT p.page_id, p.block_no, any_value(p.x) AS x, any_value(p.y) AS y, any_value(p.width) AS width, any_value(p.height) AS height, any_value(p.text) AS text, any_value(p.source) AS source, any_value(p.value) AS value, arg_min(q.value, q.block_no) AS lower
    FROM b p JOIN b q ON p.page_id = q.page_id AND q.value < 0 AND abs(q.x - p.x) < greatest(0.015::DOUBLE, p.width * 0.65::DOUBLE) AND abs(q.y - p.y) < greatest(0.065::DOUBLE, p.height * 2) WHERE p.value > 0 AND (p.height > p.width * 0.8::DOUBLE OR p.reading_angle IN (90, 270)) GROUP BY 1, 2),
  w AS (SELECT * FROM n p WHERE NOT EXISTS (SELECT 1 FROM n q WHERE q.page_id = p.page_id AND q.block_no <> p.block_no AND contains(q.text, '.') AND {RATIO} > 0.7 AND q.width * q.height > p.width * p.height * 1.5::DOUBLE)),
  s AS (SELECT *, bool_or(source = 'pdf_text') OVER (PARTITION BY page_id) AS own FROM w) SELECT page_id, min(block_no) AS block_no, min(value) AS value, arg_min(lower, block_no) AS lower FROM s WHERE NOT own OR source = 'pdf_text' GROUP BY 1 HAVING count(DISTINCT value) = 1""")
def geo_nominal_with_tolerance(spark, d):
    return geo.nominal_with_tolerance(view(spark, d, "v_dim").withColumn("value", F.expr("try_cast(text AS DOUBLE)")))


CLUSTER = "n AS (SELECT page_id, block_no, y, coalesce(y - lag(y) OVER (PARTITION BY page_id ORDER BY y, block_no) > 0.1, false)::BIGINT AS new FROM v_block), c AS (SELECT page_id, block_no, y, sum(new) OVER (PARTITION BY page_id ORDER BY y, block_no ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM n)"


@query("geo_gap_cluster", f"WITH {CLUSTER} SELECT page_id, cluster, count(*) AS n, round(avg(y), 6) AS mean FROM c GROUP BY 1, 2")
def geo_gap_cluster(spark, d):
    return geo.gap_cluster(view(spark, d, "v_block"), "y", 0.1, ["page_id"], ["block_no"]).groupBy("page_id", "cluster").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean"))


@query("geo_glyph_runs", "WITH g AS (SELECT page_id, block_no, y, text, floor(x * 2)::BIGINT AS lane FROM v_block WHERE length(text) = 1), n AS (SELECT *, coalesce(y - lag(y) OVER (PARTITION BY page_id, lane ORDER BY y, block_no) > 0.3, false)::BIGINT AS new FROM g), c AS (SELECT *, sum(new) OVER (PARTITION BY page_id, lane ORDER BY y, block_no ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM n) SELECT page_id, lane, cluster, string_agg(text, '' ORDER BY y, block_no) AS number, count(*) AS n FROM c GROUP BY 1, 2, 3")
def geo_glyph_runs(spark, d):
    return geo.glyph_runs(view(spark, d, "v_block"), F.floor(C("x") * 2), 0.3)


LOADS, HEIGHTS = "'^(load|force|负荷|载荷|力值)( ?\\((n|kn|kgf)\\))?$'", "'^(height|(working|installed) height|高度|工作高度|安装高度)( ?\\((mm|毫米)\\))?$'"


#: Bytes of lineitem's files whose pages are looked through at once: on the way they took thirteen times as much of disk at sf0.1.
PAGES_AT_ONCE = 256 << 20


@query("geo_table_lookup", f"""WITH t AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, x1 - x0 AS w, greatest(1, y1 - y0) AS h, CASE WHEN regexp_full_match(text, '[+-]?[0-9]+(\\.[0-9]+)?') THEN text::DOUBLE END AS number FROM v_sheet),
  n AS (SELECT * FROM t a WHERE number IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t b WHERE b.page_id = a.page_id AND b.number IS NOT NULL AND length(b.text) > length(a.text) AND contains(b.text, a.text) AND b.x0 - a.h * 0.2 <= a.x0 AND b.y0 - a.h * 0.2 <= a.y0 AND b.x1 + a.h * 0.2 >= a.x1 AND b.y1 + a.h * 0.2 >= a.y1)),
  f AS (SELECT p.point_no, coalesce(p.unit, 'N') AS unit, n.* FROM v_force p JOIN n ON n.page_id = p.page_id AND abs(n.number - p.force) <= 1e-7),
  r AS (SELECT a.page_id, a.no AS a, b.* EXCLUDE (page_id), n.no IS NOT NULL AS whole FROM t a JOIN t b ON a.page_id = b.page_id AND abs(a.cy - b.cy) <= greatest(a.h, b.h) * 0.7 LEFT JOIN n ON n.page_id = b.page_id AND n.no = b.no),
  o AS (SELECT hd.page_id, hd.no AS header, l.no, l.text, l.cy, l.h, (coalesce(max(c.cx) FILTER (c.cx < l.cx), l.cx - 2 * greatest(20, l.w)) + l.cx) / 2 AS low, (coalesce(min(c.cx) FILTER (c.cx > l.cx), l.cx + 2 * greatest(20, l.w)) + l.cx) / 2 AS high
    FROM t hd JOIN r l ON l.page_id = hd.page_id AND l.a = hd.no JOIN r c ON c.page_id = hd.page_id AND c.a = hd.no WHERE regexp_matches(lower(hd.text), {LOADS}) GROUP BY hd.page_id, hd.no, l.no, l.text, l.cy, l.h, l.cx, l.w),
  u AS (SELECT o.*, list(lower(trim(t.text, '()'))) AS units FROM o LEFT JOIN t ON t.page_id = o.page_id AND t.cy > o.cy AND t.cy - o.cy < 2 * o.h AND t.cx > o.low AND t.cx < o.high GROUP BY ALL),
  hm AS (SELECT f.page_id, f.point_no, f.no AS f_no, u.header, l.no AS label_no, l.text AS label, min(v.number) AS x, min(v.no) AS cell_no, 0 AS kind
    FROM f JOIN u ON u.page_id = f.page_id AND u.no = u.header AND f.cy > u.cy AND f.cy - u.cy < 12 * u.h AND f.cx > u.low AND f.cx < u.high AND (regexp_matches(u.text, '(?i)(^|[^a-z])' || f.unit || '([^a-z/]|$)') OR list_contains(u.units, lower(f.unit)))
      JOIN u l ON l.page_id = f.page_id AND l.header = u.header AND regexp_matches(lower(l.text), {HEIGHTS}) AND (regexp_matches(lower(l.text), '(^|[^a-z])mm|毫米') OR list_has_any(l.units, ['mm', '毫米']))
      JOIN r v ON v.page_id = f.page_id AND v.a = f.no AND v.whole AND v.number > 0 AND v.cx > l.low AND v.cx < l.high GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(DISTINCT v.number) = 1),
  g AS (SELECT * FROM f WHERE EXISTS (SELECT 1 FROM r WHERE r.page_id = f.page_id AND r.a = f.no AND r.x1 < f.x0 AND regexp_matches(lower(r.text), '\\b(load|force)\\b|负荷|载荷|力值')) AND EXISTS (SELECT 1 FROM r WHERE r.page_id = f.page_id AND r.a = f.no AND regexp_matches(r.text, '(^|[^A-Za-z])' || f.unit || '([^A-Za-z/]|$)'))),
  k AS (SELECT g.page_id, g.point_no, g.no AS f_no, l.no AS label_no, l.text AS label, abs(l.cy - g.cy) AS away, g.h, min(v.number) AS x, min(v.no) AS cell_no
    FROM g JOIN t l ON l.page_id = g.page_id AND regexp_full_match(lower(l.text), '((installed |working |test )?height|高度|安装高度|工作高度|测试高度)') AND abs(l.cy - g.cy) <= 2.5 * greatest(g.h, l.h) AND l.x0 < g.x0
      JOIN r v ON v.page_id = g.page_id AND v.a = l.no AND v.whole AND v.number > 0 AND v.x0 > l.x1 AND abs(v.cx - g.cx) < greatest(v.w, g.w)
    WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.page_id = g.page_id AND lower(b.text) IN ('load', 'force', '载荷', '负荷', '力值') AND b.cy > least(l.cy, g.cy) + 0.7 * greatest(l.h, g.h) AND b.cy < greatest(l.cy, g.cy) - 0.7 * greatest(l.h, g.h))
      AND EXISTS (SELECT 1 FROM r WHERE r.page_id = l.page_id AND r.a = l.no AND regexp_matches(lower(r.text), '\\bmm\\b|毫米')) GROUP BY 1, 2, 3, 4, 5, 6, 7 HAVING count(DISTINCT v.number) = 1),
  b AS (SELECT *, row_number() OVER (PARTITION BY page_id, point_no, f_no ORDER BY away, label_no) AS i FROM k),
  vm AS (SELECT page_id, point_no, f_no, -1 AS header, label_no, label, x, cell_no, 1 AS kind FROM b WHERE i = 1 AND NOT EXISTS (SELECT 1 FROM k WHERE k.page_id = b.page_id AND k.point_no = b.point_no AND k.f_no = b.f_no AND k.x <> b.x AND abs(k.away - b.away) < b.h * 0.5)),
  m AS (SELECT page_id, point_no, count(DISTINCT x) AS n, arg_min({{'x': x, 'f': f_no, 'c': cell_no, 'l': label}}, (kind, f_no, header, label_no)) AS s FROM (FROM hm UNION ALL BY NAME FROM vm) GROUP BY 1, 2)
  SELECT p.page_id, p.point_no, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'found' ELSE 'conflict' END AS state, CASE WHEN n = 1 THEN s.x END AS value, CASE WHEN n = 1 THEN s.f END AS force_no, CASE WHEN n = 1 THEN s.c END AS cell_no, CASE WHEN n = 1 THEN s.l END AS label FROM v_force p LEFT JOIN m ON m.page_id = p.page_id AND m.point_no = p.point_no""")
def geo_table_lookup(spark, d):
    def heights(lines):
        lines = durable(lines)  # read by thirteen branches
        return sheets.table_height(view(spark, d, "v_force", v_sheetrow=lines), view(spark, d, "v_sheet", v_sheetrow=lines))

    shares = max(1, -(-stored_bytes(spark, f"{d}/lineitem.parquet") // PAGES_AT_ONCE))
    return in_shares(view(spark, d, "v_sheetrow"), "page_id", shares, heights)


@query("geo_layout_hint", "WITH r AS (SELECT page_id, text, count(DISTINCT round(x, 2)) AS p FROM v_block GROUP BY 1, 2) SELECT page_id, max(p) AS places, max(p) >= 3 AS multi FROM r GROUP BY 1")
def geo_layout_hint(spark, d):
    return geo.layout_hint(view(spark, d, "v_block"))


@query("geo_row_regions", "WITH a AS (SELECT DISTINCT page_id, y FROM v_block WHERE block_no % 3 = 1), b AS (SELECT page_id, y, coalesce((lag(y) OVER w + y) / 2, -1e9) AS top, coalesce((lead(y) OVER w + y) / 2, 1e9) AS bottom FROM a WINDOW w AS (PARTITION BY page_id ORDER BY y)) SELECT b.page_id, b.y, count(*) AS n, round(min(v.x), 9) AS \"left\", round(max(v.x + v.width), 9) AS \"right\" FROM b JOIN v_block v ON v.page_id = b.page_id AND v.y >= top AND v.y < bottom GROUP BY 1, 2")
def geo_row_regions(spark, d):
    b = view(spark, d, "v_block")
    return geo.row_regions(b.where("block_no % 3 = 1"), b)


LOC = "j AS (SELECT c.review_id AS page_id, c.field, b.block_no, CASE WHEN c.page = 1 THEN 8 WHEN b.y < 0.5 THEN 7 ELSE 2 END AS score FROM (SELECT DISTINCT review_id, field, page, CAST(CAST(FLOOR(value) AS INT) AS VARCHAR) AS text FROM v_cand) c JOIN v_block b ON b.page_id = c.review_id AND b.text = c.text), m AS (SELECT page_id, field, max(score) AS best FROM j GROUP BY 1, 2)"


@query("geo_locate_field", f"WITH {LOC}, r AS (SELECT j.page_id, j.field, best, count(*) AS n, min(block_no) AS b FROM j JOIN m ON m.page_id = j.page_id AND m.field = j.field AND j.score = m.best GROUP BY 1, 2, 3) SELECT page_id, field, best, CASE WHEN n = 1 THEN b END AS block_no, CASE WHEN n = 1 THEN 'located' ELSE 'ambiguous' END AS state FROM r")
def geo_locate_field(spark, d):
    c = view(spark, d, "v_cand").select(C("review_id").alias("page_id"), "field", "page", F.floor("value").cast("string").alias("text")).distinct()
    scored = c.join(view(spark, d, "v_block"), ["page_id", "text"]).withColumn("score", F.when(C("page") == 1, 8).when(C("y") < 0.5, 7).otherwise(2))
    return geo.locate_field(scored, ["page_id", "field"])


@query("geo_support_value", "WITH n AS (SELECT p.page_id, p.block_no, p.text, count(DISTINCT q.text) AS n, min(q.text) AS only_text FROM v_block p JOIN v_block q ON p.page_id = q.page_id AND p.block_no <> q.block_no AND abs(p.x - q.x) <= 0.1 AND abs(p.y - q.y) <= 0.1 GROUP BY 1, 2, 3) SELECT page_id, block_no, CASE WHEN n = 1 AND only_text = text THEN 'supported' WHEN n = 1 THEN 'contradicted' ELSE 'ambiguous' END AS state FROM n")
def geo_support_value(spark, d):
    b = view(spark, d, "v_block")
    return geo.support_value(b, b, 0.1)


@query("geo_annotation_merge", "WITH o AS (SELECT page_id, block_no, x + 0.01 AS x, y FROM v_block WHERE block_no % 3 > 0), b AS (SELECT p.page_id, p.block_no, o.block_no AS old_no, round(abs(p.x - o.x) + abs(p.y - o.y), 9) AS d FROM v_block p JOIN o ON o.page_id = p.page_id), r AS (SELECT *, row_number() OVER (PARTITION BY page_id, block_no ORDER BY d, old_no) AS f, row_number() OVER (PARTITION BY page_id, old_no ORDER BY d, block_no) AS g FROM b WHERE d <= 0.05) SELECT v.page_id, v.block_no, r.old_no, CASE WHEN r.old_no IS NULL THEN 'new' ELSE 'kept' END AS state FROM v_block v LEFT JOIN r ON r.page_id = v.page_id AND r.block_no = v.block_no AND f = 1 AND g = 1")
def geo_annotation_merge(spark, d):
    b = view(spark, d, "v_block").select("page_id", "block_no", "x", "y")
    return geo.annotation_merge(b.where("block_no % 3 > 0").withColumn("x", C("x") + 0.01), b, 0.05)


@query("geo_apply_patch", "WITH p AS (SELECT page_id, block_no + CASE WHEN block_no % 5 = 0 THEN 1000 ELSE 0 END AS block_no, x * 1.5 AS new_x FROM v_block WHERE block_no % 2 = 0 UNION ALL SELECT page_id, block_no, x FROM v_block WHERE block_no % 4 = 0), n AS (SELECT page_id, block_no, count(*) AS e, min(new_x) AS new_x FROM p GROUP BY 1, 2), r AS (SELECT n.page_id, n.block_no, b.x, new_x, CASE WHEN b.x IS NULL THEN 'unknown' WHEN e > 1 THEN 'repeated' WHEN new_x NOT BETWEEN 0 AND 1 THEN 'range' ELSE 'ok' END AS reason FROM n LEFT JOIN v_block b ON b.page_id = n.page_id AND b.block_no = n.block_no) SELECT page_id, block_no, reason, CASE WHEN reason = 'ok' THEN new_x ELSE x END AS x FROM r")
def geo_apply_patch(spark, d):
    b = view(spark, d, "v_block").select("page_id", "block_no", "x")
    one = b.where("block_no % 2 = 0").select("page_id", (C("block_no") + F.when(C("block_no") % 5 == 0, 1000).otherwise(0)).alias("block_no"), (C("x") * 1.5).alias("new_x"))
    return geo.apply_patch(b, one.union(b.where("block_no % 4 = 0").select("page_id", "block_no", "x")))


@query("geo_localization_diagnostics", f"WITH {LOC}, f AS (SELECT DISTINCT review_id AS page_id, field FROM v_cand) SELECT f.page_id, f.field, CASE WHEN m.best IS NULL THEN 'unlocated' WHEN m.best < 7 THEN 'weak' ELSE 'ok' END AS state FROM f LEFT JOIN m ON m.page_id = f.page_id AND m.field = f.field")
def geo_localization_diagnostics(spark, d):
    f = view(spark, d, "v_cand").select(C("review_id").alias("page_id"), "field").distinct()
    return f.join(geo_locate_field(spark, d).select("page_id", "field", "best"), ["page_id", "field"], "left").select("page_id", "field", F.when(C("best").isNull(), "unlocated").when(C("best") < 7, "weak").otherwise("ok").alias("state"))


RUNS = r"regexp_extract_all(lower(text), '[a-z0-9_.+\-]+|[\x{4e00}-\x{9fff}]{2,}')"
TOK = rf"list_concat({RUNS}, flatten(list_transform(list_filter({RUNS}, lambda t: length(t) > 4 AND regexp_full_match(t, '[\x{{4e00}}-\x{{9fff}}]+')), lambda t: list_transform(range(1, length(t)), lambda i: substr(t, i, 2)))))"


@query("srch_token_index", f"WITH t AS (SELECT doc_id, unnest({TOK}) AS token FROM documents), p AS (SELECT token, doc_id, count(*) AS n FROM t GROUP BY 1, 2), f AS (SELECT token, count(*) AS n_chunks FROM p GROUP BY 1) SELECT * FROM p JOIN f USING (token)")
def srch_token_index(spark, d):
    return search.postings(table(spark, d, "documents"), "doc_id", "text")


TOP = f"q AS (SELECT item_id, token, count(*) AS r FROM (SELECT item_id, unnest({TOK}) AS token FROM benchmark) GROUP BY 1, 2), c AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest({TOK}) AS token FROM documents)), s AS (SELECT item_id, doc_id, 8.0::DOUBLE + sum(r) AS score FROM c JOIN q USING (token) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)"


@query("srch_score_topk", f"WITH {TOP} SELECT * FROM k WHERE rank <= 10")
def srch_score_topk(spark, d):
    return search.score_topk(table(spark, d, "benchmark"), table(spark, d, "documents"), 10, "item_id", "doc_id")


VEC = "v AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS s FROM embeddings e JOIN embeddings q ON e.label = q.label AND e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM v WHERE s >= 0.1)"


@query("srch_vector_topk", f"WITH {VEC} SELECT query_id, vec_id, rank, round(s * 0.3, 6) AS score FROM w WHERE rank <= 30")
def srch_vector_topk(spark, d):
    v = table(spark, d, "embeddings")
    return search.vector_topk(v.where("vec_id % 50 = 0"), v, 30, "label")


@query("srch_fallback", f"WITH {TOP}, p AS (SELECT * FROM k WHERE rank <= 3 AND score >= 20), sec AS (SELECT item_id, min(doc_id) AS doc_id FROM k GROUP BY 1) SELECT item_id, doc_id, 'primary' AS origin FROM p UNION ALL SELECT item_id, doc_id, 'fallback' FROM sec WHERE item_id NOT IN (SELECT item_id FROM p)")
def srch_fallback(spark, d):
    queries, chunks = table(spark, d, "benchmark"), table(spark, d, "documents")
    top = search.score_topk(queries, chunks, 3, "item_id", "doc_id").where("score >= 20").select("item_id", "doc_id")
    return search.fallback(top, search.first_match(queries, chunks, "item_id", "doc_id"), "item_id")


@query("srch_attach_refs", f"WITH {TOP} SELECT item_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS refs FROM k WHERE rank <= 5 GROUP BY 1")
def srch_attach_refs(spark, d):
    top = search.score_topk(table(spark, d, "benchmark"), table(spark, d, "documents"), 5, "item_id", "doc_id")
    return top.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("r")).select("item_id", F.array_join(F.transform("r.doc_id", lambda x: x.cast("string")), ",").alias("refs"))
