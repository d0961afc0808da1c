"""Registration of queries, and the stand-in views over the driver's tables that they and their DuckDB twins read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SEQ = "ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"

#: Views in SQL that Spark and DuckDB both take.
VIEWS = {
    "v_cand": f"""SELECT l_orderkey AS review_id, CAST({SEQ} AS BIGINT) AS seq,
        CASE l_linenumber % 4 WHEN 0 THEN 'wire_diameter' WHEN 1 THEN 'outer_diameter' WHEN 2 THEN 'free_length' ELSE 'total_coils' END AS field,
        CASE l_suppkey % 5 WHEN 0 THEN 'manual' WHEN 1 THEN 'vision_model' WHEN 2 THEN 'page_ocr' WHEN 3 THEN 'reader_service' ELSE 'inference' END AS source,
        l_quantity AS value, 0.5 + 4 * l_discount AS confidence, CASE WHEN l_returnflag = 'A' THEN l_tax END AS tol_upper,
        CASE WHEN l_returnflag = 'A' THEN 0 - l_tax END AS tol_lower, CAST(1 + l_suppkey % 2 AS BIGINT) AS page FROM lineitem""",
    "v_point": f"""SELECT l.l_orderkey AS review_id, CAST({SEQ} AS BIGINT) AS seq, CONCAT('F', CAST(l.l_linenumber AS VARCHAR(9))) AS label,
        100 - l.l_quantity AS height, 'mm' AS height_unit, l.l_extendedprice / 1000 AS force,
        CASE l.l_suppkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'kN' ELSE 'kgf' END AS force_unit, l.l_returnflag AS test_type,
        CAST(60 + o.o_orderkey % 60 AS DOUBLE) AS free_length, CASE WHEN l.l_linestatus = 'O' THEN l.l_tax * 10 END AS force_tol, CAST(1 + l.l_suppkey % 2 AS BIGINT) AS page
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "v_param": """SELECT p_partkey AS review_id, CAST(p_size AS DOUBLE) / 10 AS wire_diameter, p_retailprice / 50 AS outer_diameter,
        CAST(20 + p_partkey % 80 AS DOUBLE) AS free_length, CAST(3 + p_partkey % 60 AS DOUBLE) AS total_coils, CAST(1 + p_partkey % 3 AS INT) AS grade,
        CAST((p_partkey * 7) % 100 AS DOUBLE) / 100 AS tol_upper, 0 - CAST((p_partkey * 11) % 100 AS DOUBLE) / 100 AS tol_lower,
        CASE WHEN p_type IN ('SMALL', 'PROMO') THEN 'ground' WHEN p_type = 'LARGE' THEN 'not_ground' END AS end_mode, p_name AS material_raw FROM part""",
    "v_band": """SELECT CAST(c_min AS DOUBLE) AS c_min, CAST(c_max AS DOUBLE) AS c_max, include_min, grade, CAST(factor AS DOUBLE) AS factor, CAST(minimum AS DOUBLE) AS minimum FROM (VALUES
        (3, 8, true, 1, 0.01, 0.15), (3, 8, true, 2, 0.015, 0.2), (3, 8, true, 3, 0.025, 0.4), (8, 15, false, 1, 0.015, 0.2), (8, 15, false, 2, 0.02, 0.3),
        (8, 15, false, 3, 0.03, 0.5), (15, 22, false, 1, 0.02, 0.3), (15, 22, false, 2, 0.03, 0.5), (15, 22, false, 3, 0.04, 0.7)) AS b(c_min, c_max, include_min, grade, factor, minimum)""",
    "v_dict": """SELECT * FROM (VALUES (1, 'RING-RED', 'red ring'), (2, 'GEAR-HOT', 'hot gear'), (3, 'BOLT-COLD', 'cold-bolt'),
        (4, 'ANVIL-OLD', 'OLD ANVIL'), (5, 'RING', 'ring'), (6, 'PLATE', 'plate')) AS d(id, term, alias)""",
    "v_note": """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS line_no, l_partkey, l_suppkey,
        CONCAT('H', CAST(l_linenumber AS VARCHAR(9)), '=', CAST(CAST(FLOOR(100 - l_quantity) AS INT) AS VARCHAR(9)), 'mm F', CAST(l_linenumber AS VARCHAR(9)), '=',
        CAST(CAST(FLOOR(l_extendedprice) AS INT) AS VARCHAR(9)), CASE WHEN l_returnflag = 'A' THEN 'N+/-10%' WHEN l_returnflag = 'R' THEN 'kN' ELSE 'N' END,
        CASE l_partkey % 6 WHEN 0 THEN '; no Ra 3.2 on inner face' WHEN 1 THEN '; surface Ra 1.6 required' WHEN 2 THEN '; material RING or PLATE allowed, BOLT not allowed'
          WHEN 3 THEN '; salt spray 48 h; wire 2.5 +/-0.1; outer 20 0/-0.3' WHEN 4 THEN '; both ends 1.5 coils each, temper 260 C; HRC 45' ELSE '; std GB/T 1239 cold coiled' END) AS text FROM lineitem""",
    "v_rough": """SELECT doc_id, line_no, l_partkey, l_suppkey, CONCAT(text, CASE l_suppkey % 4 WHEN 0 THEN ' bore Ra 0.8 and Ra 6.3 outer face' WHEN 1 THEN ', about Ra 12.5' ELSE '' END) AS text FROM v_note""",
    "v_label": """SELECT doc_id, line_no, l_partkey, l_suppkey, CONCAT(text, CASE l_suppkey % 32 WHEN 0 THEN '; WIRE DIA: φ2.5' WHEN 1 THEN '; OD 20' WHEN 2 THEN '; I.D. 12.25' WHEN 3 THEN '; 平均径：16' WHEN 4 THEN '; Free Length 42.5' WHEN 5 THEN '; BODY LENGTH 40' WHEN 6 THEN '; 压并高度 21' WHEN 7 THEN '; 总圈数: 9.5' WHEN 8 THEN '; ACTIVE COILS 7.5' WHEN 9 THEN '; 端圈数 2' WHEN 10 THEN '; support coils 1' WHEN 11 THEN '; PITCH 4.2' WHEN 12 THEN '; 弹簧刚度 12.5 N/mm' WHEN 13 THEN '; 垂直度 0.8' WHEN 14 THEN '; straightness 0.5' WHEN 15 THEN '; 永久变形 ≤ 0.3' WHEN 16 THEN '; ARM LENGTH 33' WHEN 17 THEN '; 自由角 90' WHEN 18 THEN '; WORKING ANGLE 45' WHEN 19 THEN '; OPENING 3' WHEN 20 THEN '; 缺口宽 2.5' WHEN 21 THEN '; 板厚 1.2' WHEN 22 THEN '; GB/T 1239.2-2009 cold wound' WHEN 23 THEN '; GBT 23934-2015' WHEN 24 THEN '; 圆柱螺旋 外径受控 内径控制' WHEN 25 THEN '; conical, hot formed' WHEN 26 THEN '; barrel 内径 受控' WHEN 27 THEN '; rectangular section 变节距' WHEN 28 THEN '; 精度等级：2级' WHEN 29 THEN '; 外径精度 T级 自由高度等级 1' WHEN 30 THEN '; 负荷精度等级 3 刚度等级 2' ELSE '' END) AS text FROM v_note""",
    "v_block": f"""SELECT l_orderkey AS page_id, CAST({SEQ} AS BIGINT) AS block_no, l_discount * 9 AS x, l_tax * 11 AS y, 0.02 + l_quantity / 1000 AS width,
        CAST(0.03 AS DOUBLE) AS height, CAST(CAST(FLOOR(l_quantity) AS INT) AS VARCHAR(9)) AS text FROM lineitem""",
    "v_dim": f"""SELECT l_orderkey AS page_id, CAST({SEQ} AS BIGINT) AS block_no, 0.1 + (l_partkey % 3) * 0.2 + (l_suppkey % 3) * 0.004 + CAST(0 AS DOUBLE) AS x, 0.1 + (l_suppkey % 4) * 0.03 + CAST(0 AS DOUBLE) AS y, CAST(CASE WHEN l_partkey % 5 = 0 THEN 0.01 ELSE 0.03 END AS DOUBLE) AS width,
        CAST(CASE WHEN l_partkey % 5 = 0 THEN 0.009 ELSE 0.03 END AS DOUBLE) AS height, CASE l_suppkey % 5 WHEN 0 THEN '-0.2' WHEN 1 THEN '-0.35' WHEN 2 THEN '12.5' WHEN 3 THEN 'Ra 12' ELSE CAST(l_linenumber AS VARCHAR(9)) END AS text,
        CASE WHEN l_returnflag = 'A' THEN 'pdf_text' ELSE 'ocr' END AS source, CASE WHEN l_suppkey % 7 = 0 THEN 90 ELSE 0 END AS reading_angle FROM lineitem""",
    "v_sheet": f"""SELECT page_id, no, text, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x0 + w AS DOUBLE) AS x1, CAST(y0 + h AS DOUBLE) AS y1 FROM (
        SELECT page_id, k * 10 + 1 AS no, CAST(q AS VARCHAR(9)) AS text, CASE WHEN page_id % 2 = 0 THEN 110 ELSE 100 + 50 * k END AS x0, CASE WHEN page_id % 2 = 0 THEN 20 + 22 * k ELSE 20 END AS y0, 30 AS w, 10 AS h FROM v_sheetrow
        UNION ALL SELECT page_id, k * 10 + 2, CONCAT(CAST(20 + p % 60 AS VARCHAR(9)), CASE WHEN s % 3 = 0 THEN '.5' ELSE '' END), CASE WHEN page_id % 2 = 0 THEN 215 ELSE 100 + 50 * k END + CASE WHEN p % 11 = 0 THEN 60 ELSE 0 END, CASE WHEN page_id % 2 = 0 THEN 20 + 22 * k ELSE 40 END, 30, 10 FROM v_sheetrow
        UNION ALL SELECT page_id, k * 10 + 3, SUBSTR(CAST(20 + p % 60 AS VARCHAR(9)), 1, 1), CASE WHEN page_id % 2 = 0 THEN 216 ELSE 101 + 50 * k END, CASE WHEN page_id % 2 = 0 THEN 21 + 22 * k ELSE 41 END, 8, 8 FROM v_sheetrow WHERE p % 4 = 0
        UNION ALL SELECT page_id, k * 10 + 4, '77', 100 + 50 * k, 0, 30, 10 FROM v_sheetrow WHERE page_id % 14 = 7
        UNION ALL SELECT page_id, 1, CASE page_id % 3 WHEN 0 THEN 'Load (N)' WHEN 1 THEN '负荷' ELSE 'FORCE' END, CASE WHEN page_id % 2 = 0 THEN 100 ELSE 10 END, CASE WHEN page_id % 2 = 0 THEN 10 ELSE 20 END, 50, 10 FROM v_sheetrow WHERE k = 1
        UNION ALL SELECT page_id, 2, CASE WHEN page_id % 8 = 0 THEN 'kN' WHEN page_id % 2 = 0 THEN '(N)' ELSE 'N' END, CASE WHEN page_id % 2 = 0 THEN 115 ELSE 62 END, CASE WHEN page_id % 2 = 0 THEN 23 ELSE 21 END, 10, 8 FROM v_sheetrow WHERE k = 1 AND page_id % 9 <> 4
        UNION ALL SELECT page_id, 3, CASE page_id % 5 WHEN 0 THEN '高度' WHEN 1 THEN 'working height' ELSE 'Height' END, CASE WHEN page_id % 2 = 0 THEN 200 ELSE 10 END, CASE WHEN page_id % 2 = 0 THEN 10 ELSE 40 END, 60, 10 FROM v_sheetrow WHERE k = 1
        UNION ALL SELECT page_id, 4, CASE WHEN page_id % 6 = 5 THEN 'in' WHEN page_id % 4 = 2 THEN '(mm)' ELSE 'mm' END, CASE WHEN page_id % 2 = 0 THEN 220 ELSE 75 END, CASE WHEN page_id % 2 = 0 THEN 23 ELSE 41 END, 20, 8 FROM v_sheetrow WHERE k = 1
        UNION ALL SELECT page_id, 5, 'No.', 20, 10, 30, 10 FROM v_sheetrow WHERE k = 1 AND page_id % 2 = 0
        UNION ALL SELECT page_id, 6, 'Test height', 10, 0, 60, 10 FROM v_sheetrow WHERE k = 1 AND page_id % 14 = 7
        UNION ALL SELECT page_id, 7, 'mm', 75, 0, 20, 10 FROM v_sheetrow WHERE k = 1 AND page_id % 14 = 7
        UNION ALL SELECT page_id, 8, 'Force', 10, 33, 40, 4 FROM v_sheetrow WHERE k = 1 AND page_id % 22 = 11) AS t""",
    "v_sheetrow": f"""SELECT l_orderkey AS page_id, CAST({SEQ} AS BIGINT) AS k, CAST(FLOOR(l_quantity) AS INT) AS q, l_partkey AS p, l_suppkey AS s FROM lineitem""",
    "v_force": """SELECT page_id, k AS point_no, CAST(q AS DOUBLE) AS force, CASE s % 5 WHEN 0 THEN 'kN' WHEN 1 THEN NULL ELSE 'N' END AS unit FROM v_sheetrow""",
    "v_patch": """SELECT review_id, CAST(1 AS BIGINT) AS seq, 'wire_diameter' AS field, wire_diameter + 0.5 AS number, CAST(NULL AS VARCHAR(9)) AS word FROM v_param WHERE review_id % 4 = 0
        UNION ALL SELECT review_id, CAST(2 AS BIGINT), 'wire_diameter', wire_diameter + 1.5, NULL FROM v_param WHERE review_id % 8 = 0
        UNION ALL SELECT review_id, CAST(3 AS BIGINT), 'free_length', 25 + CAST(0 AS DOUBLE), NULL FROM v_param WHERE review_id % 5 = 0
        UNION ALL SELECT review_id, CAST(4 AS BIGINT), 'outer_diameter', outer_diameter * 1.5, NULL FROM v_param WHERE review_id % 7 = 0
        UNION ALL SELECT review_id, CAST(5 AS BIGINT), 'inner_diameter', 0 - 1 + CAST(0 AS DOUBLE), NULL FROM v_param WHERE review_id % 23 = 0
        UNION ALL SELECT review_id, CAST(6 AS BIGINT), 'end_mode', NULL, 'ground' FROM v_param WHERE review_id % 6 = 1
        UNION ALL SELECT review_id, CAST(7 AS BIGINT), 'total_coils', total_coils + 40, NULL FROM v_param WHERE review_id % 11 = 0
        UNION ALL SELECT review_id, CAST(8 AS BIGINT), 'colour', 1 + CAST(0 AS DOUBLE), NULL FROM v_param WHERE review_id % 13 = 0
        UNION ALL SELECT review_id, CAST(9 AS BIGINT), 'free_length', NULL, NULL FROM v_param WHERE review_id % 17 = 0
        UNION ALL SELECT review_id, CAST(10 AS BIGINT), 'wire_upper', 0.3 + CAST(0 AS DOUBLE), NULL FROM v_param WHERE review_id % 19 = 0
        UNION ALL SELECT review_id, CAST(11 AS BIGINT), 'mean_diameter', outer_diameter / 2, NULL FROM v_param WHERE review_id % 29 = 0""",
    "v_mark": f"""SELECT l_orderkey AS page_id, CAST({SEQ} AS BIGINT) AS mark_no, CASE l_suppkey % 4 WHEN 0 THEN 1.6 WHEN 1 THEN -1 ELSE 3.2 END + CAST(0 AS DOUBLE) AS value, CASE WHEN l_suppkey % 9 = 0 THEN 'nm' ELSE 'um' END AS unit, CASE WHEN l_returnflag = 'A' THEN 'unverified' ELSE 'direct' END AS status,
        CASE WHEN l_suppkey % 3 = 0 THEN ' face' ELSE 'Ra' END AS evidence, CONCAT('s', CAST(l_suppkey % 3 AS VARCHAR(9))) AS source, CASE l_partkey % 6 WHEN 0 THEN '左端面' WHEN 1 THEN '右端面' WHEN 2 THEN '外圆' END AS place, 0.1 + (l_partkey % 4) * 0.01 + CAST(0 AS DOUBLE) AS x, CAST(0.1 AS DOUBLE) AS y, CAST(0.03 AS DOUBLE) AS width, CAST(0.02 AS DOUBLE) AS height FROM lineitem""",
    "v_review": """SELECT o_orderkey AS job_id, o_custkey AS owner_id, o_orderdate AS updated_at, CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'need_review' ELSE 'fail' END AS status FROM orders""",
    "v_event": """SELECT event_id, ts, user_id AS job_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'generating_3d' WHEN 'click' THEN 'generating_2d'
        WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, value, props FROM events""",
    "v_job": """SELECT event_id, ts, job_id, status, value, props FROM (SELECT e.*, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS newest FROM v_event e) AS n WHERE newest = 1""",
    "v_snap": """SELECT o_orderkey AS id, o_totalprice AS before_value, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS after_value FROM orders""",
    "v_coil": """SELECT review_id, wire_diameter, outer_diameter, free_length, total_coils, grade, tol_upper, tol_lower, end_mode, material_raw,
        CASE WHEN review_id % 31 = 0 THEN 'extension_spring' WHEN review_id % 37 = 0 THEN 'torsion_spring' WHEN review_id % 41 = 0 THEN 'wave_spring' ELSE 'compression_spring' END AS spring_type,
        CASE WHEN review_id % 13 = 0 THEN NULL WHEN review_id % 4 = 0 THEN 'open' ELSE 'closed' END AS end_type,
        CASE review_id % 7 WHEN 0 THEN 0.75 WHEN 1 THEN 1 WHEN 2 THEN 1.25 WHEN 3 THEN 0.9 WHEN 4 THEN -1 WHEN 5 THEN 1 END + CAST(0 AS DOUBLE) AS support_coils,
        CASE WHEN review_id % 10 = 5 THEN total_coils - 2 WHEN review_id % 25 = 1 THEN total_coils + 1 WHEN review_id % 25 = 8 THEN total_coils END AS drawn_active, review_id % 29 = 0 AS uneven FROM v_param""",
    "v_state": """SELECT o_orderkey AS id, CONCAT('{"type":"c","features":{"ends":"closed","n":', CAST(o_custkey AS VARCHAR(19)), '},"points":[{"label":"F1","force":', CAST(o_custkey % 50 AS VARCHAR(19)), ',"page":1},{"label":"F2","tags":[]}],"updated_at":"x"}') AS before_doc,
        CONCAT('{"points":[{"page":2,"force":', CAST(o_custkey % 50 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR(19)), ',"label":"F1","confidence":0.5},{"tags":[],"label":"F2"}],"features":{"source":["m"],"n":', CAST(o_custkey AS VARCHAR(19)), ',"ends":"closed"},"type":"c"}') AS after_doc FROM orders""",
    "v_tmpl": """SELECT * FROM (VALUES ('t/a', 1, 1, true, 'compression_spring'), ('t/b', 1, 1, true, 'compression_spring'), ('t/b', 2, 1, true, 'compression_spring'), ('t/c', 1, 2, true, 'compression_spring'),
        ('t/d', 1, 2, true, 'compression_spring'), ('t/e', 1, 9, false, 'compression_spring'), ('t/f', 1, 0, true, 'extension_spring'), ('t/g', 1, 3, true, 'torsion_spring'), ('t/h', 1, 2, true, 'compression_spring'))
        AS t(code, version, priority, enabled, drawing_type)""",
    "v_cond": """SELECT code, version, kind, field, word, CAST(number AS DOUBLE) AS number, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high FROM (VALUES
        ('t/a', 1, 'range', 'wire_diameter', NULL, NULL, 0.1, 2), ('t/b', 1, 'range', 'wire_diameter', NULL, NULL, 1, 3), ('t/b', 2, 'range', 'wire_diameter', NULL, NULL, 2, 5),
        ('t/b', 2, 'in', 'end_mode', 'ground', NULL, NULL, NULL), ('t/b', 2, 'in', 'end_mode', 'not_ground', NULL, NULL, NULL), ('t/c', 1, 'in', 'end_mode', 'ground', NULL, NULL, NULL),
        ('t/c', 1, 'range', 'free_length', NULL, NULL, 30, 60), ('t/c', 1, 'range', 'total_coils', NULL, NULL, 5, 30), ('t/c', 1, 'required', 'drawn_active', NULL, NULL, NULL, NULL),
        ('t/d', 1, 'in', 'total_coils', NULL, 7, NULL, NULL), ('t/d', 1, 'in', 'total_coils', NULL, 9, NULL, NULL), ('t/d', 1, 'in', 'total_coils', NULL, 12, NULL, NULL), ('t/e', 1, 'range', 'wire_diameter', NULL, NULL, 0, 99),
        ('t/g', 1, 'required', 'end_mode', NULL, NULL, NULL, NULL), ('t/h', 1, 'range', 'free_length', NULL, NULL, NULL, 90), ('t/h', 1, 'required', 'wire_diameter', NULL, NULL, NULL, NULL))
        AS c(code, version, kind, field, word, number, low, high)""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a table's files, by the file system that holds them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


#: Bytes of a table's files that one task takes of it: some 140,000 rows of lineitem, 20,000 of part (with four items each), 120,000 of events.
SHARE = {"lineitem": 2_500_000, "part": 180_000, "events": 2_500_000}


def tasks(spark: SparkSession, sf_dir: str, name: str) -> int:
    """As many tasks as the size of a table asks for."""
    return max(1, -(-stored_bytes(spark, f"{sf_dir}/{name}.parquet") // SHARE[name]))


def dealt(rows: DataFrame, spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """rows dealt by keys over as many tasks as the size of the table they come from asks for; as they are where the session's own number is
    enough. Windows, groups and joins by these keys take it over, so what a task sorts doesn't grow with the table."""
    n = tasks(spark, sf_dir, name)
    return rows.repartition(n, *keys) if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A stand-in view as a DataFrame; views that it reads may be given."""
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", text)}
    if "PARTITION BY l_orderkey" in text:
        used["lineitem"] = dealt(used["lineitem"], spark, sf_dir, "lineitem", "l_orderkey")
    used |= {v: given[v] if v in given else view(spark, sf_dir, v) for v in VIEWS if re.search(rf"\bFROM {v}\b", text)}
    for name_ in used:
        text = re.sub(rf"\b(FROM|JOIN) {name_}\b", rf"\1 {{{name_}}}", text)
    return spark.sql(text, **used)


def with_views(sql: str) -> str:
    """DuckDB SQL with the stand-in views that it names put before it."""
    need: list[str] = []

    def add(text: str) -> None:
        for v in VIEWS:
            if re.search(rf"\b{v}\b", text) and v not in need:
                add(VIEWS[v])
                need.append(v)

    add(sql)
    body = sql.strip()
    recursive = " RECURSIVE" if body.upper().startswith("WITH RECURSIVE") else ""
    rest = re.sub(r"(?is)^WITH(\s+RECURSIVE)?\s", "", body) if body.upper().startswith("WITH") else None
    if not need:
        return body
    head = f"WITH{recursive} " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in need)
    return f"{head}, {rest}" if rest is not None else f"{head} {body}"


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame under its SURVEY key, with its DuckDB twin."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return add
