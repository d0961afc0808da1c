"""Queries of sections 2.1, 2.14 and 2.15: sources, sinks, streams, plug-ins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from factforge.operators import fuse
from factforge.plans.base import query, table, view
from factforge.plans.base import tasks as share
from factforge.plans.fusion import SCORED
from factforge.sources import tables
from factforge.streaming import events

C = F.col
CAND = ["review_id", "seq", "field", "source", "value", "confidence"]


@query("src_candidate_json", "SELECT review_id, seq, field, source, value, confidence FROM v_cand")
def src_candidate_json(spark, d):
    path = tables.scratch(spark, "candidates")
    tables.write_payloads(view(spark, d, "v_cand").select(*CAND), path)
    return tables.read_candidates(spark, path)


@query("src_text_blocks", "SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents")
def src_text_blocks(spark, d):
    return tables.text_blocks(table(spark, d, "documents"), "doc_id", "text")


@query("src_recognizer_payload", "SELECT review_id, field, max(value) AS value, NULL::VARCHAR AS label FROM v_cand GROUP BY 1, 2 UNION ALL SELECT review_id, 'load_point', height, label FROM v_point")
def src_recognizer_payload(spark, d):
    best = view(spark, d, "v_cand").groupBy("review_id", "field").agg(F.max("value").alias("v"))
    maps = best.groupBy("review_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "v"))).alias("parameters"))
    points = view(spark, d, "v_point").groupBy("review_id").agg(F.collect_list(F.struct("height", "label")).alias("points"))
    return tables.recognizer_payload(maps.join(points, "review_id", "full"))


@query("src_feature_groups", "SELECT c.review_id, c.seq, c.field AS feature_type, c.value, b.x, b.y FROM v_cand c LEFT JOIN v_block b ON b.page_id = c.review_id AND b.block_no = c.seq + 1")
def src_feature_groups(spark, d):
    c = view(spark, d, "v_cand").select("review_id", "seq", "field", "value", (C("seq") + 1).alias("reference"))
    markers = view(spark, d, "v_block").select(C("page_id").alias("review_id"), C("block_no").alias("reference"), "x", "y")
    groups = {f: c.where(C("field") == f).drop("field") for f in ("wire_diameter", "outer_diameter", "free_length", "total_coils")}
    return tables.feature_groups(groups, markers).select("review_id", "seq", "feature_type", "value", "x", "y")


@query("src_dictionary", "SELECT p_name AS key, 'duplicate' AS problem FROM part GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT p_name, 'not_positive:p_size' FROM part WHERE NOT p_size - 5 > 0")
def src_dictionary(spark, d):
    return tables.dictionary_report(table(spark, d, "part").select("p_name", (C("p_size") - 5).alias("p_size")), "p_name", ["p_size"])


@query("src_term_import", "SELECT 'sfc_' || substr(sha256(p_name), 1, 12) AS id, p_name AS name, min(p_partkey) AS first_row FROM part GROUP BY p_name")
def src_term_import(spark, d):
    return tables.term_import(table(spark, d, "part"), "p_name", "p_partkey")


@query("src_file_inventory", r"WITH e AS (SELECT page_id, html, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([A-Za-z0-9]+)/?$', 1)) AS ext FROM pages) SELECT page_id, CASE WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('dwg', 'dxf', 'step') THEN 'cad' WHEN ext IN ('png', 'jpg', 'tif') THEN 'image' ELSE 'unknown' END AS kind, ext IN ('png', 'jpg', 'tif') OR length(html) = 0 AS scanned FROM e")
def src_file_inventory(spark, d):
    return tables.file_inventory(table(spark, d, "pages"), "url", F.length("html"))


@query("src_relational", "SELECT o_custkey AS owner_id, count(*) AS n FROM orders JOIN (SELECT DISTINCT user_id FROM events) ON user_id = o_custkey GROUP BY 1")
def src_relational(spark, d):
    owners = table(spark, d, "events").select(C("user_id").alias("owner_id")).distinct()
    return table(spark, d, "orders").select(C("o_custkey").alias("owner_id")).groupBy("owner_id").agg(F.count("*").alias("n")).join(owners, "owner_id")


#: Changes of the second batch: one or two a review, some of them stale, some by another owner; its answers, and the rows after it.
CHANGES = """c AS (SELECT id, 1 AS seq, CASE WHEN id % 13 = 0 THEN 'b' ELSE 'a' END AS owner, CASE WHEN id % 10 = 0 THEN 0 WHEN id % 7 = 3 THEN NULL ELSE 1 END AS expected, before_value + 1 AS value FROM v_snap WHERE id % 4 > 0
    UNION ALL SELECT id, 2, 'a', CASE WHEN id % 12 = 6 THEN 2 ELSE 1 END, before_value + 2 FROM v_snap WHERE id % 6 = 0),
  f AS (SELECT id, seq, owner, expected, value, CASE WHEN owner = 'b' THEN 'not_found' WHEN expected <> 1 THEN 'revision_conflict' ELSE 'saved' END AS first FROM c WHERE seq = 1),
  s AS (SELECT c.id, c.expected, c.value, 1 + coalesce((f.first = 'saved')::INT, 0) AS current, f.first FROM c LEFT JOIN f ON f.id = c.id WHERE c.seq = 2),
  t AS (SELECT id, 1 AS seq, first AS outcome, CASE first WHEN 'saved' THEN 2 WHEN 'revision_conflict' THEN 1 END AS revision, value FROM f UNION ALL SELECT id, 2, CASE WHEN expected = current THEN 'saved' ELSE 'revision_conflict' END, current + (expected = current)::INT, value FROM s)"""


@query("sink_review_upsert", f"WITH {CHANGES}, n AS (SELECT id, max(revision) AS revision, arg_max(value, revision) AS value FROM t WHERE outcome = 'saved' GROUP BY 1) SELECT v.id, 0 AS seq, 'row' AS outcome, coalesce(n.revision, 1) AS revision, coalesce(n.value, v.before_value) AS value FROM v_snap v LEFT JOIN n ON n.id = v.id UNION ALL SELECT id, seq, outcome, revision, NULL FROM t")
def sink_review_upsert(spark, d):
    """All reviews in one batch, changes in another, which is then sent again."""
    folder, k = tables.scratch(spark, "reviews"), C("id")
    s = view(spark, d, "v_snap")
    tables.save_reviews(s.select("id", F.lit(1).cast("long").alias("seq"), F.lit("a").alias("owner"), F.lit(None).cast("long").alias("expected"), C("before_value").alias("value")), folder, "first")
    one = s.where(k % 4 > 0).select("id", F.lit(1).cast("long").alias("seq"), F.when(k % 13 == 0, "b").otherwise("a").alias("owner"), F.when(k % 10 == 0, 0).when(k % 7 == 3, None).otherwise(1).cast("long").alias("expected"), (C("before_value") + 1).alias("value"))
    two = s.where(k % 6 == 0).select("id", F.lit(2).cast("long").alias("seq"), F.lit("a").alias("owner"), F.when(k % 12 == 6, 2).otherwise(1).cast("long").alias("expected"), (C("before_value") + 2).alias("value"))
    for _ in range(2):
        told = tables.save_reviews(one.unionByName(two), folder, "second")
    rows = tables.saved_reviews(spark, folder).select("id", F.lit(0).cast("long").alias("seq"), F.lit("row").alias("outcome"), "revision", "value")
    return rows.unionByName(told.withColumn("value", F.lit(None).cast("double")))


@query("sink_review_json", "SELECT review_id, count(*) AS n, round(sum(value), 6) AS total FROM v_cand GROUP BY 1")
def sink_review_json(spark, d):
    docs = tables.review_json(view(spark, d, "v_cand"))
    parsed = docs.select(F.from_json("document", "review_id long, candidates array<struct<seq: long, field: string, value: double>>").alias("j")).select("j.review_id", F.inline("j.candidates"))
    return parsed.groupBy("review_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def _events(spark, d):
    return view(spark, d, "v_event").select("event_id", C("ts").cast("timestamp").alias("ts"), "job_id", "status", "value")


def _stream(spark, d):
    """The events table as files of a folder, read as a stream."""
    path = tables.scratch(spark, "events")
    _events(spark, d).repartition(4, "job_id").write.parquet(path)
    return events.event_stream(spark, path, "event_id long, ts timestamp, job_id long, status string, value double")


FOLD = """WITH RECURSIVE o AS (SELECT job_id, status AS s, value AS v, CASE status WHEN 'queued' THEN 1 WHEN 'generating_3d' THEN 2 WHEN 'generating_2d' THEN 3 ELSE 4 END AS k, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS i FROM v_event),
  f AS (SELECT job_id, i, s AS status, k AS at, v AS progress, 0::BIGINT AS ignored, 0::BIGINT AS conflicts FROM o WHERE i = 1
    UNION ALL SELECT f.job_id, o.i, CASE WHEN f.at < 4 AND (o.k > f.at OR o.s = f.status AND o.v > f.progress) THEN o.s ELSE f.status END, CASE WHEN f.at < 4 AND (o.k > f.at OR o.s = f.status AND o.v > f.progress) THEN o.k ELSE f.at END,
      CASE WHEN f.at < 4 AND (o.k > f.at OR o.s = f.status AND o.v > f.progress) THEN o.v ELSE f.progress END, f.ignored + CASE WHEN f.at < 4 AND (o.k > f.at OR o.s = f.status AND o.v > f.progress) OR f.at = 4 AND o.k = 4 AND o.s <> f.status THEN 0 ELSE 1 END,
      f.conflicts + CASE WHEN f.at = 4 AND o.k = 4 AND o.s <> f.status THEN 1 ELSE 0 END FROM f JOIN o ON o.job_id = f.job_id AND o.i = f.i + 1)"""


@query("st_status_fold", f"{FOLD} SELECT job_id, arg_max(status, i) AS status, arg_max(progress, i) AS progress, max(ignored) AS ignored, max(conflicts) AS conflicts FROM f GROUP BY 1")
def st_status_fold(spark, d):
    return events.last_rows(events.finished(events.status_fold(_stream(spark, d)), tables.shared_dir(spark), "update", events.ROCKS), "job_id")


#: Least rows of an arriving file, so that files dealt round robin are never empty.
FILE_ROWS = 10_000


def _arrivals(spark, d):
    """Events as they come, in four batches by time: every third again after an hour, every fifth with another value after two. A batch has as
    many files as the table's size asks for, the same in all of them, as the stream takes so many at a time; times without events have none."""
    path, e = tables.scratch(spark, "arrivals"), _events(spark, d)
    later = lambda rows, hours: rows.withColumn("ts", C("ts") + F.make_interval(hours=F.lit(hours)))
    every = e.unionByName(later(e.where("event_id % 3 = 0"), 1)).unionByName(later(e.where("event_id % 5 = 0").withColumn("value", C("value") + 1), 2))
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    part = F.least(F.floor(4 * (C("ts").cast("double") - F.lit(first).cast("double")) / (F.lit(last).cast("double") - F.lit(first).cast("double") + 1)), F.lit(3))
    found = {r.part: r.n for r in every.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # four rows
    files = max(1, min([-(-share(spark, d, "events") // 4), *(n // FILE_ROWS for n in found.values())]))
    for i in sorted(found) or [0]:
        rows = every.where(part == i)
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(path)
    return spark.readStream.schema("event_id long, ts timestamp, job_id long, status string, value double").option("maxFilesPerTrigger", files).parquet(path)


@query("st_dedupe_events", "SELECT job_id || ':' || event_id AS id, unnest(CASE WHEN event_id % 15 = 0 THEN ['new', 'replay', 'conflict'] WHEN event_id % 3 = 0 THEN ['new', 'replay'] WHEN event_id % 5 = 0 THEN ['new', 'conflict'] ELSE ['new'] END) AS outcome FROM v_event")
def st_dedupe_events(spark, d):
    judged = events.replays(_arrivals(spark, d), ["job_id", "event_id"], ["status", "value"], buckets=max(64, share(spark, d, "events")))
    return events.finished(judged, tables.shared_dir(spark), "append", events.ROCKS).select("id", "outcome")


@query("st_lease_timeout", """WITH e AS (SELECT job_id, event_id, epoch_us(ts) AS us, status IN ('generating_3d', 'generating_2d') AS leased FROM v_event), n AS (SELECT max(us) // 1000 - 3600000 AS wm FROM e),
  g AS (SELECT *, coalesce(NOT lag(leased) OVER o OR us - lag(us) OVER o > 86400000000, true)::BIGINT AS fresh, lead(us) OVER o AS nxt FROM e WINDOW o AS (PARTITION BY job_id ORDER BY us, event_id)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
  h AS (SELECT *, row_number() OVER (PARTITION BY job_id, run ORDER BY us, event_id) AS heartbeats FROM r WHERE leased) SELECT job_id, us + 86400000000 AS expired_us, heartbeats FROM h, n WHERE (nxt IS NULL OR nxt > us + 86400000000) AND (us + 86400000000) // 1000 + 1 <= wm""")
def st_lease_timeout(spark, d):
    """Leases of a day, and events that come up to an hour late."""
    return events.finished(events.lease_expiries(_stream(spark, d), 86_400, "1 hour"), tables.shared_dir(spark), "append", events.ROCKS)


@query("st_latest_snapshot", "SELECT job_id, arg_max(status, (ts, event_id)) AS status, count(*) AS n FROM v_event GROUP BY 1")
def st_latest_snapshot(spark, d):
    out = events.finished(events.latest_snapshot(_stream(spark, d)), tables.shared_dir(spark), "update")
    return events.last_rows(out, "job_id").select("job_id", "status", "n")


@query("st_incremental_fuse", f"WITH {SCORED} SELECT review_id, field, seq, source, value, score FROM r WHERE rank = 1")
def st_incremental_fuse(spark, d):
    path = tables.scratch(spark, "arrivals")
    n = share(spark, d, "lineitem")
    files = -(-n // 12)  # of a third of the rows; two thirds come first, whatever the size
    view(spark, d, "v_cand").select(*CAND).repartition(3 * files).write.parquet(path)
    stream = spark.readStream.schema(tables.CANDIDATE).option("maxFilesPerTrigger", 2 * files).parquet(path)
    best = lambda rows: fuse.scored(rows).where("rank = 1").select(*rows.columns)
    return fuse.top1(events.incremental(stream, tables.scratch(spark, "incremental"), best, "review_id", tasks=-(-n // 6)))


@query("st_family_progress", "SELECT job_id % 10 AS family, count(*) AS n, count(*) FILTER (status = 'completed') AS completed, round(max(value), 6) AS most FROM v_event GROUP BY 1")
def st_family_progress(spark, d):
    out = events.finished(events.family_progress(_stream(spark, d), C("job_id") % 10), tables.shared_dir(spark), "update")
    return events.last_rows(out, "family")


@query("udf_engine", f"SELECT doc_id AS review_id, line_no AS seq, 'load_height' AS field, 'reader_service' AS source, CAST(unnest(regexp_extract_all(text, 'H[0-9]+=([0-9.]+)mm', 1)) AS DOUBLE) AS value, 0.9::DOUBLE AS confidence FROM v_note")
def udf_engine(spark, d):
    """A plug-in recognizer is any function of batches of text to rows of the candidate schema, as many for a text as it finds."""

    def engine(frames):
        for f in frames:
            found = f.set_index(["doc_id", "line_no"]).text.str.extractall(r"H[0-9]+=([0-9.]+)mm")[0].astype(float).reset_index()
            yield pd.DataFrame({"review_id": found.doc_id, "seq": found.line_no, "field": "load_height", "source": "reader_service", "value": found[0], "confidence": 0.9})

    return view(spark, d, "v_note").select("doc_id", "line_no", "text").mapInPandas(engine, tables.CANDIDATE)
