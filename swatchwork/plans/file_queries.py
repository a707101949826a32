"""Queries on published results and report summaries; the files are written from the tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from swatchwork.runtime import shared_dir, written
from swatchwork.sources import adapters as A
from swatchwork.sources import files as I

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(A.with_views("cand") + """, r AS (SELECT item_id % 40 AS part, item_id, cand_no, foreground, detail_p10 >= 60 AS good FROM cand),
later AS (SELECT DISTINCT part FROM r WHERE cand_no > 1 AND part % 3 = 0 AND good)
SELECT part, item_id, cand_no, foreground FROM r WHERE good AND CASE WHEN part IN (SELECT part FROM later) THEN cand_no > 1 ELSE cand_no = 1 END""")
def published_results(spark, sf_dir):
    """First candidates are published for all parts, then later ones for every third; low scores are failed
    items and keep nothing back. The last manifest is read."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    status = F.when(F.col("detail_p10") >= 60, "ok").otherwise("failed")
    rows = written(A.cand(spark, sf_dir).select((F.col("item_id") % 40).alias("part"), "item_id", "cand_no", "foreground", status.alias("status")))
    I.publish_results(rows.filter("cand_no = 1"), path, "part")
    I.publish_results(rows.filter("cand_no > 1 AND part % 3 = 0"), path, "part")
    return I.read_results(spark, path).select("part", "item_id", "cand_no", "foreground")


@query(A.with_views("cand") + """, c AS (SELECT item_id, nodes % 5 AS n, nodes % 3 AS m FROM cand WHERE cand_no = 1),
k AS (SELECT item_id, n::BIGINT AS passed, CASE WHEN item_id % 5 = 0 THEN NULL WHEN item_id % 7 = 1 THEN m ELSE 0 END::BIGINT AS failed, n + CASE WHEN item_id % 5 = 0 THEN 0 WHEN item_id % 7 = 1 THEN m ELSE 0 END AS total FROM c)
SELECT item_id AS doc_id, passed, failed, total::BIGINT AS total, CASE WHEN coalesce(failed, 0) <> 0 THEN 'manual_review' WHEN total > 0 AND passed = total THEN 'passed' ELSE 'own' END AS operation_status FROM k""")
def report_summary(spark, sf_dir):
    """Counts as numbers, lists and texts, some of them true instead of a count."""
    n, m = "(nodes % 5)", "(nodes % 3)"
    many = f"concat('[', array_join(array_repeat('1', {n}), ','), ']')"
    passed = f"CASE item_id % 3 WHEN 0 THEN cast({n} AS string) WHEN 1 THEN {many} ELSE concat('\"', {n}, '\"') END"
    failed = f"CASE WHEN item_id % 5 = 0 THEN 'true' WHEN item_id % 7 = 1 THEN cast({m} AS string) ELSE '[]' END"
    text = f"concat('{{\"designer_operations\": {{\"status\": \"own\", \"failed\": ', {failed}, ', \"summary\": {{\"passed\": ', {passed}, '}}}}}}')"
    reports = A.cand(spark, sf_dir).filter("cand_no = 1").selectExpr("item_id AS doc_id", f"{text} AS json")
    return I.report_summary(reports).select("doc_id", "passed", "failed", "total", "operation_status")
