"""Snapshot queries: documents grouped by source stand for versioned files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import versioning
from ..session import shared_dir
from ..sources import live, samples, tables
from .history import dim
from .registry import query, table, us


def doc_files(spark, sf):
    """Every document as a file: name, content hash, size."""
    d = table(spark, sf, "documents")
    return d.select(F.col("source").alias("folder"), F.col("doc_id").cast("string").alias("name"),
                    F.sha2("text", 256).alias("sha256"), F.col("n_chars").cast("long").alias("n_rows"), "lang")


def changed_files(spark, sf):
    """A later state: English texts edited, long ones gone, a file per label added."""
    d = table(spark, sf, "documents")
    text = F.when(F.col("lang") == "en", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    cur = d.filter("n_chars < 3000").select(F.col("doc_id").cast("string").alias("name"), F.sha2(text, 256).alias("sha256"),
                                            F.col("n_chars").cast("long").alias("n_rows"))
    new = table(spark, sf, "labels").select(F.concat(F.lit("label-"), "doc_id").alias("name"),
                                            F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256"), F.lit(1).cast("long").alias("n_rows"))
    return cur.unionByName(new.distinct())


DIFF_SQL = """a AS (SELECT CAST(doc_id AS VARCHAR) AS name, sha256(text) AS sha, CAST(n_chars AS BIGINT) AS n FROM documents),
b AS (SELECT CAST(doc_id AS VARCHAR) AS name, sha256(CASE WHEN lang = 'en' THEN text || '!' ELSE text END) AS sha, CAST(n_chars AS BIGINT) AS n FROM documents WHERE n_chars < 3000
 UNION SELECT 'label-' || doc_id, sha256(CAST(doc_id AS VARCHAR)), 1 FROM labels),
d AS (SELECT coalesce(a.name, b.name) AS name, a.sha AS sha256_a, a.n AS n_rows_a, b.sha AS sha256_b, b.n AS n_rows_b,
 CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' WHEN a.sha <> b.sha THEN 'changed' END AS change FROM a FULL JOIN b ON a.name = b.name)"""


@query("content_hashes", "SELECT source AS folder, CAST(doc_id AS VARCHAR) AS name, sha256(text) AS sha256, CAST(n_chars AS BIGINT) AS n_rows FROM documents")
def _(spark, sf):
    return doc_files(spark, sf).drop("lang")


@query("snapshot_ids", """SELECT o_custkey AS folder, count(*) AS n_files, substr(sha256(string_agg(o_orderkey || '=' || sha256(CAST(o_totalprice AS DECIMAL(12, 2))::VARCHAR), chr(10) ORDER BY CAST(o_orderkey AS VARCHAR))), 1, 12) AS snapshot_id FROM orders GROUP BY 1""")
def _(spark, sf):
    """A folder per customer, a file per order."""
    f = table(spark, sf, "orders").select(F.col("o_custkey").alias("folder"), F.col("o_orderkey").cast("string").alias("name"),
                                          F.sha2(F.col("o_totalprice").cast("decimal(12,2)").cast("string"), 256).alias("sha256"))
    return versioning.snapshot_id(f, ("folder",)).select("folder", "n_files", "snapshot_id")


@query("snapshot_diff", f"WITH {DIFF_SQL} SELECT * FROM d WHERE change IS NOT NULL")
def _(spark, sf):
    return versioning.diff_snapshots(doc_files(spark, sf), changed_files(spark, sf))


@query("snapshot_verify", f"WITH {DIFF_SQL} SELECT count(change) = 0 AS ok, count(*) FILTER (change = 'removed') AS missing, count(*) FILTER (change = 'added') AS extra, count(*) FILTER (change = 'changed') AS mismatched FROM d")
def _(spark, sf):
    d = versioning.verify_counts(doc_files(spark, sf), changed_files(spark, sf))
    return d.select("ok", "missing", "extra", "mismatched")


@query("snapshot_listing", """SELECT l_returnflag || l_linestatus AS snapshot_id, epoch_us(max(l_shipdate)) AS created_us, count(DISTINCT l_suppkey) AS n_files FROM lineitem GROUP BY 1""")
def _(spark, sf):
    s = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("snapshot_id"),
                                            F.col("l_shipdate").cast("timestamp").alias("created_at"), F.lit("").alias("message"),
                                            F.col("l_suppkey").alias("name"))
    return versioning.list_snapshots(s).select("snapshot_id", us("created_at").alias("created_us"), "n_files")


@query("file_hashes")
def _(spark, sf):
    """The given table files themselves."""
    return versioning.file_meta(spark, sf, "*.parquet").select("name", "sha256", "size_bytes")


@query("scenario_files", """SELECT event_type AS scenario, count(*) AS n, round(sum(CASE WHEN value < 200 THEN value END), 4) AS s FROM events GROUP BY 1""")
def _(spark, sf):
    """Scenario CSV files written from the events and scanned back; unreadable numbers become null."""
    base = f"{shared_dir(spark)}/scenarios-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select("event_type", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                                          F.when(F.col("value") < 200, F.col("value").cast("string")).otherwise("bad").alias("level"))
    e.write.partitionBy("event_type").option("header", True).csv(base)
    w = samples.read_scenarios(spark, base, ["level", "absent"], scenario=samples.partition_value("event_type"))
    return w.groupBy("scenario").agg(F.count("ts").alias("n"), F.round(F.sum("level"), 4).alias("s"))


@query("report_files", """SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1""")
def _(spark, sf):
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    tables.write_report(table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("l_returnflag STRING, n LONG").option("header", True).csv(path)


# --- live samples -----------------------------------------------------------------

@query("live_samples", """WITH d(tag) AS (VALUES ('click'), ('view'), ('purchase'), ('error')), m AS (SELECT event_id, ts, event_type, value FROM events)
SELECT d.tag, count(*) AS n, count(value) FILTER (m.event_type = d.tag) AS n_values, round(sum(value) FILTER (m.event_type = d.tag), 4) AS s FROM m CROSS JOIN d GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "events")
    msg = e.select(F.to_json(F.struct(
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"), F.create_map("event_type", "value").alias("values"),
        F.create_map("event_type", F.lit(0)).alias("quality"), F.lit("file").alias("source"))).alias("value"))
    d = live.explode_samples(live.parse_samples(msg), dim(spark))
    return d.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"), F.round(F.sum("value"), 4).alias("s"))
