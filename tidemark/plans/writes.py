"""Writes as frames on customers, orders and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import tables
from tidemark.plans.register import Registry, table

registry = Registry()


@registry.query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 2 = 0""")
def insert_on_conflict_nothing(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return tables.insert_absent(c.where("c_custkey % 4 <> 0"), c.where("c_custkey % 2 = 0").withColumn("c_name", F.lit("new")), ["c_custkey"])


@registry.query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer")
def upsert_by_key(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return tables.upsert(c, c.where("c_custkey % 2 = 0").withColumn("c_name", F.lit("new")), ["c_custkey"])


@registry.query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def conditional_update(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return tables.update(o, F.col("o_orderstatus") == "O", {"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1})


@registry.query("SELECT count(*) FILTER (o_orderstatus = 'O') AS changed FROM orders")
def update_row_count(spark, sf_dir):
    return tables.updated_rows(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "O")


@registry.query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def delete_cascade(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return tables.delete_cascade(c, o, c.where("c_mktsegment = 'MACHINERY'"), "c_custkey", "o_custkey")[1].select("o_orderkey")


@registry.query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderdate > TIMESTAMP '1998-01-01')")
def delete_upcoming(spark, sf_dir):
    gone = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") > F.lit("1998-01-01").cast("timestamp_ntz"))
    return table(spark, sf_dir, "orders").where(~gone).select("o_orderkey")


@registry.query("SELECT s_suppkey, s_nationkey = 3 AND s_suppkey = (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = 3) OR s_nationkey <> 3 AND s_acctbal > 5000 AS is_source FROM supplier")
def set_source_device(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("is_source", F.col("s_acctbal") > 5000)
    first = s.where("s_nationkey = 3").agg(F.min("s_suppkey").alias("_first"))
    s = s.crossJoin(F.broadcast(first))  # one row
    return tables.set_single(s, "s_nationkey", "s_suppkey", "is_source", F.lit(3), F.col("_first")).select("s_suppkey", "is_source")


@registry.query("""SELECT coalesce(a.name, r.name) AS name, CASE WHEN a.name IS NULL THEN 'pending' WHEN r.name IS NULL THEN 'unknown' ELSE 'applied' END AS state
    FROM (SELECT n_name AS name FROM nation WHERE n_nationkey < 20) a FULL JOIN (SELECT n_name AS name FROM nation WHERE n_nationkey > 2) r USING (name)""")
def schema_state(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    return tables.schema_state(n.where("n_nationkey < 20"), n.where("n_nationkey > 2"))


@registry.query("""SELECT s_suppkey, array_to_string(list_filter([CASE WHEN NOT s_acctbal > 0 THEN 'positive' END, CASE WHEN NOT s_nationkey < 20 THEN 'nation' END], lambda x: x IS NOT NULL), ',') AS broken FROM supplier WHERE NOT s_acctbal > 0 OR NOT s_nationkey < 20""")
def rule_violations(spark, sf_dir):
    s = tables.violations(table(spark, sf_dir, "supplier"), {"positive": F.col("s_acctbal") > 0, "nation": F.col("s_nationkey") < 20})
    return s.select("s_suppkey", F.array_join("broken", ",").alias("broken"))


@registry.query("SELECT s_nationkey, count(*) FILTER (s_acctbal > 5000) AS sources FROM supplier GROUP BY 1 HAVING count(*) FILTER (s_acctbal > 5000) <> 1")
def one_source_per_room(spark, sf_dir):
    g = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count_if(F.col("s_acctbal") > 5000).alias("sources"))
    return g.where("sources <> 1")


@registry.query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-31' - INTERVAL 30 DAY")
def retention_due(spark, sf_dir):
    return tables.pending_deletes(table(spark, sf_dir, "orders"), "o_orderdate", F.lit("1998-01-31").cast("timestamp_ntz"), "30 DAYS").select("o_orderkey")
