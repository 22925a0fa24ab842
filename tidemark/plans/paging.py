"""Keyset pages and name search on customers, parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import paging
from tidemark.plans.register import Registry, table

registry = Registry()


@registry.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 26")
def page_first(spark, sf_dir):
    return paging.page(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", 25, descending=True).select("o_orderkey", "o_totalprice")


@registry.query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000.5 OR o_totalprice = 250000.5 AND o_orderkey > 10 ORDER BY o_totalprice, o_orderkey LIMIT 26")
def page_after_cursor(spark, sf_dir):
    return paging.page(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", 25, after=(250000.5, 10)).select("o_orderkey", "o_totalprice")


@registry.query("""SELECT o_orderkey, k AS place, n > 25 AS has_more FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER () AS n FROM
    (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 26)) WHERE k <= 25""")
def page_with_more(spark, sf_dir):
    rows = paging.page(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", 25)
    return paging.with_more(rows, "o_totalprice", "o_orderkey", 25).select("o_orderkey", F.col("place").cast("long").alias("place"), "has_more")


@registry.query("""SELECT c_custkey, replace(replace(rtrim(base64(encode('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}')), '='), '+', '-'), '/', '_') AS cursor FROM customer""")
def cursor_encode(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", paging.cursor("c_custkey", "c_name").alias("cursor"))


@registry.query("SELECT c_custkey, c_custkey AS back, c_name FROM customer")
def cursor_round_trip(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", paging.cursor("c_custkey", "c_name").alias("cursor"))
    return c.select("c_custkey", paging.from_cursor(F.col("cursor"), "c_custkey long, c_name string").alias("r")).select("c_custkey", F.col("r.c_custkey").alias("back"), "r.c_name")


_GRAMS = """list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({t}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"""


@registry.query(f"""WITH g AS (SELECT p_partkey, p_name, {_GRAMS.format(t="p_name")} AS a, {_GRAMS.format(t="'blue wigdet'")} AS b FROM part),
    s AS (SELECT p_partkey, p_name, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS similarity FROM g)
    SELECT p_partkey, p_name, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.3 ORDER BY s.similarity DESC, p_partkey LIMIT 51""")
def similarity_page(spark, sf_dir):
    hits = paging.search(table(spark, sf_dir, "part"), "p_name", "p_partkey", "blue wigdet", 50)
    return hits.select("p_partkey", "p_name", F.round("similarity", 6).alias("similarity"))


@registry.query()
def word_similarity_search(spark, sf_dir):
    """Best word extent; it has no SQL form and is tested on examples."""
    return paging.best_extents(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey", "widge", 50)


@registry.query("""SELECT c_custkey, c_name, n_name, o.n AS orders FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey
    WHERE c_acctbal > 0 AND c_mktsegment = 'MACHINERY'""")
def device_list_left_join(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    j = c.where("c_acctbal > 0 AND c_mktsegment = 'MACHINERY'").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return j.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", "n_name", "orders")


@registry.query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def unassigned_devices_anti_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@registry.query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def membership_semi_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@registry.query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01') WHERE k = 1""")
def next_upcoming_per_room(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderdate > timestamp_ntz '2000-01-01'")
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@registry.query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal NULLS FIRST, c_custkey LIMIT 1")
def stalest_room(spark, sf_dir):
    return table(spark, sf_dir, "customer").orderBy(F.asc_nulls_first("c_acctbal"), "c_custkey").limit(1).select("c_custkey", "c_acctbal")
