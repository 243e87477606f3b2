"""Means at a limit: doubles are added in the table's order."""

import random

import duckdb

from tessera import registry


def test_verdicts_where_the_mean_is_the_limit(spark, tmp_path):
    """Discounts of which every supplier's mean is 0.05 exactly, so that the order of adding decides; a table of many splits."""
    draw, rows = random.Random(3), []
    for supplier in range(300):
        for _ in range(5 + supplier % 150):
            a = draw.randrange(11)
            rows += [(supplier, a / 100), (supplier, (10 - a) / 100)]
    rows += [(300, 0.02), (301, 0.0), (302, 0.07), (303, None)]
    draw.shuffle(rows)
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql("CREATE TABLE lineitem (l_suppkey BIGINT, l_discount DOUBLE)")
    for at in range(0, len(rows), 10_000):
        con.sql("INSERT INTO lineitem VALUES " + ", ".join(f"({k}, {'NULL' if v is None else v})" for k, v in rows[at : at + 10_000]))
    con.sql(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (ROW_GROUP_SIZE 2048)")
    want = dict(con.sql(registry.oracle_sql()["a29_two_threshold_verdict"]).fetchall())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = {r["l_suppkey"]: r["verdict"] for r in registry.queries()["a29_two_threshold_verdict"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want and len({want[k] for k in range(300)}) == 2
