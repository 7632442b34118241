"""Queries against their SQL over small tables made for what the given ones don't hold."""

import os

import duckdb

import __spark_entry__ as entry
from siftline.sources import readers


def compared(spark, folder, name):
    """(ours, the SQL's): rows as texts, in order."""
    db = duckdb.connect()
    for file in os.listdir(folder):
        db.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}/*.parquet'")
    df = entry.queries()[name](spark, str(folder))
    rel = db.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in df.columns]
    return sorted(str(list(r)) for r in df.collect()), sorted(str([r[i] for i in at]) for r in rel.fetchall())


def test_supplier_keys_of_five_digits(spark, tmp_path):
    keys = [7, 1000, 9999, 10000, 99990]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(i, 1, k) for i, k in enumerate(keys * 2)], "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    ours, wanted = compared(spark, tmp_path, "exact_id_search")
    assert ours == wanted and len(ours) == 6


def test_a_zero_of_a_unit_vector_keeps_its_sign(spark, tmp_path):
    rows = [(1, 0, [1.0, -1e-8, 1e-8, 0.0, -0.0]), (2, 0, [-3.0, 4.0, 0.0, -2e-7, -4e-6])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    ours, wanted = compared(spark, tmp_path, "l2_normalise")
    assert ours == wanted and "-0.0" in ours[0]


def test_a_long_csv_text_is_cut_without_repeating_it(spark):
    text = "a,b\n" + "".join(f"\n ,\n{i},x{i}\n" for i in range(5_001))
    frame = spark.createDataFrame([(None, ""), (2**60 + 1, text), (3, "a,b\n"), (None, "c,d\n1,2\n")], "id long, text string")
    tables = readers.csv_tables(frame, "id", "text")
    got = tables.collect()
    long = {r.block: r.text.split("\n") for r in got if r.id == 2**60 + 1}
    assert sorted(long) == list(range(201)) and {len(v) for b, v in long.items() if b < 200} == {27} and long[200][2:] == ["| 5000 | x5000 |"]
    assert sorted((r.id or 0, r.block, r.text.count("\n")) for r in got if r.id != 2**60 + 1) == [(0, 0, 2), (3, 0, 2)]
    assert "explode" not in tables._jdf.queryExecution().toString()  # which made a copy of all rows for each table
