import __spark_entry__ as entry


def test_every_query_has_rows_and_matching_columns(spark):
    import duckdb

    names = entry.queries()
    sql = {k: v for k, v in entry.oracle_sql().items() if k in names}
    assert entry.entry(spark).count() == 30 and len(sql) > 30
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    text = lambda df: sorted(tuple(str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    for name, statement in sql.items():
        ours, theirs = names[name](spark, "/root/testdata/sf0.001").toPandas(), con.execute(statement).fetchdf()
        assert text(ours) == text(theirs), name
