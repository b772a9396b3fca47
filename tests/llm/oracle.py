import duckdb


def duck(query, sf_dir, tables=("documents",)):
    """Columns and sorted rows of a DuckDB query over the Parquet tables."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(query)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[k] for k in order], sorted(map(repr, (tuple(r[k] for k in order) for r in got.fetchall())))


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect())))
