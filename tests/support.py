"""Comparing a DataFrame with a DuckDB query."""


def rows_of(values, names, order):
    def norm(v):
        if isinstance(v, float):
            return round(v, 5) + 0.0
        return v
    at = [names.index(c) for c in order]
    return sorted((tuple(norm(r[i]) for i in at) for r in values), key=repr)


def same_rows(df, duck, sql):
    order = sorted(df.columns)
    rel = duck.sql(sql)
    assert sorted(rel.columns) == order
    return rows_of(df.collect(), df.columns, order), rows_of(rel.fetchall(), rel.columns, order)
