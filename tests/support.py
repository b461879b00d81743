"""What tests share: the tables, and rows made comparable."""

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return [normal(v) for v in value]
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(str([normal(v) for v in row]) for row in df.select(*(f"`{n}`" for n in names)).collect())


def rows_of_sql(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(str([normal(row[i]) for i in order]) for row in cursor.fetchall())
