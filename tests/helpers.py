"""Literal recordings, and comparison of Spark's rows with DuckDB's."""

from ondula.dataset import Dataset

SAMPLE = "rec long, filename string, idx long, frequency double, comment string, markers array<string>, X double"


def recordings(spark, values, markers=None, comments=None, rate=10.0):
    """A recording for each list of values, numbered from 1; markers and comments by index, for each recording."""
    rows = []
    for k, own in enumerate(values):
        marks, notes = markers[k] if markers else {}, comments[k] if comments else {}
        rows += [(k + 1, "one" if k == 0 else f"file{k}", i, rate, notes.get(i, ""), marks.get(i, []), float(v)) for i, v in enumerate(own)]
    return Dataset(spark.createDataFrame(rows, SAMPLE), ("X",))


def recording(spark, values, markers=None, comments=None, rate=10.0):
    return recordings(spark, [values], [markers or {}], [comments or {}], rate)


def plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.6g}")
    return [plain(v) for v in value] if isinstance(value, list) else value


def same_rows(df, duck, sql):
    """Spark's rows and DuckDB's, as sorted tuples by sorted column names."""
    names = sorted(df.columns)
    own = sorted(str(tuple(plain(row[n]) for n in names)) for row in df.collect())
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    other = sorted(str(tuple(plain(row[columns.index(n)]) for n in names)) for row in result.fetchall())
    return own, other
