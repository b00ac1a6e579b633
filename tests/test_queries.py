"""Every query with SQL gives DuckDB's rows; the others give rows."""

import duckdb
import pytest
from helpers import same_rows

from ondula.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, data_dir, name):
    own, other = same_rows(QUERIES[name](spark, data_dir), duck, SQL[name])
    assert own == other


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_rows(spark, data_dir, name):
    assert QUERIES[name](spark, data_dir).count() > 0


@pytest.fixture(scope="module")
def level(tmp_path_factory):
    """The events of two users by nine values, 0 to 80, so that neighbours are often equal; their folder and a connection."""
    folder, connection = tmp_path_factory.mktemp("level"), duckdb.connect()
    connection.execute(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, i % 2 AS user_id, CASE WHEN i // 2 % 11 = 3 THEN 'purchase' ELSE 'view' END AS event_type, CAST(hash(i) % 9 * 10 AS DOUBLE) AS value, '' AS props FROM range(1200) t(i)) TO '{folder}/events.parquet' (FORMAT parquet)")
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return str(folder), connection


@pytest.mark.parametrize("name", ["morph_scalars", "peaks_distance", "peaks_height", "peaks_min", "peaks_plain", "peaks_prominence", "tangents"])
def test_equal_neighbours_match_sql(spark, level, name):
    folder, connection = level
    own, other = same_rows(QUERIES[name](spark, folder), connection, SQL[name])
    assert own == other and other


def test_variances_halfway_match_sql(spark, tmp_path):
    """Cycles of sf0.1 whose variance lies halfway between two rounded ones, and one made with such a kurtosis, compared to the last digit."""
    cycles = [
        [46.85, 97.3, 2.71, 67.77, 14.6, 42.81, 26.9, 39.35], [40.91, 101.49, 52.75, 6.72, 55.98, 16.73, 24.48, 4.87], [49.86, 54.48, 5.75, 18.66, 38.93, 25.69, 68.76, 23.84],
        [62.41, 147.8, 33.04, 58.84, 132.23, 8.15, 102.74, 60.88], [17.51, 55.55, 4.3, 5.45, 22.51, 4.6, 118.72, 16.75], [0.0, 16.0, 80.0, 64.0, 8.0, 16.0, 0.0, 8.0, 8.0, 96.0, 80.0],
    ]
    rows = [("purchase" if not k else "view", v) for c in cycles for k, v in enumerate(c)]
    connection = duckdb.connect()
    values = ", ".join(f"({i}, TIMESTAMP '2024-01-01' + to_seconds({i}), 0, '{kind}', {v}::DOUBLE, '')" for i, (kind, v) in enumerate(rows))
    connection.execute(f"COPY (SELECT * FROM (VALUES {values}) t(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    own = QUERIES["morph_scalars"](spark, str(tmp_path))
    other = connection.execute(f"SELECT {', '.join(own.columns)} FROM ({SQL['morph_scalars']})").fetchall()
    assert sorted(map(str, map(tuple, own.collect()))) == sorted(map(str, other))
