"""Values that round to zero from below: the queries and their SQL both give a zero without a sign."""

import duckdb
import pytest

import __spark_entry__ as entry

ROWS = [(0, [-1e-7, 0.25, -2e-7]), (1, [0.5, -1e-7, 0.125]), (2, [-0.75, 0.5, 1.0]), (3, [1e-7, -0.5, -1.0]), (5, [0.5, 0.25, 0.125])]
#: The other components: rows 1 to 3 are those that a scaler is fitted on, row 5 is just below their mean of 3.
LEVEL = {0: 1.0, 1: 2.0, 2: 3.0, 3: 4.0, 5: 3 - 2.0**-22}


def _tables(spark, folder):
    wide = [(k, 0, v + [LEVEL[k]] * 61) for k, v in ROWS]
    spark.createDataFrame(wide, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["apply_mask", "apply_scaler", "concat_features"])
def test_rounded_zero_has_no_sign(spark, tmp_path, name):
    d = _tables(spark, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{d}/embeddings.parquet/*.parquet')")
    told = sorted(map(repr, con.execute(entry.oracle_sql()[name]).fetchall()))
    assert sorted(repr(tuple(r)) for r in entry.queries()[name](spark, d).collect()) == told
    assert "-0.0," not in "".join(told)
