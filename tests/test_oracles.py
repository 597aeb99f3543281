import duckdb
import pytest

from collatio.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in ("documents", "part", "customer", "nation", "region", "orders", "events", "labels"):
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


def rows(records):
    return sorted((tuple(None if x is None else round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in r) for r in records), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = tables.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert rows(tuple(r) for r in got.select(*columns).collect()) == rows(want.select(", ".join(columns)).fetchall())


def test_top2_equals_plain_lcs(spark):
    from collatio.plans.forms import CRAFTS
    from collatio.plans.queries import evaluated
    from tests.test_kernels import lcs

    seen = 0
    for r in evaluated(spark, SF).where("category = 'dictionary' and ocr_value_pre <> ''").collect():
        ranked = sorted(((200 * lcs(r.ocr_value_pre, t) / (len(r.ocr_value_pre) + len(t)), t) for t in CRAFTS), reverse=True)
        assert (r.correction_candidate, r.correction_score, r.correction_second_score) == (ranked[0][1], round(ranked[0][0], 2), round(ranked[1][0], 2))
        seen += 1
    assert seen > 100
