"""Every query against its SQL oracle, and the regression anchor of truth counts."""

import duckdb
import pytest

from provlake import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if x is None or x != x:
        return "-"
    return str(int(x)) if isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "iub" else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(_plain, r)) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(catalogue.queries()[name](spark, SF).toPandas()) == rows(db.execute(catalogue.oracle_sql()[name]).df())


@pytest.mark.parametrize("sf, counts", [("0.001", (32, 0, 154, 7, 5)), ("0.01", (82, 47, 45, 21, 5))])
def test_truth_counts(spark, sf, counts):
    got = {r[0]: r[1] for r in catalogue.queries()["stats_by_truth"](spark, f"/root/testdata/sf{sf}").collect()}
    assert tuple(got.get(t, 0) for t in ("known", "conflicting", "stale", "incomplete", "unsupported")) == counts


def test_without_the_corpus_operators():
    """Nothing outside the subpackage imports it."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for path in [*root.glob("provlake/**/*.py"), *root.glob("tests/*.py")]:
        if "llm" not in path.parts and path.name != "test_catalogue.py":
            assert "provlake.llm" not in path.read_text(), path
