"""Every registered query of the linkage engine against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from kinweave.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return [columns[i] for i in order], sorted([tuple(value(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    assert plain(got.columns, got.collect()) == plain(want.columns, want.fetchall())


def test_sample(spark, sf_dir):
    a, b = (QUERIES["sample_seeded"](spark, sf_dir).count() for _ in range(2))
    assert a == b and 50 < a < 300


def test_entry_points():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["block_term_must", "block_should_optional", "block_must_not", "block_phrase", "block_fuzzy_auto", "filter_column_dynamic", "filter_merge"])
def test_people_without_birth_date_have_candidates(spark, sf_dir, name):
    """All people are searched, those without a birth date by the other rules."""
    some, every = (QUERIES[n](spark, sf_dir).select("rec_id").distinct() for n in (name, f"{name}_all"))
    some, every = ({r[0] for r in x.collect()} for x in (some, every))
    assert some <= every and every - some and all(k % 17 == 0 for k in every - some)


def test_cascade_gets_all_people(spark, sf_dir, monkeypatch):
    from kinweave import queries

    seen = []
    monkeypatch.setattr(queries, "cascade", lambda source, *a: seen.append(source.count()) or [])
    monkeypatch.setattr(queries, "union_phases", lambda frames: None)
    queries._linked(spark, sf_dir, queries.FIRST)
    assert seen == [queries.people(spark, sf_dir).count()]


@pytest.mark.parametrize("name", ["cascade_two_phase", "workunit_partitioned_linkage"])
def test_cascade_leaves_out_no_candidate(spark, duck, tmp_path, name):
    """Over 100 documents share state and birth date of a person; the SQL pairs them all."""
    key = "(range // 160) * 5964 * 17 * 12 + (range % 160) * 5964 + 1"
    duck.sql(f"COPY (SELECT {key} AS c_custkey FROM range(480)) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    near = duck.sql(ORACLES[name].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet'"))
    got = QUERIES[name](spark, str(tmp_path))
    assert plain(got.columns, got.collect()) == plain(near.columns, near.fetchall())
