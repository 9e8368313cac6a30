"""Every registered query against its SQL twin on the smallest stored tables."""

from __future__ import annotations

import os

import pytest
from compare import compare, duck

import __spark_entry__ as entry_points

DIR = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(DIR)


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, con, name):
    ok, text = compare(spark, con, name, DIR)
    assert ok, text


def test_entry_has_a_stable_schema(spark):
    assert entry_points.entry(spark).schema == entry_points.entry(spark).schema


def test_twins_belong_to_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
