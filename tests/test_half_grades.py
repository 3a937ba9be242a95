"""halves that the double holds just below or above are rounded as the oracle rounds them."""

from __future__ import annotations

import duckdb

from lodestar.operators.text import readability
from lodestar.plans.dialect import SPARK, scan


def test_grades_of_halves_match_their_sql(spark):
    # 250 words in one sentence with 450 syllables: 39e-2 * 250 + 118e-1 * 450 / 250 - 1559e-2 is 103.15
    rows = [(k, " ".join(["banana"] * (100 + k) + ["cat"] * (150 - k)) + ".") for k in range(0, 150, 5)] + [(999, " ".join(["kola"] * 200 + ["cat"] * 50))]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    node = readability(texts=scan("documents"))
    want = con.execute(node.duck().replace("id,", "doc_id AS id,", 0).replace("SELECT id, greatest", "SELECT doc_id AS id, greatest")).fetchall()
    got = readability(texts=spark.createDataFrame(rows, "id bigint, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert next(r for r in got if r["id"] == 999)["fk_grade"] == 103.2


def test_round_by_the_power_of_ten(spark):
    xs = [103.15, -103.15, 0.25, 1.005, 2.675, 1e300]
    con = duckdb.connect()
    for n in (1, 2, 4):
        got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").selectExpr(SPARK.round("x", n)).collect()]
        assert got == [con.execute(f"SELECT round(?::DOUBLE, {n})", [x]).fetchone()[0] for x in xs]
