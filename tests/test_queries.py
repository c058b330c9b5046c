"""One query of each module against its SQL, and the shape of all."""

import os

import duckdb
import pytest
from plyforge.plans import load

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ("q_material_context", "q04_rank_contents", "q21_hanging_pieces", "p14_mobility", "w03_ply_counter", "l11_stratified_eval", "j05_chained_pools", "a07_best_worst", "a11_group_jaccard", "e04_compare_moves", "e10_notable_terms", "r04_reward_think", "r21_judge_combined", "t06_triple_stream", "k01_twin_sink", "m18_result_detail")


def canonical(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(canonical, v))
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    df = load.all_queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((repr(tuple(map(canonical, r))) for r in df.select(*columns).collect()))
    result = con.execute(load.all_oracles()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    theirs = sorted(repr(tuple(canonical(dict(zip(names, row, strict=True))[c]) for c in columns)) for row in result.fetchall())
    assert ours == theirs and ours


def test_every_oracle_has_its_query():
    assert set(load.all_oracles()) <= set(load.all_queries())
    assert len(load.all_queries()) > 250
