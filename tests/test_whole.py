"""Queries on whole inputs: against their SQL with its cuts taken out, on the smallest tables."""

import pytest

import __spark_entry__
from tests.test_oracles import SF, SQL, duck, plain  # noqa: F401

#: By query, what its SQL cuts and what stands there without the cut.
CUTS = {
    "symbol_ids": [("substr(lower(text), 1, 200)", "lower(text)")],
    "bm25_topk": [("substr(text, 1, 200)", "text")],
    "rewards": [("substr(rest, 1, 250)", "rest")],
    "quote_split": [("substr(rest, 1, 250)", "rest")],
    "turn_collapse": [(" WHERE turn % 5 <> 3", "")],
    "dictionary_merge": [("doc_id % 2 = 0", "doc_id % 2 = 0 OR doc_id % 3 = 0")],
    "rrf_fusion": [("v[1:16]", "v"), (" WHERE rank <= 20", "")],
}


@pytest.mark.parametrize("name", sorted(CUTS))
def test_query_reads_all_of_its_input(spark, duck, name):  # noqa: F811
    sql = SQL[name]
    for cut, whole in CUTS[name]:
        sql = sql.replace(cut, whole)
    found = __spark_entry__.queries()[name](spark, SF)
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    assert plain(want.fetchall(), names) == plain(found.collect(), found.columns)
