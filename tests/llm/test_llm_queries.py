import pytest
from support import rows

from loamgraph.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, duck, data_dir):
    got = QUERIES[name](spark, data_dir).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_cut_documents_are_those_beyond_the_capacity(spark, data_dir):
    from loamgraph.llm import packing
    from loamgraph.sources.tables import table

    sizes = packing.token_counts(table(spark, data_dir, "documents"), "doc_id", "text")
    want = {r.item for r in sizes.where("size > 1024").collect()}
    assert {r.doc_id for r in QUERIES["p7_found"](spark, data_dir).collect()} == want


def test_leaks_against_plain_search(spark, data_dir):
    """Every pair that shares 15 consecutive words is found, and no pair without an aligned passage."""
    from loamgraph.llm.leakage import passages, words
    from loamgraph.sources.tables import table
    import numpy as np

    docs = {r.doc_id: words(r.text) for r in table(spark, data_dir, "documents").select("doc_id", "text").collect()}
    items = {r.item_id: words(r.text) for r in table(spark, data_dir, "eval_items").select("item_id", "text").collect()}
    want = set()
    for i, w in items.items():
        for d, x in docs.items():
            if not set(w) & set(x):
                continue
            for shift in range(-len(w) + 1, len(x)):
                a, b = max(0, -shift), min(len(w), len(x) - shift)
                if b - a >= 15 and passages(np.array([x[shift + k] == w[k] for k in range(a, b)])):
                    want.add((d, i))
                    break
    assert {(r.doc_id, r.item_id) for r in QUERIES["p8_found"](spark, data_dir).collect()} == want


def test_rare_pairs_are_counted(spark, duck, data_dir):
    """No least count: every two tags that stand together on an entity."""
    want = duck.execute(
        """WITH held AS (SELECT DISTINCT tenant_id, entity_type, entity_id, tag_id FROM entity_tags WHERE tag_id IS NOT NULL)
SELECT a.tenant_id, a.tag_id AS tag_a, b.tag_id AS tag_b, count(*) AS n_ab FROM held a JOIN held b USING (tenant_id, entity_type, entity_id) WHERE a.tag_id < b.tag_id GROUP BY ALL"""
    ).df()
    assert want["n_ab"].min() == 1
    got = QUERIES["p2_pairs"](spark, data_dir).select("tenant_id", "tag_a", "tag_b", "n_ab").toPandas()
    assert rows(got) == rows(want)
