import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__  # noqa: E402
import corpus_pipeline as P  # noqa: E402

from maskforge.llm.common import staged, table  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    sizes = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        out = staged(stage(spark, docs, SF), name)
        assert out.dtypes == docs.dtypes
        docs = out
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3]
    last = P.STAGES[-1][1](spark, docs, SF)
    assert last.count() == sizes[-1]


def test_stages_on_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert any(q.startswith(f"op{n}_") for q in names)
    assert set(__spark_entry__.oracle_sql()) <= names
