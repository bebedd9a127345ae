"""Every query against its SQL in DuckDB."""

import os
import subprocess
import sys

import pytest

from tessera import catalog
from tests.conftest import DATA, rows_of

catalog.load()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    out = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.SQL:
        assert rows_of(out) == rows_of(duck.sql(catalog.SQL[name]).df())
    else:
        assert len(out)


def test_entry_needs_no_session():
    """The driver's module is imported, and its queries named, before there is a session."""
    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 200)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).stdout.strip() == "True"


def test_text_topk_by_brute_force(spark):
    """The nearest texts by signatures made one by one."""
    import numpy as np

    from tessera.functions import text

    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    bits = {r["doc_id"]: text.gram_bits(r["text"] or "") for r in rows}
    want = sorted((int(np.count_nonzero(bits[0] != b)), d) for d, b in bits.items() if d != 0)[:10]
    assert [(r["distance"], r["doc_id"]) for r in catalog.QUERIES["text_topk"](spark, DATA).orderBy("distance", "doc_id").collect()] == want
