import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def path():
    import public_tokenizers

    return public_tokenizers.path


@pytest.fixture(scope="session")
def texts():
    import duckdb

    rows = duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    odd = ["", " ", "\n\n  x  \n", "a", "  <|endoftext|> foo<|endoftext|>bar", "aaa" * 7000, "日本語テキスト" * 300 + " é ́x", "don't we'll  \t\x0b\x85 　x  y \x1c\x1d z \x00 \x00a" * 30, "word " * 6000]
    return [r[0] for r in rows] + odd + [rows[0][0], rows[0][0], ""]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with odd and repeated texts, nulls, and extra columns whose names the operators use themselves."""
    rows = [(i, t, "en", f"src{i % 3}", len(t), 1, "x", 2.0) for i, t in enumerate(texts)]
    rows += [(len(rows), None, None, None, None, None, None, None), (None, "no id", "en", "src0", 5, 1, "x", 2.0), rows[5], rows[5]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, ids string, score double").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")


@pytest.fixture(scope="session")
def plain(docs):
    """(doc_id, text) rows, null texts as empty ones."""
    return [(r.doc_id, r.text or "") for r in docs.collect()]
