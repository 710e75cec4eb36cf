import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", ".."))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.join(os.path.dirname(__file__), "..", ".."), os.environ.get("PYTHONPATH", "")])

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text[, source]) rows, with clashing extra columns."""

    def make(rows, *extra):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in extra:
            df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, very long, tied and repeated texts."""

    long = " ".join(f"word{i % 977} other{i % 31}." for i in range(12_000))
    return [None, "", " ", "\n\n", "a", "tie text here", "tie  text\there", long, long + " tail", "é ß ñ 漢字 🙂", "<|endoftext|> x"]
