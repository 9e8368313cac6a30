from __future__ import annotations

import pandas as pd
import pytest

from textlake.llm.common import arrow_batches

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def wide(spark):
    """A small table of documents with awkward rows: nulls, blanks, ties, repeats and
    other columns."""
    arrow_batches(spark)
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [
        (1, "The cat sat on the mat and the dog sat on the log near the house", "en"),
        (2, "The cat sat on the mat and the dog sat on the log near the house", "en"),
        (2, "The cat sat on the mat and the dog sat on the log near the house", "en"),
        (3, None, "en"), (4, "", None), (5, "   \n\t ", "fr"), (6, "12345 !!! ###", "fr"),
        (None, "a row without an id", "en"), (None, None, None),
        (7, "le chat est sur la table\nle chat est sur la table\n\nle chien dort", "fr"),
        (8, "\u00e9\u00e8 \U0001f600 \u65e5\u672c\u8a9e \u00a0x\u2003y \x1c z", "fr"), (9, long, "en"), (10, "x" * 50_000, "en"),
        (11, "hello <|endoftext|> world  two  spaces", "en"),
    ]
    data = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows],
                         "lang": [r[2] for r in rows], "row": 7, "place": 8, "digest": "d", "n": 1, "word": "w"})
    schema = "doc_id bigint, text string, lang string, row int, place int, digest string, n int, word string"
    return spark.createDataFrame(data.astype(object).where(data.notna(), None).values.tolist(), schema)


@pytest.fixture(scope="session")
def stored(spark):
    arrow_batches(spark)
    return spark.read.parquet(f"{DIR}/documents.parquet")
