import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, token string, n int, quality double, words string, base string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables of rows: documents as (doc_id, text[, lang[, source]]) with further columns whose names clash."""

    def write(documents, benchmark=(), labels=(), pages=None) -> str:
        rows = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1]) if r[1] is not None else None, "x", 7, 0.1, "y", "z") for r in documents]
        tables = {"documents": (rows, DOCUMENTS), "benchmark": (list(benchmark), "item_id long, text string"), "labels": (list(labels), LABELS), "pages": (list(pages or ()), "page_id long, url string, html string")}
        for name, (data, schema) in tables.items():
            spark.createDataFrame(data, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture
def prose():
    """A function that gives texts of words of an invented language."""
    rng = random.Random(5)
    syllables = {"aa": ["ka", "ro", "ti", "mu", "se"], "bb": ["zh", "qwe", "üx", "yöl", "vv"], "cc": ["the", "ing", "ton", "er", "ly"]}

    def text(n: int, lang: str = "aa") -> str:
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(n))

    return text
