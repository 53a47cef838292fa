from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Builds documents from texts, or (doc_id, text) pairs, with extra columns of clashing names."""
    def build(*rows, lang="en"):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame(
            [(i, t, lang, "s", None if t is None else len(t), 1, "x", 2) for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, length int, n string, node int")

    return build


#: Null, empty, blank, one word, unusual signs, a special string, and a very long text without a space.
ODD = (None, "", " \n\t ", "word", "Ünïcode é ́x ΑΣ. 12 34", "a<|endoftext|>b <|ENDOFTEXT|> c", "a  b \n\n c ", "x y\x1cz​",
       "▁ a▁b", "日本 語 🙂", "z" * 40_000, "the cat sat on the mat\n" * 3000)
