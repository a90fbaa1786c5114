import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

#: Columns whose names operators might be using for themselves.
CLASHING = ["n_words", "n_hit", "score", "node", "label", "key", "_0", "_text", "spans", "length"]


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of document tables from (doc_id, text) rows, with extra columns of clashing names."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in CLASHING)
        return spark.createDataFrame([(d, t, None, "s", None, *(["x"] * len(CLASHING))) for d, t in rows], schema)

    return make
