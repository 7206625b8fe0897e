import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def docs(spark):
    """(doc_id, text) rows as a table with a column that clashes with names of the operators."""

    def build(rows, schema="doc_id long, text string, score string, n_words string"):
        return spark.createDataFrame([(i, t, "mine", "mine") for i, t in rows], schema)

    return build


WORDS = "the of and to in is that for with as was on are this it be at by an or river stone cloud paper green light house water".split()


@pytest.fixture(scope="session")
def prose():
    """Seeded prose of n words."""
    import random

    def build(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + r.choice(["", "", "", str(r.randrange(50))]) for _ in range(n))

    return build
