import pytest
from tokenizers import Tokenizer

from panelmark.llm.tokens import default_path


@pytest.fixture(scope="session")
def library():
    return Tokenizer.from_file(default_path())


@pytest.fixture(scope="session")
def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


LONG = "".join(f"Word{k % 977} of{k % 13} a {k * k % 10007}.\n" for k in range(30_000))
#: (doc_id, text): nulls, empty, blank and very long texts, ties, copies, repeated rows, ids that repeat.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One  two"), (6, "one two"), (7, "a b c d e f g"), (8, "A B C\td e f g"), (8, "A B C\td e f g"),
    (9, LONG), (10, LONG + " tail"), (None, "a b c d e f g"), (None, None), (11, "mail x.y@z.example, call +1 (222) 555-0100 é\U0001f600 4111 1111 1111 1111 10.0.0.255"),
    (12, "<|endoftext|> don't  stop"), (12, "another text under one id"),
]
#: Names the operators use themselves, and one that is reserved in SQL.
CLASH = "id long, kept boolean, node string, spans string, select string, n_words int"


@pytest.fixture(scope="session")
def odd(spark):
    """ODD with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 0, True, "n", "s", "x", 1) for r in ODD], f"doc_id long, text string, {CLASH}").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
