import pytest

#: Rows that every operator has to take: nulls, empty and blank texts, repeats, ties, clashing names.
ODD = [
    (1, None), (2, ""), (3, "   \n\n\t"), (4, "one two three four five six seven"), (4, "one two three four five six seven"), (5, "one two three four five six seven"),
    (6, "Ünïcode ß 中文 😀\u0000end"), (7, "x" * 3000), (8, "word " * 2500), (None, "no id at all here today"), (None, None), (9, "<|endoftext|> a b  c   d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    names = ["node", "size", "score", "ids", "packed", "rest", "words", "label", "group", "whole", "lane", "text2"]
    rows = [(i, t, *[None if k % 2 else k for k in range(len(names))]) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
