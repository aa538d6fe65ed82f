import pytest

CLASHES = "_id long, fp long, anchor string, component string, word string, _bucket string"


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with nulls, empty and long texts, copies, ties, repeated rows, and columns whose names clash."""
    base = " ".join(f"w{i}" for i in range(120))
    near = base.replace("w60", "x60")
    passage = "first line of the passage here\nsecond line of the passage here\nthird line of it"
    long_line = " ".join(f"shared{i}" for i in range(60))
    rows = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, "  \n\t "), (7, "one"), (8, "One two"),
        (9, f"alpha beta\n{passage}\ngamma delta"), (10, f"unlike\n{passage}\nother"), (11, f"a b c\n{long_line}\nd e f"),
        (12, f"g h i\n{long_line}\nj k l"), (None, base), (None, None), (13, "dup row text"), (13, "dup row text"),
        (14, "word " * 30_000), (15, "é ñ ß 漢字   x y"), (16, f"{long_line} {base}"), (17, "A-Z aBc\r\nline\x0bvt\x0cff"),
        (-5, "negative id"), (18, "<|endoftext|> it's  two  spaces\n\n\nthree"), (19, "x" * 5000),
    ]
    data = [(d, t, "en", "s", None if t is None else len(t), 7, 7, "q", "q", "q", "q") for d, t in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}").repartition(3)


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus.limit(0)
