import random

import pytest


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, blanks, ties, repeated rows, one very long word, one very long text, many scripts."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 8)))
    base = " ".join(word() for _ in range(120))
    near = base.split()
    near[60] = "changed"
    shared = "this line is shared by many of the documents\n"
    return [
        (1, None),
        (2, ""),
        (3, " \n\t \x0b"),
        (4, "a b c"),
        (5, "A B C"),
        (6, base),
        (7, " ".join(near)),
        (8, base.upper()),
        (8, base.upper()),
        (9, "x" * 30_000),
        (10, "\n".join(" ".join(word() for _ in range(9)) for _ in range(2500))),
        (11, shared + "own one"),
        (12, " THIS line is shared by many of the documents \r\nown two"),
        (13, shared * 3),
        (14, "日本語のテキスト עברית العربية 😀 é é ß İ"),
        (15, "it's 12345 don't *** ### <|im_end|> 　x"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows with columns whose names the operators use themselves, and nulls in them."""
    names = ["n_lines", "n_dropped", "row", "key", "pos", "batch", "kind", "lang", "source", "token", "kept"]
    return spark.createDataFrame([(i, t, *[None if i % 2 else "z"] * len(names)) for i, t in edge_rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
