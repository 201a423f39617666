import random

import pytest

from labelforge.llm.queries import tokenizer_json

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot int, kept string, _text string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    parts = ["the", "of", "tion", "er", "an", "in", "ble", "ou", "re", "é", "zu"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """doc_id, text: copies, near copies, a shared passage, odd texts."""
    r = random.Random(7)
    passage = prose(99, 60)
    rows = [(i, prose(i, 80)) for i in range(40)]
    rows += [(100 + i, prose(3, 80)) for i in range(6)]  # copies
    rows += [(200 + i, prose(5, 400).replace(" ", f" x{i} ", 1)) for i in range(8)]  # near copies
    rows += [(300 + i, prose(300 + i, 10) + "\n" + passage + "\n" + prose(400 + i, 10)) for i in range(8)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "a"), (504, "one two three"), (505, "日本語" * 50), (506, "x" * 5000),
             (507, "<|endoftext|> a<|endoftext|>b  c"), (508, "word " * 300), (None, prose(1, 80)), (None, None),
             (510, "!!! *** $$$ &&& <> ## %% || " * 20), (511, "Line one\nLine one\nLINE ONE\n\n\n x"), (512, "tab\tand\x0bmore\x0cspace\r\nend\x85 \xa0 nbsp")]
    rows += [rows[0], (0, "another text of document zero " + prose(77, 30))]  # a repeated row, a repeated id
    rows.append((900, prose(900, 30000)))  # very long
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    data = [(i, t, "en" if (i or 0) % 2 else "de", "s", len(t or ""), 7, "k", "other") for i, t in texts]
    return spark.createDataFrame(data, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    return tokenizer_json()
