import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words int, label string"


@pytest.fixture(scope="session")
def corpus():
    """Documents with every odd case: nulls, empty and very long texts, copies, near copies, shared passages, repeated rows, ids twice or missing. The last two columns clash with names that operators use."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgéñß") for _ in range(r.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(70), text(120).split()
    texts = [text(r.randint(5, 150)) for _ in range(25)]
    texts += [texts[3], texts[3], f" {texts[3]}\n"]
    texts += [f"{text(20)} {passage} {text(30)}" for _ in range(5)] + [passage]
    for _ in range(6):
        near = list(base)
        near[r.randrange(len(near))] = word()
        texts.append(" ".join(near))
    texts += [None, "", " \t\n\v\f\r", "one", "one two three", "One Two THREE", text(20_000), "a\u00a0b c\u2003d", "line x\nline x\nline x\n\nother", "$$$ ### " * 30]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "b", None]), len(t or ""), 1, "x") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[5], "en", "a", 3, None, None), (None, texts[30], None, None, None, None, None), (2, text(80), "en", "b", 1, 1, "x")]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, fold=False):
    data = (text or "").encode()
    return (data.lower() if fold else data).split()


def key(row):
    """Rows in an order, nulls among them."""
    return tuple((x is not None, x) for x in row)
