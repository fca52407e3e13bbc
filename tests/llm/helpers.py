"""Fixtures shared by the tests of the corpus operators."""

from __future__ import annotations

import random

WORDS = "the of and to in that is was for on with as at by an be this from or have".split()
SCHEMA = "doc_id long, text string, source string, lang string, kept string, n long, h string, _k1 string"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Rows (doc_id, text, source, lang and columns whose names the operators use)
    with copies, near copies, shared passages and every edge case."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(WORDS) + rnd.choice(["", "", "ing", "er", "é"])
    passage = " ".join(word() for _ in range(40))
    texts: list[str | None] = []
    for i in range(n):
        words = [word() for _ in range(rnd.choice([1, 2, 3, 5, 30, 80, 200]))]
        text = " ".join(words)
        if i % 5 == 0 and len(words) > 20:
            text = text[:50] + "\n" + passage + "\n" + text[50:]
        texts.append(text)
    for i in range(12):  # copies, with other white space, and copies with one word changed
        words = texts[rnd.randrange(n)].split(" ")
        texts.append("\t".join(words) if i % 3 else " ".join(words))
        words[rnd.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += ["", None, " \t\n", "x", "\n\n", "A b\nThe Line\n the line \nÄ\nä", passage, passage.upper(),
              " ".join(word() for _ in range(9000)), "aaaa" * 300, "aaaa" * 301, "é" * 90, "é" * 91]
    texts += ["Shared line\n" + str(i) for i in range(11)] + [" shared LINE \n\r" + str(i) for i in range(3)]
    ids: list[int | None] = list(range(len(texts)))
    rnd.shuffle(ids)
    rows = [(i, t, rnd.choice(["a", "a", "b", "c", None]), rnd.choice(["en", None]), "x", i, "h", "k")
            for i, t in zip(ids, texts)]
    return rows


def odd_rows(rows: list[tuple]) -> list[tuple]:
    """Rows with null ids, and whole rows that repeat."""
    return [*rows, (None, "x", None, None, None, None, None, None), (None, None, None, None, None, None, None, None),
            rows[3], rows[3], rows[7]]


def frame(spark, rows: list[tuple], schema: str = SCHEMA):
    return spark.createDataFrame(rows, schema)
