from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pack int, part int, score double"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(("ba", "ke", "mo", "ri", "tu", "zé", "LO")) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, near copies, shared passages, nulls, ties and odd texts, and columns with clashing names."""
    rng = random.Random(8)
    passage, line = sentence(rng, 70), sentence(rng, 12)
    texts: list[str | None] = [None, "", "   ", "a", "two words", line, "x" * 5000, "one two three four five", "one two three four five"]
    base = [sentence(rng, rng.randint(30, 260)) for _ in range(30)]
    texts += base + base[:4]
    for b in base[:12]:
        words = b.split(" ")
        for k in (1, 2, 9):
            w = list(words)
            for _ in range(k):
                w[rng.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    texts += [f"{sentence(rng, 40)} {passage} {sentence(rng, rng.randint(0, 60))}" for _ in range(6)]
    texts += [f"{line} {sentence(rng, 60)}" for _ in range(6)]
    texts.append(sentence(rng, 4000))
    texts.append("ab " * 400)
    rows = [(i * 3, t, "en", "s", None, 1, 2, 0.5) for i, t in enumerate(texts)]
    rows += [(rows[12][0], rows[12][1], "en", "s", None, 1, 2, 0.5)]  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist(), [(r[0], r[1]) for r in rows]


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
