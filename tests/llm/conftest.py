import random

import pytest

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur über naïve 日本".split()


def corpus(seed: int = 5, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared lines and passages, odd texts, nulls."""
    rnd = random.Random(seed)
    say = lambda k: " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "", ",", "."]) + str(rnd.randint(0, 30)) for _ in range(k))
    shared, short = say(70), say(6)
    out: list[tuple] = []
    for i in range(n):
        kind = i % 10
        if kind == 3 and out:
            text = out[rnd.randrange(len(out))][1]  # a copy
        elif kind == 4:
            words = say(60).split()
            out.append((1000 + i, " ".join(words), "en", "s", 0))
            words[rnd.randrange(60)] = "changed"
            text = " ".join(words)
        elif kind == 5:
            text = f"{say(5)}\n{shared}\n\n{say(20)}\n{short}"
        elif kind == 6:
            text = f"{say(9)} {shared[:260]} {say(3)}\n{say(55)}\n{say(3)}"
        elif kind == 7:
            text = rnd.choice(["", None, " ", "\n\n", "a", "a a a a a a", "x" * 400, "ab" * 300, "日本" * 90, "<|endoftext|> x  y\n \n z"])
        else:
            text = "\n".join(say(rnd.randint(1, 40)) for _ in range(rnd.randint(1, 6)))
        out.append((i, text, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(text or "")))
    out.append((2000, "\n".join(say(30) for _ in range(300)), "en", "long", 0))
    out.append((None, say(80), None, None, None))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
