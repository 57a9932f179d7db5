import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, shared passages, nulls, empty, long and repeated ones."""
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("the", "er", "on", "Ñan", "re", "ing", "st", "|") for b in ("a", "is", "ed", ".", ",", "")]
    prose = lambda n: " ".join(rng.choices(words, k=n)) + rng.choice(["", "\n", "\t x"])
    passage = prose(60)
    texts = [prose(rng.randint(1, 150)) for _ in range(60)]
    texts += [prose(30) + " " + passage + "\n" + prose(30) for _ in range(12)]
    texts += [texts[3]] * 15 + [texts[5] + " tail"] * 3 + [None, "", " \n\t ", "word", "two words", "a b a b a b " * 40, prose(8000), "x" * 5000, " \x1fodd\x85space\xa0here"]
    rows = [(i, t, "en", rng.choice(["s0", "s0", "s1", None]), 0) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[0], rows[1], (None, "no id here", "en", "s1", 0), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    # columns with names that operators use inside
    return spark.createDataFrame([(*r, 1, 2, 3) for r in corpus], DOC + ", k1 int, fp int, start int").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
