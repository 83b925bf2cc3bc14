import random

import pytest


@pytest.fixture(scope="session")
def awkward():
    """(id, text) rows with nulls, blanks, repeats, copies, near copies and one long text."""
    r = random.Random(5)
    words = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(60)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = say(300), say(60)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "two words"), (7, base), (8, base), (8, base), (9, base + " tail"), (10, base.upper())]
    rows += [(20 + i, say(r.randrange(1, 40)) + "\n" + passage + "\n" + say(r.randrange(1, 40))) for i in range(12)]
    rows += [(60 + i, base.replace("word3 ", f"x{i} ")) for i in range(10)]
    rows += [(90, say(4000)), (91, "aa " * 500), (92, "\n\n" + say(5) + "\n" + say(5) + "\n"), (93, "ÀÉ ñandú — 漢字 😀 é")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame([(i, t, "en", "s", 1, "extra") for i, t in awkward], "doc_id long, text string, lang string, source string, n_chars long, k string").repartition(3)
