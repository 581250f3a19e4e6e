import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and ring shell tower quiet amber copper willow river stone lantern harbor meadow velvet thunder orchid granite whisper".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty, blank, long and repeated texts, ties and copies."""
    rng = random.Random(7)
    long = " ".join(rng.choice(WORDS) for _ in range(60_000))
    base = " ".join(f"w{i}" for i in range(120))
    near = base.replace("w60 ", "x ")
    rows = [
        (5, None, "en", "s", 0), (3, "", "en", "s", 0), (8, " \n\t ", None, None, None), (1, long, "en", "s", 1), (2, base, "en", "t", 1), (4, near, "en", "t", 1), (6, base, "fr", "t", 1),
        (7, "Naïve café 漢字 🎉 é don't I'll 12 3.5", "fr", None, 1), (9, "word", "en", "s", 1), (9, "word", "en", "s", 1), (None, "no id here at all", "en", "s", 1), (10, "a b c", "en", "u", 1), (11, "12 345 --", "en", "u", 1), (100, near, "en", "u", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with columns named as operators name theirs."""
    names = "lang_pred score coverage epoch mix_order n_email id d1 block token fp bucket seq units level part ids _text _row held_out".split()
    return odd.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
