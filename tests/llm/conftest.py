import random

import pytest

WORDS = "alpha beta gamma delta river stone cloud paper light green seven under house train music ocean".split()


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)) + "."


#: Null, empty, white space, one word, other scripts, marks, a very long text, controls.
ODD_TEXTS = [None, "", " \t\n", "word", "日本語 テキスト é", "▁a  b", "x " * 60_000, "A\x00b c", prose(1), prose(1)]


@pytest.fixture
def odd(spark):
    """Odd texts with a null key, a repeated row, and columns that clash with results and working names."""
    rows = [(None if i == 3 else i, t, "en") for i, t in enumerate(ODD_TEXTS)]
    rows.append(rows[8])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clashes = "shard slot _block f_words kept quality score lang_pred token_ids n_tokens component_id _fp _text matches n_words contaminated secret_spans severity toxic held_out _id _row _order n".split()
    return df.withColumns({c: df["doc_id"].cast("string") for c in clashes})


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
