import random
import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names operators use inside.
CLASHING = "id bigint, row string, text_key string, _id int, _key string, listed string, gone string, own string, kept string, score string, fp string, copy_no string, digest string, kind string, __mix_u string, _len string, key string".split(", ")


def awkward_rows(seed=4):
    """Nulls everywhere, empty and long texts, ties, repeated rows, copies and shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdeilnorstu") for _ in range(rng.randint(1, 7)))
    passage = [word() for _ in range(80)]
    texts = [None, "", " \n\t ", "one", "two words", "Σ ΑΣ don't <|endoftext|> ÅÅ 12", "x" * 3000, " ".join(["the same"] * 400)]
    for k in range(30):
        own = [word() for _ in range(rng.randint(10, 140))]
        if k % 3 == 0:
            own[5:5] = passage[rng.randint(0, 10) : rng.randint(62, 80)]
        texts.append(rng.choice([" ", "\n", "  "]).join(own))
    texts += texts[8:14] + texts[10:12] + [texts[9] + " more", "\n".join(word() for _ in range(60_000))]
    rows = [(k, t, rng.choice(["en", None]), rng.choice(["big", "big", "small", None]), None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, texts[9], None, "big", 1), (None, None, None, None, None), (12, "another text under the same id", "en", "small", None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The awkward rows with extra columns of clashing names."""
    from pyspark.sql import functions as F

    plain = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return plain.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def now():
    return datetime(2024, 1, 1)
