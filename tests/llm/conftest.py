import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rnd, n, alphabet="abcdefgh"):
    return [rnd.choice(alphabet) + rnd.choice("aeiou") + rnd.choice(alphabet) * rnd.randrange(1, 3) for _ in range(n)]


def make_rows():
    """Copies, near copies, a shared passage, empty, null, short and long texts, white space, odd characters."""
    rnd = random.Random(11)
    base = words(rnd, 120)
    passage = words(rnd, 60)
    texts = [None, "", " ", "\n\t ", "one", "One  ", "a b c d", "A b\tc d", "a b c d e", "a b c d e f", "x" * 70_000, "é ñ ü 🙂 　 ▁ \x00 tail", "1.2.3.4 4111 1111 1111 1111 +1 (202) 555-0199 joe@x.org"]
    texts += [" ".join(base)] * 5 + ["  ".join(base), " ".join(base).upper()]
    for i in range(40):
        w = list(base)
        for _ in range(i % 12):
            w[rnd.randrange(len(w))] = rnd.choice(base) + str(i)
        texts.append(" ".join(w))
    for i in range(30):
        texts.append(" ".join(passage + words(rnd, rnd.randrange(5, 60))))
    texts += [" ".join(words(rnd, rnd.randrange(1, 400))) for _ in range(60)]
    texts += [" ".join(words(rnd, 20_000))]
    return [(i, t, (None, "en", "de", "fr")[i % 4], None if i % 17 == 0 else f"s{min(i % 9, 4)}", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """docs with columns named as the operators' own."""
    extra = "rep n h k kept keep_id group_size score lang_pred component_id __gone __id __position bucket slot block spans media item_id url canonical t u r".split()
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit("x").alias(c) for c in extra))


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(i, None if i % 13 == 0 else int(i % 5 > 0), 0) for i in range(0, len(rows), 2)] + [(None, 1, 0), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
