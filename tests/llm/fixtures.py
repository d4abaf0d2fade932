"""Small tables that hold every awkward case."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long, line string, id long, key string"


def sentence(rng, n, words="tion the hend erth wheous en ly aned onor ble stin ar dum fel gra".split()):
    return " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))


def awkward_docs(spark, n=40, seed=1, with_null_id=True):
    """Documents with copies, near copies, nulls, blanks, a long text, repeated rows, ties
    and columns whose names clash with those that operators use inside."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "\n".join(sentence(rng, rng.randrange(5, 25)) for _ in range(rng.randrange(1, 6)))
        rows.append((i, text))
    rows += [(n, rows[0][1]), (n + 1, rows[1][1].replace("the", "tha", 1)), (n + 2, None), (n + 3, ""), (n + 4, " \n\t\n "),
             (n + 5, "one"), (n + 6, sentence(rng, 4000)), (n + 7, rows[2][1] + "\n" + rows[3][1]), (n + 8, "x" * 5000), (n + 9, rows[4][1]), (n + 9, rows[4][1])]
    if with_null_id:
        rows += [(None, rows[5][1]), (None, None)]
    return spark.createDataFrame([(i, t, "en", "src0" if (i or 0) % 3 == 0 else f"src{i}", None if t is None else len(t), "l", 7, "k") for i, t in rows], DOC)


def empty_docs(spark):
    return spark.createDataFrame([], DOC)
