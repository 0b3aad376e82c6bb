"""Small tables with every awkward case, and plain restatements of the operators' contracts."""

import random

WORDS = "the cat sat on a mat and dog ran to an old red house near green hill with nine blue birds".split()


def texts():
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    base, passage, long = say(120), say(60), say(9000)
    edited = base.split()
    edited[7], edited[80] = "CHANGED", "too"
    out = [base, " ".join(edited), base, passage + " " + say(50), say(40) + "\n" + passage, "", None, "   \t ", "word", "Two words", "é" * 60 + " ü\x0bß " + "é" * 60, long, say(30) + " " + long[:4000], "a " * 400, base.upper()]
    return out + [say(rng.randrange(1, 90)) for _ in range(20)] + [passage] * 3


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard_id long, size long, n long, label string, rank int, _h long"


def documents(spark, rows=None):
    """Columns that operators might use within, under the same names, come with other values."""
    rows = [(i, t) for i, t in enumerate(texts())] if rows is None else rows
    return spark.createDataFrame([(i, t, "en", None if k % 7 == 3 else f"s{k % 3}", len(t or ""), 7, 7, 7, "x", 7, 7) for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


def components(nodes, links):
    at = {x: x for x in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}
