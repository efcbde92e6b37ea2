"""Small tables with the awkward rows every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, extra string"


def documents(spark, n=60, seed=1):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma,", "delta", "épsilon", "zeta.", "eta", "theta", "iota", "kappa", "λ", "mu"]
    passage = " ".join(rng.choice(words) + str(i % 7) for i in range(70))
    line = "A line that many documents share."
    rows = []
    for i in range(n):
        body = " ".join(rng.choice(words) for _ in range(rng.choice([3, 20, 80])))
        if i % 3 == 0:
            body += " " + passage + " " + rng.choice(words)
        if i % 4 == 0:
            body += "\n" + ("  " + line.upper() if i % 8 else line) + "\nshort\n" + body[:30]
        rows.append((i, body))
    rows += [(n + k, rows[5][1]) for k in range(4)]  # exact copies
    rows += [(n + 10 + k, rows[6][1].replace("eta", "ETA", 1) + " x") for k in range(3)]  # near copies
    rows += [(n + 20, None), (n + 21, ""), (n + 22, " \n\t "), (None, rows[3][1]), (n + 23, "one"), (7, rows[7][1]), (n + 24, "long " * 20000)]
    rng.shuffle(rows)
    return spark.createDataFrame([(i, t, None if k % 5 == 0 else "en", None if k % 9 == 0 else f"src{k % 3}", None if t is None else len(t), 0.5, "x") for k, (i, t) in enumerate(rows)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
