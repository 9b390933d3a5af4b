"""Awkward documents: nulls, empty and long texts, ties, copies, extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", str(rng.randint(0, 99))]) for _ in range(n))


def documents(seed=1, n=40):
    rng = random.Random(seed)
    passage = prose(rng, 90)
    rows = []
    for i in range(n):
        kind = i % 8
        text = prose(rng, rng.randint(1, 160))
        if kind == 1:
            text = f"{text} {passage} {prose(rng, rng.randint(0, 60))}"
        elif kind == 2:
            text = rows[rng.randrange(len(rows))][1]
        elif kind == 3 and rows:
            words = (rows[rng.randrange(len(rows))][1] or "").split()
            if words:
                words[rng.randrange(len(words))] = "CHANGED"
            text = " ".join(words)
        elif kind == 4:
            text = rng.choice([None, "", " \n\t", "one", "ä ö\x0bü", "aaaa" * 400])
        rows.append((i * 3, text, rng.choice(["en", None]), rng.choice(["hot", "hot", "src1", None]), None, 0.5, "x"))
    rows.append((1, prose(rng, 30000), "en", "hot", 1, 0.1, "y"))
    rows.append(rows[5])
    return rows
