"""Small awkward tables and brute-force versions that the tests hold the operators against."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use inside, as extra columns of their input
CLASHING = ["size", "row", "node", "key", "words", "kept", "rank", "n", "_id", "_text", "place", "stratum", "target", "hash", "ids"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("alpha beta gamma delta rho sigma tau phi chi psi omega lamp tree road stone water".split()) + str(rng.randint(0, 30)) for _ in range(n))


def awkward_docs() -> list[tuple]:
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, exact and near copies, shared lines."""
    rng = random.Random(7)
    base = [sentence(rng, n) for n in (3, 9, 40, 60, 60, 200)]
    near = base[4].split()
    near[30] = "changed"
    shared = sentence(rng, 12)
    edited = shared.split()
    edited[5] = "edited"
    rows = [(i, t, rng.choice(["en", "de"]), rng.choice(["b", "a", "c"]), len(t)) for i, t in enumerate(base)]
    rows += [
        (10, base[2], "en", "a", 1), (11, base[2], "en", "b", 1), (12, " ".join(near), "en", "a", 1), (13, "", "en", "a", 0),
        (14, " \n\t\x0b ", "en", "a", 5), (15, None, "en", "a", None), (16, "x", None, None, 1), (None, base[3], "en", "a", 1),
        (17, base[5], "en", "a", 1), (17, base[5], "en", "a", 1), (18, shared + "\n" + sentence(rng, 20), "en", "c", 1),
        (19, sentence(rng, 20) + "\n" + shared, "en", "c", 1), (20, " ".join(edited) + "\n\n" + sentence(rng, 15) + "\n", "de", "c", 1),
        (21, "\n".join([shared] * 4 + [sentence(rng, 10)]), "de", "c", 1), (22, "Zoë 漢字 Kelvin İ \U0001F600 <|endoftext|> it's  two   blanks", "fr", "é", 1),
        (23, sentence(rng, 3000), "en", "a", 1), (24, "z" * 5000, "en", "b", 1), (25, (" ".join(["again and again the same five"] * 30)), "en", "b", 1),
        (26, "Released under the MIT License. MIT LICENSE; apache-license", "en", "b", 1), (-5, sentence(rng, 25), "en", "a", 1),
    ]
    return rows


def documents(spark, rows=None, extra: bool = True):
    df = spark.createDataFrame(awkward_docs() if rows is None else rows, DOCS)
    if extra:
        for c in CLASHING:
            df = df.selectExpr("*", f"'clash' AS `{c}`")
    return df.repartition(3)
