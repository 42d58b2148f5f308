"""Small tables with every awkward case, and plain versions of definitions."""

import random
import re

CLASHES = "id string, hash string, part string, dest string, kind string, data string, n string, signature string, keys string, label string, score string, range string, copy string, component string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def lower(text):
    return (text or "").translate(_LOWER)


def table(spark, rows, schema="doc_id long, text string, lang string"):
    """Rows with columns whose names an operator may use itself."""
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *[None] * (width - len(r)), *["x"] * 14) for r in rows], f"{schema}, {CLASHES}")


def prose(seed, n, words=60, vocabulary=400):
    """Texts with copies, near copies, shared passages, edge cases and repeated rows, by id."""
    rng = random.Random(seed)
    names = ["".join(rng.choice("abdeéghikÄlmnorstu") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
    passage = " ".join(rng.choice(names) for _ in range(35))
    texts = []
    for k in range(n):
        w = [rng.choice(names) for _ in range(rng.randint(1, words))]
        if k % 4 == 1:
            w = texts[rng.randrange(k)].split() or w
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(names)
        if k % 5 == 2:
            w[rng.randint(0, len(w)) : 0] = passage.split()
        texts.append(rng.choice([" ", "  ", "\n", "\t "]).join(w))
    texts += ["", None, "   \n\t", "One", "one", "A b c", "a B c", " ".join(["same"] * 90), names[0] * 3000, " ".join(rng.choice(names) for _ in range(5000)), "▁odd▁  marks 😀"]
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    return rows
