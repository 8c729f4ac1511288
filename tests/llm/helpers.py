"""Small documents with the awkward cases."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, letters="aeioustrnl"):
    out = []
    for k in range(n):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
        out.append(w.capitalize() if k % 9 == 0 else w)
        if k % 9 == 8:
            out[-1] += ".\n" if k % 27 == 26 else "."
    return " ".join(out) + "."


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    """Rows of documents: nulls, empty and white texts, exact and near copies, shared passages, one very long text."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append([i, prose(rng, rng.randint(20, 160)), "en" if i % 3 else "de", f"s{i % 5}"])
    base = rows[7][1]
    rows.append([n, base, "en", "s1"])
    rows.append([n + 1, base, "de", None])
    near = base.split(" ")
    near[len(near) // 2] = "changed"
    rows.append([n + 2, " ".join(near), "en", "s1"])
    shared = prose(rng, 70)
    for k in range(5):
        rows.append([n + 3 + k, prose(rng, 40) + " " + shared + " " + prose(rng, 40), "en", "s2"])
    rows += [[n + 8, None, "en", "s3"], [n + 9, "", None, "s3"], [n + 10, " \n\t ", "en", "s4"], [n + 11, "one", None, "s4"], [n + 12, "one", "en", None], [n + 13, prose(rng, 9000), "de", "s0"], [n + 14, "ein kurzer Text", "de", "s0"]]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]
