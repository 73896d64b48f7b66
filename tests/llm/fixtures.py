"""Small hand-made tables with the awkward cases: nulls, blanks, ties, repeated rows, clashing names."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, word string, h long"


def words(n, seed, of=400):
    r = random.Random(seed)
    return [f"w{r.randrange(of)}" for _ in range(n)]


def documents():
    a, b = words(120, 1), words(90, 2)
    shared = words(55, 3)
    texts = {
        1: None, 2: "", 3: " \n\t ", 4: "one", 5: "two words", 6: " ".join(a), 7: " ".join(a), 8: " ".join([*a[:50], "odd", *a[51:]]),
        9: " ".join(b) + "\n" + " ".join(shared), 10: "x " + " ".join(shared) + " y", 11: "der " * 60, 12: "der  der\n" * 15,
        13: "Ünïcode words stay  one " * 8, 14: "line a b c\nline a b c\n\nline a b c\nother", 15: "### $$$ %%% a|b <c> & " * 5,
        16: " ".join(words(9000, 4, 3000)), 17: " ".join(shared[:20]), 18: " ".join(shared[1:20]), 19: " ".join(
            [*words(30, 6), *shared[10:40], *words(30, 7)]
        ),
    }
    rows = [(k, t, "en", f"s{k % 3}" if k % 5 else None, None, 1, "x", 2) for k, t in texts.items()]
    rows += [rows[5], rows[5], rows[8], (None, " ".join(a), None, None, None, 1, "x", 2), (None, None, None, None, None, 1, "x", 2)]
    return rows


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
