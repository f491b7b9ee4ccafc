"""Documents with everything that goes wrong, and brute-force twins."""

import random
import re

LONG = " ".join(f"w{i % 977} x{i}" for i in range(20_000))
#: Columns whose names the operators use inside.
CLASHING = "id long, h long, key string, n int, line string, label string, component string, a int, text2 string"


def awkward(spark, texts=(), table=True):
    """doc_id, text, source and clashing columns: nulls, empty and very long texts, ties, repeated rows."""
    rows = [(1, None), (2, ""), (3, "one two three four five six seven eight nine ten. Eleven twelve."),
            (3, "one two three four five six seven eight nine ten. Eleven twelve."), (4, LONG), (5, LONG),
            (None, "a null id has words too. The rest of it."), (6, "   \n\t "), (7, "\n\n"), (8, "zwölf Boxkämpfer, 漢字 😀")]
    rows += [(100 + k, t) for k, t in enumerate(texts)]
    data = [(i, t, "src", 1, 2, "k", 3, "l", "b", "c", 4, "t") for i, t in rows] if table else []
    return spark.createDataFrame(data, f"doc_id long, text string, source string, {CLASHING}")


def invented(n, seed, words=40):
    rng = random.Random(seed)
    known = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return [" ".join(rng.choice(known) for _ in range(rng.randint(4, words))) for _ in range(n)]


def edited(text, rng, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(10**6))
    return " ".join(words)


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def groups(ids, links):
    """The smallest member of each id's group."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
