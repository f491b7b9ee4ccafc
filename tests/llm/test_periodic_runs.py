import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import periodic_runs as pr
from tests.llm.support import CLASHING, LONG, awkward


def by_hand(words, least=24, times=3):
    """Every widest stretch with smallest period q, looked for period by period."""
    found = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, times * q) and not any(
                    all(words[x] == words[x + r] for x in range(i, i + size - r)) for r in range(1, q)):
                found.append((i, size, q))
            i = j if j > i else i + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept(words, runs):
    gone = {k for start, size, q in runs for k in range(start + q, start + size)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_runs_against_brute_force():
    rng = random.Random(4)
    for _ in range(1500):
        n = rng.randrange(70)
        words = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(max(n, 1)), rng.randrange(1, 12)
            for i in range(at + p, min(n, at + rng.randrange(1, 50))):
                words[i] = words[i - p]
        for least, times in ((24, 3), (5, 3), (1, 4)):
            got = [x.tolist() for x in pr.find_runs(np.array(words, np.int64), least, times)]
            assert list(zip(*got, strict=True)) == by_hand(words, least, times)


def repeating(rng, n, p):
    own = [f"w{rng.randrange(50)}" for _ in range(p)]
    return [own[k % p] for k in range(n)]


def test_texts_with_runs_and_awkward_rows(spark):
    rng = random.Random(8)
    texts = ["  ".join(repeating(rng, rng.randrange(20, 300), rng.randrange(1, 30)) + [f"x{k}" for k in range(rng.randrange(9))]
                       + repeating(rng, rng.randrange(0, 90), 7)) for _ in range(60)]
    texts += ["a\x1fb\x85c " * 30, "ha " * 23, "ha " * 24, "a b " * 11, "　 " * 40, " ".join(["tick tock"] * 60_000)]
    docs = awkward(spark, texts).withColumn("periodic", F.lit(1))
    got = pr.collapse(docs, into="found")
    assert got.columns == [*docs.columns, "found"]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        words = split(r.text)
        if len(words) < 100_000:
            want = by_hand(words) if len(words) < 2_000 else []
            assert [tuple(x) for x in r.found.runs] == want, r.doc_id
            assert r.found.collapsed == kept(words, want)
        else:
            assert [tuple(x) for x in r.found.runs] == [(0, 120_000, 2)] and r.found.collapsed == "tick tock"
        assert r.found.n_words == len(words)
    assert by_hand(split(LONG)[:1900]) == []
    assert pr.collapse(awkward(spark, table=False)).count() == 0


def test_strongest_run_compares_whole_fractions(spark):
    runs = [[(0, 30, 10), (2, 33, 11), (5, 61, 20)], [(9, 30, 10), (2, 30, 10)], [], [(0, 24, 1), (30, 48, 2)]]
    rows = spark.createDataFrame([(sorted(r),) for r in runs], "runs array<struct<start:long,length:long,period:long>>")
    got = [r.best and tuple(r.best) for r in rows.select(pr.strongest(F.col("runs")).alias("best")).collect()]
    want = [max(r, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if r else None for r in runs]
    assert got == want


def test_repetition_written_by_rule(spark):
    texts = [" ".join(f"t{k}" for k in range(n)) for n in range(200)]
    docs = spark.createDataFrame([(k, t, *[None] * 9) for k, t in enumerate(texts)] + [(None, "a b", *[None] * 9)],
                                 f"doc_id long, text string, {CLASHING}")
    changed = 0
    for r in pr.repeated_by_rule(docs).collect():
        words = split(texts[r.doc_id]) if r.doc_id is not None else ["a", "b"]
        h = zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        assert split(r.text) == words
    assert changed > 10 and pr.repeated_by_rule(docs).columns == docs.columns
