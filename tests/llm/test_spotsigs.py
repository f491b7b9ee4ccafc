import random
import re

from pyspark.sql import functions as F

from gridloom.llm import spotsigs
from tests.llm.support import awkward, edited, groups, invented


def by_hand(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    content = [w for w in words if w not in spotsigs.COMMON_WORDS]
    found, k = set(), 0
    for w in words:
        if w not in spotsigs.COMMON_WORDS:
            k += 1
        elif k + spotsigs.CHAIN <= len(content):
            found.add(" ".join([w, *content[k:k + spotsigs.CHAIN]]))
    return found


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(w if rng.random() > 0.3 else rng.choice(["the", "of", "und", "la"]) for w in t.split()) for t in invented(n, seed)]


def test_signatures_by_hand(spark):
    docs = awkward(spark, [*texts(100, 5), "The, the! A-of x y z the"])
    rows = docs.select("text", spotsigs.signatures(F.col("text")).alias("s")).collect()
    for r in rows:
        want = by_hand(r.text)
        assert len(r.s) == max(1, len(want)) and r.s == sorted(r.s)
    same = {}
    for r in rows:
        same.setdefault(r.text or "", set()).add(tuple(r.s))
    assert all(len(x) == 1 for x in same.values())


def test_next_documents_and_likeness(spark):
    docs = awkward(spark, texts(60, 6))
    rows = spotsigs.edited_fingerprints(docs).collect()
    order = sorted({(-(1 << 63) if r.doc_id is None else r.doc_id, r.text) for r in rows}, key=lambda x: -x[0])
    assert len(rows) == docs.count()
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    for r in rows:
        nxt = following[(-(1 << 63) if r.doc_id is None else r.doc_id, r.text)][1]
        k = len(r.text) // 3
        assert r.n_chars == len(r.text)
        assert r.edited == r.text[:len(r.text) - k] + nxt[:k]
    assert spotsigs.edited_fingerprints(awkward(spark, table=False)).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(8)
    base = texts(40, 9)
    every = base + [edited(t, rng, 1) for t in base for _ in range(2)] + base[:5]
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    sets = {}
    for k, t in enumerate(every):
        sets.setdefault(frozenset(by_hand(t)) or t, k)
    own = [(i, s) for s, i in sets.items() if isinstance(s, frozenset)]
    want = {(i, j) for i, a in own for j, b in own if i < j and len(a & b) >= 0.6 * len(a | b)}
    got = {(r.a, r.b) for r in spotsigs.near_duplicates(docs, 0.6).collect()}
    assert got == want and len(want) > 20
    assert groups(range(3), [(1, 2)]) == {0: 0, 1: 1, 2: 1}
