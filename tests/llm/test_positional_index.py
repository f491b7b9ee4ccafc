import random
import re

from pyspark.sql import functions as F

from gridloom.llm import positional_index as pi
from tests.llm.support import CLASHING, awkward, invented

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(text, length):
    ws = split(text)
    return {tuple(ws[i:i + length]) for i in range(max(1, len(ws) - length + 1))} if ws else set()


def by_hand(texts, items, length, within):
    """Per text: n_words, words hit, items by phrase, items by near match."""
    out = []
    for text in texts:
        ws, hit, exact, near = split(text), set(), set(), set()
        for item, body in items:
            for phrase in windows(body, length):
                for i in range(len(ws) - len(phrase) + 1):
                    if tuple(ws[i:i + len(phrase)]) == phrase:
                        hit.update(range(i, i + len(phrase)))
                        exact.add(item)
                if any(set(phrase) <= set(ws[i:i + within]) for i in range(len(ws))):
                    near.add(item)
        names = [sorted(str(i) for i in found if i is not None) for found in (exact, near)]
        out.append((len(ws), sorted(hit), *names))
    return out


def check(spark, docs, items, length=10, within=12):
    found = pi.contamination(docs, items, length, within).collect()
    texts = [r.text for r in docs.collect()]
    held = [(r.item_id, r.text) for r in items.collect()]
    want = by_hand(texts, held, length, within)
    got = [(r.n_words, [k for s in r.spans for k in range(s.begin, s.end)], r.items, r.near_items) for r in found]
    ids = [r.doc_id for r in docs.collect()]
    key = lambda x: repr(x)
    assert sorted(zip([r.id for r in found], got, strict=True), key=key) == sorted(zip(ids, want, strict=True), key=key)
    return found


def bench(spark, rows):
    return spark.createDataFrame([(i, t, *[None] * 9) for i, t in rows], f"item_id long, text string, {CLASHING}")


def corpus(seed):
    rng = random.Random(seed)
    items = [(k, t) for k, t in enumerate(invented(25, seed, 30))]
    items += [(100, None), (101, ""), (102, "!!! ..."), (None, items[3][1]), (103, items[3][1]), (3, items[4][1]), (104, "Two words"),
              (105, "ha ha ha ha ha ha ha ha ha ha ha ha"), (106, "Zwölf Boxkämpfer 漢字 İstanbul naïve")]
    texts = invented(60, seed + 1, 80)
    for k in range(40):
        body = split(items[rng.randrange(25)][1])
        cut = body[rng.randrange(3):]
        if k % 3 == 1:
            rng.shuffle(cut)
        texts[k] = texts[k] + " " + "-".join(w.upper() if k % 2 else w for w in cut) + ". " + texts[k + 1]
    return texts + ["ha " * 40, "two, WORDS", "words two", "zwölf boxkämpfer 漢字! İstanbul Naïve", "w" * 5000], items


def test_exact_and_near_matches_against_brute_force(spark):
    texts, items = corpus(5)
    found = check(spark, awkward(spark, texts), bench(spark, items))
    assert sum(bool(r.items) for r in found) > 15 and any(r.near_items and not r.items for r in found)


def test_blocks_and_slices_change_nothing(spark, monkeypatch):
    texts, items = corpus(9)
    docs, held = awkward(spark, texts).where("doc_id is null or doc_id not in (4, 5)"), bench(spark, items)
    whole = {(r.id, str(r)) for r in check(spark, docs, held, 6, 8)}
    monkeypatch.setattr(pi, "BLOCK", 100)
    monkeypatch.setattr(pi, "SLICE", 40)
    assert {(r.id, str(r)) for r in check(spark, docs, held, 6, 8)} == whole


def test_empty_tables(spark):
    texts, items = corpus(2)
    docs, held = awkward(spark, texts[:5]), bench(spark, items)
    assert pi.contamination(awkward(spark, table=False), held).count() == 0
    none = pi.contamination(docs, bench(spark, [])).collect()
    assert len(none) == docs.count() and all(not r.items and not r.spans and not r.near_items for r in none)
    assert sum(r.n_words for r in none) == sum(len(split(r.text)) for r in docs.collect())


def test_a_map_that_is_full_only_stores_more_lists(spark, monkeypatch):
    texts, items = corpus(3)
    docs, held = awkward(spark, texts[:30]).where(F.length("text") < 5000), bench(spark, items)
    want = {str(r) for r in pi.contamination(docs, held, within=None).collect()}
    monkeypatch.setattr(pi, "MARKS", 1)
    assert {str(r) for r in pi.contamination(docs, held, within=None).collect()} == want
