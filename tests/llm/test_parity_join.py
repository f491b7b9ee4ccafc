import random

import numpy as np

from gridloom.llm import parity_join
from tests.llm.support import awkward, edited, groups, invented, shingle_set


def by_hand(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows}
    links = [(i, j) for i, a in sets.items() for j, b in sets.items()
             if i < j and a and b and 100 * len(a & b) >= percent * len(a | b)]
    return {i: (len(sets[i]), c) for i, c in groups(sets, links).items()}


def test_against_all_pairs(spark):
    rng = random.Random(4)
    base = invented(60, 11, words=120)
    texts = base + [edited(t, rng, rng.randint(1, 4)) for t in base for _ in range(3)] + base[:10] + ["", "a", "A", "a b", "a  b"]
    # a large group of near copies of each other
    texts += [edited(base[0], rng, 1) for _ in range(150)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for k, percent in ((4, 85), (5, 80), (2, 50)):
        got = {r.id: (r.n_shingles, r.component_id) for r in parity_join.similar(docs, k, percent).collect()}
        assert got == by_hand(rows, k, percent)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = parity_join.similar(docs).collect()
    assert len(rows) == docs.count()
    got = {(r.id, r.n_shingles > 0): r.component_id for r in rows}
    assert got[5, True] == 4 and got[1, False] == 1 and got[None, True] is None and got[6, False] == 6
    kept = parity_join.first_of_groups(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, None, 6, 7, 8]))
    assert parity_join.similar(awkward(spark, table=False)).count() == 0


def test_bands_let_no_pair_slip():
    bands = parity_join.Bands(85)
    for small in range(1, 3000):
        large = small * 100 // 85
        assert bands.of(large) - bands.of(small) in (0, 1)
        blocks, spare = bands.blocks(bands.of(small))
        differ = small + large - 2 * -(-85 * (small + large) // 185)
        assert blocks == 0 and (small == large or 100 * small < 85 * large) or blocks - max(differ, 0) > spare


def test_long_words_and_parts(monkeypatch):
    text = " ".join(["x" * 50, *["w%d" % i for i in range(40)]] * 3)
    whole = parity_join.word_hashes(text)
    monkeypatch.setattr(parity_join, "PART", 64)
    assert (parity_join.word_hashes(text) == whole).all()


def test_sets_just_below_the_threshold_differ_in_their_sketches():
    """Of sets of 300 with a likeness of 0.8 hardly a pair is left for the comparison of the sets."""
    rng, left = np.random.default_rng(5), 0
    for _ in range(100):
        grams = rng.integers(0, 1 << 63, 333, np.uint64)
        a, b = (parity_join.parity_bits(s) for s in (grams[:300], np.concatenate([grams[:267], grams[300:]])))
        apart = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b, strict=True))
        assert apart <= 66
        left += apart * (100 + 85) <= (300 + 300) * (100 - 85)
    assert left <= 5
