import hashlib
import math

import numpy as np

from gridloom.llm import vector_codes as vc

COLUMNS = "vec_id long, embedding array<float>, label int, id long, x int, codes int, error long, _gl_n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], COLUMNS)


def by_hand(rows, parts=4, entries=256, rounds=4, scale=1024):
    """The rule in plain Python: (vec_id, codes, error) per kept row, and the codebooks."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, _ in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v in kept), default=0) // parts))
    cut = [(i, [(v + [0] * (parts * width - len(v)))[p * width:(p + 1) * width] for p in range(parts)]) for i, v in kept]
    first = sorted(cut, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[list(r[1][p]) for r in first] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v in cut:
                own.setdefault(best(v[p], books[p])[1], []).append(v[p])
            for k, found in own.items():
                books[p][k] = [sum(c) // len(found) for c in zip(*found, strict=True)]
    out = []
    for i, v in cut:
        near = [best(v[p], books[p]) for p in range(parts)]
        out.append((i, [k for _, k in near], sum(d for d, _ in near)))
    return out, books


def test_transform_is_orthogonal_and_in_sequency_order():
    for n in (1, 2, 8, 32):
        rows = vc.transform(np.eye(n, dtype=int)).T
        assert [(np.diff(r) != 0).sum() for r in rows] == list(range(n))
        assert (rows @ rows.T == n * np.eye(n)).all()


def test_nearest_against_all_distances():
    rng = np.random.default_rng(1)
    for width in (1, 3, 5, 16):
        rows, entries = rng.integers(-40, 40, (1300, width)), rng.integers(-40, 40, (33, width))
        entries[9] = entries[4]
        index, error = vc.nearest(vc.transform(rows), vc.transform(entries))
        far = ((rows[:, None] - entries[None]) ** 2).sum(2)
        assert (index == far.argmin(1)).all() and (error == far.min(1) * vc.Shape(4, width).padded).all()


def check(spark, rows, entries=256):
    coded, books = vc.compress(table(spark, rows), entries=entries)
    want, tables = by_hand(rows, entries=entries)
    got = [(r.id, r.codes, r.error) for r in coded.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    flat = ",".join(str(x) for book in tables for e in book for x in e)
    assert books.digest() == hashlib.sha256(flat.encode()).hexdigest()
    return coded


def test_codes_against_plain_python(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 12))
    rows = [(k * 7 % 400, (centres[k % 30] + rng.normal(size=12) * 0.1).astype(np.float32).tolist(), k % 5 or None) for k in range(400)]
    coded = check(spark, rows, entries=24)
    sums = {}
    for r in coded.collect():
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert all(r.label_error == sums[r.label] for r in coded.collect()) and None in sums


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [nan] * 5, 0), (3, [inf, 1.0], 0), (4, [1.0, None], 0), (5, [], 1), (6, [0.5], 1),
            (7, [0.25, -0.75, 3.0, 1.0, -2.0], None), (7, [0.25, -0.75, 3.0, 1.0, -2.0], None), (None, [1.0] * 5, None), (8, [0.0] * 5, 2)]
    assert check(spark, rows).count() == 6
    assert check(spark, [(1, None, 1)]).count() == 0 and check(spark, []).count() == 0
    assert [r.codes for r in check(spark, [(1, [], None)]).collect()] == [[0, 0, 0, 0]]


def test_components_beyond_the_exact_range_are_held(spark):
    shape = vc.Shape(4, 16)
    coded, books = vc.compress(table(spark, [(1, [3e38, -3e38] * 32, 1), (2, [0.0] * 64, 1)]))
    assert {abs(x) for x in books.entries[:, 0].ravel().tolist()} == {shape.most}
    assert [r.error for r in coded.collect()] == [0, 0]
    assert shape.padded * shape.parts * shape.width * (2 * shape.most) ** 2 <= 1 << 62
