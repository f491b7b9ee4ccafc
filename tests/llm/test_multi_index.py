import numpy as np

from gridloom.llm import multi_index
from tests.llm.support import groups

COLUMNS = "vec_id long, embedding array<float>, label int, id long, key int, n int, unit int, cell int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], COLUMNS)


def test_links_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(80, 16))
    vectors = [base[k % 80] + rng.normal(size=16) * 0.08 for k in range(500)] + [base[0] * 3] * 4 + [base[1] + rng.normal(size=16) * 0.01 for _ in range(300)]
    rows = [(i, v.astype(np.float32).tolist(), int(rng.integers(0, 3))) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 5, [2.0] * 5, [3.0], [4.0]]
    rows += [(1000 + k, v, 0) for k, v in enumerate(odd)] + [(2000, rows[0][1], None), (None, rows[3][1], rows[3][2])]
    got = {r.id: r for r in multi_index.near_vectors(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v, float), x) for i, v, x in rows if x is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(i, j) for i, a, x in good for j, b, y in good
             if i != j and x == y and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98]
    found, true = sum(r.n_links for r in got.values()), len(links)
    assert 0.98 * true <= found <= true
    count = {}
    for i, _ in links:
        count[i] = count.get(i, 0) + 1
    assert all(r.n_links <= count.get(i, 0) for i, r in got.items())
    part = groups([r[0] for r in rows if r[0] is not None], [(a, b) for a, b in links if None not in (a, b)])
    assert np.mean([got[i].component_id == c for i, c in part.items()]) > 0.98
    assert got[1006].component_id == got[1007].component_id == 1006 and got[1003].n_links == 0 and got[1008].n_links == 1


def test_empty_table(spark):
    assert multi_index.near_vectors(table(spark, [])).count() == 0
    assert multi_index.near_vectors(table(spark, [(1, None, 1)])).first().component_id == 1
