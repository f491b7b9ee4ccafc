import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import findings, fuzzy_match, skew
from tests.support import duplicates_by_hand, ratio

SCHEMA = ("batch_id string, record_id string, row_ord bigint, entity_type string, key_email string,"
          " key_code string, key_name string")


def changed(rng, text):
    chars = list(text)
    for _ in range(rng.randint(0, max(1, len(chars) // 5))):
        at, kind = rng.randrange(len(chars) + 1), rng.random()
        if kind < 0.4:
            chars.insert(at, rng.choice("abc"))
        elif chars and kind < 0.7:
            del chars[min(at, len(chars) - 1)]
        elif chars:
            chars[min(at, len(chars) - 1)] = rng.choice("abc")
    return "".join(chars) or "a"


def random_rows(seed, batches=4, per_batch=60):
    rng, rows = random.Random(seed), []
    for b in range(batches):
        pool = []
        for i in range(per_batch):
            size = rng.choice([3, 5, 8, 12, 16, 20, 30, 45, 60, 70, 110])
            base = rng.choice(pool) if pool and rng.random() < 0.6 else "".join(rng.choice("abc") for _ in range(size))
            name = changed(rng, base) if rng.random() < 0.8 else base
            pool.append(name)
            rows.append((f"b{b}", f"b{b}:0:{i}", i, rng.choice(["TRAVELER", "GUIDE"]),
                         rng.choice([None, None, "x@y", f"z@y{i % 9}"]),
                         rng.choice([None, None, None, f"c{i % 7}"]), name if rng.random() < 0.95 else None))
    return rows


def matched(df, **kw):
    return {r.record_id: (r.peer_ord, r.strategy, r.score) for r in findings.find_duplicates(df, **kw).collect()}


@pytest.mark.parametrize("pairs,block,hot", [(None, None, None), (3, 2, 2), (40, 3, None)])
def test_sets_equal_row_by_row(spark, monkeypatch, pairs, block, hot):
    """Also with every key treated as crowded or hot."""
    if pairs:
        monkeypatch.setattr(fuzzy_match, "KEY_PAIRS", pairs)
        monkeypatch.setattr(fuzzy_match, "BLOCK", block)
        monkeypatch.setattr(fuzzy_match, "EARLY", block)
        monkeypatch.setattr(fuzzy_match, "GROWTH", 4)
    if hot:
        monkeypatch.setattr(skew, "HOT_ROWS", hot)
    rows = random_rows(7 + (pairs or 0), batches=2 if pairs else 4)
    names = SCHEMA.replace(" string", "").replace(" bigint", "").split(", ")
    want = duplicates_by_hand([dict(zip(names, r)) for r in rows])
    assert sum(v[1] == "name_fuzzy" for v in want.values()) > 10
    assert matched(spark.createDataFrame(rows, SCHEMA)) == want


def test_travelers_of_the_golden_file(spark):
    rows = [("b", f"b:0:{i}", i, "TRAVELER", mail, None, name) for i, (mail, name) in enumerate([
        ("ida@example.com", "ida brand"), ("ida@example.com", "ida b"), ("ivo@example.com", "ivo petkov"),
        ("iwo@example.com", "ivo petkov"), ("at home", "elif kaya")])]
    got = findings.find_duplicates(spark.createDataFrame(rows, SCHEMA), one_key=True).orderBy("row_ord").collect()
    assert [(r.record_id, r.peer_record_id, r.strategy, r.score, r.reason) for r in got] == [
        ("b:0:1", "b:0:0", "email_exact", 1.0, "DUPLICATE"), ("b:0:3", "b:0:2", "name_fuzzy", 1.0, "DUPLICATE")]
    assert got[0].explanation == ('Shares email "ida@example.com" with an earlier traveler in this upload'
                                  " — likely the same record.")


def test_near_name_is_low_confidence_and_others_are_not(spark):
    rows = [("b", f"b:0:{i}", i, e, None, None, n) for i, (e, n) in enumerate([
        ("TRAVELER", "ida brand"), ("TRAVELER", "ida brandd"), ("GUIDE", "ida brand"), ("TRAVELER", "kim"),
        ("TRAVELER", "kit")])]
    got = findings.find_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.record_id, r.reason, r.score) for r in got] == [("b:0:1", "LOW_CONFIDENCE", 0.9)]
    assert got[0].explanation == ('Name "ida brandd" is ~90% similar to "ida brand" on another traveler row'
                                  " — possible duplicate, please confirm.")
    item = findings.review_items(findings.find_duplicates(spark.createDataFrame(rows, SCHEMA))).first()
    assert (item.priority, item.status) == (0, "OPEN")


def test_lookup_spreads_a_hot_key(spark):
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(
            F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), "id")
    table = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("lo"))
    got = skew.lookup(rows, table, on=("k",), take=("lo",), weight="n", spread_by=(F.col("id"),), hot_rows=1_000)
    plain = rows.join(table.drop("n"), "k", "left").select("k", "id", "lo")
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
    shuffled = got._jdf.queryExecution().executedPlan().toString()
    assert "_place" in shuffled.split("hashpartitioning(")[1]


def test_without_picks_either_way(spark, monkeypatch):
    rows = spark.range(1000).select((F.col("id") % 10).alias("g"), "id")
    gone = spark.createDataFrame([(3,), (4,), (99,)], "g bigint")
    for bound in (100_000, 0):
        monkeypatch.setattr(skew, "LIST_ROWS", bound)
        assert skew.without(rows, gone, "g").count() == 800
        assert {r.g for r in skew.without(rows, gone, "g", keep=True).collect()} == {3, 4}


def _numbered(spark, texts):
    return spark.createDataFrame([("b", "GUIDE", t, i, 1) for i, t in enumerate(texts)],
                                 "batch_id string, entity_type string, name string, first_ord bigint, holders bigint")


def _peers(names):
    return {r.name: r.best_ord for r in fuzzy_match.earliest_similar(names).collect()}


def _peers_by_hand(texts):
    return {a: next((j for j, b in enumerate(texts[:i]) if ratio(a, b) >= 0.85), None) for i, a in enumerate(texts)}


def test_texts_of_two_edits_are_found_without_comparing_pairs(spark, monkeypatch):
    """A crowd of names that differ in a few letters: one row per way to leave letters out, not one per pair."""
    rng = random.Random(3)
    texts = list(dict.fromkeys(changed(rng, "".join(rng.choice("ab") for _ in range(rng.randint(6, 19)))) for _ in range(260)))
    want = {k: v for k, v in _peers_by_hand(texts).items() if len(k) <= 19}
    texts_of = fuzzy_match._sized(_numbered(spark, texts))
    pairs = fuzzy_match._pattern_pairs(texts_of)
    assert "levenshtein" not in pairs._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r.later_ord: r.earlier_ord for r in pairs.collect()}
    close = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts[:i])
             if max(len(a), len(b)) <= 19 and ratio(a, b) >= 0.85]
    earliest = {}
    for i, j in close:
        earliest[i] = min(j, earliest.get(i, j))
    assert len(earliest) > 50 and got == earliest
    assert {k: v for k, v in _peers(_numbered(spark, texts)).items() if len(k) <= 19} == want


def test_a_crowd_ends_with_its_earliest_names(spark, monkeypatch):
    """Names whose peer is among the first ones are not looked up by keys at all."""
    monkeypatch.setattr(fuzzy_match, "KEY_PAIRS", 100)
    monkeypatch.setattr(fuzzy_match, "EARLY", 4)
    monkeypatch.setattr(fuzzy_match, "BLOCK", 16)

    def no_keys(*_):
        raise AssertionError("keys were asked")

    monkeypatch.setattr(fuzzy_match, "_segment_pairs", no_keys)
    texts = [f"https://one.example.net/en/{i:03d}/page.html" for i in range(120)]
    assert _peers(_numbered(spark, texts)) == _peers_by_hand(texts)


def test_names_without_a_place_and_names_that_share_one(spark, monkeypatch):
    monkeypatch.setattr(fuzzy_match, "KEY_PAIRS", 20)
    monkeypatch.setattr(fuzzy_match, "EARLY", 2)
    monkeypatch.setattr(fuzzy_match, "BLOCK", 4)
    texts = [f"https://one.example.net/en/{i:03d}/page.html" for i in range(20)]
    rows = [("b", "GUIDE", t, i // 2 if i else None, 1) for i, t in enumerate(texts)]
    rows += [(None, "GUIDE", t, i, 1) for i, t in enumerate(texts)]
    names = spark.createDataFrame(rows, "batch_id string, entity_type string, name string, first_ord bigint, holders bigint")
    got = fuzzy_match.earliest_similar(names).filter("best_ord < first_ord").collect()
    assert {(r.batch_id, r.name, r.best_ord) for r in got} == {("b", t, 0) for t in texts[2:]}


def test_the_earliest_names_are_met_a_few_at_a_time(spark, monkeypatch):
    """Most names find their peer among the first few and are compared with no others."""
    rng, heads = random.Random(5), []
    texts = [f"supplier#{rng.randrange(10 ** 5):09d} mountain tours {rng.randrange(30)}" for _ in range(700)]
    kept = fuzzy_match.materialize

    def seen(frame):
        out = kept(frame)
        if "g0" in out.columns and "open" not in out.columns:
            heads.append(out.count())
        return out

    monkeypatch.setattr(fuzzy_match, "materialize", seen)
    names = list(dict.fromkeys(texts))
    assert _peers(_numbered(spark, names)) == _peers_by_hand(names)
    assert heads[0] == 4 and heads[1] <= 32


def test_letters_counted_tell_most_texts_apart(spark):
    """The cheap tests let every similar pair through, and less than half of those that share most letter pairs."""
    rng = random.Random(11)
    hosts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(40)]
    texts = [f"https://www.{rng.choice(hosts)}.example.net/en/{rng.randrange(10 ** 4)}{rng.choice(['', '/', '#top'])}" for _ in range(100)]
    texts += [changed(rng, t) for t in texts[:60]] + ["ääéé", "ääéß", "a" * 90 + "b", "b" + "a" * 90, "𝄞𝄞𝄞𝄞𝄞𝄞𝄞", "𝄞𝄞𝄞𝄞𝄞𝄞x"]
    texts = list(dict.fromkeys(texts))
    sized = fuzzy_match._sized(_numbered(spark, texts))
    a, b = (sized.select(*[F.col(c).alias(f"{p}_{c}") for c in ("name", "ord", "len", "g0", "g1", "c0", "c1")]) for p in "ab")
    gap, budget = F.abs(F.col("a_len") - F.col("b_len")), fuzzy_match.edit_budget(F.greatest("a_len", "b_len"))
    pairs = a.join(b, F.col("b_ord") < F.col("a_ord")).filter(gap <= budget)
    near = {(r.a_name, r.b_name) for r in pairs.filter(fuzzy_match._near_bits(gap, budget)).collect()}
    similar = {(x, y) for i, x in enumerate(texts) for y in texts[:i] if ratio(x, y) >= 0.85}
    assert len(similar) > 60 and similar <= near
    assert len(near) < 0.5 * pairs.filter(fuzzy_match._differing("g0", "g1") <= 4 * budget).count()
