import random
import re

import numpy as np

from gridloom.llm import fuzzy_lines, graph, repeated_spans
from tests.llm.support import awkward, edited, groups, invented
from tests.support import edit_distance


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert fuzzy_lines.edit_distance(a, b, 99) == edit_distance(a, b)
        near = fuzzy_lines.edit_distance(a, b, 3)
        assert near == edit_distance(a, b) if edit_distance(a, b) <= 3 else near > 3


def test_edits_of_long_texts_are_bounded_as_by_the_distance():
    rng = random.Random(4)
    words = [x for t in invented(6, 9, words=40) for x in t.split()]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(26, 40))) for _ in range(4)]
    lines += ["".join(map(chr, (rng.randrange(0x4E00, 0x4E20) for _ in range(180)))), "ab " * 60]
    decided = set()
    for line in lines:
        for edits in (0, 3, 9):
            other = varied(rng, line, edits)
            for a, b in ((line, other), (other, line), (line, " ".join(reversed(other.split(" ")))), (line, lines[0])):
                exact = edit_distance(a, b)
                for most in (0, exact - 1, exact, exact + 7, len(line) // 10):
                    assert fuzzy_lines.edits_at_most(a, b, most) == (exact <= most)
                decided.add(exact <= len(line) // 10)
    assert decided == {True, False}


def test_texts_compared_side_by_side_are_decided_as_by_the_distance():
    rng = random.Random(9)
    pairs = [("same", "same"), ("", ""), ("", "a"), ("abcd" * 50, "abcd" * 60), ("😀" * 70 + "ab", "😀" * 70 + "cd")]
    for _ in range(700):
        line = "".join(rng.choice("abc é漢" + "😀" * rng.randint(0, 1)) for _ in range(rng.choice((1, 63, 64, 65, 90, 128, 129))))
        other = list(line)
        for _ in range(rng.randint(1, 14)):
            at = rng.randrange(len(other) + 1)
            other[at:at + rng.randint(0, 2)] = rng.choice(("", "a", "xy", "漢"))
        pairs.append((line, "".join(other)))
    a, b = map(list, zip(*pairs, strict=True))
    exact = [edit_distance(x, y) for x, y in pairs]
    for more in (-1, 0, 3):
        most = [max(0, e + more) for e in exact]
        assert fuzzy_lines.all_at_most(a, b, most) == [e <= m for e, m in zip(exact, most, strict=True)]


def test_members_of_a_group_found_late_are_not_all_compared(spark):
    """Of 200 members of a bucket the smallest is like none; the others are all alike but for the last one."""
    keyed = spark.range(200).selectExpr("1L AS key", "id")
    about, seen = spark.range(200).selectExpr("id", "id AS place"), []

    def verify(pairs):
        seen.append({(r.a, r.b) for r in pairs.collect()})
        return pairs.where("a > 0 AND b < 199")

    links = graph.link(keyed, about, lambda a, b: a("place") < 1000, verify)
    found = {r.id: r.component for r in graph.components(links).collect()}
    assert found == dict.fromkeys(range(1, 199), 1)
    # every member meets the first ones, the one that is like none meets all
    assert sum(map(len, seen)) < 200 * graph.GROWTH + 200 < 200 * 199 / 2
    met = set().union(*seen)
    assert len(met) == sum(map(len, seen)) and {(a, 199) for a in range(199)} <= met


def test_pairs_given_up_early_are_decided_as_by_the_distance(monkeypatch):
    """Long unlike lines, lines alike but for a stretch, moved text; few places for letters, so pairs are dealt again."""
    rng = random.Random(11)
    pairs = []
    for _ in range(160):
        line = "".join(rng.choice("abcdefgh ") for _ in range(rng.choice((63, 64, 65, 128, 200, 330))))
        other = "".join(rng.choice("abcdefgh ") for _ in range(len(line)))
        at, cut = rng.randrange(len(line)), rng.randrange(len(line) // 3 + 1)
        pairs += [(line, other), (line, line[:at] + other[at:at + cut] + line[at + cut:]), (line, line[cut:] + line[:cut])]
    a, b = map(list, zip(*pairs, strict=True))
    exact = [edit_distance(x, y) for x, y in pairs]
    for places in (fuzzy_lines.MARKS, 4096):
        monkeypatch.setattr(fuzzy_lines, "MARKS", places)
        for most in ([len(x) // 10 for x in a], exact, [max(0, e - 1) for e in exact]):
            assert fuzzy_lines.all_at_most(a, b, most) == [e <= m for e, m in zip(exact, most, strict=True)]


def test_buckets_whose_members_have_all_met_are_left(spark, monkeypatch):
    """One bucket of 40 that are like none, 30 of 3 and 30 of 2: later steps take the large one only."""
    sizes = {0: 40, **{k: 3 for k in range(1, 31)}, **{k: 2 for k in range(31, 61)}}
    rows = [(key, 100 * key + i) for key, n in sizes.items() for i in range(n)]
    keyed, seen, steps = spark.createDataFrame(rows, "key long, id long"), [], []
    about = keyed.selectExpr("id", "id AS place")

    def kept(frame, real=graph.materialize):
        out = real(frame)
        if "rank" in out.columns:
            steps.append(out.count())
        return out

    def verify(pairs):
        seen.extend((r.a, r.b) for r in pairs.collect())
        return pairs.where("false")

    monkeypatch.setattr(graph, "materialize", kept)
    assert graph.link(keyed, about, lambda a, b: a("place") >= 0, verify).count() == 0
    assert len(seen) == len(set(seen)) == 40 * 39 // 2 + 30 * 3 + 30
    assert steps == [39 + 30 * 2, 39]


def compared(text):
    return [" ".join(line.split()) for line in (text or "").lower().split("\n")]


def letters(line):
    return len(re.findall(r"[^\x00-/:-`{-\x7f]", line))


def alike(known):
    """All pairs of lines with an edit similarity of 0.9 or more, by the plain definition alone."""
    out = []
    for x, a in enumerate(known):
        for b in known[:x]:
            longest = max(len(a), len(b))
            if min(len(a), len(b)) >= 0.9 * longest and 10 * edit_distance(a, b) <= longest:
                out.append((a, b))
    return out


def removed_by_hand(rows, group):
    seen, gone = set(), {}
    for i, pos, line in sorted((i, pos, line) for i, t in rows for pos, line in enumerate(compared(t)) if letters(line) >= 8):
        if group[line] in seen:
            gone.setdefault(i, []).append(pos)
        seen.add(group[line])
    return gone


def varied(rng, line, edits):
    """Words replaced, left out, put in, or with a letter changed, of a line that may have no blanks."""
    words = line.split(" ")
    for _ in range(edits):
        k = rng.randrange(len(words))
        how = rng.randrange(4) if len(words) > 3 else 3
        if how == 0:
            words[k] = rng.choice(words)
        elif how == 1:
            del words[k]
        elif how == 2:
            words.insert(k, rng.choice("of and the new 17".split()))
        elif words[k]:
            at = rng.randrange(len(words[k]))
            words[k] = words[k][:at] + rng.choice("aeiou") + words[k][at + 1:]
    return " ".join(words)


def test_alike_lines_of_every_length_share_a_key():
    rng = random.Random(6)
    words = [x for t in invented(80, 21, words=60) for x in t.split()]
    scripts = "".join(map(chr, range(0x4E00, 0x4E90)))
    for low, high, n in ((4, 6, 60), (7, 12, 60), (13, 24, 40), (25, 60, 16), (61, 110, 8), (0, 0, 30)):
        lines = []
        for _ in range(n):
            line = " ".join(rng.choice(words) for _ in range(rng.randint(low, high)))
            lines.append(line if low else "".join(rng.choice(scripts) for _ in range(rng.randint(12, 80))))
        lines += [varied(rng, x, rng.randint(1, max(1, len(x.split()) // 12))) for x in lines for _ in range(3)]
        known = sorted({x for line in lines for x in compared(line)})
        facts = fuzzy_lines.facts("\n".join(known).encode())
        bounds = np.concatenate([[0], np.cumsum(facts["n_keys"])])
        keys = {x: set(facts["keys"][bounds[k]:bounds[k + 1]].tolist()) for k, x in enumerate(known)}
        pairs = alike(known)
        found = sum(bool(keys[a] & keys[b]) for a, b in pairs)
        assert len(pairs) > 20 and found >= {6: 0.3, 0: 0.8}.get(high, 0.9) * len(pairs), (low, high)
        assert facts["chars"].tolist() == [len(x) for x in known] and facts["letters"].tolist() == [letters(x) for x in known]


def test_lines_against_all_pairs(spark):
    rng = random.Random(6)
    base = [t + " and so on" for t in invented(40, 21, words=30)]
    near = [varied(rng, t, 1) for t in base for _ in range(4)] + [t.upper() + "  \t" for t in base]
    docs = [(i, "\n".join(rng.choice(base + near) for _ in range(5))) for i in range(60)]
    known = sorted({x for _, t in docs for x in compared(t)})
    links = alike(known)
    assert len(links) > 10
    most = removed_by_hand(docs, groups(known, links))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in fuzzy_lines.dedup_lines(frame).collect()}
    count = 0
    for i, t in docs:
        assert set(got[i].removed_lines) <= set(most.get(i, [])), i
        count += len(got[i].removed_lines)
        left = [line for k, line in enumerate(t.split("\n")) if k not in got[i].removed_lines]
        assert got[i].text == "\n".join(left)
    assert count >= 0.95 * sum(map(len, most.values()))


def test_different_lines_stay_and_lines_of_one_word_count(spark):
    pairs = [("grand total 5", "grand total 987654"), ("x = alpha + b", "x = alpha - beta"), ("port 22 open", "port 8080 open"),
             ("2021 4 17 05:30", "1999 8 3 11:20"), ("}", "}"), ("of the", "of the")]
    docs = [(k, "\n".join(p[k] for p in pairs)) for k in range(2)]
    long = "".join(map(chr, range(0x4E00, 0x4E50)))
    docs += [(5, "Supercalifragilistic"), (6, "supercalifragilistic"), (7, long + "漢" + long[::-1]), (8, "漢字仮名交文章例題集"),
             (9, "漢字仮名交文章例題集"), (10, long + "字" + long[::-1])]
    got = {r.doc_id: r for r in fuzzy_lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i].removed_lines for i in (0, 1, 5, 6, 7, 8, 9, 10)] == [[], [], [], [0], [], [], [0], [0]]
    assert got[0].text == docs[0][1] and got[1].text == docs[1][1]


def test_lines_of_awkward_rows(spark):
    docs = awkward(spark, ["same line here\nsame line here", "Same  LINE here"])
    rows = fuzzy_lines.dedup_lines(docs, into="gone").collect()
    assert len(rows) == docs.count() and rows[0].__fields__ == [*docs.columns, "gone"]
    got = {str(r.doc_id): (r.text, r.gone) for r in rows}
    assert got["1"] == (None, []) and got["2"] == ("", []) and got["7"] == ("\n\n", [])
    assert got["100"] == ("same line here", [1]) and got["101"] == ("", [0]) and got["5"] == ("", [0])
    assert fuzzy_lines.dedup_lines(awkward(spark, table=False)).count() == 0


def test_facts_do_not_depend_on_what_stands_around_a_line(monkeypatch):
    lines = ["a b", "", "c", "word " * 700, "x" * 9000, "漢" * 3000, "ha " * 5000, *invented(50, 3)]
    whole = fuzzy_lines.facts("\n".join(lines).encode())
    bounds = np.concatenate([[0], np.cumsum(whole["n_keys"])])
    for k, line in enumerate(lines):
        one = fuzzy_lines.facts(line.encode())
        assert [one[c][0] for c in ("line", "chars", "letters")] == [whole[c][k] for c in ("line", "chars", "letters")]
        assert sorted(one["keys"].tolist()) == sorted(whole["keys"][bounds[k]:bounds[k + 1]].tolist())
    monkeypatch.setattr(fuzzy_lines, "PART", 6000)
    parts = fuzzy_lines.facts("\n".join(lines).encode())
    assert (parts["letters"] == whole["letters"]).all() and (parts["line"][:4] == whole["line"][:4]).all()
    assert (parts["line"][7:] == whole["line"][7:]).all() and (parts["n_keys"][7:] == whole["n_keys"][7:]).all()


def runs_by_hand(text, run_words):
    edges = [m.start() for m in re.finditer(r"\S+", text)]
    begin = [0] + [p for p in edges[1:] if re.search(r"([.!?]\s+|\n\s*)$", text[:p]) or text[p].isupper()] + [len(text)]
    parts = [re.sub(r"[^\w ]|_", "", " ".join(text[a:b].split())).lower().split() for a, b in zip(begin, begin[1:])]
    for a in range(len(parts)):
        for b in range(a + 1, len(parts) + 1):
            size = sum(map(len, parts[a:b]))
            least = size - len(parts[b - 1]) < run_words or size - len(parts[a]) < run_words
            if size >= run_words and parts[a] and parts[b - 1] and least:
                yield " ".join(sum(parts[a:b], [])), begin[a], begin[b]


def spans_by_hand(rows, run_words):
    every = [(run, i, a, b) for i, t in rows for run, a, b in runs_by_hand(t or "", run_words)]
    first = {}
    for run, i, a, b in every:
        first[run] = min(first.get(run, (i, a)), (i, a))
    gone = {}
    for run, i, a, b in every:
        if first[run] < (i, a):
            gone.setdefault(i, set()).update(range(a, b))
    return gone


def test_spans(spark):
    rng = random.Random(12)
    sentence = [t.capitalize() + "." for t in invented(400, 13, words=14)]
    passage = " ".join(sentence[:6])
    assert len(passage.split()) > 50
    docs = []
    for i in range(60):
        own = rng.sample(sentence[6:], 10)
        middle = " ".join(own[:5]) + " cut off here " + passage + " " + " ".join(own[5:])
        docs.append((i, middle if i % 3 == 0 else " ".join(own)))
    want = spans_by_hand(docs, 25)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for r in repeated_spans.repeated_spans(frame).collect():
        assert got.setdefault(r._gl_row.id, set()).isdisjoint(range(r.span_begin, r.span_end))
        got[r._gl_row.id].update(range(r.span_begin, r.span_end))
    assert got == want and set(got) == set(range(3, 60, 3))
    cleaned = {r.doc_id: r.text for r in repeated_spans.remove_repeats(frame).collect()}
    for i, t in docs:
        assert (passage in cleaned[i]) == (i == 0)
        assert cleaned[i] == "".join(c for k, c in enumerate(t) if k not in want.get(i, ()))


def test_spans_of_awkward_rows(spark):
    docs = awkward(spark)
    assert {r._gl_row.id for r in repeated_spans.repeated_spans(docs).collect()} == {5}
    kept = repeated_spans.remove_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert repeated_spans.repeated_spans(awkward(spark, table=False)).count() == 0
