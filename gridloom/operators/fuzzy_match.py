"""Near-duplicate names: the earliest similar name of every name, found by blocking.

Only distinct names take part, so a name shared by a third of the rows counts once. Every name
first meets the earliest few names of its batch, then the next few, as long as that finds most
of the peers: what is found there is the answer, as later peers cannot be earlier. Names still
open are looked up among all others, through exact-equality keys that lose nothing:

* texts up to PATTERN_MAX characters, which allow two edits: two texts are that close if and only if
  leaving out the edited letters makes them equal, so the earliest peer is a minimum per key and
  no pair is compared;
* texts up to SEGMENT_MAX characters: k edits cannot touch all of k + 1 segments, so one
  segment of the shorter text appears unchanged in the longer one, near its own place
  (partition-based similarity join; Li, Deng, Wang, Feng, PVLDB 5(3), 2011);
* longer texts: similar texts share most of their three-letter grams, so their rarest grams
  overlap (prefix filtering; Chaudhuri, Ganti, Kaushik, ICDE 2006).

Only the earliest similar name counts, so a key shared by too many names is not compared pair by
pair: its names first meet the earliest few of them, and whoever found a peer there is done with
that key. Where many names stay open the key is refined by segments of the text left around it;
after the last refinement the early part grows step by step. Work on one key is cut into blocks
spread over many tasks, and every comparison that could matter is made.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gridloom.fixed_values import FUZZY_THRESHOLD
from gridloom.functions.similarity import edit_budget
from gridloom.lineage import materialize
from gridloom.operators import skew

SEGMENT_MAX = 64
#: longest text that allows at most two edits
PATTERN_MAX = 19
GRAM = 3
#: grams ranked as common; the list is broadcast, so it is bounded
COMMON_GRAMS = 4_096
#: a key with more pairs than this is crowded
KEY_PAIRS = 4_000_000
REFINE_LEVELS = 2
#: names a crowded key starts with, and how fast that part grows
EARLY = 256
GROWTH = 8
#: names every text meets first; most find their peer there and are spared the rest of the EARLY ones
FIRST = EARLY // GROWTH ** 2
#: the first names of a batch are met in growing steps while a step costs less than so many times EARLY comparisons a name
STEP_WORK = 16
#: times a longer text can carry one piece of a segment in its window (k + 1 places)
REPEATS = int(SEGMENT_MAX * (1.0 - FUZZY_THRESHOLD)) + 1
BLOCK = 1_000
#: names of the early part that a block of other names meets in one task
HEAD_BLOCK = 4_000
#: how often a letter is counted in the bits that tell texts apart
BAG_TIMES = 64
NAMES_PER_PARTITION = 250
MAX_PARTITIONS = 20_000


def distinct_names(rows: DataFrame) -> DataFrame:
    """batch_id, entity_type, name, first_ord, holders of the rows' key names."""
    return (
        rows.filter(F.col("key_name").isNotNull())
        .groupBy("batch_id", "entity_type", F.col("key_name").alias("name"))
        .agg(F.min("row_ord").alias("first_ord"), F.count("*").alias("holders"))
    )


def earliest_similar(names: DataFrame) -> DataFrame:
    """Every name with best_ord and best_name: the earliest name similar to it, if earlier."""
    stats = names.agg(F.max(F.length("name")).alias("longest"), F.count("*").alias("n")).first()
    # Two sides of n names, the longer texts repeating a piece a few times: too few to crowd.
    roomy = stats["n"] ** 2 * REPEATS <= KEY_PAIRS
    parts = _join_partitions(names, stats["n"])
    cores = names.sparkSession.sparkContext.defaultParallelism
    texts, found = _sized(names, None if roomy else max(cores, min(MAX_PARTITIONS, stats["n"] // HEAD_BLOCK))), None
    if not roomy:
        texts, found = _met_early(materialize(texts), stats["n"])
    if roomy or not texts.filter("open").isEmpty():
        later = _pattern_pairs(texts).unionByName(_segment_pairs(texts, roomy, parts))
        if (stats["longest"] or 0) > SEGMENT_MAX:
            later = later.unionByName(_gram_pairs(texts, roomy, parts))
        found = later if found is None else found.unionByName(later)
    best = found.groupBy("batch_id", "entity_type", "later_ord").agg(
        F.min("earlier_ord").alias("best_ord")
    )
    own = ["batch_id", "entity_type"]
    # The peer's text follows from its place: one more join on a unique key.
    texts = names.select(*own, F.col("first_ord").alias("best_ord"), F.col("name").alias("best_name"))
    best = best.join(texts, [*own, "best_ord"], "inner")
    return names.join(
        best.withColumnRenamed("later_ord", "first_ord"), [*own, "first_ord"], "left"
    )


def _join_partitions(names: DataFrame, n: int) -> int:
    """Partitions of the pair join: comparing texts costs far more than the bytes it reads.

    Sizing by bytes, as the adaptive planner does, would leave the work to a few tasks.
    """
    cores = names.sparkSession.sparkContext.defaultParallelism
    return max(cores, min(MAX_PARTITIONS, n // NAMES_PER_PARTITION))


def _grams() -> Column:
    """The letter pairs of a name, hashed to 128 marks."""
    return F.expr("transform(sequence(1, length(name) - 1), i -> pmod(xxhash64(substring(name, i, 2)), 128))")


def _bag() -> Column:
    """The letters of a name, one mark of 128 for each time a letter occurs."""
    times = f"least(length(name) - length(replace(name, c, '')), {BAG_TIMES})"
    return F.expr("flatten(transform(filter(array_distinct(split(name, '')), c -> c <> ''),"
                  f" c -> transform(sequence(1, {times}), j -> pmod(xxhash64(c, j), 128))))")


def _bits(marks: str, first: int) -> Column:
    """Which marks there are, as 64 of 128 bits."""
    return F.expr(
        f"aggregate({marks}, 0L, (acc, b) -> acc |"
        f" if(b >= {first} and b < {first + 64}, shiftleft(1L, cast(b - {first} as int)), 0L))"
    )


#: the bits of a text that tell most pairs apart before their edits are counted
_BITS = ("g0", "g1", "c0", "c1")


def _differing(*bits: str) -> Column:
    one, two = (F.bit_count(F.col(f"a_{b}").bitwiseXOR(F.col(f"b_{b}"))) for b in bits)
    return one + two


def _near_bits(gap: Column, budget: Column) -> Column:
    """Cheap tests before the real one.

    A replaced letter takes away one letter and adds one, and one put in or taken out, of which there are at least as
    many as the lengths differ by (`gap`), counts once. An edit takes away or adds at most four letter pairs.
    """
    return (_differing("c0", "c1") + gap <= 2 * budget) & (_differing("g0", "g1") <= 4 * budget)


def _similar(a: str, b: str, budget: str, longer: str) -> str:
    """Whether two texts are similar. -1, for more edits than the budget, turns into many: edits are counted once."""
    return f"1.0D - pmod(levenshtein({a}, {b}, {budget}), {1 << 30}) / {longer} >= {FUZZY_THRESHOLD}D"


def _verified(pairs: DataFrame) -> DataFrame:
    """Keep similar pairs; `a` is the shorter text. Emits the later and the earlier place."""
    longer = F.length("b_name")
    similar = F.expr(_similar("a_name", "b_name", "budget", "length(b_name)"))
    return pairs.withColumn("budget", edit_budget(longer)).filter(similar).select(
        "batch_id", "entity_type",
        F.greatest("a_ord", "b_ord").alias("later_ord"),
        F.least("a_ord", "b_ord").alias("earlier_ord"),
    )


# -- the earliest names -----------------------------------------------------------------

_OWN = ["batch_id", "entity_type"]


def _sized(names: DataFrame, parts: int | None = None) -> DataFrame:
    """The names as texts: ord, len, bits of letters and their pairs, n and lens (of the batch: names, lengths up to PATTERN_MAX)."""
    length = F.length("name")
    sizes = names.groupBy(*_OWN).agg(
        F.count("*").alias("n"), F.collect_set(F.when(length <= PATTERN_MAX, length)).alias("lens"))
    spread = (F.col("name"), F.col("ord"))
    # nothing is earlier or later than a name without a place or a batch
    placed = names.dropna(subset=[*_OWN, "first_ord"])
    if parts is not None:
        # the marks of a text cost far more than its bytes tell
        placed = placed.repartition(parts, "name")
    marked = placed.select(*_OWN, "name", F.col("first_ord").alias("ord"), length.alias("len"),
                           _grams().alias("_grams"), _bag().alias("_bag"))
    texts = marked.select(*_OWN, "name", "ord", "len", _bits("_grams", 0).alias("g0"), _bits("_grams", 64).alias("g1"),
                          _bits("_bag", 0).alias("c0"), _bits("_bag", 64).alias("c1"))
    return skew.lookup(texts, sizes, on=_OWN, take=("n", "lens"), weight="n", spread_by=spread).withColumn(
        "open", F.lit(True))


def _met_early(texts: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The texts behind the earliest ones, `open` if no peer was found yet, and the pairs found.

    Every open text meets the FIRST names of its batch, then the next ones up to FIRST * GROWTH
    and so on: a peer found in one step is earlier than any of the steps to come.
    """
    key = [*_OWN, "ord"]
    # names that share a place stay together; ranked once, as every step asks for a stretch of ranks
    rank = F.rank().over(Window.partitionBy(*_OWN).orderBy("ord"))
    ranked = materialize(texts.withColumn("_rank", rank))
    cores = texts.sparkSession.sparkContext.defaultParallelism
    open_texts, found, done, size, left = texts, None, 0, FIRST, n
    while True:
        head = materialize(ranked.filter((F.col("_rank") <= size) & (F.col("_rank") > done)).drop("_rank", "open"))
        # Each block of open texts meets each block of the head: neither side is repeated more often than the other has blocks.
        rows = F.ceil(F.least(F.col("n"), F.lit(left)) / BLOCK).cast("bigint")
        cols = F.ceil(F.least(F.col("n"), F.lit(size - done)) / HEAD_BLOCK).cast("bigint")
        parts = max(cores, min(MAX_PARTITIONS, math.ceil(left / BLOCK) * math.ceil(min(n, size - done) / HEAD_BLOCK)))

        def side(some: DataFrame, p: str, own: Column, many: Column, x: str, y: str, parts: int = parts) -> DataFrame:
            shown = [F.col(c).alias(f"{p}_{c}") for c in ("name", "ord", "len", *_BITS)]
            shown.append(edit_budget(F.col("len")).alias(f"{p}_budget"))
            every = F.explode(F.sequence(F.lit(0).cast("bigint"), many - 1)).alias(y)
            return some.select(*_OWN, F.pmod(F.xxhash64("name", "ord"), own).alias(x), every, *shown).repartition(
                parts, *_OWN, "_x", "_y")

        a = side(open_texts, "a", rows, cols, "_x", "_y")
        b = side(head, "b", cols, rows, "_y", "_x")
        # the longer text has the larger budget
        gap, budget, longer = F.abs(F.col("a_len") - F.col("b_len")), F.greatest("a_budget", "b_budget"), F.greatest("a_len", "b_len")
        pairs = a.join(b, [*_OWN, "_x", "_y"]).filter(
            (F.col("b_ord") < F.col("a_ord")) & (gap <= budget) & _near_bits(gap, budget))
        # Edits are counted from the earliest name on, up to the first similar one.
        near = pairs.groupBy(*_OWN, "_x", "_y", "a_ord", "a_name").agg(F.array_sort(F.collect_list(F.struct(
            "b_ord", "b_name", budget.alias("budget"), longer.alias("longer")))).alias("near"))
        first_near = F.expr("aggregate(near, cast(null as bigint), (acc, b) -> coalesce(acc,"
                            f" if({_similar('a_name', 'b.b_name', 'b.budget', 'b.longer')}, b.b_ord, null)))")
        met = materialize(near.select(*_OWN, F.col("a_ord").alias("later_ord"), first_near.alias("_first")).groupBy(
            *_OWN, "later_ord").agg(F.min("_first").alias("earlier_ord")).filter("earlier_ord is not null"))
        found = met if found is None else found.unionByName(met)
        gone = met.select(*_OWN, F.col("later_ord").alias("ord")).unionByName(head.select(*key))
        open_texts = materialize(open_texts.join(gone, key, "left_anti"))
        done, size = size, size * GROWTH
        # what the next step would compare
        left, work = open_texts.agg(F.count("*"), F.sum(F.least(F.lit(size), F.col("n")) - done)).first()
        if not left or work > STEP_WORK * EARLY * n:
            break
    first = ranked.filter(F.col("_rank") <= done).select(*key)
    marked = open_texts.select(*key, "open")
    rest = texts.drop("open").join(first, key, "left_anti").join(marked, key, "left")
    return materialize(rest.withColumn("open", F.coalesce("open", F.lit(False)))), found


# -- patterns ---------------------------------------------------------------------------


def _pattern_pairs(texts: DataFrame) -> DataFrame:
    """The earliest peer of every open text, of pairs whose longer text has up to PATTERN_MAX characters.

    Up to two edits turn one text into the other if and only if both read the same without the edited letters.
    A letter that was replaced leaves its place in both texts, so the place is part of the key; one
    that was put in or taken out does not. With k edits and a gap g between the lengths, that means:
    g = 0: k places in both, or (k = 2) a letter less in both; g = k: g letters less in the longer text;
    g = 1, k = 2: a letter less in the longer text, then a place in both.
    """
    short = texts.filter((F.col("len") <= PATTERN_MAX) & (edit_budget(F.floor(F.col("len") / FUZZY_THRESHOLD + 1e-6)) >= 1))
    # long_len, k and the form: text without letters, places, and whether it is the longer text's
    base = short.select(*_OWN, "ord", "open", "name", "len", "lens")

    def cut(text: Column, at: Column) -> Column:
        return F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text)))

    def rows(own: DataFrame, form: int, gap: int, long: bool, *cuts: str) -> DataFrame:
        """One row per way to make the cuts: 'place' keeps its place in the key, 'letter' does not."""
        own = own.withColumns({"text": F.col("name"), "places": F.lit(0)})
        before = None
        for kind in cuts:
            # of two cuts of a kind only those from left to right are made: the second at or behind the first
            low = F.col("_at") if before == kind else F.lit(1)
            own = own.filter(F.length("text") >= low).withColumn("_at", F.explode(F.sequence(low, F.length("text"))))
            own = own.withColumn("text", cut(F.col("text"), F.col("_at")))
            if kind == "place":
                own = own.withColumn("places", F.col("places") * 64 + F.col("_at"))
            before = kind
        longest = F.col("len") + (0 if long else gap)
        mark = [*_OWN, longest, F.lit(form), F.lit(gap), "places", "text"]
        return own.select(*_OWN, "ord", "open", F.lit(gap == 0).alias("both"), F.lit(long).alias("long"),
                          # two hashes of 64 bits: no two of a billion keys fall together
                          F.xxhash64(*mark).alias("key"), F.xxhash64(F.lit(form), "text", "places", longest, *_OWN).alias("key2"))

    def allowed(k: int, longest: Column) -> Column:
        return (edit_budget(longest) == k) & (longest <= PATTERN_MAX)

    found, length = [], F.col("len")
    for k, form, gap, long_cuts, short_cuts in (
        (1, 0, 0, ("place",), None), (1, 1, 1, ("letter",), ()),
        (2, 2, 0, ("place", "place"), None), (2, 3, 0, ("letter",), None),
        (2, 4, 1, ("letter", "place"), ("place",)), (2, 5, 2, ("letter", "letter"), ()),
    ):
        longer = base.filter(allowed(k, length))
        if short_cuts is None:
            found.append(rows(longer, form, gap, True, *long_cuts))
            continue
        # only lengths that the batch has
        found.append(rows(longer.filter(F.array_contains("lens", length - gap)), form, gap, True, *long_cuts))
        shorter = base.filter(allowed(k, length + gap)).filter(F.array_contains("lens", length + gap))
        found.append(rows(shorter, form, gap, False, *short_cuts))
    keyed = found[0]
    for more in found[1:]:
        keyed = keyed.unionByName(more)
    same = Window.partitionBy("key", "key2")
    keyed = keyed.withColumns({
        "_of_long": F.min(F.when(F.col("long"), F.col("ord"))).over(same),
        "_of_short": F.min(F.when(~F.col("long"), F.col("ord"))).over(same),
    })
    peer = F.when(F.col("both") | ~F.col("long"), F.col("_of_long")).otherwise(F.col("_of_short"))
    return keyed.filter("open").withColumn("earlier_ord", peer).filter("earlier_ord < ord").groupBy(
        *_OWN, F.col("ord").alias("later_ord")).agg(F.min("earlier_ord").alias("earlier_ord"))


# -- segments ---------------------------------------------------------------------------


def _segment_pairs(texts: DataFrame, roomy: bool, parts: int) -> DataFrame:
    """Similar pairs whose longer text has PATTERN_MAX + 1 to SEGMENT_MAX characters and whose later one is open."""
    sized = texts.drop("n", "lens")
    length = F.col("len")
    least = F.lit(PATTERN_MAX + 1)
    reach = F.least(F.floor(length / FUZZY_THRESHOLD + 1e-6).cast("int"), F.lit(SEGMENT_MAX))
    short = (
        sized.filter(reach >= least).filter(length <= SEGMENT_MAX)
        .withColumn("long_len", F.explode(F.sequence(F.greatest(length, least), reach)))
        .withColumnRenamed("len", "short_len")
        .withColumn("k", edit_budget(F.col("long_len")))
        .filter("k >= 1 and long_len - short_len <= k")
    )
    long = (
        sized.filter(length.between(least, SEGMENT_MAX)).withColumn("k", edit_budget(length))
        .withColumn("short_len", F.explode(F.sequence(F.greatest(F.lit(1), length - F.col("k")), length)))
        .withColumnRenamed("len", "long_len")
    )
    start = F.xxhash64("batch_id", "entity_type", "long_len", "short_len")
    short = short.withColumns({"sig": start, "rest": F.col("name")})
    long = long.withColumns({"sig": start, "rest": F.col("name")})
    found = []
    for level in range(REFINE_LEVELS + 1):
        short, long = _cut(short, probe=False), _cut(long, probe=True)
        crowded = None if roomy else _crowded(short, long)
        if crowded is None:
            found.append(_cold(short, long, roomy, parts))
            break
        short, cold_short = _split(short, crowded)
        long, cold_long = _split(long, crowded)
        found.append(_cold(cold_short, cold_long, roomy, parts))
        short, long = materialize(short), materialize(long)
        if level == REFINE_LEVELS:
            found += _climb(short, long, crowded, parts)
            break
        found.append(_meet(short, long, None, 0, 0, parts))
        best = _best(found[-1])
        left = _left_over(short, long, best)
        few = left.filter(F.col("todo") <= KEY_PAIRS)
        last = _steps(crowded)
        found.append(_meet(_under(short, few), _under(long, few), best, 1, last, parts))
        many = left.filter(F.col("todo") > KEY_PAIRS)
        if many.isEmpty():
            break
        short, long = _under(short, many), _under(long, many)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _cut(texts: DataFrame, probe: bool) -> DataFrame:
    """One row per segment (or, for the longer text, per place a segment may have moved to).

    `rest` is the text still uncut. Its k + 1 segments have even lengths, the last ones one
    character longer. Segment i can move by at most i characters counted from the left and by
    k - i counted from the right. The cut-out piece joins the signature, the remainder is the
    next `rest`.
    """
    gap = F.col("long_len") - F.col("short_len")
    size = F.length("rest") - (gap if probe else F.lit(0))
    parts = F.col("k") + 1
    cut = texts.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    base = F.floor(size / parts).cast("int")
    longer_from = parts - F.pmod(size, parts)
    cut = cut.withColumns({
        "_len": base + (F.col("_i") >= longer_from).cast("int"),
        "_at": F.col("_i") * base + F.greatest(F.lit(0), F.col("_i") - longer_from),
    })
    if probe:
        right = F.col("k") - F.col("_i")
        cut = cut.withColumns({
            "_lo": F.greatest(F.lit(0), F.col("_at") - F.col("_i"), F.col("_at") + gap - right),
            "_hi": F.least(F.length("rest") - F.col("_len"), F.col("_at") + F.col("_i"),
                           F.col("_at") + gap + right),
        }).filter("_lo <= _hi").withColumn("_at", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    piece = F.substring("rest", F.col("_at") + 1, F.col("_len"))
    around = F.concat(F.substring("rest", F.lit(1), F.col("_at")),
                      F.substring("rest", F.col("_at") + F.col("_len") + 1, F.length("rest")))
    return cut.select(
        "batch_id", "entity_type", "name", "ord", "open", *_BITS, "long_len", "short_len", "k",
        F.xxhash64("sig", "_i", piece).alias("sig"), around.alias("rest"),
    )


def _crowded(short: DataFrame, long: DataFrame) -> DataFrame | None:
    """Signatures with more than KEY_PAIRS pairs of an open text, their sizes and the span of their places."""
    sizes = (
        short.select("sig", "ord", "open", F.lit(1).alias("_s"), F.lit(0).alias("_l"))
        .unionAll(long.select("sig", "ord", "open", F.lit(0), F.lit(1)))
        .groupBy("sig").agg(F.sum("_s").alias("n_short"), F.sum("_l").alias("n_long"),
                            F.sum(F.when(F.col("open"), F.col("_s"))).alias("_open_short"),
                            F.sum(F.when(F.col("open"), F.col("_l"))).alias("_open_long"),
                            F.min("ord").alias("lo"), F.max("ord").alias("hi"))
        .filter(F.greatest(F.coalesce("_open_short", F.lit(0)) * F.col("n_long"),
                           F.coalesce("_open_long", F.lit(0)) * F.col("n_short")) > KEY_PAIRS)
        .drop("_open_short", "_open_long")
        .withColumn("n_rows", F.col("n_short") + F.col("n_long"))
    )
    return None if sizes.isEmpty() else materialize(sizes)


_SIZES = ("n_short", "n_long", "lo", "hi", "n_rows")


def _split(texts: DataFrame, crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows under crowded signatures, with the sizes, and the others."""
    marked = skew.lookup(texts, crowded, on=("sig",), take=_SIZES, weight="n_rows",
                         spread_by=(F.col("name"), F.col("ord")))
    return marked.filter("n_rows is not null"), marked.filter("n_rows is null").drop(*_SIZES)


def _steps(crowded: DataFrame) -> int:
    """The step at which the early part of the largest crowd is all of it."""
    size, step = crowded.agg(F.max("n_rows")).first()[0], 0
    while EARLY * GROWTH ** step < size:
        step += 1
    return step


def _until(step: int) -> Column:
    """First place behind the early part: its share of the crowd's span of places.

    Places stand in for ranks, so no crowd has to be sorted; an uneven spread costs balance only.
    """
    if step < 0:
        return F.col("lo")
    share = F.least(F.lit(1.0), F.lit(float(EARLY * GROWTH ** step)) / F.col("n_rows"))
    return F.col("lo") + F.floor((F.col("hi") - F.col("lo") + 1) * share)


def _open(texts: DataFrame, best: DataFrame | None, step: int) -> DataFrame:
    """Rows that may still find an earlier peer at or behind the start of the step."""
    start = _until(step - 1)
    rows = texts.filter(F.col("open") & (F.col("ord") > start))
    if best is None:
        return rows
    own = ["batch_id", "entity_type"]
    known = best.withColumnRenamed("later_ord", "ord")
    return rows.join(known, [*own, "ord"], "left").filter(
        F.col("best_ord").isNull() | (F.col("best_ord") > start)
    ).drop("best_ord")


def _meet(short: DataFrame, long: DataFrame, best: DataFrame | None, first: int, last: int,
          parts: int) -> DataFrame:
    """Similar pairs whose earlier name lies in the steps `first` to `last` of its crowd."""
    early = (F.col("ord") >= _until(first - 1)) & (F.col("ord") < _until(last))
    size = F.least(F.col("n_rows"), F.lit(EARLY * GROWTH ** last))
    one = _grid_join(short.filter(early), _open(long, best, first), size, F.col("n_long"), parts)
    two = _grid_join(_open(short, best, first), long.filter(early), F.col("n_short"), size, parts)
    return materialize(
        _verified(one.filter("a_ord < b_ord")).unionByName(_verified(two.filter("b_ord < a_ord")))
    )


def _best(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.groupBy("batch_id", "entity_type", "later_ord").agg(
        F.min("earlier_ord").alias("best_ord")))


def _climb(short: DataFrame, long: DataFrame, crowded: DataFrame, parts: int) -> list[DataFrame]:
    """Let the early part grow until it is the whole crowd."""
    found, best = [], None
    for step in range(_steps(crowded) + 1):
        found.append(_meet(short, long, best, step, step, parts))
        seen = found[0]
        for more in found[1:]:
            seen = seen.unionByName(more)
        best = _best(seen)
    return found


def _left_over(short: DataFrame, long: DataFrame, best: DataFrame) -> DataFrame:
    """Per crowded signature the pairs its open rows still ask for after the first step."""
    todo = _open(short, best, 1).select("sig", "n_rows", F.col("n_long").alias("_n")).unionAll(
        _open(long, best, 1).select("sig", "n_rows", F.col("n_short")))
    return materialize(todo.groupBy("sig").agg(F.sum("_n").alias("todo"), F.max("n_rows").alias("weight")))


def _cold(short: DataFrame, long: DataFrame, every_open: bool, parts: int) -> DataFrame:
    """Similar pairs under one signature; of two texts the later one has to be open."""
    if every_open:
        return _verified(_join(short, long, ["sig"], parts))
    return _verified(_open_join(short, long, parts))


def _open_join(short: DataFrame, long: DataFrame, parts: int) -> DataFrame:
    one = _join(short, long.filter("open"), ["sig"], parts).filter("a_ord < b_ord")
    # of texts of equal length the shorter one, by name, is the earlier one
    two = _join(short.filter("open"), long, ["sig"], parts).filter("b_ord < a_ord")
    return one.unionByName(two)


def _under(texts: DataFrame, signatures: DataFrame) -> DataFrame:
    return skew.lookup(texts, signatures, on=("sig",), take=("todo",), weight="weight",
                       spread_by=(F.col("name"), F.col("ord"))).filter("todo is not null").drop("todo")


def _join(short: DataFrame, long: DataFrame, on: list[str], parts: int) -> DataFrame:
    def side(rows: DataFrame, p: str, size: str) -> DataFrame:
        bits = _BITS if "g0" in rows.columns else ()
        own = ["batch_id", "entity_type", "name", "ord", *bits]
        return rows.select(
            *on, *[F.col(c).alias(f"{p}_{c}") for c in own], F.col(size).alias(f"{p}_len")
        ).repartition(parts, *on)

    pairs = side(short, "a", "short_len").join(side(long, "b", "long_len"), on, "inner").filter(
        (F.col("a_batch_id") == F.col("b_batch_id")) & (F.col("a_entity_type") == F.col("b_entity_type"))
        # Texts of equal length meet in both roles; one of the two is enough.
        & ((F.col("a_len") < F.col("b_len")) | (F.col("a_ord") < F.col("b_ord")))
    )
    if "a_g0" in pairs.columns:
        pairs = pairs.filter(_near_bits(F.col("b_len") - F.col("a_len"), edit_budget(F.col("b_len"))))
    return pairs.withColumnsRenamed({"a_batch_id": "batch_id", "a_entity_type": "entity_type"})


def _grid_join(short: DataFrame, long: DataFrame, n_short: Column, n_long: Column, parts: int) -> DataFrame:
    """Join with each signature cut into blocks of about BLOCK rows on both sides.

    A block of one side meets every block of the other, each meeting under its own join key, so
    the comparison is whole and no signature lands in one task.
    """
    def blocks(n: Column) -> Column:
        return F.ceil(n / BLOCK).cast("bigint")

    def own(n: Column) -> Column:
        return F.pmod(F.xxhash64("name", "ord"), blocks(n))

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), blocks(n) - 1))

    a = short.withColumn("_x", own(n_short)).withColumn("_y", every(n_long))
    b = long.withColumn("_y", own(n_long)).withColumn("_x", every(n_short))
    return _join(a, b, ["sig", "_x", "_y"], parts)


# -- grams ------------------------------------------------------------------------------


def _gram_pairs(names: DataFrame, roomy: bool, parts: int) -> DataFrame:
    """Similar pairs whose longer text exceeds SEGMENT_MAX characters and whose later one is open.

    A pair with longer length L shares at least L(1 - 0.15 q) - q + 1 grams of q letters.
    Order all grams by one fixed ranking, rare ones first: a pair that shares t of a text's n
    grams shares one among its first n - t + 1. Repeats of a gram are numbered, so counts are
    exact. The ranking only affects speed; it puts the most frequent grams last.
    """
    slack = 1.0 - FUZZY_THRESHOLD
    length = F.col("len")
    texts = names.select("batch_id", "entity_type", "name", "ord", "len", "open").filter(F.floor(length / FUZZY_THRESHOLD + 1e-6) > SEGMENT_MAX)
    grams = texts.select(
        "batch_id", "entity_type", "ord", "len",
        F.explode(F.expr(
            f"transform(sequence(1, len - {GRAM - 1}), i -> substring(name, i, {GRAM}))"
        )).alias("gram"),
    )
    counted = grams.groupBy("batch_id", "entity_type", "ord", "len", "gram").count()
    common = (
        counted.groupBy("gram").agg(F.sum("count").alias("freq"))
        .orderBy(F.col("freq").desc(), "gram").limit(COMMON_GRAMS)
    )
    shared = F.ceil(length * (1.0 - slack * GRAM) - GRAM + 1 - 1e-6)
    keep = length - GRAM + 1 - shared + 1
    rank = F.row_number().over(
        Window.partitionBy("batch_id", "entity_type", "ord").orderBy("freq", "gram", "nth")
    )
    prefix = (
        counted.join(F.broadcast(common), "gram", "left")
        .withColumn("freq", F.coalesce("freq", F.lit(0)))
        .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("count"))))
        .withColumn("_rank", rank).filter(F.col("_rank") <= keep)
        .select("batch_id", "entity_type", "ord",
                F.xxhash64("batch_id", "entity_type", "gram", "nth").alias("sig"))
    )
    keyed = prefix.join(texts, ["batch_id", "entity_type", "ord"])
    short = keyed.withColumns({"short_len": F.col("len"), "long_len": F.col("len")})
    long = short.filter(length > SEGMENT_MAX)
    crowded = None if roomy else _crowded(short, long)
    climbed = []
    if crowded is not None:
        hot_short, short = _split(short, crowded)
        hot_long, long = _split(long, crowded)
        climbed = _climb(materialize(hot_short), materialize(hot_long), crowded, parts)
    close = F.col("b_len") - F.col("a_len") <= edit_budget(F.col("b_len"))
    # One comparison per pair, however many grams it shares.
    met = _join(short, long, ["sig"], parts) if roomy else _open_join(short, long, parts)
    once = met.filter(close).dropDuplicates(
        ["batch_id", "entity_type", "a_ord", "b_ord"])
    out = _verified(once)
    for more in climbed:
        out = out.unionByName(more)
    return out
