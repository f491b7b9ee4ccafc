"""SpotSigs fingerprints: chains of content words that follow common words.

Every common word (an anchor) of a text gives a signature: the anchor and the next content words
behind it. A text's fingerprint is the set of its signatures' hashes; two texts are as alike as the
Jaccard likeness of their sets. Texts without any signature (too short, or no common word) have the
hash of the whole text instead, so equal texts always have equal fingerprints.

Nulls: a null text reads as empty. A null id is a document like others, last in the order. Rows
equal in id and text keep their place in the result, each with the same next document. An empty
table gives no rows; columns other than id and text are not read. Everything is built of DataFrame
functions.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.lineage import materialize

# Common words of English, German, French and Spanish.
COMMON_WORDS = (
    "a", "al", "an", "and", "are", "as", "at", "auf", "aux", "avec", "be", "but", "by", "con", "dans", "das",
    "de", "del", "dem", "den", "der", "des", "die", "du", "ein", "eine", "el", "en", "es", "est", "et", "for",
    "from", "für", "had", "has", "have", "he", "i", "ich", "il", "im", "in", "is", "ist", "it", "la", "las", "le",
    "les", "lo", "los", "mit", "nicht", "not", "of", "on", "or", "para", "par", "pas", "por", "pour", "que",
    "qui", "se", "sich", "sie", "su", "sur", "that", "the", "they", "this", "to", "un", "una", "und", "une",
    "von", "was", "were", "which", "with", "you", "y", "zu",
)
#: Content words in a signature.
CHAIN = 3
#: Stands for a null id.
_NO_ID = -(1 << 63)
_WORD = r"[\p{L}\p{N}]"


def _content_pattern(anchors: Sequence[str]) -> str:
    """Words that are no anchors. Alternatives are grouped by first letter, which the regex engine
    doesn't do by itself."""
    by_letter = defaultdict(list)
    for word in anchors:
        by_letter[word[0]].append(word[1:])
    alternatives = "|".join(f"{c}(?:{'|'.join(sorted(rest))})" for c, rest in sorted(by_letter.items()))
    return rf"(?<!{_WORD})(?!(?:{alternatives})(?!{_WORD})){_WORD}+"


def _hash(text: Column) -> Column:
    """28 bits of the MD5 digest."""
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(7)), 16, 10).cast("int")


def signatures(text: Column, anchors: Sequence[str] = COMMON_WORDS, chain: int = CHAIN) -> Column:
    """The sorted set of a text's signature hashes, array<int>."""
    pattern = _content_pattern(anchors)
    low = F.lower(F.coalesce(text, F.lit("")))
    content = F.regexp_extract_all(low, F.lit(pattern), F.lit(0))
    # what lies before the k-th content word: blanks and, perhaps, anchors
    gaps = F.split(low, pattern)

    def spots(words: Column) -> Column:
        def of_gap(gap: Column, k: Column) -> Column:
            words_behind = [F.get(words, k + n) for n in range(chain)]
            found = F.when(
                (F.length(gap) > 1) & (k + chain <= F.size(words)),
                F.regexp_extract_all(gap, F.lit(f"{_WORD}+"), F.lit(0)),
            ).otherwise(F.array().cast("array<string>"))
            return F.transform(found, lambda anchor: _hash(F.concat_ws(" ", anchor, *words_behind)))

        return F.array_distinct(F.flatten(F.transform(gaps, of_gap)))

    # the words are named once: an array of one, taken out again
    found = F.get(F.transform(F.array(content), spots), F.lit(0))
    whole = F.array(_hash(F.concat(F.lit("whole "), F.coalesce(text, F.lit("")))))
    return F.get(F.transform(F.array(found), lambda s: F.when(F.size(s) > 0, F.array_sort(s)).otherwise(whole)), F.lit(0))


def fingerprint(hashes: Column) -> Column:
    """A set of hashes as a string of seven hexadecimal digits each."""
    return F.array_join(F.transform(hashes, lambda x: F.lower(F.lpad(F.hex(x), 7, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets, 0 to 1."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of ids (a < b) of distinct fingerprints at least this alike, with their likeness; equal
    fingerprints are first put together under their smallest id.

    Sets are partitioned by length: bands whose ends have the ratio `threshold`, so partners stand in
    the same band or the next. Inside a band only the rarest signatures of a set are looked up, as
    many as a partner can't avoid sharing one of; sets whose lengths rule a pair out are not compared.
    """
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), signatures(F.col(text)).alias("set"))
    sets = materialize(own.groupBy("set").agg(F.min("id").alias("id")))
    counted = sets.select("id", F.explode("set").alias("sig"))
    seen = counted.groupBy("sig").agg(F.count("*").alias("seen"))
    ranked = counted.join(seen, "sig").where("seen > 1").groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seen", "sig"))), lambda x: x["sig"]).alias("order"))
    size = F.size("set")
    # signatures found nowhere else stand before all others and can't match
    length = F.greatest(F.lit(0), F.floor(size * (1 - threshold) + 1e-9).cast("int") + 1 - (size - F.size("order")))
    band = F.floor(F.log(size) / -F.log(F.lit(threshold)))
    keyed = sets.join(ranked, "id").select(
        "id", size.alias("size"), band.alias("band"), F.explode(F.slice("order", F.lit(1), length)).alias("sig"))
    a = keyed.withColumnsRenamed({"id": "a", "size": "a_size"}).withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    b = keyed.withColumnsRenamed({"id": "b", "size": "b_size"})
    fits = (F.col("a_size") >= F.col("b_size") * threshold - 1e-9) & (
        (F.col("a_size") < F.col("b_size")) | (F.col("a_size") == F.col("b_size")) & (F.col("a") < F.col("b")))
    pairs = a.join(b, ["band", "sig"]).where(fits).select("a", "b").distinct()
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("a_set")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("set").alias("b_set")), "b")
    alike = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                         likeness(F.col("a_set"), F.col("b_set")).alias("likeness"))
    return alike.where(F.col("likeness") >= threshold - 1e-9)


def _keys(docs: DataFrame) -> DataFrame:
    """text, _id, _h (hash of the text) and _n (its length)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        text.alias("text"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("_id"),
        F.xxhash64(text).alias("_h"), F.length(text).cast("long").alias("_n"))


def _previous(keyed: DataFrame) -> DataFrame:
    """Each key with the one before it by descending id (before the first: the last).

    Only ids travel: they are sorted by range; at a range's first row the last row of the range before
    comes from a table with one row per range.
    """
    keys = keyed.groupBy("_id", "_h").agg(F.min("_n").alias("_n"))
    ranged = materialize(keys.repartitionByRange(F.desc("_id"), "_h").withColumn("_range", F.spark_partition_id()))
    order = Window.partitionBy("_range").orderBy(F.desc("_id"), "_h")
    key = F.struct("_id", "_h", "_n")
    rows = ranged.select("*", F.row_number().over(order).alias("_row"), F.lag(key).over(order).alias("_before"))
    tails = rows.groupBy("_range").agg(F.max_by(key, "_row").alias("_tail"))
    by_range = Window.orderBy("_range")
    every = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tails = tails.select("_range", F.coalesce(F.lag("_tail").over(by_range), F.last("_tail").over(every)).alias("_tail"))
    found = rows.join(F.broadcast(tails), "_range")  # one row per range
    before = F.coalesce("_before", "_tail")
    return found.select("_id", "_h", before["_id"].alias("_before_id"), before["_h"].alias("_before_h"),
                        F.floor(before["_n"] / 3).cast("int").alias("_taken"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of an edited text and that of the next document.

    The next document is the next lower doc_id (after the last: the highest; equal ids by a hash of
    the text). Edited: the last third of the text is replaced by as much of the next one's beginning.
    Returns doc_id, n_chars, text, edited, own_set, edited_set, next_set.
    """
    keyed = _keys(docs)
    # read twice with the same columns, so that Spark deals the texts out once
    dealt = keyed.select("_id", "_h", "text", signatures(F.col("text")).alias("own_set"))
    # the beginning of each text goes to the document that stands before it
    heads = dealt.join(_previous(keyed), ["_id", "_h"]).select(
        F.col("_before_id").alias("_id"), F.col("_before_h").alias("_h"),
        F.struct(F.left("text", F.col("_taken")).alias("head"), F.col("own_set").alias("set")).alias("_next"),
    ).groupBy("_id", "_h").agg(F.first("_next").alias("_next"))
    n = F.length("text").cast("long")
    both = dealt.join(heads, ["_id", "_h"]).select(
        F.nullif("_id", F.lit(_NO_ID)).alias("doc_id"), n.alias("n_chars"), "text",
        F.concat(F.left("text", (n - F.floor(n / 3)).cast("int")), F.col("_next.head")).alias("edited"),
        "own_set", F.col("_next.set").alias("next_set"))
    return both.withColumn("edited_set", signatures(F.col("edited")))
