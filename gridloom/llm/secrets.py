"""Secret scan: candidates by shape, false positives removed by a random forest.

A candidate is any run of 16 or more letters, digits and + / _ - inside a word, a token of three or more such
parts joined by dots, or the value, of 6 characters or more and with any marks, that is assigned to a name like
`password`, in the same word or the next. A word has as many candidates as it holds. The forest sees its
length, how often the kind of character changes, how varied and of which kinds they are, how much of
it a dictionary covers (the four-letter parts of words that the corpus itself uses often), the path
it stands under, and the words around it. It is trained on labelled findings.

`findings_by_rule` gives such labels where nobody has labelled any: provider keys of a fixed form and
random-looking values behind a word like `password` are secrets; values without any digit, plain
numbers and values that hold a word like `example`, or are assigned to such a name, are not; the rest has no label and is left to the
forest. Training takes about `sample` labelled findings, chosen by a hash. If only one kind of label
occurs, findings labelled as secrets are reported as such.

A null or empty text has no candidates; a null path is an empty one. Rows with null ids are scanned
too. Rows equal in id and text get the same findings. Other columns stay, whatever their names. An
empty table gives no rows. Everything is built of DataFrame functions and Spark's own learner.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.lineage import materialize

RUN = r"(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]{8,}+(?:\.[A-Za-z0-9_\-]{8,}+){2,}+|[A-Za-z0-9+/_\-]{16,}+"
#: Times a word has to occur in the corpus to stand in the dictionary.
OFTEN = 20
_ROW = "_gl_row"
# Words that announce a secret, words of examples, and public forms of provider keys.
_ANNOUNCED = r"(?i)pass(?:word|wd|phrase)?|pwd|secret|token|api.?key|access.?key|auth|bearer|credential|private"
_EXAMPLE = r"(?i)example|sample|dummy|placeholder|changeme|fake|your[_-]"
_PROVIDER = r"^(?:A(?:KIA|SIA|ROA|IDA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_\-]{35}|eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+|sk_live_[A-Za-z0-9]{16,})$"
_NAME = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api.?key|access.?key|auth|credential|private.?key)[A-Za-z0-9_\-]{0,20}[\"'`]?"
# a value assigned in the same word, the words before a value, and such a value without its quotes
_ASSIGNED_VALUE = rf"(?i){_NAME}[=:]+[\"'`]?([^\s\"'`,;&<>=:]{{6,}})"
_ASSIGNMENT = rf"(?i){_NAME}\s*[=:]+[\"'`]?$"
_BARE_VALUE = r"^[\"'`(\[]*([^\s\"'`]{6,}?)[\"'`)\],;.]*$"
_TEST_PATH = r"(?i)test|example|sample|mock|fixture|doc"
FEATURES = (
    "length", "changes", "digits", "upper", "lower", "variety", "coverage", "longest_word", "hexadecimal",
    "assigned", "quoted", "announced", "example", "test_path", "path_depth",
)


def _row(id_col: str, text: str) -> Column:
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("h"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """_gl_row (id and text hash), place (number of the word), value and what stands around it."""
    some = docs.where(F.col(text).rlike(rf"{RUN}|(?i){_NAME}\s*[=:]")).select(
        _row(id_col, text).alias(_ROW), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
        F.split(F.col(text), r"\s+").alias("_words"))
    found = some.select(_ROW, "path", F.inline(F.filter(
        F.transform("_words", lambda w, k: F.struct(
            k.alias("place"), w.alias("word"),
            F.concat_ws(" ", F.get("_words", k - 2), F.get("_words", k - 1)).alias("before"))),
        # the cheap half of each test comes first, as most words fail it
        lambda s: ((F.length(s["word"]) >= 16) & s["word"].rlike(RUN))
        | ((s["word"].contains("=") | s["word"].contains(":")) & s["word"].rlike(rf"(?i){_NAME}[=:]"))
        | (F.right(s["before"], F.lit(2)).rlike("[=:]") & s["before"].rlike(_ASSIGNMENT)))))
    next_word = F.when(F.col("before").rlike(_ASSIGNMENT), F.regexp_extract("word", _BARE_VALUE, 1)).otherwise("")
    values = F.array_distinct(F.concat(F.regexp_extract_all("word", F.lit(RUN), F.lit(0)),
                                       F.regexp_extract_all("word", F.lit(_ASSIGNED_VALUE), F.lit(1)), F.array(next_word)))
    found = found.withColumn("value", F.explode(values)).where("value <> ''")
    return found.withColumn("lead", F.expr("substring_index(word, value, 1)")).dropDuplicates([_ROW, "place", "value"])


def dictionary(docs: DataFrame, text: str = "text", often: int = OFTEN) -> DataFrame:
    """The four-letter parts of words that occur often in all texts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    common = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)
    return common.select(F.explode(_parts(F.col("word"))).alias("part")).distinct()


def _parts(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - 3), lambda k: F.substr(word, k, F.lit(4)))


def described(found: DataFrame, known_parts: DataFrame) -> DataFrame:
    """The candidates with the forest's features."""
    value, low = F.col("value"), F.lower("value")
    parts = found.select(_ROW, "place", "value", F.explode(F.array_distinct(_parts(low))).alias("part"))
    covered = parts.join(known_parts.withColumn("_known", F.lit(1.0)), "part", "left").groupBy(_ROW, "place", "value").agg(
        F.avg(F.coalesce("_known", F.lit(0.0))).alias("coverage"))
    length = F.length(value)
    near = F.concat_ws(" ", "before", "lead")
    # what stands before the value since the last value's end, and the name it is assigned to
    close = F.regexp_extract(near, r"[^;,&?/]*$", 0)
    name = F.regexp_extract(near, r"([A-Za-z0-9_.\-]+)[\"'`]?\s*[=:]\W*$", 1)

    def share(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)) / length

    def flag(condition: Column) -> Column:
        return condition.cast("double")

    return found.join(covered, [_ROW, "place", "value"]).withColumns({
        "length": length.cast("double"),
        "changes": F.regexp_count(value, F.lit(
            r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Za-z])|(?<=[0-9])(?=[^0-9])|(?<=[+/_\-])(?=[A-Za-z0-9])")) / length,
        "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"),
        "variety": F.size(F.array_distinct(F.split(value, ""))) / length,
        "longest_word": F.array_max(F.transform(
            F.regexp_extract_all(value, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w))).cast("double"),
        "hexadecimal": flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "assigned": flag(near.rlike(r"[=:]\W*$")), "quoted": flag(F.col("lead").rlike("[\"'`]$")),
        "announced": flag(close.rlike(_ANNOUNCED)),
        "example": flag(F.concat_ws(" ", name, value).rlike(_EXAMPLE)),
        "test_path": flag(F.col("path").rlike(_TEST_PATH)),
        "path_depth": F.regexp_count("path", F.lit("/")).cast("double"),
    }).fillna(0.0, ["longest_word"])


def findings_by_rule(features: DataFrame) -> DataFrame:
    """The candidates with label: 1.0 a secret, 0.0 none, null undecided."""
    mixed = (F.col("digits") > 0) & (F.col("digits") < 1) & (F.col("changes") >= 0.15)
    return features.withColumn("label", F.when(F.col("example") > 0, 0.0)
                               .when(F.col("value").rlike(_PROVIDER), 1.0)
                               .when((F.col("announced") > 0) & (F.col("assigned") > 0) & mixed, 1.0)
                               .when((F.col("digits") == 0) | (F.col("digits") == 1), 0.0))


def train(labelled: DataFrame, sample: int = 20_000) -> PipelineModel | None:
    """A forest on about `sample` labelled findings; None if one kind of label is missing."""
    labelled = labelled.where(F.col("label").isNotNull())
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    # both kinds get half of the sample, as far as there are as many
    chance = F.lit(0)
    for label, n in counts.items():
        chance = F.when(F.col("label") == label, int(min(1.0, sample / 2 / n) * (1 << 30))).otherwise(chance)
    chosen = labelled.where(F.pmod(F.xxhash64("value", "place", _ROW), F.lit(1 << 30)) < chance)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=30, maxDepth=8, seed=5,
                                    probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction")
    return PipelineModel([assembler, forest.fit(assembler.transform(chosen.select("label", *FEATURES)))])


def scan(docs: DataFrame, labelled: DataFrame | None = None, sample: int = 20_000, id_col: str = "doc_id",
         text: str = "text", path: str = "source", cut: float = 0.5) -> DataFrame:
    """Findings held for secrets: _gl_row, place, value, probability.

    labelled: findings with the columns of `described` and label; none: those that the rules label.
    """
    found = materialize(candidates(docs, id_col, text, path))
    features = materialize(findings_by_rule(described(found, dictionary(docs, text))))
    model = train(features if labelled is None else labelled, sample)
    if model is None:
        scored = features.select(_ROW, "place", "value", F.coalesce("label", F.lit(0.0)).alias("probability"))
    else:
        scored = model.transform(features).select(
            _ROW, "place", "value", F.get(vector_to_array("_probability"), F.lit(1)).alias("probability"))
    return scored.where(F.col("probability") >= cut)


def redact(docs: DataFrame, findings: DataFrame, mask: str = "[secret]", id_col: str = "doc_id",
           text: str = "text") -> DataFrame:
    """The documents with found values replaced; all rows and columns stay."""
    # longest first, so that no value is cut by a shorter one inside it
    values = findings.groupBy(_ROW).agg(F.collect_set("value").alias("_gl_values")).withColumn(
        "_gl_values", F.array_sort("_gl_values", lambda a, b: F.length(b) - F.length(a)))
    values = values.select(F.col(f"{_ROW}.id").alias("_gl_id"), F.col(f"{_ROW}.h").alias("_gl_h"), "_gl_values")
    rows = docs.join(values, F.col(id_col).eqNullSafe(F.col("_gl_id")) & (F.xxhash64(F.col(text)) == F.col("_gl_h")), "left")
    clean = F.when(F.col("_gl_values").isNull(), F.col(text)).otherwise(
        F.aggregate("_gl_values", F.col(text), lambda t, v: F.replace(t, v, F.lit(mask))))
    return rows.withColumn(text, clean).select(*docs.columns)
