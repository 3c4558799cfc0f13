"""Secret scans with character Markov models.

Base patterns find assigned values, access keys and hex strings. The method adds strings that look random:
first-order Markov models over characters, one of random strings and one of ordinary identifiers, are compared by
log-likelihood ratio. The labelled samples are the corpus's own, whole: the base matches are random strings, the
words of all documents without any base match are ordinary ones, if they stand there twice at least: words recur,
random strings don't, and one that no base pattern finds is not to be learnt as a word. Numbers are ordinary always. A string is a secret if the ratio over all its
characters reaches `THRESHOLD` bits, whatever its length (a short string has fewer bits to show); `MIN_RANDOM` is the
least length that is looked at, as that of an assigned value is in the base pattern.

Everything is built-in functions: a match's position is the running sum of the lengths of the pieces and
matches before it, and a string's score is a sum over its character pairs, looked up in an array.

Defined cases: null and blank texts have no spans; without base matches the random model is uniform by its
smoothing; rows are told apart by an ordinal, so null and repeated ids give one row each; an empty table gives
no rows; extra columns are ignored, whatever their names; a text of any length is scanned whole, in one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Kinds in the order in which spans that start together are listed; "random" is the method's own.
KINDS = ("assign", "access", "hex", "random")

#: Pattern and the group that is the string itself.
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    "access": (r"AKIA[A-Z0-9]+", 0),
    "hex": (r"[0-9a-f]{32,}", 0),
}
BASE = tuple(PATTERNS)
_TOKEN = "[A-Za-z0-9+/_=-]"
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_VALUE, MIN_ACCESS, MIN_RANDOM = 8, 16, 8
PATTERNS["random"] = (rf"(?<!{_TOKEN}){_TOKEN}{{{MIN_RANDOM},}}", 0)

#: Characters that the models tell apart; all others are one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
_CODES = len(ALPHABET) + 1
#: Occurrences from which on a word is an ordinary one.
MIN_SEEN = 2
SMOOTHING = 0.5
#: Weight of a character's own frequency in its probability after another.
BACK_OFF = 10.0
#: Least log-likelihood ratio of a string, in bits: what outweighs one random string in a million.
THRESHOLD = 20.0


def _may_hold(text: Column, kind: str) -> Column:
    """False only where a text can't match the kind's pattern; cheaper than the pattern."""
    if kind == "assign":
        low = F.lower(text)
        return F.greatest(*[low.contains(k) for k in _KEYS])
    if kind == "access":
        return text.contains("AKIA")
    return F.rlike(text, F.lit(PATTERNS[kind][0]))


def _none() -> Column:
    return F.expr("cast(array() as array<struct<kind:string,gap:int,size:int,token:string>>)")


def _matches(text: Column, kind: str) -> Column:
    """array<struct<kind, gap, size, token>>: what stands before each match, and the match, in code points."""
    pattern, group = PATTERNS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    token = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), token.alias("token"))
    found = F.filter(zipped, lambda x: x["whole"].isNotNull())  # the text after the last match has none
    row = lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("size"), x["token"].alias("token"))
    return F.when(_may_hold(text, kind), F.transform(found, row)).otherwise(_none())


def scan(docs: DataFrame, table: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """ordinal, doc_id, found: one row per row of docs, with the matches of the base patterns, and where one looks random all of the method's."""
    own = docs.select(F.monotonically_increasing_id().alias("ordinal"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tokens = F.regexp_extract_all("text", F.lit(PATTERNS["random"][0]), F.lit(0))
    random = F.when(F.exists(tokens, lambda x: score(x, table) >= threshold), _matches(F.col("text"), "random")).otherwise(_none())
    return own.select("ordinal", "doc_id", F.concat(*[_matches(F.col("text"), k) for k in BASE], random).alias("found"))


def _holds() -> Column:
    return F.when(F.col("kind") == "assign", F.length("token") >= MIN_VALUE).when(F.col("kind") == "access", F.col("size") >= MIN_ACCESS).otherwise(True)


def located(scanned: DataFrame) -> DataFrame:
    """ordinal, kind, start, end, token of the matches that hold."""
    each = scanned.where(F.size("found") > 0).select("ordinal", F.posexplode("found").alias("i", "x")).select("ordinal", "i", "x.*")
    before = Window.partitionBy("ordinal", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    rows = each.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.col("size"))
    return rows.where(_holds()).select("ordinal", "kind", "start", "end", "token")


def _codes(token: Column) -> Column:
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(ALPHABET)))


def _pairs(token: Column) -> Column:
    """The indices of a string's character pairs, as one number each."""
    codes = _codes(token)
    return F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: a * _CODES + b)


def transitions(tokens: DataFrame) -> dict[int, int]:
    """Counts of the character pairs of `token`, each standing for n; at most _CODES squared of them."""
    pairs = tokens.where(F.length("token") > 1).select(F.explode(_pairs(F.col("token"))).alias("pair"), "n")
    return {r.pair: r.n for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}


def ratios(random: dict[int, int], ordinary: dict[int, int], smoothing: float = SMOOTHING) -> list[float]:
    """Log-likelihood ratio of each pair, in bits: its second character's probability after the first, random against ordinary.

    A pair that training has not seen falls back on how often its second character was seen at all.
    """

    def log_probabilities(counts: dict[int, int]) -> list[float]:
        codes = range(_CODES)
        into = [sum(counts.get(a * _CODES + b, 0) for a in codes) + smoothing for b in codes]
        alone = [x / sum(into) for x in into]
        out = []
        for a in codes:
            row = [counts.get(a * _CODES + b, 0) + BACK_OFF * alone[b] for b in codes]
            out += [math.log2(x / sum(row)) for x in row]
        return out

    return [r - o for r, o in zip(log_probabilities(random), log_probabilities(ordinary), strict=True)]


def score(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a string, in bits: the sum over its transitions."""
    return F.aggregate(_pairs(token), F.lit(0.0), lambda acc, p: acc + F.get(F.lit(table), p))


def random_strings(docs: DataFrame) -> DataFrame:
    """token, n: the strings of all base matches."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select(F.explode(F.concat(*[_matches(text, k) for k in BASE])).alias("x")).select("x.*").where(_holds())
    return each.groupBy("token").agg(F.count("*").alias("n"))


def ordinary_words(docs: DataFrame) -> DataFrame:
    """token, n: the recurring words, and the numbers, of all documents in which no base pattern can match."""
    text = F.coalesce(F.col("text"), F.lit(""))
    clean = docs.select(text.alias("text")).where(~F.greatest(*[_may_hold(F.col("text"), k) for k in BASE]))
    words = clean.select(F.explode(F.regexp_extract_all("text", F.lit(rf"{_TOKEN}{{2,}}"), F.lit(0))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).where((F.col("n") >= MIN_SEEN) | ~F.rlike("token", F.lit("[A-Za-z]")))


def train(docs: DataFrame) -> list[float]:
    return ratios(transitions(random_strings(docs)), transitions(ordinary_words(docs)))


def found(docs: DataFrame, threshold: float = THRESHOLD, table: list[float] | None = None) -> DataFrame:
    """ordinal, doc_id and spans (array of kind, start, end, bits), one row per row of docs; the models are trained on docs unless given."""
    table = table or train(docs)
    scanned = written(scan(docs, table, threshold), "secrets")
    spans = located(scanned)
    rated = spans.withColumn("bits", F.when(F.col("kind") == "random", score(F.col("token"), table))).where(F.col("bits").isNull() | (F.col("bits") >= threshold))
    # base spans stay; of the method's own, those that overlap none
    base = F.col("kind") != "random"
    w = Window.partitionBy("ordinal").orderBy("start", "end")
    last = F.max(F.when(base, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.min(F.when(base, F.col("start"))).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    kept = rated.withColumns({"_last": last, "_next": following}).where(base | ((F.coalesce("_last", F.lit(0)) <= F.col("start")) & (F.col("_next").isNull() | (F.col("_next") >= F.col("end")))))
    each = kept.groupBy("ordinal").agg(F.collect_list(F.struct("kind", "start", "end", "bits")).alias("spans"))
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,bits:double>>)")
    return scanned.select("ordinal", "doc_id").join(each, "ordinal", "left").withColumn("spans", F.coalesce("spans", none))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    order = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("s"), F.array_position(order, x["kind"]).alias("k"), x["end"].alias("e"), x["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def op7_secret_scan(spark, sf_dir):
    rows = found(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
