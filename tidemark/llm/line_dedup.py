"""Line dedup by a deletion-neighbourhood join.

Two lines are duplicates if one edit (a character replaced, added or removed) at most makes them equal. A line is
dropped where such a line stands earlier, by document id (null last) and line number; the earliest stays.

Two lines within one edit leave the same rest when the edited character is deleted, at the same place. The variants
are emitted coarse to fine, as hashed keys: first each half of a line is deleted, then the parts of those halves
whose rest another line shares, 16 at a time, down to single characters. Each round joins equal keys and goes on
with what is shared, so that a line of any length emits 16 variants a round rather than one for each character, and
almost all lines leave after the first. A variant is tied to the longer line's length, so the shorter line of a
pair emits the same key with nothing deleted. What shares a key at the end is within one edit of all that share it:
the earliest of them is found by one aggregation, not by pairs, and its edit distance is verified.

Everything is DataFrame functions. Each text is handled once, whatever the number of its copies.

Defined cases: null and empty texts have no lines; white space around a line does not count; blank lines are
neither matched nor dropped; lines of one character are all within one edit of each other (`min_near`, 0 unless
given, lets lines under so many characters match equal lines only); lines of rows that share document id and line
number are not earlier than each other, so all of them stay; an empty table gives no rows; extra columns are ignored
by `judged` and pass through `deduplicated`, whatever their names; a line of any length has 16 variants a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _ASCII_SPACE, broadcast_small, own_columns, written

MIN_NEAR = 0
FAN = 16
#: Stands for a null document id: after all others.
_LAST = str(2**63)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_ASCII_SPACE))


def _place(doc_id: Column, line_no: Column) -> Column:
    """One number that orders lines by document id, then line number."""
    return F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(_LAST).cast("decimal(20,0)")) * F.lit(2**31).cast("decimal(10,0)") + line_no.cast("decimal(10,0)")


def _key(line: Column, longer: Column, start: Column, end: Column) -> Column:
    """What is left of a line, or of one that is a character shorter, without the characters start to end of the longer."""
    return F.xxhash64(longer, start, end, F.left(line, start), F.right(line, longer - end))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line of every line with a word."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return each.select("doc_id", "line_no", _trimmed(F.col("raw")).alias("line")).where("line <> ''")


def identified(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), F.col("line")), "place": _place(F.col("doc_id"), F.col("line_no"))})


def shared(variants: DataFrame) -> DataFrame:
    """The variants whose key another line has, too."""
    keys = variants.groupBy("key").agg(F.min("h1").alias("least"), F.max("h1").alias("most")).where("least <> most").select("key")
    return variants.join(broadcast_small(written(keys, "line-keys")), "key", "left_semi")


def _halves(texts: DataFrame) -> DataFrame:
    """The first round: both halves, as the longer line of a pair and as the shorter."""
    n = F.col("n")
    parts = [F.struct((n + more).alias("longer"), F.lit(half).alias("half"), F.col(f"k{more}{half}").alias("key")) for more in (0, 1) for half in (0, 1)]
    rows = texts.select("h1", "h2", "place", F.explode(F.array(*parts)).alias("v")).select("h1", "h2", "place", "v.*")
    middle = F.expr("longer div 2").cast("int")
    return rows.withColumns({"start": F.when(F.col("half") == 0, 0).otherwise(middle), "end": F.when(F.col("half") == 0, middle).otherwise(F.col("longer"))}).drop("half")


def _finer(rows: DataFrame) -> DataFrame:
    """Each block split into FAN parts at most; blocks of one character stay."""
    size = F.col("end") - F.col("start")
    at = lambda i: F.col("start") + F.expr(f"((end - start) * {i}) div {FAN}").cast("int")
    parts = F.array(*[F.struct(at(i).alias("start"), at(i + 1).alias("end")) for i in range(FAN)])
    cut = rows.where(size > 0).withColumn("p", F.explode(F.filter(parts, lambda x: x["end"] > x["start"])))
    return cut.select("h1", "h2", "place", "line", "longer", "p.start", "p.end").withColumn("key", _key(F.col("line"), F.col("longer"), F.col("start"), F.col("end")))


def near(texts: DataFrame, rows: DataFrame, min_near: int = MIN_NEAR) -> DataFrame:
    """h1, h2, near: the place of the earliest line within one edit, of the lines that have one before them.

    texts: h1, h2, place (the first), n and the halves' keys of each distinct line; rows: identified lines.
    """
    blocks = written(shared(_halves(texts.where(F.col("n") >= min_near))).drop("key"), "line-halves")
    wanted = broadcast_small(blocks.select("h1", "h2").distinct())
    spelt = rows.select("h1", "h2", "line").join(wanted, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("line").alias("line"))
    blocks = written(blocks.join(spelt, ["h1", "h2"]), "line-blocks")
    while True:
        size = blocks.agg(F.max(F.col("end") - F.col("start"))).first()[0]
        blocks = written(shared(_finer(blocks)), "line-blocks")
        if size is None or size <= FAN:
            break
        blocks = blocks.drop("key")
    first = blocks.groupBy("key").agg(F.min(F.struct("place", "line")).alias("first"))
    pairs = blocks.join(first, "key").where(F.col("first.place") < F.col("place"))
    verified = pairs.where(F.levenshtein("line", "first.line", 1).between(0, 1))
    return verified.groupBy("h1", "h2").agg(F.min("first.place").alias("near"))


def earliest(rows: DataFrame, min_near: int = MIN_NEAR) -> tuple[DataFrame, DataFrame]:
    """(the rows without their text, and h1, h2, earliest: the place of the first line like it) of identified lines."""
    n = F.length("line")
    keys = {}
    for more in (0, 1):
        longer = n + more
        middle = F.floor(longer / 2).cast("int")
        keys[f"k{more}0"] = _key(F.col("line"), longer, F.lit(0), middle)
        keys[f"k{more}1"] = _key(F.col("line"), longer, middle, longer)
    slim = written(rows.select("doc_id", "line_no", "h1", "h2", "place", n.alias("n"), *[v.alias(k) for k, v in keys.items()]), "lines")
    texts = slim.groupBy("h1", "h2").agg(F.min("place").alias("place"), *[F.first(c).alias(c) for c in ("n", *keys)])
    texts = written(texts, "line-texts")
    close = broadcast_small(written(near(texts, rows, min_near), "line-near"))
    return slim, texts.select("h1", "h2", "place").join(close, ["h1", "h2"], "left").select("h1", "h2", F.least("place", "near").alias("earliest"))


def judged(docs: DataFrame, min_near: int = MIN_NEAR) -> DataFrame:
    """doc_id, line_no, kept, and the earliest line like it (earliest_doc_id, earliest_line_no), for every line with a word."""
    slim, first = earliest(identified(lines(docs)), min_near)
    base = F.lit(2**31).cast("decimal(10,0)")
    of = F.floor(F.col("earliest") / base).cast("decimal(20,0)")
    doc = F.when(of < F.lit(_LAST).cast("decimal(20,0)"), of.cast("long"))
    return slim.select("doc_id", "line_no", "h1", "h2", "place").join(first, ["h1", "h2"]).select(
        "doc_id", "line_no", doc.alias("earliest_doc_id"), F.pmod("earliest", base).cast("int").alias("earliest_line_no"), (F.col("place") <= F.col("earliest")).alias("kept")
    )


def deduplicated(docs: DataFrame, min_near: int = MIN_NEAR) -> DataFrame:
    """docs, in its columns, without the dropped lines; a text whose lines are all dropped is empty."""
    own = written(docs.select(F.struct(*own_columns(docs)).alias("doc"), F.monotonically_increasing_id().alias("row")), "line-docs")
    _, first = earliest(identified(lines(own.select("doc.doc_id", "doc.text"))), min_near)
    each = own.select("row", F.col("doc.doc_id").alias("doc_id"), F.posexplode(F.split("doc.text", "\n")).alias("line_no", "raw")).withColumn("line", _trimmed(F.col("raw")))
    drops = identified(each.where("line <> ''")).join(first, ["h1", "h2"]).where(F.col("place") > F.col("earliest")).select("row", "line_no")
    kept = each.join(drops, ["row", "line_no"], "left_anti").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("line_no", "raw"))).alias("lines"))
    text = F.when(F.col("doc.text").isNotNull(), F.array_join(F.coalesce(F.col("lines.raw"), F.array().cast("array<string>")), "\n"))
    return own.join(kept, "row", "left").select(F.col("doc").withField("text", text).alias("doc")).select("doc.*")


def op1_line_dedup(spark, sf_dir):
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
    WITH each AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
        FROM documents WHERE text IS NOT NULL),
    lines AS (SELECT doc_id, line_no, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM each),
    ranked AS (SELECT *, dense_rank() OVER (ORDER BY doc_id NULLS LAST, line_no) AS place FROM lines WHERE line <> ''),
    texts AS (SELECT line, length(line) AS n, min(place) AS place FROM ranked GROUP BY line),
    halves AS (SELECT line, n, place, n + more AS longer, half FROM texts, (VALUES (0), (1)) a(more), (VALUES (0), (1)) b(half)),
    keyed AS (SELECT *, CASE half WHEN 0 THEN right(line, longer - longer // 2) ELSE left(line, longer // 2) END AS rest FROM halves),
    pairs AS (
        SELECT DISTINCT a.line, b.place, b.line AS other, greatest(a.n, b.n) AS longer
        FROM keyed a JOIN keyed b ON a.longer = b.longer AND a.half = b.half AND a.rest = b.rest AND b.place < a.place AND a.line <> b.line
        WHERE greatest(a.n, b.n) = a.longer),
    near AS (
        SELECT line, min(place) AS near FROM pairs
        WHERE len(list_filter(range(longer), lambda p: left(line, p) = left(other, p) AND right(line, longer - 1 - p) = right(other, longer - 1 - p))) > 0
        GROUP BY line),
    firsts AS (SELECT t.line, least(t.place, coalesce(n.near, t.place)) AS earliest FROM texts t LEFT JOIN near n USING (line)),
    places AS (SELECT DISTINCT place, doc_id, line_no FROM ranked)
    SELECT r.doc_id, r.line_no::INTEGER AS line_no, p.doc_id AS earliest_doc_id, p.line_no::INTEGER AS earliest_line_no, r.place <= f.earliest AS kept
    FROM ranked r JOIN firsts f USING (line) JOIN places p ON p.place = f.earliest"""
