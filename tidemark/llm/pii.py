"""Personal data: base patterns, and information-theoretic sanitisation of what else gives them away.

The base patterns find email addresses, IP addresses, card and phone numbers. These are the protected entities.
A term may give an entity away even when the entity itself is masked: over the corpus, the pointwise mutual information of term t and entity e, log2(N n(e,t) / (n(e) n(t))) with n counting documents, says how many
bits of e's information content log2(N / n(e)) the term reveals. All counts are over whole texts and all documents,
wherever in a text the two stand. A term is a run of letters and digits, of any length. Entities are protected by value
and by kind: that a document holds an address at all is an entity as well, so that words that go with addresses are
found even where each address stands once. Terms that reveal at least the share `disclosure` of an entity's information
become spans too, at every occurrence in every document. `sanitised` replaces entities by their kind, and terms by the
kinds of what they reveal (`<email-related>`); terms that reveal at least the share `removal` are left out.

An estimate from few texts is discounted by its own uncertainty: the share is multiplied by s / (s + `discount`), where
s distinct texts hold both (copies of one page are one text). Of one text, every rare word would reveal its entities
wholly; `discount` 0 says so, and is the exact count. No pair is dropped: what has too few texts to reach `disclosure`
at any strength of association follows from the two numbers (`least_texts`), and isn't counted further.

Defined cases: null and blank texts have no spans; equal rows get equal results (each row has its own key from
its first pass on, whatever its id); an empty table gives no rows; extra columns are ignored, whatever their names,
and pass through `sanitised`; no text is so long that a pattern is not linear in it.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_small, own_columns, written

#: Kinds in the order in which spans that start together are listed; "term" is the method's own.
KINDS = ("email", "ip", "card", "phone", "term")
DISCOUNT = 0.35
DISCLOSURE, REMOVAL = 0.85, 0.999

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a start within a run of digits can't succeed where the run's own start fails
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\W_]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: from each @ back over its local part, and on over its domain."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        else:
            end = max(end, at + 1)
        at = text.find("@", end)
    return found


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns by start, then kind."""
    if not text:
        return []
    found = [("email", *x) for x in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """The matches of the terms of a text that overlap no span."""
    reach = list(accumulate((e for _, _, e in spans), max))  # the furthest end so far
    starts = [s for _, s, _ in spans]
    for m in _TERM.finditer(text):
        before = bisect_left(starts, m.end()) - 1  # the last span that starts before the term's end
        if before < 0 or reach[before] <= m.start():
            yield m


def entities_of(text: str, spans: list[tuple[str, int, int]]) -> set[str]:
    return {f"{k}:{text[s:e].lower() if k in ('email', 'ip') else _NOT_DIGIT.sub('', text[s:e])}" for k, s, e in spans}


SCAN = "ordinal long, page string, entities array<string>, terms array<string>"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document (ordinal, text) with base spans: its text's hash, and its distinct entities and terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ordinal, text in zip(b.ordinal, b.text, strict=True):
                spans = base_spans(text)
                if spans:
                    page = hashlib.blake2b(" ".join(_WORD.findall(text)).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
                    rows.append((ordinal, page, sorted(entities_of(text, spans)), sorted({m[0].lower() for m in terms_of(text, spans)})))
            yield pd.DataFrame(rows, columns=["ordinal", "page", "entities", "terms"])

    return docs.select("ordinal", "text").mapInPandas(run, SCAN)


def known_terms(terms: DataFrame) -> Callable[[str], bool]:
    """Whether a word may be one of the terms, by the bits of their checksums (of a bounded number), which go to the tasks."""
    # so many bits a term that of the other words, which are far more, hardly any pass
    size = 1 << min(27, max(16, (terms.count() << 14).bit_length()))
    at = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(size)) + 1
    made = terms.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = bytearray(size >> 3)
    for r in made.collect():  # 4 KB each, and no more of them than size holds
        begin = (r.bucket - 1) * len(r.bits)
        bits[begin : begin + len(r.bits)] = r.bits
    held = bytes(bits)

    def may_be(word: str) -> bool:
        at = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) & (size - 1)
        return bool(held[at >> 3] >> (at & 7) & 1)

    return may_be


def document_counts(docs: DataFrame, may_be: Callable[[str], bool], flush: int = 400_000) -> DataFrame:
    """(term, docs): in how many documents each of the known terms stands. Tasks send sums, not occurrences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()

        def out() -> pd.DataFrame:
            d = pd.DataFrame({"term": list(counts.keys()), "n": list(counts.values())})
            counts.clear()
            return d

        for b in batches:
            for t in b.text:
                if t:
                    counts.update({x.lower() for x in set(_TERM.findall(t)) if may_be(x)})
                    if len(counts) >= flush:
                        yield out()
        if counts:
            yield out()

    return docs.select("text").mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("docs"))


def least_texts(discount: float, disclosure: float) -> int:
    """The fewest texts s for which s / (s + discount) reaches disclosure."""
    return max(1, math.ceil(discount * disclosure / (1 - disclosure) - 1e-9)) if disclosure < 1 or not discount else 2**62


def disclosing(scanned: DataFrame, docs: DataFrame, discount: float = DISCOUNT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, term, revealed): the terms that reveal more than the share `disclosure` of an entity's information.

    Entities that stand in the same texts (an address book's) are counted as one group.
    """
    needed = least_texts(discount, disclosure)
    kinds = F.array_distinct(F.transform("entities", lambda e: F.concat(F.substring_index(e, ":", 1), F.lit(":"))))
    each = scanned.select("ordinal", "page", F.explode(F.concat("entities", kinds)).alias("entity"))
    pages = each.groupBy("entity", "page").agg(F.count("*").alias("n"))
    signature = [F.bit_xor(F.xxhash64(F.lit(i), "page")).alias(f"g{i}") for i in (1, 2)]
    entities = pages.groupBy("entity").agg(F.count("*").alias("about"), F.sum("n").alias("n_entity"), *signature)
    group = F.concat_ws(":", "about", "n_entity", "g1", "g2")
    entities = written(entities.where(F.col("about") >= needed).select("entity", group.alias("group"), "n_entity"), "pii-entities")
    held = each.join(broadcast_small(entities.select("entity", "group")), "entity").groupBy("ordinal").agg(F.collect_set("group").alias("held"))
    pairs = scanned.select("ordinal", "page", "terms").join(held, "ordinal").select("page", "held", F.explode("terms").alias("term")).select("page", "term", F.explode("held").alias("group"))
    both = pairs.groupBy("group", "term", "page").agg(F.count("*").alias("n")).groupBy("group", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("support"))
    both = written(both.where(F.col("support") >= needed), "pii-pairs")
    n = float(docs.count())
    # the few terms let through besides find no partner among the pairs; a join before the sums would meet each task's own
    terms = document_counts(docs, known_terms(written(both.select("term").distinct(), "pii-supported")))
    groups = entities.groupBy("group").agg(F.first("n_entity").alias("n_entity"))
    bits = F.log2(n * F.col("n_both") / (F.col("n_entity") * F.col("docs")))
    total = F.log2(n / F.col("n_entity"))
    sure = F.col("support") / (F.col("support") + discount)
    joined = both.join(terms, "term").join(broadcast_small(groups), "group").where(total > 0).withColumn("revealed", bits / total * sure)
    found = joined.where(F.col("revealed") >= disclosure - 1e-12).select("group", "term", "revealed")
    return found.join(entities.select("entity", "group"), "group").select("entity", "term", "revealed")


def by_term(pairs: DataFrame) -> DataFrame:
    """(term, revealed, of): the most that each term reveals, and the kinds of the entities that it reveals, joined by +."""
    kinds = F.array_sort(F.collect_set(F.substring_index("entity", ":", 1)))
    return pairs.groupBy("term").agg(F.max("revealed").alias("revealed"), F.array_join(kinds, "+").alias("of"))


MARKED = "ordinal long, doc_id long, base array<struct<kind string, start int, end int>>, may array<struct<term string, start int, end int>>"


def marked(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per row of docs (ordinal, doc_id, text): its base spans, and the occurrences of the terms (term) outside of them, and of few others."""
    listed_in = known_terms(terms)

    def one(text: str | None, spans: list) -> list[dict]:
        words = {w for w in set(_TERM.findall(text or "")) if listed_in(w)}
        return [{"term": m[0].lower(), "start": m.start(), "end": m.end()} for m in terms_of(text, spans) if m[0] in words] if words else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            base = [base_spans(t) for t in b.text]
            yield pd.DataFrame({"ordinal": b.ordinal, "doc_id": b.doc_id.astype("Int64"), "base": [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in base], "may": [one(t, s) for t, s in zip(b.text, base, strict=True)]})

    return docs.select("ordinal", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, MARKED)


SPAN = "struct<kind string, start int, end int>"


def found(docs: DataFrame, discount: float = DISCOUNT, disclosure: float = DISCLOSURE) -> DataFrame:
    """ordinal, doc_id, base and spans (both arrays of kind, start, end), one row per row of docs."""
    return _found(docs.select(F.monotonically_increasing_id().alias("ordinal"), "doc_id", "text"), discount, disclosure)


def _found(own: DataFrame, discount: float, disclosure: float) -> DataFrame:
    """`found`, of rows with ordinals; and terms: array of start, end, of and revealed of the disclosing terms."""
    terms = written(by_term(disclosing(written(scan(own), "pii-scan"), own, discount, disclosure)), "pii-terms")
    rows = written(marked(own, terms), "pii-marked")
    may = rows.where(F.size("may") > 0).select("ordinal", F.explode("may").alias("x")).select("ordinal", "x.*")
    each = may.join(broadcast_small(terms), "term").groupBy("ordinal").agg(F.collect_list(F.struct("start", "end", "of", "revealed")).alias("terms"))
    spans = F.transform("terms", lambda x: F.struct(F.lit("term").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    joined = rows.select("ordinal", "doc_id", "base").join(each, "ordinal", "left")
    return joined.withColumn("spans", F.concat("base", F.coalesce(spans, F.expr(f"cast(array() as array<{SPAN}>)"))))


def listed(spans: F.Column) -> F.Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    order = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("s"), F.array_position(order, x["kind"]).alias("k"), x["end"].alias("e"), x["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def sanitised(docs: DataFrame, generalise: bool = True, discount: float = DISCOUNT, disclosure: float = DISCLOSURE, removal: float = REMOVAL) -> DataFrame:
    """docs, in its columns, with every span generalised, or removed where it reveals too much or nothing is generalised."""
    own = written(docs.select(F.struct(*own_columns(docs)).alias("doc"), F.monotonically_increasing_id().alias("ordinal")), "pii-docs")
    marks = _found(own.select("ordinal", "doc.doc_id", "doc.text"), discount, disclosure).where(F.size("spans") > 0)
    mask = lambda x, name: F.struct(x["start"].alias("start"), x["end"].alias("end"), name.alias("mask"))
    base = F.transform("base", lambda x: mask(x, F.concat(F.lit("<"), x["kind"], F.lit(">"))))
    terms = F.transform("terms", lambda x: mask(x, F.when(x["revealed"] < removal, F.concat(F.lit("<"), x["of"], F.lit("-related>"))).otherwise("")))
    marks = marks.select("ordinal", F.array_sort(F.concat(base, F.coalesce(terms, F.expr("cast(array() as array<struct<start int, end int, mask string>>)")))).alias("marks"))

    @F.pandas_udf("string")
    def masked(texts: pd.Series, marks: pd.Series) -> pd.Series:
        def one(text, marks):
            if text is None or marks is None:
                return text
            out, at = [], 0
            for m in marks:
                if m["start"] >= at:
                    out += [text[at : m["start"]], m["mask"] if generalise else ""]
                at = max(at, m["end"])
            return "".join([*out, text[at:]])

        return pd.Series([one(t, s) for t, s in zip(texts, marks, strict=True)])

    whole = own.join(marks, "ordinal", "left").select("doc", masked("doc.text", "marks").alias("text"))
    return whole.select(F.col("doc").withField("text", F.col("text")).alias("doc")).select("doc.*")


def op4_pii(spark, sf_dir):
    rows = found(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, KINDS[:-1]), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
