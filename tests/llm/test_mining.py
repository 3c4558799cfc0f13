"""Collocations, whitening and packing against plain Python and numpy."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_cases import odd_rows, prose, table
from tokenizers import Tokenizer

from tidemark.llm import collocations, common, packing, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def expected_phrases(rows, top=2000, least=10):
    """(lang, rank, phrase, a, l, r, n, score), by the definition."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found, longer = [], Counter()
        for q, b in candidates.items():
            for p in {q[i : i + k] for k in range(2, len(q)) for i in range(len(q) - k + 1)}:
                longer[p] = max(longer[p], b)
        for p, a in candidates.items():
            if longer[p] and 100 * longer[p] >= 50 * a:
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), p, k))
        for rank, (score, a, _, p, k) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, " ".join(p), -a, counts[p[:k]], counts[p[k:]], n[lang], -score))
    return Counter(out)


def phrase_rows():
    rng = random.Random(3)
    rows = [(r[0], r[1], "en" if i % 3 else None) for i, r in enumerate(odd_rows())]
    for i in range(60):
        common = rng.choice(["New York  City", "new york city hall", "of the\tof the of the", "a a a a", "é ß É. of the", "tie\x0bone tie one"])
        rows.append((100 + i, f"{common} {prose(i, 30, 40)}, {common};{common}", ("en", "de", "", None)[i % 4]))
    return rows + [(200, "loop " * 500, "de"), (201, "x. " * 300 + "the end", "en")]


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 20000, "part_bytes": 100000}])
def test_collocations_are_brute_force(spark, sizes):
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, phrase string").repartition(3)
    out = collocations.collocations(docs, **sizes).collect()
    want = expected_phrases([(lang, text) for _, text, lang in rows])
    assert len(want) > 10
    assert Counter((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out) == want


def test_collocations_take_the_first_of_each_language(spark):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = collocations.collocations(docs, top=3, min_count=2).collect()
    assert Counter((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out) == expected_phrases([(lang, text) for _, text, lang in rows], 3, 2)


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 10**13 - 7, 10**13 + 11, 3 * 10**13 + 5
    counts = spark.createDataFrame([("en", "x", 1, left), ("en", "y", 1, right), ("en", "x y", 2, a)], "lang string, phrase string, size int, f long")
    row = collocations.scored(counts).first()
    assert (row.a, row.l, row.r, row.score) == (a, left, right, 1000000 * a * a // (left * right))


def test_phrases_of_rare_words_are_no_candidates():
    phrases = collocations.Phrases(b"the old man the old\nman the rareword the old x the old", "en", 3)
    parts = 3
    of = lambda n, which: dict(zip(phrases.texts(n, which, phrases.words).to_pylist(), which, strict=True))
    place = lambda n, which: (lambda p, b: p << collocations.BITS | b)(*collocations.places(phrases.keys(n, which), parts))
    every = [of(n, np.arange(len(phrases.found[n - 1][0]))) for n in (1, 2, 3)]
    # by chance, the counters of all phrases are heavy, but those of two words are not
    light = [place(1, np.array([every[0][w]]))[0] for w in ("rareword", "x")] + [place(2, np.array([every[1]["old man"]]))[0]]
    reached = np.setdiff1d(np.concatenate([place(n, np.arange(len(every[n - 1]))) for n in (1, 2, 3)]), light)
    found = [set(of(n, which)) for n, (which, _) in enumerate(phrases.candidates(reached, parts), 1)]
    # no phrase goes from a line to the next
    assert found == [{"the", "old", "man"}, {"the old", "man the"}, {"man the old"}]
    assert [len(x) for x in phrases.candidates(reached[:0], parts)[0]] == [0, 0]


def test_shards_are_kept_as_texts_alone_and_may_lie_apart(spark, monkeypatch):
    rows, made = phrase_rows(), []

    def apart(df, name):
        df = common.written(df, name)
        made.append((name, df.columns, df.count()))
        return df.repartition(7) if name == "phrase-shards" else df

    monkeypatch.setattr(collocations, "written", apart)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    out = collocations.collocations(docs, part_bytes=20000).collect()
    assert Counter((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out) == expected_phrases([(lang, text) for _, text, lang in rows])
    # one shard, a row for each language, however many parts the sketch has
    assert made[0] == ("phrase-shards", ["shard", "lang", "payload"], len({"und" if lang is None else lang for *_, lang in rows}))


def test_codes_of_words_are_found_where_they_were_put():
    ranks = [0, 1, 127, 128, 129, 383, 384, 128 + (128 << 8) - 1, 128 + (128 << 8), 99_999, 10**6, 1 << 30]
    codes = [collocations.code(r) for r in ranks]
    assert len(set(codes)) == len(codes) and not any(collocations.BREAK in c for c in codes)
    rng = random.Random(8)
    put = [rng.randrange(len(codes)) for _ in range(3000)]
    phrases = [(i,) for i in range(len(codes))] + [(i, k) for i in range(len(codes)) for k in range(len(codes))]
    want = [sum(tuple(put[at : at + len(p)]) == p for at in range(len(put))) for p in phrases]
    got = collocations.scanned("".join(codes[i] for i in put), ["".join(codes[i] for i in p) for p in phrases])
    assert got.tolist() == want


def moved(df):
    """How many rows pass all exchanges for df's result."""
    df.collect()
    rows, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan" or "QueryStage" in name:
            todo.append(node.executedPlan() if name == "AdaptiveSparkPlan" else node.plan())
            continue
        if name == "Exchange":
            rows += node.metrics().apply("shuffleRecordsWritten").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_scores_deal_each_phrase_out_once(spark):
    counts = [("en", "", 0, 10**8)] + [("en", f"w{i}", 1, 50) for i in range(30)]
    counts += [("en", f"w{i} w{k}", 2, 20) for i in range(30) for k in range(30)]
    counts += [("en", f"w{i} w{k} w{(i + k) % 30}", 3, 15) for i in range(30) for k in range(15)]
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = moved(collocations.scored(spark.createDataFrame(counts, "lang string, phrase string, size int, f long")))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # 11,879 with sums by cut, then by phrase, then dealt to the join with the longer ones
    assert rows <= 9000


def test_sketch_rows_come_back_as_they_were_packed():
    buckets = np.array([0, 3, 70000, (1 << collocations.BITS) - 1])
    counts = np.array([1, 10, 300, 2])
    back = collocations.unpacked(collocations.packed(buckets, counts), True)
    assert (back[0] == buckets).all() and (back[1] == counts).all()
    assert (collocations.unpacked(collocations.packed(buckets), False)[0] == buckets).all()
    assert len(collocations.unpacked(collocations.packed(buckets[:0]), False)[0]) == 0


def test_long_texts_are_cut_between_lines():
    for text in (b"", b"a\n" * 50, b"x" * 95 + b"\nb", b"a b\n\n" + b"y" * 30 + b"\nz"):
        cut = list(collocations.cut_pieces(text, 20))
        assert b"".join(cut) == text and all(len(c) <= 20 or b"\n" not in c[:-1] for c in cut) and all(c.endswith(b"\n") for c in cut[:-1])


def vector_rows(n=300, d=7):
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + rng.normal(size=d)
    rows = [(i, [float(v) for v in np.float32(m)]) for i, m in enumerate(mixed)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(150)]  # copies count once in the fit
    return rows + [(5, None), (6, [None] + [1.0] * (d - 1)), (7, [float("nan")] * d), (8, [math.inf] * d), (9, [1.0, 2.0]), (10, []), (None, rows[4][1])]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, x int").repartition(3)


def test_whitening_is_numpy(spark):
    rows = vector_rows()
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and len(v) == 7 and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}))
    n, sums = len(fit), fit.sum(0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    out = whitening.components_of(vectors(spark, rows)).collect()
    assert len(out) == 4 * len(good)
    assert {(r.n, r.identity_error < 1e-9) for r in out} == {(n, True)}
    signs = {}
    want = defaultdict(list)
    for i, x in good:
        want[i].append(np.array(x))
    for r in out:
        c = r.component - 1
        assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
        assert r.deviation in {int(((n * x - sums) ** 2).sum()) for x in want[r.vec_id]}
        score = max(((x - sums / n) @ axes[:, c] / math.sqrt(values[c]) for x in want[r.vec_id]), key=lambda s: -abs(abs(s) - abs(r.whitened)))
        assert abs(score) == pytest.approx(abs(r.whitened), abs=1e-8)
        if abs(score) > 1e-3:
            assert signs.setdefault(c, np.sign(score * r.whitened)) == np.sign(score * r.whitened)
    model = whitening.fit(whitening.distinct_vectors(whitening.fixed_point(vectors(spark, rows), "vec_id", "embedding")), None)
    assert len(model.values) == 7 and np.allclose(model.values, values)


def test_whitening_leaves_out_components_without_variance(spark):
    for rows, count in (([], 0), ([(1, None)], 0), ([(1, [1.0, 2.0])] * 3, 0), ([(1, [])], 0), ([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])], 1)):
        out = whitening.components_of(vectors(spark, rows)).collect()
        assert {r.component for r in out} == ({1} if count else set())
        assert all(abs(r.identity_error) < 1e-9 and r.explained == pytest.approx(1) for r in out)


def test_deviations_are_exact_or_null():
    model = whitening.Whitening(3, [5, -7], 1.0, np.eye(2), np.ones(2))
    x = np.array([[1, 2], [2**30, 5], [2**31 - 1, 0], [2**62, 1], [-(2**63), 2**63 - 1]])
    exact = [(3 * int(a) - 5) ** 2 + (3 * int(b) + 7) ** 2 for a, b in x]
    assert model.deviations(x) == [e if e < 2**63 else None for e in exact]
    assert np.allclose(model.project(x)[:3], (x[:3] - np.array([5, -7]) / 3))


def test_wide_vectors_do_not_overflow(spark):
    rows = [(i, [float(v), 1e30 if i else -1e30, float(i * i)]) for i, v in enumerate([1.0, 2.5, -3.0, 9.0])]
    out = whitening.components_of(vectors(spark, rows)).collect()
    assert {r.component for r in out} >= {1} and all(r.deviation is None for r in out)


def cost(cuts, prices, window):
    sizes = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return sum((0 if (b - a).bit_count() == 1 else window - (b - a)) + prices[b] + packing.SEQUENCE for a, b in sizes)


@pytest.mark.parametrize("window", [1, 16, 37, 64])
def test_cuts_are_the_cheapest(window):
    rng = np.random.default_rng(window)
    for _ in range(40):
        n = int(rng.integers(1, 300))
        stops = rng.random(n) < rng.random()
        ends = np.union1d(np.flatnonzero(rng.random(n) < 0.1) + 1, [n])
        at, penalty = packing.possible_cuts(stops, ends, window, window * int(rng.integers(2)))
        prices = dict(zip(at.tolist(), penalty.tolist(), strict=True))
        best = [0]
        for j in range(1, len(at)):
            best.append(min(best[i] + cost([int(at[i]), int(at[j])], prices, window) for i in range(j) if at[j] - at[i] <= window))
        cuts = packing.best_cuts(at, penalty, window)
        assert cuts[0] == 0 and cuts[-1] == n and cost(cuts, prices, window) == best[-1]


def packing_rows():
    rows = [(r[0], r[1]) for r in odd_rows()] + [(100 + i, prose(i, 10 + 37 * i) + ".") for i in range(60)]
    return rows + [(300, "a<|endoftext|>b   \x1c c… d。"), (301, "no stop " * 4000), (302, "y" * 9000), (303, "it's 1,000.5! İ́ É́")]


@pytest.mark.parametrize(("window", "bound"), [(2048, None), (64, 2000)])
def test_packing_is_a_partition_of_the_tokens(spark, monkeypatch, window, bound):
    rows = packing_rows()
    if bound:
        monkeypatch.setattr(packing, "BLOCK", bound)
        monkeypatch.setattr(packing, "BYTES", bound)
        monkeypatch.setattr(packing, "OPEN", 3)
        # the workers import the module anew; the same code with these bounds runs here
        known, packer = packing.Encoder(Path(TOKENIZER).read_text()), packing.Packer(window, 0)
        found = []
        for i, tokens in enumerate(known.documents((t or "").encode() for _, t in rows)):
            packer.add(i, tokens)
            found += packer.pack(False)
        found += packer.pack(True)
        found = [(i, s, n, zlib.crc32(ids), t, q, o) for i, s, n, t, q, o, ids in found]
    else:
        docs = table(spark, [(i, t) for i, (_, t) in enumerate(rows)]).withColumn("ids", F.lit(1)).repartition(2)
        found = [tuple(r) for r in packing.op13(docs, TOKENIZER).collect()]
    plain = Tokenizer.from_file(TOKENIZER)
    ids = [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows]
    at = defaultdict(int)
    for i, start, length, crc, total, _, _ in sorted(found):
        assert start == at[i] and length >= 1 and total == len(ids[i])
        assert crc == zlib.crc32(np.array(ids[i][start : start + length], "<u4").tobytes())
        at[i] += length
    assert [at[i] for i in range(len(rows))] == list(map(len, ids))
    sequences = defaultdict(list)
    for _, _, length, _, _, q, offset in found:
        sequences[q].append((offset, length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
    sizes = [sum(n for _, n in p) for p in sequences.values()]
    padding = sum(window - n for n in sizes if n.bit_count() > 1)
    assert padding <= 0.05 * sum(sizes) and len(sizes) <= 1.5 * sum(sizes) / window + 8


def test_sequences_are_padded(spark):
    docs = table(spark, [(1, "one two three."), (2, None), (3, prose(1, 3000))])
    found = packing.pieces(docs.coalesce(1), TOKENIZER)
    out = packing.sequences(found).collect()
    for r in out:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == (r.length if r.length.bit_count() == 1 else 2048) and (ids[r.length :] == 0).all()
    plain = Tokenizer.from_file(TOKENIZER)
    stream = [i for r in sorted(out, key=lambda r: r.sequence_id) for i in np.frombuffer(r.ids, "<u4")[: r.length].tolist()]
    assert stream == [i for t in ("one two three.", "", prose(1, 3000)) for i in [*plain.encode(t, add_special_tokens=False).ids, 1]]


def test_sentences_end_at_marks_and_lines():
    known = packing.Encoder(Path(TOKENIZER).read_text())
    tokens = known.whole([b'One two. "Three?" www.x.com four\nfive'])[0]
    words = [known.tokenizer.id_to_token(i) for i in tokens.ids[tokens.stops]]
    assert words[:3] == [".</w>", '?"</w>', "four</w>"] and len(words) == 5  # and the text's last word and the end token


def test_empty_tables(spark):
    docs = table(spark, []).withColumn("lang", F.lit(None).cast("string"))
    assert packing.op13(docs, TOKENIZER).count() == 0 and collocations.collocations(docs).count() == 0
