"""Corpus operators against brute force, and their defined results for awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerweave.llm import components, exact_dedup, langid, license_scan, mixing, ngram_join, packing, queries, sentence_spans, sketches, suffix_dedup, toxicity
from ledgerweave.llm.common import table

WORD = re.compile("[^\x20\x09-\x0d]+")
BPE = public_tokenizers.path("byte_bpe_50k.json")

# doc_id, text, source, lang, and columns whose names clash with results
AWKWARD = [
    (1, None, "a", None, 1, "x"),
    (2, "", "a", "en", 2, None),
    (3, "one", None, "en", None, "x"),
    (4, "one", None, None, 4, "x"),
    (4, "one", None, None, 4, "x"),
    (5, " \t\n ", "b", "de", 5, "x"),
    (6, "alpha beta gamma delta epsilon zeta eta theta", "b", "en", 6, "x"),
    (7, "ALPHA beta gamma  delta\tepsilon zeta eta theta <|endoftext|> x", "b", "en", 6, "x"),
    (8, "long " + "lorem ipsum dolor sit amet consectetur " * 4000, "c", "en", 6, "x"),
    (None, "no id at all here my friend", "c", "en", 6, "x"),
]
SCHEMA = "doc_id long, text string, source string, lang string, size int, keep_id string"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def rows(docs):
    return sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()))


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def classes_by_brute_force(rows, width, percent):
    sets = {}
    for d, text in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text)]
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}
    links = defaultdict(int)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), links[d]) for d in ids}


@pytest.mark.parametrize("width,percent,block", [(4, 85, 1_500_000), (3, 40, 1_500_000), (3, 40, 700)])
def test_jaccard_components(docs, rows, width, percent, block):
    got = ngram_join.jaccard_components(docs, width=width, percent=percent, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == classes_by_brute_force(rows, width, percent)


def test_jaccard_near_copies_in_blocks(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for d in range(150):
        w = list(base)
        for k in rng.integers(0, 80, int(rng.integers(0, 4))):
            w[k] = f"x{rng.integers(0, 3)}"
        rows.append((d, " ".join(w[: int(rng.integers(70, 81))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes_by_brute_force(rows, 4, 85)
    for block in (400, 3000, 1_000_000):
        got = ngram_join.jaccard_components(df, width=4, percent=85, block=block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == want


def test_jaccard_awkward(awkward, empty):
    got = ngram_join.jaccard_components(awkward, width=4, percent=85).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == len(AWKWARD)
    assert [(r.n_shingles, r.component_id) for d in (1, 2, 5) for r in by[d]] == [(0, 1), (0, 2), (0, 5)]
    assert {r.component_id for d in (3, 4) for r in by[d]} == {3}
    assert by[3][0].n_links == 2
    assert ngram_join.jaccard_components(empty).count() == 0


def test_jaccard_repeated_and_null_ids(spark):
    a, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "ac")
    near = {"a": a + " end", "c": c + " end"}

    def found(rows):
        got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=85)
        return sorted((r.doc_id or 0, r.component_id, r.n_links) for r in got.collect())

    assert found([(5, a), (7, near["a"]), (5, c)]) == [(5, 5, 0), (5, 5, 1), (7, 5, 1)]
    assert found([(None, a), (None, a), (9, near["a"])]) == [(0, 9, 2), (0, 9, 2), (9, 9, 2)]
    # Id 2 has two texts and so joins the others; ids 5 have two texts that are near each other
    rows = [(1, a), (2, a), (2, c), (3, near["c"]), (5, "x " + a), (5, "y " + a), (6, "")]
    assert found(rows) == [(1, 1, 3), (2, 1, 1), (2, 1, 3), (3, 1, 1), (5, 1, 3), (5, 1, 3), (6, 6, 0)]


def test_components_in_rounds(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    edges = [(int(x), int(y)) for x, y in zip(a, b, strict=True) if x != y] + [(1000 + i, 1001 + i) for i in range(60)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    node, root = components.forest(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    for limit in (0, 20, 10**6):
        got = {r.node: r.component for r in components.connected_components(df, limit).collect()}
        assert got == dict(zip(node.tolist(), root.tolist(), strict=True))


def exact_by_brute_force(rows, prefer_longer):
    groups = defaultdict(list)
    for d, text in rows:
        groups[re.sub("[\x20\x09-\x0d]+", "", text)].append((-len(text) if prefer_longer else 0, d))
    return {d: (min(g)[1], len(g), min(g)[1] == d, hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, d in g}


@pytest.mark.parametrize("prefer_longer", [True, False])
def test_exact_dedup(spark, docs, rows, prefer_longer):
    got = exact_dedup.exact_dedup(docs, prefer_longer=prefer_longer).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == exact_by_brute_force(rows, prefer_longer)
    many = [(i, "a b" + " " * (i % 5) if i % 3 else f"text {i}") for i in range(3000)]  # a group over many partitions
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(5)
    got = exact_dedup.exact_dedup(df, prefer_longer=prefer_longer).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == exact_by_brute_force(many, prefer_longer)


def test_exact_dedup_awkward(awkward, empty):
    got = exact_dedup.exact_dedup(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert {r.keep_id for r in got if r.doc_id in (1, 2, 5)} == {1}
    ones = [r for r in got if r.doc_id in (3, 4)]
    assert [r.group_size for r in ones] == [3, 3, 3] and sum(r.kept for r in ones) == 1
    kept = exact_dedup.drop_exact_copies(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 6, 7, 8]
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0


def spark_hash(*words, seed=42):
    h = seed
    for w in words:
        h = xxhash.xxh64_intdigest(w if isinstance(w, bytes) else w.to_bytes(8, "little"), seed=h)
    return h


def sketch_by_brute_force(text, k=64, width=5):
    h = [spark_hash(w.encode()) for w in WORD.findall(text)]
    every = {spark_hash(*h[i : i + width]) >> 16 for i in range(len(h) - width + 1)}
    return sorted(every)[:k], every


def test_fingerprints(docs, rows):
    got = {r.doc_id: r for r in sketches.fingerprints(docs, k=64).collect()}
    ordered = rows[::-1]
    assert len(got) == len(rows)
    import base64

    for i, (d, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        n, half = len(text), len(text) // 2
        edited = text[: n - half] + after[:half]
        r = got[d]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, every = sketch_by_brute_force(text)
        b, _ = sketch_by_brute_force(edited)
        if len(WORD.findall(text)) >= 5:
            assert base64.b64decode(r.fingerprint) == b"".join(x.to_bytes(6, "big") for x in a)
            assert abs(r.n_distinct - len(every)) <= 0.6 * len(every)
            if len(WORD.findall(edited)) >= 5:
                union = sorted(set(a) | set(b))[:64]
                assert r.near_edited == pytest.approx(len(set(a) & set(b) & set(union)) / len(union))


def test_fingerprints_awkward(spark, awkward, empty):
    got = sketches.fingerprints(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 5)} == {""}
    assert len({r.fingerprint for r in got if r.doc_id in (3, 4)}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert sketches.fingerprints(empty).count() == 0
    lone = sketches.fingerprints(awkward.filter("doc_id = 6")).collect()
    assert lone[0].near_next == 1.0


def test_sketches_merge(spark):
    words = [f"w{i}" for i in range(3000)]
    parts = [(0, " ".join(words[:2000])), (0, " ".join(words[1500:])), (1, " ".join(words[:100]))]
    df = sketches.with_sketch(spark.createDataFrame(parts, "g int, text string"), "text", "sk")
    whole = sketches.with_sketch(spark.createDataFrame([(0, " ".join(words))], "g int, text string"), "text", "sk").first().sk
    got = {r.g: r.sk for r in sketches.merge_groups(df, "g", "sk").collect()}
    assert got[0] == whole and len(got[1]) == 96
    assert df.filter("g = 0").select(sketches.distinct_count(df.sk).alias("n")).first().n == pytest.approx(2000, rel=0.2)


def test_packing_round_trip(docs, rows):
    tok = Tokenizer.from_file(BPE)
    ids = {d: [*e.ids, 0] for (d, _), e in zip(rows, tok.encode_batch([t for _, t in rows], add_special_tokens=False), strict=True)}
    check_packing(packing.pack_documents(docs, BPE).collect(), ids, 1.06)


def check_packing(got, ids, slack):
    bins, docs_seen = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        docs_seen[r.doc_id].append((r.piece, r.start, r.length))
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    for d, parts in docs_seen.items():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts)))
        assert sum(p[2] for p in parts) == len(ids[d])
        assert all(p[2] == 2048 for p in parts[1:]) and (len(parts) == 1) == (len(ids[d]) <= 2048)
    assert docs_seen.keys() == ids.keys()
    assert len(bins) <= slack * sum(map(len, ids.values())) / 2048 + 1


def test_packing_awkward(awkward, empty):
    tok = Tokenizer.from_file(BPE)
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t, *_ in AWKWARD if d != 4}
    got = packing.pack_documents(awkward, BPE).collect()
    assert sum(r.doc_id == 4 for r in got) == 2
    for r in got:
        if r.doc_id != 4:
            assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert packing.pack_documents(empty, BPE).count() == 0


def test_encoder_equals_tokenizer():
    tok, own = Tokenizer.from_file(BPE), packing.ByteLevelEncoder(BPE, kept=500)  # so small that it starts over
    assert own.by_span
    fixed = ["a", " a", "a ", "a  b", "a\n\nb c", "x.\ny, z", "tab\tb", "\x01 mark", "café   non break", "it's 3.14, ok... 'll", "你好 　x", "<|endoftext|> y", "e.g., (a) b.", "", " ", "\n\n", "x" * 300]
    bits = ["a", "B", "é", "×", "÷", "Ü", "1", "9", " ", " ", " ", "\n", "\t", "\r", ".", ",", "!", "%", "'", "'s", "'ll", "-", "(", "…", "word", "the", "\x85", "\xa0", "\u2003", "\x0b", "\x1c", "<|endoftext|>", "漢", "🙂", "\u0301", "ß", "²"]
    draw = random.Random(5)
    for k in range(60):
        texts = fixed + ["".join(draw.choices(bits[:25] if k % 2 else bits, k=draw.randrange(30))) for _ in range(40)]
        for text, ids in zip(texts, own.column(pa.array(texts)), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text
    # A file of another kind: every text goes through the tokenizer whole
    other = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(other), packing.ByteLevelEncoder(other)
    texts = ["Some words, of  which\none is new.", ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.column(pa.array(texts))] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_sum_of_squares_rule():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 33, 300)
    bins, place, fill = packing.sum_of_squares(lengths, 32)
    gaps = defaultdict(int)
    level = {}
    for s, b, p in zip(lengths.tolist(), bins.tolist(), place.tolist(), strict=True):
        def total(gap, s=s):
            n = dict(gaps)
            if gap != 32:
                n[gap] -= 1
            if gap - s:
                n[gap - s] = n.get(gap - s, 0) + 1
            return sum(v * v for v in n.values())

        best = min(total(g) for g in [32, *(g for g, v in gaps.items() if v and g >= s)])
        gap = 32 - level.get(b, 0)
        assert p == level.get(b, 0) and total(gap) == best
        if gap != 32:
            gaps[gap] -= 1
        if gap - s:
            gaps[gap - s] += 1
        level[b] = p + s
    assert max(level.values()) <= 32


def test_mixing(docs, rows):
    got = mixing.mix_sources(docs).collect()
    total = sum(r.size for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * total, rel=1e-6)
    for v in by.values():
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v) / 2
    assert sorted(mixing.mix_sources(docs.repartition(3)).collect()) == sorted(got)


def test_mixing_targets(spark):
    sizes = {None: 700, "b": 10, "a": 1000, "c": 500, "z": 0}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df, (3, 1, 2), 1.5, 2.0).collect()}
    names = sorted((k for k in sizes if k is not None)) + [None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    want, budget = {}, 1.5 * sum(sizes.values())
    free = set(names)
    while True:
        left = budget - sum(want.values())
        share = {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
        over = {k for k in free if share[k] >= 2 * sizes[k]}
        if not over:
            break
        want |= {k: 2.0 * sizes[k] for k in over}
        free -= over
        if not free:
            break
    want |= {k: share[k] for k in free}
    assert got == pytest.approx(want)


def mixed_by_brute_force(docs, cuts, seed=7):
    """The words taken from each document: down the Pareto order, each that still fits, then the closing one."""
    out = {}
    for c in cuts:
        own = [(d, n) for d, n, s in docs if s == c.source]
        u = {d: (int(hashlib.md5(f"{d}:{seed}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for d, _ in own}
        low, high = 0.0, 1e9  # the factor by halving
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * min(1, mid / n**0.5) for _, n in own) < c.need else (low, mid)
        p = {d: min(1, high / n**0.5) for d, n in own}
        order = sorted(own, key=lambda x: (u[x[0]] / (1 - u[x[0]]) * (1 - p[x[0]]) / p[x[0]], x[0])) if c.need > 0 else own
        left, taken = c.need, set()
        for d, n in order:
            if n <= left and c.need > 0:
                left -= n
                taken.add(d)
        close = [(abs(left - n), d) for d, n in order if d not in taken and abs(left - n) < left]
        taken |= {min(close)[1]} if close else set()
        out |= {d: (c.whole + (d in taken)) * n for d, n in own}
    return out


def test_inclusion_probabilities(spark):
    sizes = [1, 1, 4, 4, 9, 100, 100, 400, 2500]
    df = spark.createDataFrame([(n, s) for n in sizes for s in ("a", None)], "size long, source string")
    for need in (3.5, 100.0, 1500.0, 3000.0):
        needs = spark.createDataFrame([("a", need), (None, need / 2)], "source string, need double")
        for r in mixing.inclusion_factor(df, needs).collect():
            p = [min(1, r.factor / n**0.5) for n in sizes]
            assert sum(a * n for a, n in zip(p, sizes, strict=True)) == pytest.approx(need if r.source else need / 2)


def test_mixed_documents_tell_rows_apart(spark):
    rows = [(i, "w " * (i + 1), s, 0) for i in range(20) for s in "ab"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    words = defaultdict(int)
    for r in mixing.mixed_documents(df).select("source", mixing.word_count(F.col("text")).alias("n")).collect():
        words[r.source] += r.n
    want = defaultdict(int)
    for r in mixing.mix_sources(df).collect():
        want[r.source] += r.taken
    assert words == want


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_mixing_goes_on_past_documents_that_do_not_fit(spark, seed):
    sizes = [(i, 5000 if i % 20 == 0 else 100 + i, "ab"[i % 3 == 0]) for i in range(1, 121)]
    df = spark.createDataFrame([(d, "w " * n, s) for d, n, s in sizes], "doc_id long, text string, source string")
    how = {"weights": (1, 1), "total_share": 0.25, "max_copies": 1.0}
    got = {r.doc_id: r for r in mixing.mix_sources(df, seed=seed, **how).collect()}
    sized = df.select("doc_id", "source", mixing.word_count(df.text).alias("size"))
    sized = sized.withColumn("u", mixing.random_number(sized.doc_id, seed))
    cuts = mixing._cuts(sized, (1, 1), 0.25, 1.0).collect()
    assert {d: r.taken for d, r in got.items()} == mixed_by_brute_force(sizes, cuts, seed)
    for c in cuts:
        assert abs(sum(r.taken for r in got.values() if r.source == c.source) - c.target) < 120


def test_mixing_awkward(awkward, empty):
    got = mixing.mix_sources(awkward).collect()
    assert len(got) == len(AWKWARD) and all(r.taken <= 2 * r.size for r in got)
    assert {r.size for r in got if r.doc_id in (1, 2, 5)} == {0}
    assert mixing.mixed_documents(awkward).columns == awkward.columns
    assert mixing.mix_sources(empty).count() == 0


def test_language(spark, docs):
    got = {r.doc_id: r for r in queries.op9_language_id(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.lang for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d in got if got[d].held_out} == set(held)
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) >= 0.97


def test_language_sample(spark):
    rows = [(i, f"the words of text {i} " * 3, "en") for i in range(3000)] + [(9000 + i, f"die Wörter von Text {i} " * 3, "de") for i in range(3)]
    rows += [(None, f"les mots du texte {i}", "fr") for i in range(400)] + [(5, "", "it")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample, every = langid.sampled(df, 300)
    got = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert every == {"en": 3000, "de": 3, "fr": 400, "it": 1}
    assert got["de"] == 3 and 200 <= got["en"] <= 300 and 100 <= got["fr"] <= 200 and "it" not in got
    assert set(langid.fit(df).langs) == {"de", "en", "fr"}


def test_language_awkward(awkward, empty):
    got = langid.identify_language(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 5)} == {("und", 0.0)}
    assert langid.identify_language(empty).count() == 0
    assert {r.lang_pred for r in langid.identify_language(awkward.withColumn("lang", awkward.lang.substr(9, 9)).filter("lang is null")).collect()} <= {"und"}


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, sf).collect()}
    labels = pq.read_table(f"{sf}/labels.parquet").to_pylist()
    held = [(r["toxic"], got[r["doc_id"]]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r.held_out for _, r in held)
    assert np.mean([t == r.predicted for t, r in held]) >= 0.9


def test_toxicity_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(6, 1), (7, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(awkward, labels).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(awkward, labels.limit(0)).collect()} == {0.0}
    assert toxicity.drop_toxic(awkward, labels.limit(0)).columns == awkward.columns


def test_isotonic_and_trees():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = (x[:, 1] > 0.5).astype(float)
    raw = toxicity.Trees(rounds=20).fit(x, y).raw(x)
    assert ((raw > 0) == (y > 0)).mean() > 0.97
    px, py = toxicity.isotonic(raw, y)
    assert (np.diff(py) >= 0).all() and (np.diff(px) >= 0).all()


def test_toxicity_learns_from_texts_with_a_common_opening(spark, monkeypatch):
    opening = "This page was saved by the archive in the year two thousand. "
    rows = [(i, opening + (f"you vile scum number{i}" if i % 2 else f"a calm walk number{i}"), i % 2) for i in range(1, 81)]
    rows += [(100 + i, (opening + f"YOU  vile\nscum number{i} "), 1) for i in (1, 3, 5)]
    kept = []
    monkeypatch.setattr(toxicity, "written", lambda df, name: kept.append(df) or df)
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert sorted(r.doc_id for r in kept[0].collect()) == list(range(1, 81))
    assert model.weights and model.trees is not None


def test_sentence_spans(spark, awkward, empty):
    passage = "The first of the three sentences is here. The second one follows it closely. And then a third ends the passage! "
    rows = [(1, "Own words. " + passage + "More own words."), (2, passage), (3, "Start. " + passage + passage), (4, "A. B. C. D."), (5, "A. B. C. E."), (6, " \n "), (7, "ab\x01cd. ef")]
    got = {r.doc_id: r for r in sentence_spans.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept_text == rows[0][1] and got[2].kept_text == "" and got[3].kept_text == "Start. "
    assert got[3].removed == [1, 2, 3, 4, 5, 6] and got[4].n_removed == got[5].n_removed == 0
    assert got[6].kept_text == " \n " and got[6].n_sentences == 0 and got[7].kept_text == "ab\x01cd. ef"
    rows = sentence_spans.remove_repeated_spans(awkward).collect()
    assert len(rows) == len(AWKWARD)
    # The long text is one sentence, of which there is no other; equal rows of id 4 are one occurrence
    assert sorted((r.doc_id or 0, r.n_sentences, r.kept_text) for r in rows) == sorted((r[0] or 0, int(bool((r[1] or "").strip())), r[1] or "") for r in AWKWARD)
    assert sentence_spans.remove_repeated_spans(empty).count() == 0


def spans_by_brute_force(rows, span=2, words=16, long=30):
    """Every large enough run of sentences, of any size, counted as words: what all but its first occurrence cover."""
    parts, seen, gone = {}, set(), defaultdict(set)
    for d, text in sorted(rows):
        cut, at = [], 0
        spans = [m.span() for m in WORD.finditer(text)]
        for (a, b), (c, _) in zip(spans, [*spans[1:], (len(text), 0)], strict=True):
            if text[b - 1] in ".!?" or "\n" in text[b:c] or c == len(text):
                cut.append(text[at:c])
                at = c
        parts[d] = cut or [text]
        bare = [tuple(WORD.findall(p)) for p in cut]
        for i in range(len(bare)):
            run = ()
            for j in range(i, len(bare)):
                run += bare[j]
                if (j - i + 1 >= span and len(run) >= words) or len(run) >= long:
                    if run in seen:
                        gone[d].update(range(i, j + 1))
                    seen.add(run)
    return {d: (sorted(gone[d]), "".join(p for i, p in enumerate(cut) if i not in gone[d])) for d, cut in parts.items()}


def test_sentence_spans_of_short_and_of_long_sentences(spark):
    short = "".join(f"Item {i}. " for i in range(25))
    long = " ".join(f"word{i}" for i in range(60)) + ". "
    pair = " ".join(f"left{i}" for i in range(30)) + "! " + " ".join(f"right{i}" for i in range(30)) + "? "
    rows = [(1, "One. " + short + "Two. "), (2, "Other words here. " + short + "The end. "), (3, "Before. " + long + "After. "), (4, "Ahead. " + long + "Behind. ")]
    rows += [(5, "Up. " + pair + "Down. "), (6, "In. " + pair + "Out. "), (7, "A. B. C. D. " * 20), (8, "x\n" + "}\n" * 40 + "y\n"), (9, "z\n" + "}\n" * 40), (10, "Short. " + "tail " * 12), (11, "Short. " + "tail " * 12)]
    rows += [(12, long.strip()), (13, short + long + pair + short), (14, "  " + pair.replace(" ", "\t ") + "\r\n\n next"), (15, "Fresh start. Tiny. " + long[:-2] + "\n\n" + "Fin")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.removed, r.kept_text) for r in sentence_spans.remove_repeated_spans(df).collect()}
    assert got[2][1] == "Other words here. The end. " and got[4][1] == "Ahead. Behind. " and got[6][1] == "In. Out. "
    assert got[10][1] == rows[9][1] and got[11][1] == rows[10][1] and got[12][1] == "" and got[14][1] == "next"
    assert got == spans_by_brute_force(rows)


def test_sentence_spans_by_brute_force(spark, rows):
    some = [(d, t) for d, t in rows if len(t) < 3000][:250]
    got = {r.doc_id: (r.removed, r.kept_text) for r in sentence_spans.remove_repeated_spans(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    assert got == spans_by_brute_force(some)


def licenses_by_brute_force(text, contained=0.8):
    fold = lambda t: re.sub(r"[!-/:-@\[-`{-~]", " ", t.translate({c: c + 32 for c in range(65, 91)}))

    def cut(t):
        w = WORD.findall(fold(t))
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])

    found = {}
    have = cut(text)
    for name, template in license_scan.TEMPLATES.items():
        want = set(cut(template))
        size = min(x for k in range(20) for x in (2**k, 3 * 2**k) if x >= len(want))
        shares = [len(want & set(have[i : i + 2 * size])) / len(want) for i in range(0, len(have), size)]
        if shares and max(shares) >= contained:
            found[name] = (max(shares), size * shares.index(max(shares)))
    return found


def test_license_scan(spark, awkward, empty):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    texts = {d: t for d, t in texts.items() if d % 10 == 0 or "icense" in (t or "")}
    long = " ".join(["words before"] * 40) + " " + license_scan.TEMPLATES["MIT"].upper() + " and after. " + license_scan.TEMPLATES["ISC"]
    texts |= {-1: long, -2: "", -3: "Released, under the mit LICENSE", -4: license_scan.TEMPLATES["BSD-3-Clause"]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = defaultdict(dict)
    for r in license_scan.license_scan(df).collect():
        got[r.doc_id][r.license] = (r.containment, r.window_start)
    assert got == {d: f for d, t in texts.items() if (f := licenses_by_brute_force(t))}
    assert set(got[-1]) == {"MIT", "ISC"} and set(got[-3]) == {"MIT notice 2"} and set(got[-4]) == {"BSD-2-Clause", "BSD-3-Clause"}
    # Notices as documents have them, worded apart from the templates
    planted = ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0."]
    assert all(any(license_scan.scan(pa.array([f"some words. {p} More"]), license_scan.Templates([t], 5), 5, 0.8) for t in license_scan.TEMPLATES.values()) for p in planted)
    assert license_scan.license_scan(awkward).count() == 0 and license_scan.license_scan(empty).count() == 0
    assert license_scan.license_scan(df, templates={}).count() == 0


def test_license_scan_finds_altered_copies():
    """Whole licenses and headers in other words, two words in a hundred changed."""
    names = [k for k in license_scan.TEMPLATES if "notice" not in k]
    templates, draw = license_scan.Templates(list(license_scan.TEMPLATES.values()), 5), random.Random(3)
    every, hit = 0, 0
    for _ in range(3):
        texts = []
        for k in names:
            w = [f"other{draw.randrange(1000)}" if draw.random() < 0.02 else x for x in license_scan.TEMPLATES[k].split()]
            around = [f"w{draw.randrange(500)}" for _ in range(draw.randrange(900))]
            texts.append(" ".join([*around, *w, *around]))
        found = {(names[r], list(license_scan.TEMPLATES)[t]) for r, t, _, _ in license_scan.scan(pa.array(texts), templates, 5, 0.8)}
        every += len(names)
        hit += sum((k, k) in found for k in names)
    assert hit >= 0.9 * every


def test_class_sizes():
    assert [license_scan.class_size(n) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13, 17, 25)] == [1, 2, 3, 4, 6, 6, 8, 8, 12, 12, 16, 24, 32]


def test_pipeline_stages(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, before, sf_dir), name)
        assert docs.columns == columns
        if name == "exact_dedup":
            kept = {r.doc_id for r in exact_dedup.exact_dedup(before).filter("kept").collect()}
            assert sorted(kept) == sorted(r.doc_id for r in docs.collect())
        if name == "ngram_jaccard_join":
            want = classes_by_brute_force([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(d for d, v in want.items() if v[1] == d)
        if name == "mixing":
            taken = {r.doc_id: r.copies for r in mixing.mix_sources(before).collect() if r.copies}
            assert {k: v for k, v in taken.items()} == dict(docs.groupBy("doc_id").count().collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_stages_awkward(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    names = ["doc_id", "text", "source", "lang", "__score", "__gone"]
    awkward = spark.createDataFrame(AWKWARD, SCHEMA).toDF(*names)
    empty = spark.createDataFrame([], SCHEMA).toDF(*names)
    found = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, awkward, sf_dir)
        assert out.columns == names
        found[name] = sorted((r.doc_id or 0, r.text) for r in out.collect()) if name != "mixing" else out.collect()
        none = stage(spark, empty, sf_dir)
        assert none.columns == names and none.count() == 0
    # Clean texts stay; of 1, 2 and 5, which are empty, and of 3 and 4 one row stays
    assert [d for d, _ in found["toxicity"]] == sorted(r[0] or 0 for r in AWKWARD)
    assert [d for d, _ in found["exact_dedup"]] == [0, 1, 3, 6, 7, 8]
    # Texts without words are linked with nothing
    assert [d for d, _ in found["ngram_jaccard_join"]] == [0, 1, 2, 3, 5, 6, 7, 8]
    assert all(r.doc_id != 8 or r.text == AWKWARD[8][1] for r in found["mixing"])
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf_dir).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, awkward, sf_dir).collect()
    assert sum(r.piece == 0 for r in packed) == len(AWKWARD)


def test_near_copies_without_an_id(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (3, text + " end"), (None, "alone here"), (4, "start " + text), (4, "another text of that id altogether")]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    # Rows without an id are one document, linked with 3; the rows of 4 are one document too
    assert [(r.doc_id, r.text) for r in out.collect()] == [(3, text + " end")]


def repeats_by_brute_force(rows, length=100):
    seen, out = set(), {}
    for d, text in sorted(rows):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            part = data[i : i + length]
            if part in seen:
                gone[i : i + length] = True
            seen.add(part)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        rest = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[d] = (len(data), int(gone.sum()), len(edges) // 2, hashlib.sha256(rest).hexdigest())
    return out


def repeats_of(df):
    return {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}


def test_suffix_dedup(docs, rows):
    assert repeats_of(docs.repartition(5)) == repeats_by_brute_force(rows)


def test_suffix_dedup_hard(spark, monkeypatch):
    rng = np.random.default_rng(3)
    text = lambda n, k=26: "".join(chr(97 + c) for c in rng.integers(0, k, n))
    base, line, low = text(900), text(60), text(700, 2)
    rows = []
    for d in range(60):
        t = list(base)
        for k in rng.integers(0, 900, int(rng.integers(0, 3))):
            t[k] = "Z"
        rows.append((3 * d, text(int(rng.integers(0, 80))) + "".join(t) + text(20)))
        rows.append((3 * d + 1, text(150) + line + text(150)))
        rows.append((3 * d + 2, low[d : 400 + 5 * d] + "a" * 250 + "ab" * 80))
    rows += [(1000, ""), (1001, "x" * 99), (1002, "x" * 100), (1003, "x" * 100), (1004, "é" * 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = repeats_by_brute_force(rows)
    assert repeats_of(df) == want


def test_difference_cover_order():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 5, 40, 301, 302, 303):
        for kinds in (1, 2, 5):
            t = rng.integers(1, kinds + 1, n)
            assert suffix_dedup.difference_cover_order(t, n).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
            short = [t[i : i + 20].tolist() for i in suffix_dedup.difference_cover_order(t, 20)]
            assert short == sorted(short)


def test_suffix_dedup_awkward(awkward, empty):
    got = suffix_dedup.remove_repeats(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert {r.n_bytes for r in got if r.doc_id in (1, 2)} == {0}
    assert next(r for r in got if r.doc_id == 8).spans and any(r.doc_id is None for r in got)
    assert suffix_dedup.remove_repeats(empty).count() == 0
