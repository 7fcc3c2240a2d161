"""SimHash components and tokenizer alignment against brute force on whole small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from ledgerweave.llm import alignment, queries, simhash
from ledgerweave.llm.common import table

WORD = re.compile("[^\x20\x09-\x0d]+")
A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, fingerprint string, component_id string, n_a int, block long"
AWKWARD = [
    (1, None, "x", None, 1, 1),
    (2, "", None, "y", 2, None),
    (3, "one", "x", None, None, 1),
    (4, "one", "x", None, 4, 1),
    (4, "one", "x", None, 4, 1),
    (4, "two words", "x", None, 4, 1),
    (5, " \t\n ", "x", "y", 5, 1),
    (6, "odd▁piece mark", "x", "y", 6, 1),
    (7, "ALPHA beta  gamma\tdelta <|endoftext|> <s> x </s> <unk>", "x", "y", 6, 1),
    (8, "long " + "lorem ipsum dolor sit amet consectetur " * 3000, "x", "y", 6, 1),
    (9, "é 日本語 　テスト 😀😀 \x00 \x1f naïve—“quoted” ﬁ é", "x", "y", 6, 1),
    (10, "=" * 700 + "ab" * 300 + "\n\n\n   \n" + "-" * 77, "x", "y", 6, 1),
    (None, "no id at all here my friend", "x", "y", 6, 1),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def components_of(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def print_by_brute_force(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    values = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def simhash_by_brute_force(rows):
    prints = [print_by_brute_force(t) for _, t in rows]
    distinct = sorted(set(prints))
    found = components_of([(a, b) for i, a in enumerate(distinct) for b in distinct[i:] if (a ^ b).bit_count() <= 3])
    least = {}
    for (d, _), p in zip(rows, prints, strict=True):
        if d is not None:
            least[found[p]] = min(d, least.get(found[p], d))
    return Counter((d, f"{p:016x}", least.get(found[p])) for (d, _), p in zip(rows, prints, strict=True))


def test_simhash_equals_brute_force(spark, sf_dir, awkward):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op12_simhash(spark, sf_dir).collect())) == simhash_by_brute_force(rows)
    got = simhash.simhash_components(awkward)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(map(tuple, got.collect())) == simhash_by_brute_force([(r[0], r[1]) for r in AWKWARD])
    assert simhash.simhash_components(awkward.limit(0)).collect() == []


def test_covering_masks_hold_every_pair_within_the_radius():
    rng = random.Random(5)
    for radius in (1, 2, 3, 4):
        masks = simhash.covering_masks((1 << 64) - 1, radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(500):
            gone = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(m & gone == 0 for m in masks)
    open_bits = masks[0] ^ ((1 << 64) - 1)
    assert all(m & ~open_bits == 0 for m in simhash.covering_masks(open_bits, 3))


def test_steps_end(spark):
    kept = [0]
    for most in (32, 16, 8):
        _, kept = simhash._deeper(spark, kept, 3)
        assert max(64 - k.bit_count() for k in kept) <= most


def test_crowded_buckets_lose_no_pair(spark):
    rng, prints = random.Random(9), set()
    for _ in range(2):  # fingerprints that differ in 11 bits at most, and others that hang on them
        centre, open_bits = rng.getrandbits(64), rng.sample(range(64), 11)
        prints |= {centre ^ sum(1 << b for b in open_bits if rng.random() < 0.4) for _ in range(1500)}
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(2, 7))) for _ in range(200)}
    prints |= {rng.getrandbits(64) for _ in range(60)}
    rows = spark.createDataFrame([(simhash._signed(p),) for p in prints], "print long")
    ordered = np.array(sorted(prints), np.uint64)
    one, other = simhash.links_within(ordered, 3)
    want = components_of(zip(one.tolist(), other.tolist(), strict=True))
    some = ordered[:: len(ordered) // 40]
    for p in some.tolist():  # the forest itself, by plain comparison
        for q in ordered[np.bitwise_count(ordered ^ np.uint64(p)) <= 3].tolist():
            assert want.get(p, p) == want.get(q, q)
    got = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.near_links(rows, large=256).collect()]
    assert components_of(got) == want
    with pytest.raises(ValueError):
        simhash.near_links(rows, large=2)


def alignment_by_brute_force(rows):
    a_model, b_model = Tokenizer.from_file(A_FILE), SentencePieceProcessor(model_file=B_FILE)
    a_model.encode_special_tokens = True
    plain = alignment.byte_characters()
    docs = []
    for d, text in rows:
        whole = (" " + (text or "")).encode()
        a = a_model.encode(whole.decode(), add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        bytes_a = [bytes(plain[c] for c in a_model.id_to_token(k)) for k in a]
        bytes_b = [bytes([int(b_model.id_to_piece(k)[3:5], 16)]) if b_model.is_byte(k) else b_model.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append((d, [], [], []))
            continue
        groups, i, j, ua, ub = [([], [])], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if ua <= ub and i < len(a):
                groups[-1][0].append(a[i])
                ua += len(bytes_a[i])
                i += 1
            else:
                groups[-1][1].append(b[j])
                ub += len(bytes_b[j])
                j += 1
            if ua == ub:
                groups.append(([], []))
        docs.append((d, a, b, groups[:-1]))
    count = Counter(p for *_, groups in docs for p in {(x, y) for g in groups for x in g[0] for y in g[1]})
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    out = []
    for d, a, b, groups in docs:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        out.append((d, len(a), len(b), len(groups), len(links), sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links), digest))
    return Counter(out), {(x, y, n, n == highest[x]) for (x, y), n in count.items()}


def test_alignment_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    want, _ = alignment_by_brute_force(rows)
    got = queries.op13_tokenizer_alignment(spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == want


def test_alignment_of_awkward_rows(spark, awkward, monkeypatch):
    want, pairs = alignment_by_brute_force([(r[0], r[1]) for r in AWKWARD])
    for block_bytes in (1, 1 << 20):
        by_doc, by_pair = alignment.align_tokenizers(awkward, A_FILE, B_FILE, block_bytes=block_bytes)
        assert Counter(map(tuple, by_doc.collect())) == want
        assert set(map(tuple, by_pair.collect())) == pairs
    by_doc, by_pair = alignment.align_tokenizers(awkward.limit(0), A_FILE, B_FILE)
    assert by_doc.collect() == [] and by_pair.collect() == []


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    texts = [(" " + (r[1] or "")).encode() for r in AWKWARD]
    plain = alignment.Aligner(A_FILE, B_FILE).align(texts)
    monkeypatch.setattr(alignment, "PLAIN_LINKS", 1)
    assert alignment.Aligner(A_FILE, B_FILE).align(texts) == plain
    assert np.array_equal(alignment.merged(np.array([1, 4, 6, 9]), np.array([2, 4, 9])), np.array([4, 9]))
