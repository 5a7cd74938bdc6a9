"""The training-data operators on small tables: against plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import bpe, iblt, licenses, neighbours, packing, quality, simhash, tokenfiles, toxicity, warc
from graphloom.llm.common import connected_components, ordered_buckets, training_rows
from graphloom.llm.license_rules import BASE, GATE_WORDS, GATES, rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to quick brown fox jumps over lazy dog river stone cloud paper green slow deep bright".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows and odd characters."""
    rng = random.Random(5)
    long = "\n".join(prose(rng, 40) for _ in range(300))
    texts = [None, "", " ", "\n\n", "a", "ÀÉ ñandú straße İ", "tab\tand\x1fodd\x0b spaces   here  ", "🎉 émoji 漢字", "don't 'll <|endoftext|> ...", long, "x" * 5000, "same text", "same text", "CAPS and CAPS", " lead", "trail "]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[11], (None, "no id", None, None, None), (None, None, None, None, None), (-7, "negative id", "en", "s", 11)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), DOCS)
    clash = ["score", "length", "ids", "fp", "bucket", "next", "rank", "key", "words", "n", "h"]
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def keyed(rows):
    return sorted((tuple(r) for r in rows), key=str)


# Packing
def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_packing_whole(odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(odd, path).collect()
    want = []
    for doc_id, text, *_ in odd_rows():
        ids = [*ids_of(path, text), 0]
        want += [(doc_id, at // 2048, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for at in range(0, len(ids), 2048)]
    assert keyed((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == keyed(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(none, path).collect() == []


def best_possible(items, capacity):
    """The least number of bins, by search."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for room in sorted({b for b in bins if b >= items[k]}):
            rest = list(bins)
            rest.remove(room)
            go(k + 1, [*rest, room - items[k]])
        go(k + 1, [*bins, capacity - items[k]])

    go(0, [])
    return best[0]


def test_plan_is_valid_and_near_the_optimum():
    rng = random.Random(1)
    for _ in range(60):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        counts = {s: items.count(s) for s in set(items)}
        slots, n = packing.plan(counts, 20)
        fill = {}
        for size, (first, sequence, offset) in slots.items():
            bounds = [*first[1:], counts[size]]
            for lo, hi, q, off in zip(first, bounds, sequence, offset):
                for r in range(lo, hi):
                    fill.setdefault(q + r - lo, []).append((off, size))
        assert sum(len(x) for x in fill.values()) == len(items) and len(fill) == n
        for parts in fill.values():
            at = 0
            for off, size in sorted(parts):
                assert off == at
                at += size
            assert at <= 20
        least = best_possible(items, 20)
        assert least <= n <= least + 1


def test_reduction_keeps_the_optimum():
    rng, sets = random.Random(1), {1: 0, 2: 0, 3: 0}
    for t in range(2500):
        capacity = rng.choice([20, 33, 50])
        items = [rng.randint(rng.choice([1, 3, capacity // 5]), rng.choice([capacity, capacity // 2])) for _ in range(rng.randint(1, 9))]
        if not t:
            capacity, items = 33, [16, 14, 14, 7, 6, 5, 4]
        left = {s: items.count(s) for s in set(items)}
        fixed = packing._reduce(left, capacity)
        for chosen, n in fixed:
            sets[len(chosen)] += n
            assert sum(chosen) <= capacity
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sorted(rest + [s for chosen, n in fixed for s in chosen * n]) == sorted(items)
        assert sum(n for _, n in fixed) + best_possible(rest, capacity) == best_possible(items, capacity)
    assert min(sets.values()) > 100


def test_reduction_fixes_dominating_sets():
    counts = {15: 2, 5: 2, 19: 1, 8: 1}
    fixed = packing._reduce(counts, 20)
    assert ((15, 5), 2) in fixed and ((19,), 1) in fixed and counts == {}
    assert packing.plan({}, 20) == ({}, 0)


# Quality and toxicity
def labelled(spark, n=240):
    rng = random.Random(3)
    bad = ["moron", "idiot", "scum"]
    docs, labels = [], []
    for i in range(n):
        junk, toxic = i % 4 == 0, i % 3 == 0
        words = [rng.choice(WORDS) for _ in range(60)]
        if junk:
            words = [w.upper() + "!!" for w in words[:20]] * 3
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label):
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 40
    return sum(r.predicted == r[label] for r in rows) / len(rows)


def test_quality(spark, odd, none):
    docs, labels = labelled(spark)
    assert accuracy(quality.score_documents(docs, labels), labels, "quality") > 0.95
    got = quality.score_documents(odd, labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert quality.score_documents(none, labels).collect() == []
    assert {r.score for r in quality.score_documents(odd, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0.6 * 240 < kept.count() < 0.9 * 240


def test_quality_score_is_the_difference(spark, odd):
    """The query's scores against plain compression with the model's dictionaries."""
    import zstandard

    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    assert 1 <= len(model.bad) <= len(model.good) <= quality.SIDES

    def size(text, dictionary):
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(c.compress(text[at : at + (1 << 17)])) for at in range(0, len(text), 1 << 17))

    def plain(text):
        g, b = (min(size(text, d) for d in side) for side in (model.good, model.bad)) if text else (1, 1)
        return 1 / (1 + np.exp(-(model.weights[0] + model.weights[1] * 10 * (b - g) / (b + g))))

    assert model.weights[1] > 0
    got = quality.score_documents(odd, labels.limit(0)).count()
    assert got == len(odd_rows())
    both = docs.select("doc_id", "text").unionByName(odd.filter("doc_id < 20 AND doc_id >= 0").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    scores = {r.doc_id: r.score for r in quality.score(both, model).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in both.collect()}
    assert len(scores) > 250 and all(scores[k] == pytest.approx(plain(t)) for k, t in texts.items())


def test_training_takes_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)] + [(0, 1)], "doc_id long, quality int")
    rows = training_rows(docs, labels, "quality", (10, 10), 100)
    assert len(rows) == len({r.doc_id for r in rows}) and all(r.text == f"text {min((k for k in range(100) if k % 5 == r.doc_id), key=str)}" for r in rows)


def test_held_out_rows_teach_nothing(spark):
    docs, labels = labelled(spark)
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    flipped = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    for m in (quality, toxicity):
        assert keyed(m.score_documents(docs, labels).select("doc_id", "score").collect()) == keyed(m.score_documents(docs, flipped).select("doc_id", "score").collect())


def test_toxicity(spark, odd, none):
    docs, labels = labelled(spark)
    scored = toxicity.score_documents(docs, labels)
    assert accuracy(scored, labels, "toxic") > 0.95
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in scored.filter("predicted = 1").collect():
        assert all(any(w in ("moron", "idiot", "scum") for w in re.findall(r"\w+", texts[r.doc_id].lower()[s.begin : s.end])) for s in r.spans) and r.spans
    got = toxicity.score_documents(odd, labels).collect()
    assert len(got) == len(odd_rows()) and all(r.predicted == 0 for r in got)
    assert toxicity.score_documents(none, labels).collect() == []
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 150 <= kept.count() <= 170


def test_spans_are_offsets_in_the_text():
    assert toxicity.spans_of("İİ moron", np.array([0, 0, 0.9])) == [(3, 8)]
    for text in ("İİ moron", "a İ moron scum İx", "MORON", "ẞ ΑΣ moron"):
        found = toxicity.words(text)
        toxic = np.array([float(w in ("moron", "scum")) for w in found])
        assert " ".join(text[a:b].lower() for a, b in toxicity.spans_of(text, toxic)) == " ".join(w for w in found if w in ("moron", "scum"))


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        e, steps = rng.normal(size=n), rng.normal(size=(2, 2))
        first = np.zeros(n, bool)
        first[0] = True
        z, p = 0.0, np.zeros(n)
        for y in np.ndindex(*[2] * n):
            s = np.exp(sum(e[t] * y[t] for t in range(n)) + sum(steps[y[t - 1], y[t]] for t in range(1, n)))
            z += s
            p += s * np.array(y)
        assert np.allclose(toxicity.marginals(e, first, steps)[0], p / z)
    e, cuts = rng.normal(size=300), np.arange(300) % 37 == 0
    whole, pairs = toxicity.marginals(e, cuts, steps)
    parts = [toxicity.marginals(x, np.arange(len(x)) == 0, steps) for x in np.split(e, np.flatnonzero(cuts)[1:])]
    assert np.allclose(whole, np.concatenate([x[0] for x in parts])) and np.allclose(pairs, sum(x[1] for x in parts))


# Licences
def test_licenses(spark, none):
    texts = [None, "", "Released under the MIT License.", "x under the mit license under THE mit\nlicense", "Apache License, Version 2.0 and CC BY-NC 4.0", "GNU Lesser General Public License version 3", "SPDX-License-Identifier: GPL-2.0-only", "mit license é cc by nc", "no licence here", "underthe mit license", "the BSD 3-clause license; public domain", "Released as MIT No Attribution", "gpl mit licence " * 90 + "gnu gpl 3 0 or later under the mit license"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[2]), (2, texts[2])], "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("norm", F.lit(1))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    made = [(a, b, c, re.compile(f"(?<= )(?:{d})(?= )")) for a, b, c, d in rules()]

    def plain(doc_id, text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        starts, base = [], set()
        for label, phrase in BASE.items():
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            starts += at
            base |= {label} if at else set()
        norm = f" {' '.join(w)} "
        found = [(m.start(), m.end(), b, a) for a, b, _, r in made for m in r.finditer(norm)]
        kept = {d[3] for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and (e[2] < d[2] or (e[2] == d[2] and e[1] - e[0] > d[1] - d[0])) for e in found)}
        return (doc_id, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | kept)))

    got = licenses.label_documents(df)
    assert keyed(got.drop("score").collect()) == keyed(plain(r.doc_id, r.text) for r in df.collect())
    labels = {r.doc_id: r.labels for r in got.collect()}
    assert labels[4] == "apache-2,cc-by-nc" and labels[5] == "lgpl-3" and labels[6] == "gpl-2" and labels[10] == "bsd-3,public-domain" and labels[11] == "mit-0"
    assert licenses.label_documents(none).collect() == []


def samples(pattern):
    """Texts that a rule's pattern matches: every alternative, optional parts there and not there (the latter alone where they are many)."""
    from re import _constants as C
    from re import _parser

    def several(parts):
        out = [""]
        for p in parts:
            out = [a + b for a in out for b in part(p)]
            out = list(dict.fromkeys([*out[:60], *out[-60:]]))
        return out

    def part(node):
        op, arg = node
        if op is C.LITERAL:
            return [chr(arg)]
        if op is C.NOT_LITERAL:
            return ["x"]
        if op is C.IN:
            return ["x" if arg[0][0] is C.NEGATE else chr(arg[0][1] if arg[0][0] is C.LITERAL else arg[0][1][0])]
        if op is C.BRANCH:
            return [x for b in arg[1] for x in several(b)]
        if op is C.SUBPATTERN:
            return several(arg[3])
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, _, inner = arg
            return ([""] if not least else []) + several(inner)
        raise AssertionError(op)

    return several(_parser.parse(pattern))


def test_every_rule_has_a_gate():
    words = re.compile(rf"(?<![0-9a-z])(?:{'|'.join(GATE_WORDS)})(?![0-9a-z])")
    for _, _, word, pattern in rules():
        for text in samples(pattern):
            assert any(g in text for g in GATES) or words.search(text), (pattern, text)
            assert f" {word}" in f" {text}", (pattern, text)
    assert len(rules()) > 300 and len(set(rules())) == len(rules())


def test_a_text_full_of_detections(spark):
    import time

    texts = ["mit license " * 80_000, "the mit license gpl " * 20_000 + "cc by nc " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in licenses.label_documents(df).collect()}
    assert time.perf_counter() - began < 40
    assert got[0].labels == "mit" and got[0].n_words == 160_000 and got[1].n_base == 20_000 and got[1].first_word == 80_000
    assert {"mit", "gpl", "cc-by-nc"} <= set(got[1].labels.split(","))
    found = licenses.scan(df.filter("doc_id = 0")).first().found
    assert [(f.start, f.end) for f in sorted(found)] == sorted([(12 * k + 1, 12 * k + 12) for k in range(80_000)] + [(12 * k + 5, 12 * k + 16) for k in range(79_999)])


# SimHash
def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits=3):
    """The smallest id reachable from each row."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= bits:
            root[find(i)] = find(j)
    out = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            out[find(i)] = min(out.get(find(i), doc), doc)
    return [out.get(find(i)) for i in range(len(prints))]


def test_simhash(spark, odd, none):
    rng = random.Random(9)
    base = [prose(rng, 120).split() for _ in range(6)]
    rows = [(r[0], r[1]) for r in odd_rows()]
    for k in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((100 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    want = [(d, f"{p:016x}", c) for (d, p), c in zip(prints, plain_components(prints))]
    assert keyed(simhash.simhash_components(df).collect()) == keyed(want)
    assert simhash.simhash_components(none).collect() == []
    assert simhash.simhash_components(odd).count() == len(odd_rows())


def test_blocks_lose_no_link_in_crowded_buckets(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    values = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for cell in (7, 2048):
        links = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.near_links(df, cell=cell).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        mine = {v: v for v in values}

        def find(x, mine=mine):
            while mine[x] != x:
                x = mine[x]
            return x

        for a, b in links:
            mine[find(a)] = find(b)
        for a, b in combinations(values, 2):
            if (a ^ b).bit_count() <= 3:
                assert find(a) == find(b)


def test_drop_near_copies(spark, odd, none):
    kept = simhash.drop_near_copies(odd).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 11 in ids and 12 not in ids
    assert simhash.drop_near_copies(odd).columns == odd.columns
    assert sum(r.text == "no id" for r in kept) == 1 and simhash.drop_near_copies(none).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = dict(map(tuple, connected_components(edges).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(edges.limit(0)).collect() == []


# Tokens
def test_bpe(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc_id, text, *_ in odd_rows():
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert keyed(bpe.round_trip(odd, path, public_tokenizers.PATTERN).collect()) == keyed(want)
    assert bpe.round_trip(none, path, public_tokenizers.PATTERN).collect() == []
    back = bpe.decode_documents(bpe.encode_documents(odd, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert keyed((r.doc_id, bytes(r.bytes)) for r in back.collect()) == keyed((r[0], (r[1] or "").encode()) for r in odd_rows())


def test_chunks_don_t_change_encodings():
    rng = random.Random(8)
    alphabet = [*"ab e'sdt\n\t  \r12\x1f\x85 éßİΣ漢🎉.,!_×", "<|endoftext|>", "'ll", "..."]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for make, name in ((packing.WordEncoder, "word_bpe_49k.json"), (tokenfiles.Encoder, "byte_bpe_50k.json")):
        for plain in (False, True):
            path = public_tokenizers.path(name)
            t = Tokenizer.from_file(path)
            t.encode_special_tokens = plain
            ids, n = make(path, plain).encode(texts)
            assert ids.tolist() == [i for x in t.encode_batch(texts, add_special_tokens=False) for i in x.ids] and n.sum() == len(ids)


def test_merge_of_long_pieces():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"aab": 3, b"ab": 4}
    assert bpe.merge(b"aab", ranks) == [3] and bpe.merge(b"aaab", ranks) == [2, 4]
    assert bpe.merge(b"a" * 50_001, ranks) == [2] * 25_000 + [0]


def test_variable_length_code():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = tokenfiles.pack(ranks)
        assert (tokenfiles.unpack(control, data, n) == ranks).all() and len(control) == (n + 3) // 4
    body = tokenfiles.file_bytes([1, None], [2, 1], *tokenfiles.pack(np.array([5, 300, 7], np.uint32)))
    ids, lengths, ranks = tokenfiles.parse_file(body)
    assert ids == [1, None] and lengths.tolist() == [2, 1] and ranks.tolist() == [5, 300, 7]
    with pytest.raises(ValueError):
        tokenfiles.parse_file(body[:-5] + b"x" + body[-4:])


def test_token_files(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = tokenfiles.file_round_trip(odd, path, 2).collect()
    per = [(doc, [*ids_of(path, text), 2]) for doc, text, *_ in odd_rows()]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert keyed((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == keyed((d, len(i), crc(i)) for d, i in per)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert tokenfiles.file_round_trip(none, path, 2).collect() == []


# Neighbours
def test_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[50:90] = x[40]  # ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0), (1003, [None] + [1.0] * 15, 0), (1004, [float("inf")] * 16, 0), (None, x[3].tolist(), 0), (1020, [1.0, 2.0], 0), (1021, [3.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit(1))
    got = neighbours.nearest(df, shard=250, block=10).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    d = x.astype(np.float64)
    hit = total = 0
    for q in range(0, 600, 20):
        s = (d * d[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        assert sorted(by[q]) == list(range(1, 21))
        mine = [by[q][k] for k in range(1, 21)]
        assert [i for i, _ in sorted(mine, key=lambda m: (-m[1], m[0]))] == [i for i, _ in mine]
        assert all(v == s[i] for i, v in mine)
        hit += len({i for i, _ in mine} & set(best))
        total += 20
    assert hit / total >= 0.9
    assert by[1020] == {1: (1021, 5.0)} and set(by) == {*range(0, 600, 20), 1020}
    assert neighbours.nearest(df.limit(0)).collect() == []


# Fingerprints
def plain_digests(text):
    """Paragraphs with their numbers among their equals."""
    found = re.split("[ \n]", text) if len(text) <= 128 else []
    for piece in text.split("\n") if len(text) > 128 else []:
        cut = " ".join(w + "\n" * (xxhash.xxh64_intdigest(w.encode(), 42) % 64 == 0) for w in piece.split(" ")).split("\n")
        found += cut if len(piece) > 256 else [piece]
    seen = Counter(found)
    return {(p, k) for p, n in seen.items() for k in range(n)}


def edits_in_order(order):
    """Plain n_chars, hash and likenesses of texts in the order of the contract."""
    same = lambda a, b: len(a & b) / len(a | b)
    for k, t in enumerate(order):
        n = order[(k + 1) % len(order)]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + n[:cut]
        parts = [plain_digests(x) for x in (t, edited, n)]
        yield len(t), hashlib.sha256(edited.encode()).hexdigest(), same(parts[0], parts[1]), same(parts[0], parts[2]), len(parts[0] ^ parts[1])


def test_fingerprints(spark, none):
    rng = random.Random(6)
    lines = [prose(rng, 5) for _ in range(400)]
    texts = [None, "", "one line", "a\nb\nc\nd\ne\nf", "\n".join(lines), "\n".join(lines[:300] + lines[:100:-1]), "é" * 9, "same\nlines", "same\nlines", prose(rng, 900), "x\n" * 200 + "y", "x\n" * 100 + "y"]
    ids = [3, 9, 1, 40, 22, 5, 7, 8, 100, 101, 102, 103]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("next", F.lit(1)).withColumn("bucket", F.lit(1)).withColumn("o", F.lit(1))
    got = {r.doc_id: r for r in iblt.fingerprint_edits(df).collect()}
    order = sorted(zip(ids, (t or "" for t in texts)), reverse=True)
    for (i, _), (n, sha, near_edited, near_next, differ) in zip(order, edits_in_order([t for _, t in order])):
        r = got[i]
        assert r.n_chars == n and r.edited_sha256 == sha and len(set(r.edited_difference)) == differ
        assert r.near_edited == pytest.approx(near_edited) and r.near_next == pytest.approx(near_next)
    assert got[8].fingerprint == got[100].fingerprint != got[1].fingerprint and 0 < got[103].near_next < 1
    assert iblt.fingerprint_edits(none).collect() == []
    single = iblt.fingerprint_edits(df.filter("doc_id = 1")).collect()
    assert len(single) == 1 and single[0].near_next == 1.0


def test_recovered_digests(spark):
    """The digests that peeling gives back are those of the differing paragraphs, each with its side."""
    old, new = [f"line {k}" for k in range(60)], [f"line {k}" for k in range(3, 64)]
    df = spark.createDataFrame([("\n".join(old), "\n".join(new))], "a string, b string")
    a, b = iblt.digests(F.col("a")), iblt.digests(F.col("b"))
    row = df.select(a.alias("a"), b.alias("b")).select("a", "b", iblt.difference(F.col("a"), F.col("b"), iblt.sketch(F.col("a")), iblt.sketch(F.col("b"))).alias("d")).first()
    assert {x.digest for x in row.d if x.side == 1} == set(row.a) - set(row.b) and {x.digest for x in row.d if x.side == -1} == set(row.b) - set(row.a) and row.d


def test_fingerprints_of_odd_rows(spark, odd):
    got = iblt.fingerprint_edits(odd).collect()
    rows = [(r[0], r[1] or "") for r in odd_rows()]
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    want = [(rows[k][0], n, sha, round(e, 9), round(x, 9)) for k, (n, sha, e, x, _) in enumerate(edits_in_order([t for _, t in rows]))]
    assert keyed((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == keyed(want)


def test_buckets_are_ordered_and_spread(spark):
    """A third of the rows has no id, a third one id; no bucket holds more than a few times sqrt(n) rows."""
    n = 9000
    x = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit(77)).otherwise(F.col("id") % 500)
    df = spark.range(n).select(x.alias("x"), F.xxhash64("id").alias("h"))
    rows = df.withColumn("b", ordered_buckets(df, "x", "h")).collect()
    assert max(Counter(r.b for r in rows).values()) < 6 * n**0.5
    rows.sort(key=lambda r: (r.x is not None, r.x or 0, (r.h + (1 << 63)) if r.x in (None, 77) else 0))
    b = [r.b for r in rows]
    assert b == sorted(b) and len(set(b)) > 100


# WARC
def test_warc(spark):
    big, other = "<p>" + "x" * 200 + "</p>", "<p>" + "é" * 90 + "</p>"
    rows = [(5, "http://a", big), (2, "http://b\r\nX: 1", big), (9, None, big), (3, "u", other), (4, "u", "tiny"), (1, "u", "tiny"), (6, "u", None), (7, "u", ""), (None, "u", big), (2, "again", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = keyed((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(df).collect())
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        first = min(x[0] for x in rows if x[2] == h and x[0] is not None)
        again = len(b) >= 100 and p != first
        want.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == keyed(want)
    assert warc.archive_pages(df.limit(0)).collect() == []


def test_warc_stores_payloads_once(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "y" * 150) for i in range(5)], "page_id long, url string, html string")
    root = warc.write_archive(df, f"file://{tmp_path}/w")
    assert spark.read.parquet(f"{root}/payloads").count() == 1
    records = {r.page_id: bytes(r.record) for r in warc.read_archive(spark, root).collect()}
    assert records[0].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and records[0].endswith(b"\r\n\r\n" + b"y" * 150 + b"\r\n\r\n")
    assert b"WARC-Refers-To: " in records[3] and records[3].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")


def test_warc_record_ids_are_unique(spark, tmp_path):
    rows = [(i % 7 if i % 5 else None, "u", ("z" * 120, "", "q" * 300)[i % 3]) for i in range(60)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = warc.read_archive(spark, warc.write_archive(df, f"file://{tmp_path}/w"))
    heads = [bytes(r.record).split(b"\r\n\r\n")[0].decode() for r in records.collect()]
    ids = [re.search("WARC-Record-ID: (.*)\r", h)[1] for h in heads]
    assert len(set(ids)) == len(rows)
    assert {re.search("WARC-Refers-To: (.*)\r", h)[1] for h in heads if "Refers-To: " in h} <= set(ids)
    files = warc.write_warc(records, f"file://{tmp_path}/out", most=3000).collect()
    assert sum(f.records for f in files) == len(rows) and len(files) > 3
    found = b"".join((tmp_path / "out" / f.file).read_bytes() for f in files)
    assert sum(f.bytes for f in files) == len(found) == sum(len(r.record) for r in records.collect()) and found.count(b"WARC/1.1\r\n") == len(rows)
