"""The near-copy stage's SimHash, its blocks and its families against plain versions."""

import random
from itertools import combinations

import numpy as np
import pytest
from test_likeness import planted

from graphloom.llm import likeness, simhash


def plain_words(hashes):
    """The SimHash of shingle hashes, bit by bit."""
    out, full = [], (1 << 64) - 1
    for first, second in likeness._ODD.T.tolist():
        mixed = [h * first & full for h in hashes]
        mixed = [(h ^ h >> 32) * second & full for h in mixed]
        mixed = [h ^ h >> 29 for h in mixed]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mixed) > len(mixed)))
    return out


def plain_blocks(words):
    whole = sum(w << 64 * i for i, w in enumerate(words[: -likeness.SKETCH]))
    return [whole >> 12 * i & 4095 for i in range(likeness.BLOCKS)]


@pytest.mark.parametrize("n", [1, 4, 5, 254, 255, 256, 700])
def test_a_bit_is_set_in_over_half_of_the_shingles(n):
    hashes = [random.Random(n).getrandbits(64) for _ in range(n)]
    words = likeness.simhash(np.array(hashes, np.uint64))
    assert words.tolist() == plain_words(hashes)
    assert (likeness.block_places(words[None])[0] & 4095).tolist() == plain_blocks(plain_words(hashes))


@pytest.mark.parametrize("sample, most", [(likeness.SAMPLE, likeness.CELL), (1, 5)])
def test_families_are_the_components_of_near_prints(spark, sample, most):
    rng = random.Random(3)
    texts = planted(rng, 20, 2) + planted(rng, 1, 40, 120, (0, 25)) + ["", "a b c", "a b c d e f g", "a b c d e f"]
    reps = likeness.signatures(spark.createDataFrame([(t,) for t in texts], "text string")).dropDuplicates(["fp"]).cache()
    rows = [(r.fp, r.size, np.frombuffer(r.print, np.uint64)) for r in reps.collect()]
    root = {fp: fp for fp, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, m, p), (b, n, q) in combinations(rows, 2):
        meet = any(x == y for x, y in zip(plain_blocks(p.tolist()), plain_blocks(q.tolist())))
        differ = sum(int(x ^ y).bit_count() for x, y in zip(p[-likeness.SKETCH :].tolist(), q[-likeness.SKETCH :].tolist()))
        if min(m, n) > 3 and 5 * min(m, n) >= 4 * max(m, n) and meet and differ <= likeness.MAX_BITS:
            root[find(a)] = find(b)
    families = {}
    for fp in root:
        families.setdefault(find(fp), set()).add(fp)
    got = {}
    for r in likeness.meetings(reps, sample, most).collect():
        got.setdefault((r.key, r.n), set()).add(r.fp)
    assert sorted(map(sorted, got.values())) == sorted(sorted(f) for f in families.values() if len(f) > 1)
    assert all(n == len(f) for (_, n), f in got.items()) and max(n for _, n in got) > 20


def test_short_texts_of_just_the_likeness_lose_no_link(spark):
    rng = random.Random(6)
    longer = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(9)) for _ in range(300)]  # 5 shingles, their copies 4
    rows = [(i, t) for i, t in enumerate(longer)] + [(1000 + i, t.rsplit(" ", 1)[0]) for i, t in enumerate(longer)]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(300))


def test_candidates_come_from_the_prints_alone(spark):
    text = planted(random.Random(1), 1, 1, edits=(1, 1))
    reps = likeness.signatures(spark.createDataFrame([(t,) for t in text], "text string")).collect()
    other = [(r.fp, r.size, random.Random(r.fp).randbytes(len(r.print))) for r in reps]
    assert likeness.meetings(spark.createDataFrame(reps)).count() == 2
    assert likeness.meetings(spark.createDataFrame(other, "fp long, size long, print binary")).count() == 0


def rows_and_links(spark, monkeypatch, copies):
    """The sets of a group of near copies, the rows dealt to cells of 8 sets a chunk, and the links that come out of them and of near_prints."""
    texts = planted(random.Random(9), 1, copies, 250, (1, 2))
    reps = likeness.signatures(spark.createDataFrame([(t,) for t in texts], "text string")).dropDuplicates(["fp"]).cache()
    met, plain = [], likeness.in_arrow

    def counted(df, run, schema):
        out = plain(df, run, schema)
        if schema.startswith("a bigint"):
            met.append((df.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(likeness, "in_arrow", counted)
    links = [tuple(r) for r in likeness.near_prints(reps, 1, 8).collect()]
    monkeypatch.undo()
    left = {r.fp for r in reps.collect()}
    n, front = len(left), {min(left)}
    while front:
        left -= front
        front = {x for pair in links for x in pair if not front.isdisjoint(pair)} & left
    assert not left
    return n, sum(x for x, _ in met), sum(y for _, y in met), len(links)


def test_a_group_of_near_copies_has_rows_and_links_in_proportion(spark, monkeypatch):
    n, rows, links, out = rows_and_links(spark, monkeypatch, 25)
    more, more_rows, more_links, more_out = rows_and_links(spark, monkeypatch, 100)
    assert more_rows / more < 1.5 * rows / n
    assert more_links <= 2 * likeness.FIRST * more and more_out <= 2 * more


def test_large_groups_in_a_block_meet_others(spark):
    # With small chunks groups have chunks of their own in a block; families are those of whole blocks.
    texts = planted(random.Random(4), 2, 40, 200, (1, 3)) + planted(random.Random(5), 5, 2, 120, (0, 12))
    reps = likeness.signatures(spark.createDataFrame([(t,) for t in texts], "text string")).dropDuplicates(["fp"]).cache()
    want = likeness.meetings(reps, 1, 10_000).collect()
    assert sorted(likeness.meetings(reps, 1, 4).collect()) == sorted(want)
