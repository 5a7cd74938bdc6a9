"""The near-copy stage against every pair of whole texts."""

import random
from itertools import combinations

import pytest

from graphloom.llm import likeness, simhash


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def components(sets):
    """Of each place, the first place reachable over pairs of likeness 0.8 or more."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(sets))]


def planted(rng, bases, copies, words=250, edits=(1, 11)):
    """Base texts and copies of each in which a few words are replaced by new ones."""
    out = []
    for b in range(bases):
        base = [f"w{rng.randrange(3000)}" for _ in range(words)]
        out.append(" ".join(base))
        for c in range(copies):
            w = list(base)
            for at in rng.sample(range(len(w)), rng.randint(*edits)):
                w[at] = f"new{b}x{c}x{at}"
            out.append(" ".join(w))
    return out


def test_planted_near_copies_go(spark):
    texts = planted(random.Random(2), 60, 2) + ["a b c", "a b c d", "A  b C", "", " \n", None]
    sets = [plain_set(t) for t in texts]
    likes = [like(sets[3 * b], sets[3 * b + c]) for b in range(60) for c in (1, 2)]
    assert sum(0.8 <= x < 0.9 for x in likes) >= 20 and sum(0.9 <= x < 0.97 for x in likes) >= 10 and sum(x < 0.8 for x in likes) >= 10
    kept = simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(components(sets)))


@pytest.mark.parametrize("small, weight", [(2, 900), (2, 1 << 19), (32, 1 << 19)])
def test_crowded_keys_lose_no_link(spark, small, weight):
    texts = planted(random.Random(8), 2, 40, 120, (0, 6))
    sets = [plain_set(t) for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    known = likeness.sets(df)
    links = likeness.similar_links(likeness.meetings(likeness.signatures(df).dropDuplicates(["fp"])), known, small, weight).collect()
    prints = [likeness.set_print(likeness.shingles(t.encode())) for t in texts]
    place = {p: i for i, p in reversed(list(enumerate(prints)))}
    assert all(like(sets[place[a]], sets[place[b]]) >= 0.8 for a, b in links)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    want = components(sets)
    assert all((find(prints[i]) == find(prints[j])) == (want[i] == want[j]) for i, j in combinations(range(len(texts)), 2))


def test_rows_that_repeat_an_id_stand_for_their_own_texts(spark):
    rng = random.Random(5)
    clean, other, (base, copy) = *planted(rng, 2, 0), planted(rng, 1, 1, edits=(2, 2))
    rows = [(5, clean), (5, copy), (3, base), (5, clean), (5, other), (None, copy)]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(3, base), (5, clean), (5, other)])
