import random

import numpy as np
import pytest

from linkloom.llm import near_dups
from linkloom.llm.components import components
from linkloom.llm.near_dups import keep_one_each, near_duplicates
from linkloom.llm.shingles import COORDINATES, fingerprint, shingle_sets, sketch

SPACE = " \t\n\v\f\r"


def words_of(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in SPACE:
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def brute(rows):
    sets = []
    for _, text, *_ in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    out = []
    for i, row in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None] if sets[i] else [row[0]]
        least = min((x for x in ids if x is not None), default=None)
        out.append((row[0], len(sets[i]), least, row[0] == least))
    return sorted(out, key=repr)


def corpus(copies):
    rng = random.Random(copies)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 160))]
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            rows.append((n, " ".join(w), "s"))
            n += 1
    passage = [word() for _ in range(80)]
    for _ in range(40):
        rows.append((n, " ".join(passage + [word() for _ in range(rng.randint(5, 30))]), "p"))
        n += 1
    rng.shuffle(rows)
    return rows + [(n + 1, "One  two\tTHREE", "s"), (n, "one two three", None), (n + 2, "", "s"), (n + 3, None, "s"), (n + 4, " \n", "s"), (None, rows[0][1], "s"), (None, "quite alone", "s"), rows[1]]


@pytest.mark.parametrize(("copies", "block"), [(6, 512), (40, 512), (40, 8)])
def test_against_brute_force(spark, copies, block, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    rows = corpus(copies)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS node", "2 AS label").repartition(3)
    got = sorted([tuple(r)[:4] for r in near_duplicates(df).collect()], key=repr)
    assert got == brute(rows)


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "s"), (3, text + " more", "s"), (9, "something else entirely here now", "s"), (8, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["doc_id"] for r in keep_one_each(df).collect()} == {3, 9, 8}
    assert near_duplicates(df.limit(0)).count() == 0


def test_sketches_agree_as_sets_do():
    rng = np.random.default_rng(4)
    for size in (3, 40, 700):
        shared = rng.integers(0, 1 << 60, size).astype(np.uint64)
        agree = []
        for _ in range(30):
            a, b = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 60, size // 3).astype(np.uint64)])) for _ in range(2))
            agree.append((sketch(a) == sketch(b)).mean())
        assert abs(np.mean(agree) - size / (size + 2 * (size // 3))) < 0.05


def test_every_coordinate_is_filled():
    for size in (1, 2, 5, 1000):
        s = sketch(np.arange(1, size + 1, dtype=np.uint64))
        assert len(s) == COORDINATES and s.max() < (2 * COORDINATES) << 40


def test_shingles_do_not_depend_on_the_batch():
    texts = [b"a B c d e f", b"", b"x", b"a b\tc\nd E  f", b"one two three four", b"a b c d e"]
    together = shingle_sets(texts)
    for t, s in zip(texts, together, strict=True):
        assert (shingle_sets([t])[0] == s).all()
    assert (together[0] == together[3]).all() and [len(s) for s in together] == [2, 0, 1, 2, 1, 1]
    assert fingerprint(together[0]) == fingerprint(together[3]) != fingerprint(together[5])


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)]
    group = {i: i for p in pairs for i in p}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        group[b] = a
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {i for a, b in pairs if a != b for i in (a, b)}
    assert got == {i: root(i) for i in linked}


@pytest.mark.parametrize("columns", [4096, 7])
def test_links_between_against_brute_force(columns, monkeypatch):
    monkeypatch.setattr(near_dups, "COLUMNS", columns)
    rng = random.Random(columns)
    for _ in range(40):
        base = rng.sample(range(1000), 40)
        sets = [set(rng.sample(base, rng.randint(30, 40)) + rng.sample(range(1000), rng.randint(0, 4))) for _ in range(rng.randint(2, 14))]
        label = [rng.choice(b"abcdef") for _ in sets]
        rows = [(bytes([c]), bytes([i]), np.array(sorted(s), np.uint64).tobytes()) for i, (c, s) in enumerate(zip(label, sets, strict=True))]
        similar = lambda i, j: 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])  # noqa: B023, E731
        for split in (None, len(rows) // 2):
            pairs = [(i, j) for i in range(len(rows)) for j in range(i) if split is None or (j < split <= i)]
            got = [(a[0], b[0]) for a, b in near_dups.links_between(rows if split is None else rows[:split], None if split is None else rows[split:], 85)] if split != 0 else []
            assert all(similar(i, j) and label[i] != label[j] for i, j in got)
            groups = lambda links: {frozenset(g) for g in joined(links, label)}  # noqa: B023, E731
            if split != 0:
                assert groups(got) == groups([(i, j) for i, j in pairs if similar(i, j)])
                assert len(got) < len(set(label))


def joined(links, label):
    """Components that links make of labels."""
    group = {c: {c} for c in label}
    for i, j in links:
        if group[label[i]] is not group[label[j]]:
            whole = group[label[i]] | group[label[j]]
            for c in whole:
                group[c] = whole
    return group.values()


def test_a_large_group_of_loose_copies(spark, monkeypatch):
    """Copies of one text, some with so many edits of their own that they are linked with nothing, in buckets of many blocks."""
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    rng = random.Random(12)
    base = [f"{rng.randrange(1 << 30):x}" for _ in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(120)] = f"{rng.randrange(1 << 30):x}"
        rows.append((i, " ".join(w), "s"))
    got = sorted([tuple(r)[:4] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()], key=repr)
    assert got == brute(rows)


def test_a_task_that_forgets_sends_again():
    seen = near_dups.Seen(3)
    assert [seen.new(k) for k in "abcab"] == [True, True, True, True, True] and not seen.new("b")


def test_clashing_columns_are_kept(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(5, text, "s", 1, 2), (3, text, "s", 3, 4)], "doc_id long, text string, source string, _k1 long, keys int")
    assert [tuple(r) for r in keep_one_each(df).collect()] == [(3, text, "s", 3, 4)]
