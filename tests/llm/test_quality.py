import random

import pytest

from linkloom.llm.quality import MEASURES, base_counts, keep_good, quality_report, repeat_words

SCHEMA = "doc_id long, text string, source string"
SPACE = " \t\n\v\f\r"


def words_of(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute_counts(text):
    words = words_of(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words_of(x)]
    dups = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(inside)


def brute(rows, min_docs, share, most):
    norm = lambda line: " ".join("".join(c.lower() if c.isascii() else c for c in w) for w in words_of(line))
    holders, hosts = {}, {}
    for _, text, host in rows:
        hosts.setdefault(host, set()).add(text)
        for line in (text or "").split("\n"):
            if norm(line):
                holders.setdefault((host, norm(line)), set()).add(text)
    out = []
    for doc_id, text, host in rows:
        counts = brute_counts(text or "")
        gone = sum(len(words_of(x)) for x in (text or "").split("\n") if norm(x) and len(h := holders[host, norm(x)]) > min_docs and 100 * len(h) > share * len(hosts[host]))
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        out.append((doc_id, *counts, gone, failed, not failed and 100 * gone <= most * counts[0]))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé#<") for _ in range(rng.randint(1, 5)))
    lines = [" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(12)]
    rows = []
    for d in range(160):
        parts = [rng.choice(lines) if rng.random() < 0.6 else " ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 7))]
        parts = [p.upper() if rng.random() < 0.2 else p.replace(" ", "  \t") if rng.random() < 0.2 else p for p in parts]
        rows.append((d, rng.choice(["\n", "\n\n", "\r\n"]).join(parts), rng.choice(["h1", "h1", "h2", None])))
    return rows + rows[:20] + [(500, None, "h1"), (501, None, None), (None, rows[1][1], "h2"), (502, "\x0b\x0c \n", "h1")]


@pytest.mark.parametrize(("min_docs", "share", "most"), [(2, 0, 50), (5, 10, 70), (50, 2, 70)])
def test_against_brute_force(spark, min_docs, share, most):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS line", "2 AS words").repartition(3)
    got = quality_report(df, min_docs, share, most).select("doc_id", *MEASURES, "n_removed_words", "base_failed", "kept")
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(rows, min_docs, share, most)


def test_counts_of_odd_texts():
    for text in ["", " ", "a", "a b c a b c", "x\nx\n\nx ", "x y z x y z x y", "   a", "a\x1cb", "#*$%&|<>é"]:
        assert base_counts(text.encode()) == brute_counts(text), text
    assert repeat_words([b"a"] * 5) == 5


def test_filter_keeps_clean_rows_and_columns(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(1, good, "s", 7), (2, "short", "s", 5), (1, good, "s", 7), (3, None, None, None), (None, good + " x", "t", 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", n_chars long")
    assert sorted(keep_good(df).collect(), key=repr) == sorted([r for r in df.collect() if r["text"] and r["text"] != "short"], key=repr)
    assert keep_good(df.limit(0)).count() == 0 and quality_report(df.limit(0)).count() == 0
