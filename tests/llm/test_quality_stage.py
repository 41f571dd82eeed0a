import random

from linkloom.llm.quality import keep_good

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def host_rows(rng, host, n, share, line, first):
    """n clean documents of a host, of which share percent hold the line, in different spellings."""
    rows = []
    for i in range(n):
        clean = " ".join(f"{rng.randrange(1 << 40):x}" for _ in range(60))
        held = [line, line.upper(), line.replace(" ", "\t ")][i % 3]
        rows.append((first + i, f"{clean}\n{held}\r\nlast {first + i}" if 100 * i < share * n else clean, "en", host, 7))
    return rows


def texts(df):
    return {r["doc_id"]: (r["text"], r["n_chars"]) for r in df.collect()}


def test_boilerplate_lines_go_from_kept_documents(spark):
    rng = random.Random(2)
    rows = host_rows(rng, "big", 200, 30, "subscribe to our letter", 0) + host_rows(rng, None, 10, 0, "", 1000)
    rows += [rows[0], (2000, " ".join(f"w{i}" for i in range(60)) + "\nsubscribe to our letter", "en", "other", 7), (2001, "short\nsubscribe to our letter", "en", "big", 7)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = keep_good(df)
    assert out.columns == df.columns and out.count() == len(rows) - 1
    got = texts(out)
    for doc_id, text, _, host, n in rows[:-1]:
        if host == "big" and "\n" in text:
            first, _, last = text.split("\n")
            text, n = f"{first}\n{last}", len(first) + 1 + len(last)
        assert got[doc_id] == (text, n)


def test_equal_shares_are_treated_alike_on_small_and_large_hosts(spark):
    rng = random.Random(3)
    line = "all rights are reserved"
    rows = host_rows(rng, "small", 30, 10, line, 0) + host_rows(rng, "large", 600, 10, line, 1000) + host_rows(rng, "rare", 300, 1, line, 5000) + host_rows(rng, "tiny", 2, 100, line, 9000)
    left = {r["source"] for r in keep_good(spark.createDataFrame(rows, SCHEMA)).collect() if line.split()[0] in r["text"].lower()}
    assert left == {"rare", "tiny"}


def test_clashing_columns_and_an_empty_table(spark):
    rng = random.Random(4)
    rows = [(*r, 1, 2) for r in host_rows(rng, "big", 60, 30, "subscribe to our letter", 0)]
    df = spark.createDataFrame(rows, SCHEMA + ", _k1 long, removed_lines int")
    out = keep_good(df)
    assert out.columns == df.columns and {(r["_k1"], r["removed_lines"]) for r in out.collect()} == {(1, 2)} and out.count() == 60
    assert keep_good(df.limit(0)).count() == 0
