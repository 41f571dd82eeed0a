import random
import re

from linkloom.llm import secrets
from linkloom.llm.automaton import compile_rules
from linkloom.llm.secrets import RULES, find_secrets, find_spans, redact, redact_text, scanner

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS, HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]+")
BITS = [b"password", b"PassWd", b"token", b"secret", b"api_key", b"apikey", b"API_", b":", b"=", b'"', b"'", b" ", b"  ", b"AKIA", b"AKI", b"A", b"ABCDEF012", b"0123456789abcdef", b"deadbeef", b"f", b"hunter2", b"x_y.z", b"\n", "é".encode(), b"==", b"-"]
MORE = [b"eyJ", b".", b"ghp_", b"0" * 36, b"xoxb-", b"AIza", b"x" * 35, b"sk_live_", b"http", b"://", b"@", b"-----BEGIN ", b"RSA ", b"PRIVATE KEY-----", b"_", b"a" * 9]


def base(data):
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(data) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(data) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(data) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_rules_against_backtracking():
    rng = random.Random(1)
    for _ in range(4000):
        data = b"".join(rng.choice(BITS) for _ in range(rng.randint(1, 25)))
        assert [s for s in find_spans(scanner(), data) if s[2] < 3] == base(data), data


def test_all_regexes_are_leftmost_longest():
    rng = random.Random(2)
    compiled = [re.compile(r.pattern.encode()) for r in RULES]
    for _ in range(3000):
        data = b"".join(rng.choice(BITS + MORE) for _ in range(rng.randint(1, 25)))
        found = scanner().find(data)
        for k in range(3, len(RULES)):
            assert found[k] == [m.span() for m in compiled[k].finditer(data)], (RULES[k], data)


def test_compiler_on_random_regexes():
    rng = random.Random(3)
    patterns = ["a+b?", "(ab|b)+c", "[ab]{2,3}c", "a(?:b|c)*", "(?i:ab)c+", "[^a]b{2}", "x|yz", r"\x61\x62"]
    for p in patterns:
        scan, plain = compile_rules([p]), re.compile(p.encode())
        for _ in range(300):
            data = bytes(rng.choice(b"abcABxyz") for _ in range(rng.randint(0, 12)))
            assert scan.find(data)[0] == [m.span() for m in plain.finditer(data)], (p, data)


def test_table_cases(spark):
    token = 'pässword password="hunter22" é AKIA' + "A" * 16
    df = spark.createDataFrame([(1, token), (2, None), (3, ""), (1, token), (None, "x" * 200_000 + " secret=abcdef")], "doc_id long, text string").selectExpr("*", "1 AS spans")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in find_secrets(df).collect()}
    assert got[1] == [("assign", 9, 27), ("access", 31, 51)] and token[9:27] == 'password="hunter22'
    assert got[2] == got[3] == [] and got[None] == [("assign", 200_001, 200_014)]
    assert find_secrets(df.limit(0)).count() == 0


def test_redaction(spark):
    assert redact_text(scanner(), b'a token = "0123456789abcdef01234567" b') == b'a <secret>" b'
    df = spark.createDataFrame([(1, "é secret=abcdef!", "s", 16), (2, None, None, None), (3, "clean", "s", 5)], "doc_id long, text string, source string, n_chars long")
    assert {tuple(r) for r in redact(df).collect()} == {(1, "é <secret>!", "s", 11), (2, None, None, None), (3, "clean", "s", 5)}


def test_query(spark, tmp_path):
    import hashlib

    text = "x secret: abcdef and deadbeefdeadbeefdeadbeef"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in secrets.op6_secrets(spark, str(tmp_path)).collect()}
    assert (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"]) == (1, 0, 1)
    spans = "assign:2:16,hex:21:45"
    assert got[1]["spans"] == spans and got[1]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
