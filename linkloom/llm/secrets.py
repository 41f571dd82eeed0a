"""Operator 6: secret scans with one deterministic automaton for all rules.

The rules' regexes are compiled by subset construction and minimisation into one transition array,
and each text is read once, byte by byte, for all rules together. Only where a rule ends are its
match's start and longest end looked up, with small automata of that rule. Matches of a rule are
leftmost, longest and do not overlap; those that fail the rule's least length are dropped after that.
The rule for private keys ends with the BEGIN line; its span is then carried on over the key.

Defined cases: a null or empty text has no spans; spans are code points, end exclusive; spans that begin at
one place stand in the order of the rules; repeated rows stay repeated; a very long text is scanned whole
in one pass; other columns are ignored (find_secrets) or kept as they are (redact); an empty table gives
no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.automaton import Scanner, compile_rules
from linkloom.llm.common import batches, lean, table, utf8_rows


class Rule(NamedTuple):
    kind: str
    pattern: str
    least: int  # characters of the match, or of the value for an assignment


#: One run of characters behind a fixed head keeps the joint automaton small; passes() looks closer at a
#: match. In the order in which spans with the same start are listed. The first three are the base rules; a
#: bound on repetition in the automaton (hex) only spares it the short runs that are dropped anyway.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{8,}", 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 24),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"[sr]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("url_password", r"://[A-Za-z0-9._~%!$&*+=:-]+@", 0),
)
BASE = 3
KEY_END = re.compile(rb"-----END [A-Z ]*PRIVATE KEY-----")
#: Header lines, lines of base64, and a short last one that is padded or ends the text; line ends may be escaped.
KEY_BODY = re.compile(rb"(?:\s*+[A-Za-z-]++: [^\n]*+\n)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{24,}+={0,2}+)++(?:(?:\s|\\[nr])++[A-Za-z0-9+/]++(?:={1,2}|(?=\s*+\Z)))?")


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return compile_rules([r.pattern for r in RULES])


def value_of(assignment: bytes) -> bytes:
    """What an assignment's match assigns: all behind the first : or =, spaces and an optional quote."""
    at = min(i for i in (assignment.find(b":"), assignment.find(b"=")) if i >= 0) + 1
    rest = assignment[at:].lstrip(b" ")
    return rest[1:] if rest[:1] in (b'"', b"'") else rest


def passes(rule: Rule, match: bytes) -> bool:
    """Whether a match of the rule's regex is reported."""
    if rule.kind == "assign":
        return len(value_of(match)) >= rule.least
    if rule.kind == "url_password":
        user, colon, password = match[3:-1].partition(b":")
        return bool(user and password)
    return len(match) >= rule.least


def key_end(data: bytes, end: int) -> int:
    """Where the private key ends whose BEGIN line ends at end: behind its END line, or without one behind its base64 lines."""
    closing = data.find(b"-----", end)
    if closing >= 0 and (found := KEY_END.match(data, closing)):
        return found.end()
    found = KEY_BODY.match(data, end)
    return found.end() if found else end


def find_spans(scan: Scanner, data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, rule) in bytes of the secrets in a UTF-8 text, by start, then by the rules' order."""
    out = []
    for k, matches in enumerate(scan.find(data)):
        rule = RULES[k]
        for start, end in matches:
            if passes(rule, data[start:end]):
                end = key_end(data, end) if rule.kind == "private_key" else end
                out.append((start, end, k))
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    places = sorted({x for s in spans for x in s[:2]})
    at, n, known = 0, 0, {}
    for p in places:
        n += len(data[at:p].decode("utf-8", "replace"))
        at, known[p] = p, n
    return [(known[a], known[b], k) for a, b, k in spans]


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, start, end) of every text, in order."""
    scan = docs.sparkSession.sparkContext.broadcast(scanner())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("spans", kind)])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rules = scan.value
        for batch in it:
            for doc_id, text in utf8_rows(batch):
                spans = find_spans(rules, text) if text else []
                yield doc_id, [{"kind": RULES[k].kind, "start": a, "end": b} for a, b, k in in_code_points(text, spans)] if spans else []

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(rows(it), schema)

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact_text(scan: Scanner, data: bytes, mark: bytes = b"<secret>") -> bytes:
    """The text with every maximal union of overlapping spans replaced by a mark."""
    spans = find_spans(scan, data)
    if not spans:
        return data
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end = spans[i][:2]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out += [data[at:start], mark]
        at, i = end, i + 1
    return b"".join([*out, data[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with the secrets of column text replaced, and n_chars, where there is one, counted anew."""
    scan = docs.sparkSession.sparkContext.broadcast(scanner())
    names = docs.columns
    place = names.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = scan.value
        for batch in it:
            column = batch.column(place)
            clean = [None if t is None else redact_text(rules, t) for t in column.cast(pa.binary()).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(clean, pa.binary()).cast(column.type)
            yield pa.record_batch(columns, schema=batch.schema)

    out = docs.mapInArrow(lean(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in RULES[:BASE]]
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )


QUERIES = {"op6_secrets": op6_secrets}
SQL: dict[str, str] = {}
