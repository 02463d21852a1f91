"""Secret scans with one combined deterministic automaton.

Method. All rule regexes are compiled into one search automaton (subset construction, then minimisation) whose transition
array is walked once over the bytes of a batch of texts. Texts in which a rule accepts are walked again with the anchored
automaton, which gives the leftmost longest spans per rule; rules with a least length then drop shorter spans.

Defined results: a null text is empty and has no spans. Offsets are code points, the end exclusive. Texts are scanned whole,
whatever their length. Rows are handled one by one, so repeated rows give repeated results; an empty table an empty one.
Columns pass through; one named like the output column is replaced.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanax.llm import automaton as A

VALUE = A.span("AZ", "az", "09", "+", "/", "_", ".", "=", "-")
NAME = A.span("AZ", "az", "09", "_", "-")


class Rule(NamedTuple):
    """shape finds; search is what a text must hold for shape to be tried; least bounds the span, or its body if there is one."""

    kind: str
    shape: A.Node
    search: A.Node
    least: int
    body: bool = False


def _rules() -> list[Rule]:
    quote, blanks = A.opt(A.cls("\"'")), A.star(A.cls(" "))
    names = A.alt(*[A.lit(x, True) for x in ("password", "passwd", "secret", "token")], A.seq(A.lit("api", True), A.opt(A.lit("_")), A.lit("key", True)))
    assign = A.seq(names, quote, blanks, A.cls(":="), blanks, quote, A.plus(A.cls(VALUE)))
    access = A.seq(A.lit("AKIA"), A.plus(A.cls(A.span("AZ", "09"))))
    hexes = A.cls(A.span("09", "af"))
    github = A.seq(A.lit("gh"), A.cls("pousr"), A.lit("_"), A.plus(A.cls(A.span("AZ", "az", "09"))))
    slack = A.seq(A.lit("xox"), A.cls("baprs"), A.lit("-"), A.plus(A.cls(A.span("AZ", "az", "09", "-"))))
    jwt = A.seq(A.lit("eyJ"), A.plus(A.cls(NAME)), A.lit("."), A.plus(A.cls(NAME)), A.lit("."), A.plus(A.cls(NAME)))
    pem = A.seq(A.lit("-----BEGIN "), A.star(A.cls(A.span("AZ", " "))), A.lit("PRIVATE KEY-----"))
    return [
        Rule("assign", assign, assign, 6, True),
        Rule("access", access, access, 20),
        Rule("hex", A.plus(hexes), A.repeat(hexes, 24), 24),
        Rule("github", github, github, 40),
        Rule("slack", slack, slack, 15),
        Rule("jwt", jwt, jwt, 30),
        Rule("pem", pem, pem, 0),
    ]


BASE = ("assign", "access", "hex")
KINDS = tuple(r.kind for r in _rules())


@cache
def _compiled() -> tuple[list[Rule], A.Automaton, A.Matcher]:
    rules = _rules()
    return rules, A.compile_rules([r.search for r in rules], search=True), A.Matcher(A.compile_rules([r.shape for r in rules], search=False))


def scan_batch(texts: pa.Array) -> list[list[tuple[str, int, int, int]]]:
    """Per text its spans (kind, start, end, body) in bytes, by start and then by kind as listed."""
    rules, search, matcher = _compiled()
    binary = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)
    masks = A.scan_all(search, data, offsets[:-1], np.diff(offsets))
    out: list[list[tuple[str, int, int, int]]] = [[] for _ in range(len(binary))]
    for i in np.flatnonzero(masks).tolist():
        text = data[offsets[i] : offsets[i + 1]].tobytes()
        found = []
        for k, rule in enumerate(rules):
            if masks[i] >> k & 1:
                found += [(start, k, end, body) for start, end, body in matcher.spans(text, k) if end - (body if rule.body else start) >= rule.least]
        out[i] = [(rules[k].kind, start, end, body if rules[k].body else start) for start, k, end, body in sorted(found)]
    return out


def _in_characters(text: bytes, places: list[int]) -> list[int]:
    before = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return [int(before[p - 1]) if p else 0 for p in places]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.arrow_udf(SPANS)
def secret_spans(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    rows = []
    for text, spans in zip(texts, scan_batch(texts), strict=True):
        if spans:
            at = _in_characters(text.as_buffer().to_pybytes(), [p for s in spans for p in s[1:3]])
            rows.append([{"kind": s[0], "start": at[2 * i], "end": at[2 * i + 1]} for i, s in enumerate(spans)])
        else:
            rows.append([])
    return pa.array(rows, kind)


@F.arrow_udf(T.StringType())
def without_secrets(texts: pa.Array) -> pa.Array:
    """The texts with each secret replaced; of overlapping ones the whole."""
    rows = []
    for text, spans in zip(texts, scan_batch(texts), strict=True):
        if not spans:
            rows.append(text.as_py())
            continue
        raw, out, done = text.as_buffer().to_pybytes(), [], 0
        for kind, _, end, body in sorted(spans, key=lambda s: s[3]):
            if body >= done:
                out += [raw[done:body], f"[{kind} removed]".encode()]
            done = max(done, end)
        rows.append(b"".join([*out, raw[done:]]).decode())
    return pa.array(rows, pa.string())


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with secret_spans, an array of (kind, start, end) by start and kind."""
    return docs.withColumn("secret_spans", secret_spans(F.col(text)))


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with secrets taken out of the text, and n_chars, if there is such a column, counted anew."""
    out = docs.withColumn(text, without_secrets(F.col(text)))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(F.col(text)).cast(docs.schema[n_chars].dataType))
    return out


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
