"""Secret scanning: all rules in one byte pass over a combined deterministic automaton.

A rule is a head and a run of value bytes. The automaton of all rules tells where a run has become long enough to
count; from there the value's end is the end of its run, and the start is found by the head's own automaton, read
backwards. Matches of a rule are the leftmost ones that do not overlap, as its regex head + value+ would find
them; then those whose value is too short are dropped. Python's loop over bytes is the scan; texts without a match, most of
them, take no more than that.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import compile_patterns
from .common import map_texts, table


@dataclass(frozen=True)
class Rule:
    """least: value bytes that a match must have. fires: value bytes at which the automaton reports.

    fires is least where runs too short cannot hide a match (a value byte never belongs to a later match's head within
    the same run), else 1. No match may hold a whole other match of its rule in its head.
    """

    kind: str
    head: str
    value: str
    least: int
    fires: int
    fold: bool = False


#: Kinds of the contract, then those that this method adds; values may be any of the bytes in brackets.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 6, 1, True),
    Rule("access", "AKIA", "[A-Z0-9]", 16, 16),
    Rule("hex", "", "[0-9a-f]", 24, 24),
)
ADDED = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36, 1),
    Rule("pem", "-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY", "-", 5, 5),
)


#: What follows the header of a private key: all to the END line, or where there is none, lines of "Name: value" and of base64.
KEY_BODY = re.compile(rb"-----(?:(?:(?!-----)[\s\S])*-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----|(?:\s*[A-Za-z0-9-]+: [^\r\n]*[\r\n])*(?:(?:\s|\\[nr])*[A-Za-z0-9+/=]{16,})*(?:\s*[A-Za-z0-9+/]+={1,2})?)")


class _Backwards:
    """A head's automaton from its last byte to its first, as lists; final holds the states that no byte leaves."""

    def __init__(self, rule: Rule) -> None:
        one = compile_patterns([(rule.head, rule.fold)], anchored=True, backwards=True)
        self.columns, self.accepting, self.table = one.columns, one.accepting, one.table.tolist()
        self.final = {s for s, to in enumerate(self.table) if s < one.accepting and set(to) == {s}}


class Scanner:
    """spans(text): (kind index, start, end) in code points, by start, then rule."""

    def __init__(self, rules: tuple[Rule, ...] = BASE + ADDED) -> None:
        self.rules = rules
        whole = compile_patterns([(f"{r.head}{r.value}{{{r.fires},}}", r.fold) for r in rules])
        n = whole.table.shape[1]
        self.columns = whole.columns
        self.table = (whole.table * n).ravel().tolist()
        self.accepting = whole.accepting * n
        self.accepts = {i * n: a for i, a in enumerate(whole.accepts)}
        self.heads = [_Backwards(r) if r.head else None for r in rules]
        self.values = [{b for b in range(256) if one.table[0][one.columns[b]] >= one.accepting} for one in (compile_patterns([(r.value, False)], anchored=True) for r in rules)]

    def _start(self, k: int, data: bytes, value_at: int, floor: int) -> int | None:
        """The leftmost start at floor or later of a head that ends at value_at."""
        head = self.heads[k]
        if head is None:
            return value_at if value_at >= floor else None
        found, s, at = None, 0, value_at
        table, columns, accepting, final = head.table, head.columns, head.accepting, head.final
        while at > floor:
            at -= 1
            s = table[s][columns[data[at]]]
            if s >= accepting:
                found = at
            if s in final:
                break
        return found

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        table, accepting = self.table, self.accepting
        low = data.translate(self.columns)
        s = 0
        for c in low:
            s = table[s + c]
            if s >= accepting:
                break
        else:
            return []
        accepts, out, done = self.accepts, [], [0] * len(self.rules)
        s = 0
        for i, c in enumerate(low, 1):
            s = table[s + c]
            if s < accepting:
                continue
            for k in accepts[s]:
                if i <= done[k]:
                    continue
                rule, values = self.rules[k], self.values[k]
                at = i - rule.fires
                start = self._start(k, data, at, done[k])
                if start is None:
                    continue
                end = i
                while end < len(data) and data[end] in values:
                    end += 1
                if rule.kind == "pem" and (body := KEY_BODY.match(data, at)):
                    end = max(end, body.end())
                done[k] = end
                if end - at >= rule.least:
                    out.append((k, start, end))
        return sorted(out, key=lambda x: (x[1], x[0]))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        data = text.encode("utf-8", "surrogatepass")
        found = self.byte_spans(data)
        if not found or len(data) == len(text):
            return found
        at = sorted({x for _, a, b in found for x in (a, b)})
        chars, last, n = {}, 0, 0
        for x in at:
            n += len(data[last:x].decode("utf-8", "surrogatepass"))
            last, chars[x] = x, n
        return [(k, chars[a], chars[b]) for k, a, b in found]


SCANNED = "doc_id long, spans array<struct<kind: string, start: int, end: int>>"
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive; by start, then rule), a row for each row of docs.

    Whole texts are read; a null text is empty and has no spans. Repeated rows stay, other columns are not read. No shuffle.
    """
    scanner = Scanner(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": rules[k].kind, "start": a, "end": e} for k, a, e in scanner.spans(t.as_py() or "")] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, SPANS)], ["doc_id", "spans"])

    return map_texts(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, SCANNED)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each span of text, or of overlapping spans their union, replaced by mark; other columns are kept.

    A null text stays null, texts without spans stay as they are.
    """
    scanner = Scanner(rules)
    at = docs.columns.index(text)

    def hide(t: str | None) -> str | None:
        if not t or not (found := scanner.spans(t)):
            return t
        out, last = [], 0
        for _, a, e in found:
            if a >= last:
                out += [t[last:a], mark]
            last = max(last, e)
        return "".join([*out, t[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([hide(t.as_py()) for t in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return map_texts(docs, run, docs.schema)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets in all documents."""
    found = scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE]
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kinds: F.filter("spans", lambda x: x["kind"].isin(kinds))
    return found.select(
        "doc_id",
        *(F.size(of([k])).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(joined(of(base)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
