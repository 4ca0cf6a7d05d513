"""Secret scans through a trigram index.

Every rule's regular expression is parsed and turned into a Boolean query over the
(case-folded) trigrams that any match must contain. For each slice of documents an
inverted index maps the wanted trigrams to the documents holding them; queries intersect
and unite those postings, and only candidate documents are verified with the expression.
Rules without a mandatory trigram scan every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as kinds
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import slices


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose `group` is shorter than `least` are dropped."""

    kind: str
    pattern: str
    fold: bool = False
    group: int = 0
    least: int = 0


# The base rules, in the order of kinds.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 18),
    Rule("hex", r"[0-9a-f]+", False, 0, 16),
)
# Published formats of further credentials.
EXTRA_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE_RULES + EXTRA_RULES
SPANS = "array<struct<kind:string,start:int,end:int>>"
#: Literal alternatives followed through one expression before they are cut into trigrams.
MOST_LITERALS = 64


def trigram_query(pattern: str) -> list:
    """Conjunction of disjunctions of conjunctions: [[{trigram}]]; [] if nothing is mandatory."""
    clauses: list[list[frozenset[str]]] = []
    gaps = 0  # parts met so far after which literals begin anew

    def flush(literals: set[str]) -> None:
        options = {frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in literals}
        if options and all(options):
            clauses.append(sorted(options, key=sorted))

    def follow(items, literals: set[str]) -> set[str]:
        """The literal strings, of those before `items` and of its own, that end where it ends."""
        nonlocal gaps
        for op, arg in items:
            step: set[str] | None = None
            if op is kinds.LITERAL:
                step = {chr(arg).lower()}
            elif op is kinds.SUBPATTERN:
                step = exact(arg[3])
            elif op is kinds.BRANCH:
                options = [exact(x) for x in arg[1]]
                step = None if any(x is None for x in options) else set().union(*options)
            elif op is kinds.IN and all(x[0] is kinds.LITERAL for x in arg):
                step = {chr(x[1]).lower() for x in arg}
            elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
                low, high, inner = arg
                own = exact(inner)
                if own is not None and high <= 1:
                    step = own | ({""} if low == 0 else set())
                elif own is not None and low and len(own) == 1 and low == high:
                    step = {next(iter(own)) * low}
            elif op is kinds.AT:
                step = {""}
            if step is not None and len(literals) * len(step) <= MOST_LITERALS:
                literals = {x + y for x in literals for y in step}
                continue
            flush(literals)
            gaps += 1
            literals = {""} if step is None else step
        return literals

    def exact(items) -> set[str] | None:
        """The strings of a part made of literals only."""
        nonlocal clauses
        outer, clauses, before = clauses, [], gaps
        found = follow(items, {""})
        clauses = outer
        return None if gaps > before else found

    flush(follow(parser.parse(pattern), {""}))
    return clauses


class Scanner:
    """Compiled rules with their trigram queries."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.fold else 0)), trigram_query(r.pattern)) for r in rules]
        self.terms = sorted({t for _, _, q in self.rules for c in q for option in c for t in option})
        codes = np.array([int.from_bytes(t.encode("ascii"), "big") for t in self.terms], np.int64)
        self.term_of = np.zeros(1 << 24, np.uint8 if len(codes) < 255 else np.uint16)
        self.term_of[codes] = np.arange(1, len(codes) + 1)

    def postings(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Inverted index of the wanted trigrams: sorted document numbers of each."""
        raw = [x.encode("utf-8", "surrogatepass").lower() for x in texts]
        ends = np.cumsum([len(x) + 2 for x in raw])
        flat = np.frombuffer(b"\0\0".join(raw) + b"\0\0", np.uint8)
        codes = flat[:-2].astype(np.int32)
        for shift in (1, 2):
            codes <<= 8
            codes |= flat[shift : len(flat) - 2 + shift]
        terms = self.term_of[codes]
        at = np.flatnonzero(terms)
        pairs = np.unique(terms[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, "right"))
        which, docs = np.divmod(pairs, len(texts))
        bounds = np.searchsorted(which, np.arange(1, len(self.terms) + 2))
        return {t: docs[bounds[i] : bounds[i + 1]] for i, t in enumerate(self.terms)}

    def candidates(self, query: list, index: dict[str, np.ndarray], count: int) -> np.ndarray:
        """Documents that satisfy every clause."""
        keep = np.ones(count, bool)
        for options in query:
            clause = np.zeros(count, bool)
            for option in options:
                both = np.zeros(count, np.int32)
                for term in option:
                    both[index[term]] += 1
                clause |= both == len(option)
            keep &= clause
        return np.flatnonzero(keep)

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Spans (start, rule number, end) of every text, in that order."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for lo, hi in slices(texts):
            part = texts[lo:hi]
            index = self.postings(part)
            for number, (rule, regex, query) in enumerate(self.rules):
                for doc in self.candidates(query, index, len(part)):
                    text, spans = part[doc], found[lo + doc]
                    spans += [(m.start(), number, m.end()) for m in regex.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        for spans in found:
            spans.sort()
        return found


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """The worker's own compiled rules."""
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans) for every row: spans of secrets by start, then rule order, in code points, end exclusive.

    Null and empty texts have no spans; null or repeated ids pass through unchanged; other
    columns are not read; an empty table gives an empty result. Nothing is shuffled.
    Matching is ASCII: only ASCII letters fold.
    """
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = rows.schema[id_col].dataType
    schema = f"`{id_col}` {kind.simpleString()}, spans {SPANS}"
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(rules)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            spans = own.scan(texts)
            out = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, span_type)], names=[id_col, "spans"])

    return rows.mapInArrow(run, schema)


def redact_secrets(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, mask: str = "[{kind}]") -> DataFrame:
    """The same rows and columns, each union of overlapping spans replaced by its first kind.

    Null texts stay null, texts without secrets stay as they are.
    """
    names, place = df.columns, df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(rules)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            found = own.scan([x or "" for x in texts])
            for i, spans in enumerate(found):
                if spans:
                    parts, end = [], 0
                    for s, k, e in spans:
                        if s >= end:
                            parts += [texts[i][end:s], mask.format(kind=rules[k].kind)]
                        end = max(end, e)
                    texts[i] = "".join(parts) + texts[i][end:]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, df.schema)


def of_kind(spans: Column, *wanted: str) -> Column:
    return F.filter(spans, lambda x: x.kind.isin(*wanted))


def span_list(spans: Column, kinds_kept: tuple[str, ...] | None = None) -> Column:
    """Spans as kind:start:end, joined by commas."""
    kept = spans if kinds_kept is None else of_kind(spans, *kinds_kept)
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every span of every document, with counts and a digest of the base rules."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = tuple(r.kind for r in BASE_RULES)
    counts = [F.size(of_kind(F.col("spans"), k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(span_list(F.col("spans"), base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
