"""Secret scan: a trigram index decides which rules' patterns a text is tried against.

From each rule's pattern follows a Boolean query over trigrams that every match must contain: AND
along a sequence, OR between alternatives. Texts are taken in blocks; a block's index maps each
trigram that some rule asks for to the sorted numbers of the block's texts that hold it. A rule's
query is answered by intersecting and uniting those postings, and only its candidates are searched
with the pattern itself. A pattern that forces no trigram (a run of hex digits) is searched in every
text. Trigrams are of bytes with A-Z lowered, so either case meets the same postings.

A block is one Arrow batch cut at ``BLOCK_BYTES``; a longer text is a block of its own. Nothing is
shuffled, and nothing is kept between blocks.

Null text is empty; repeated rows are scanned alike; an empty table gives no rows; every rule reads a text of any length in linear time; equal starts are
listed in the order of the rules. Extra columns are ignored whatever their names, and
``mask_documents`` keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from re import _constants as op, _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rubrica.llm.common import blocks, read

BLOCK_BYTES = 1 << 20


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches, leftmost and not overlapping; one is kept where ``group`` has
    ``least`` characters or more, and where not, is passed over whole. ``span`` is the group reported."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False
    span: int = 0


#: A line break, as it is, spelled as in JSON, or both, with what quoting and comments put around it.
_BREAK = r"""(?:[\x20\t"'`,;+)]*+(?:(?:(?:\\r)?\\n[\x20\t"'`,;+)]*+)?(?:\r\n?|\n)|(?:\\r)?\\n)[\x20\t>#*|"'`,;:+/()-]*+)"""
#: Behind a line of base64: the end of the line, of the text, or of a string.
_ENDS = r"""(?=[\x20\t]*+(?:\r|\n|\\r|\\n|\Z)|["'`<])"""
#: A private key from BEGIN to END. Where END is missing or another block comes first: to the last of the lines that
#: follow and are base64 or armour headers; behind an empty line, or on the line of BEGIN, words are told from base64 by length.
_PRIVATE_KEY = (
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:"
    r"[^-]*+(?:-(?!----BEGIN |----END )[^-]*+)*+-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:[\x20\t]*+[A-Za-z0-9+/]{20,}+={0,2})*+"
    rf"(?:{_BREAK}++(?:(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash|MessageID):[^\r\n\\]*+|[A-Za-z0-9+/=]{{20,}}+{_ENDS})"
    rf"|{_BREAK}[A-Za-z0-9+/=]++{_ENDS})*+)"
)

#: Three runs joined by dots, found from the start of the first. Whether all three are there is asked once a run: asked
#: at every ``eyJ`` in it, a run made of them would be read to its end each time.
_WEB_TOKEN = (
    r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]{13,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10})"
    r"[A-Za-z0-9_-]*?(eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)"
)

RULES = [
    Rule(
        "assign",
        r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
        1,
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 18, 0, True),
    Rule("hex", r"[0-9a-f]{16,}", 16, 0, True),
    Rule("private_key", _PRIVATE_KEY),
    Rule("repo_token", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", _WEB_TOKEN, span=1),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("url_password", r"://[A-Za-z0-9._-]*:[^\x00-\x20/@:]{6,}@[A-Za-z0-9]"),
]

#: A query is None (any text), ("and" | "or", parts), or a trigram in bytes.
Query = None | bytes | tuple


def _both(kind: str, parts: Iterable[Query]) -> Query:
    parts = list(parts)
    if kind == "or" and any(p is None for p in parts):
        return None
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    if len(parts) < 2:
        return parts[0] if parts else None
    return (kind, tuple(parts))


def _spelled(text: str) -> Query:
    data = text.encode().lower()
    return _both("and", [data[k : k + 3] for k in range(len(data) - 2)])


def _strings(tokens, most: int = 16) -> list[str] | None:
    """All strings a part of a pattern can match, or None where they are many."""
    found = [""]
    for kind, value in tokens:
        if kind is op.LITERAL:
            more = [chr(value)]
        elif kind is op.SUBPATTERN:
            more = _strings(value[3], most)
        elif kind is op.BRANCH:
            each = [_strings(branch, most) for branch in value[1]]
            more = None if None in each else [s for strings in each for s in strings]
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
            more = [chr(c) for _, c in value]
        elif kind is op.MAX_REPEAT and value[1] is not op.MAXREPEAT and value[1] <= 2:
            one = _strings(value[2], most)
            more = None if one is None else [s * k for k in range(value[0], value[1] + 1) for s in one]
        else:
            more = None
        if more is None or len(found) * len(more) > most:
            return None
        found = [a + b for a in found for b in dict.fromkeys(more)]
    return found


def _required(tokens) -> Query:
    tokens = list(tokens)
    parts, start = [], 0
    while start < len(tokens):
        # the longest run from here whose strings can be listed
        end, strings = start, None
        while end < len(tokens) and (longer := _strings(tokens[start : end + 1])) is not None:
            end, strings = end + 1, longer
        if strings is not None:
            parts.append(_both("or", [_spelled(s) for s in strings]))
            start = end
            continue
        kind, value = tokens[start]
        if kind is op.SUBPATTERN:
            parts.append(_required(value[3]))
        elif kind is op.BRANCH:
            parts.append(_both("or", [_required(branch) for branch in value[1]]))
        elif kind is op.MAX_REPEAT and value[0] >= 1:
            parts.append(_required(value[2]))
        start += 1
    return _both("and", parts)


def trigram_query(pattern: str) -> Query:
    """Boolean trigram query that holds for every text with a match; None where nothing is forced."""
    return _required(parser.parse(pattern))


def trigrams(query: Query) -> set[bytes]:
    if query is None:
        return set()
    if isinstance(query, bytes):
        return {query}
    return set().union(*[trigrams(part) for part in query[1]])


def _code(gram: bytes) -> int:
    return gram[0] << 16 | gram[1] << 8 | gram[2]


class BlockIndex:
    """Postings of the wanted trigrams over one block of texts."""

    def __init__(self, texts: Sequence[bytes], wanted: np.ndarray):
        self.size = len(texts)
        block = np.frombuffer(b"\n".join(texts).lower(), dtype=np.uint8).astype(np.uint32)
        starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]]) if texts else np.zeros(0, int)
        codes = (block[:-2] << 16) | (block[1:-1] << 8) | block[2:] if len(block) > 2 else block[:0]
        at = np.flatnonzero(wanted[codes])
        owner = np.searchsorted(starts, at, side="right") - 1
        pairs = np.unique(codes[at].astype(np.int64) * (self.size + 1) + owner)
        grams, owners = np.divmod(pairs, self.size + 1)
        cuts = np.flatnonzero(np.diff(grams)) + 1
        self.postings = {int(g[0]): o for g, o in zip(np.split(grams, cuts), np.split(owners, cuts)) if len(g)}

    def answer(self, query: Query) -> np.ndarray:
        """Sorted numbers of the texts for which the query holds."""
        if query is None:
            return np.arange(self.size)
        if isinstance(query, bytes):
            return self.postings.get(_code(query), np.zeros(0, np.int64))
        found = None
        for part in query[1]:
            own = self.answer(part)
            if found is None:
                found = own
            elif query[0] == "and":
                found = np.intersect1d(found, own, assume_unique=True)
            else:
                found = np.union1d(found, own)
            if query[0] == "and" and not len(found):
                break
        return found


class Scanner:
    """Rules with their queries; made once per task."""

    def __init__(self, rules: Sequence[Rule] = RULES):
        self.rules = list(rules)
        self.patterns = [re.compile(r.pattern) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.wanted = np.zeros(1 << 24, dtype=bool)
        for query in self.queries:
            for gram in trigrams(query):
                self.wanted[_code(gram)] = True

    def scan(self, texts: Sequence[str]) -> list[list[tuple[int, int, int]]]:
        """Per text its matches (start, number of the rule, end), sorted."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        index = BlockIndex(raw, self.wanted)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, (rule, pattern, query) in enumerate(zip(self.rules, self.patterns, self.queries)):
            for k in index.answer(query):
                for match in pattern.finditer(texts[k]):
                    if match.end(rule.group) - match.start(rule.group) >= rule.least:
                        found[k].append((match.start(rule.span), number, match.end(rule.span)))
        return [sorted(spans) for spans in found]


def find_secrets(docs: DataFrame, keep: Sequence[str] = (), rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """``keep`` and ``spans``: array of (kind, start, end) by start, then rule; in characters of the text."""
    rules = list(rules)
    source = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "_text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            spans = [s for block in blocks(texts, BLOCK_BYTES) for s in scanner.scan(block)]
            rows = [[{"kind": rules[r].kind, "start": a, "end": b} for a, r, b in own] for own in spans]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], names=[*keep, "spans"])

    out = ", ".join([schema, "spans array<struct<kind:string,start:bigint,end:bigint>>"] if keep else ["spans array<struct<kind:string,start:bigint,end:bigint>>"])
    return source.mapInArrow(run, out)


def joined(spans, kinds: Sequence[str] | None = None) -> F.Column:
    """``kind:start:end`` of the spans, comma-joined; of ``kinds`` alone where given."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(list(kinds)))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The documents with every secret replaced by ``[KIND]``; other columns and clean texts stay.

    A span that begins inside an earlier one goes with it.
    """
    rules = list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = batch.column(at).to_pylist()
            found = [s for block in blocks([t or "" for t in texts], BLOCK_BYTES) for s in scanner.scan(block)]
            clean = [_masked(t, spans, rules) if spans else t for t, spans in zip(texts, found)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def _masked(text: str, spans: Sequence[tuple[int, int, int]], rules: Sequence[Rule]) -> str:
    parts, end = [], 0
    for start, number, stop in spans:
        if start >= end:
            parts += [text[end:start], f"[{rules[number].kind.upper()}]"]
        end = max(end, stop)
    return "".join(parts) + text[end:]


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    base = [r.kind for r in RULES if r.base]

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in base],
        F.sha2(joined(F.col("spans"), base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
