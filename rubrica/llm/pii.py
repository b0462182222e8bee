"""Personal data: fixed patterns, and a skip-chain conditional random field around them.

The patterns find emails, addresses, card and phone numbers; what they find stays. The field labels
the tokens of a document (white space apart) with a kind or none. Its factors are a maximum-entropy
model of a token's shape, a chain between neighbours, and skip edges between distant tokens that are
equal or similar (the same last seven digits, the name of an email elsewhere): a number written
out once with its country code lends its label to its shorter copies. Tokens inside a pattern's match
are observed. Loopy belief propagation passes messages over chain and skips together, so labels
agree across a document; a token is added where its belief in a kind reaches ``SURE``.

Only tokens with a digit, an ``@`` or an email's name are nodes. All other words have one and the same
shape, so a run of k of them between two nodes is summed out exactly: its edge is the (k+1)-step
transfer matrix of the chain. Repeats of a token are linked each to the one before, so edges grow with the
text, not with the square of a repeat.

*Training* is piecewise, from the patterns' own matches: shapes with labels, neighbouring labels and
labels at both ends of skip edges are counted over all documents, and only those counts (a few
hundred rows, at most one per shape and label) reach the driver, where the factors are fitted. Labelling is a
map with the fitted factors; nothing is shuffled.

Null text is empty; repeated rows are labelled alike, ties go to the kind listed first; an empty table
gives no rows; a text of any length is read whole in linear time. Extra columns are ignored whatever
their names, and ``mask_documents`` keeps them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rubrica.llm.common import read

KINDS = ["email", "ip", "card", "phone"]
#: Labels: none, then the kinds.
LABELS = 1 + len(KINDS)
#: Least belief for an added token.
SURE = 0.9
#: Rounds of message passing, and how much of the old message each keeps.
ROUNDS, DAMPING = 10, 0.3
#: Counts added to equal labels of a skip edge before fitting, and to every other pair.
AGREE, SMOOTH = 50.0, 0.5
#: Runs of plain words longer than this pass messages as if they were this long.
LONGEST_RUN = 64
#: Documents labelled together.
TOGETHER = 500

_ADDRESS = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_ACTIVE = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]+")
_EDGE = ".,;:!?\"'()[]{}<>|"
#: Words that announce a kind, by the kind's number.
CUES = dict.fromkeys(["email", "e-mail", "mail", "mailto"], 1) | dict.fromkeys(["ip", "host", "server"], 2)
CUES |= dict.fromkeys(["card", "visa", "mastercard", "amex"], 3) | dict.fromkeys(["phone", "tel", "call", "mobile", "fax"], 4)

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _is_byte(part: str) -> bool:
    """At most 255, however many zeros stand in front."""
    rest = part.lstrip("0")
    return len(rest) < 3 or len(rest) == 3 and rest <= "255"


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns by start, then kind."""
    found: list[Span] = []
    end = 0
    if "@" in text:
        for m in _ADDRESS.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _NAME:
                start -= 1
            if start < m.start():
                end = m.end()
                found.append((start, 0, end))
    found += [(*m.span()[:1], 1, m.end()) for m in _IP.finditer(text) if all(_is_byte(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


@dataclass
class Node:
    """A token that may be personal data: where it stands, its number among the tokens, its shape, the key it
    shares with similar tokens, and the kind observed (0 where no pattern matched)."""

    start: int
    end: int
    place: int
    shape: tuple[int, ...]
    key: str
    observed: int


#: Values per field of a shape.
FIELDS = (2, 8, 2, 2, 2, 2, 4, 2, 2, 2, 2, 5)


def shape_of(token: str, cue: int) -> tuple[int, ...]:
    digits = _digits(token)
    n = len(digits)
    bucket = 0 if n == 0 else 1 if n <= 3 else 2 if n <= 6 else 3 if n == 7 else 4 if n <= 9 else 5 if n <= 12 else 6 if n <= 15 else 7
    name, _, host = token.partition("@")
    parts = token.split(".", 4)
    return (
        int(bool(name) and any(c.isalpha() for c in host)),
        bucket,
        int(any(c.isalpha() for c in token)),
        int(token.startswith("+")),
        int(token.startswith("(")),
        int("-" in token),
        min(token.count("."), 3),
        int(token.isdigit()),
        int(14 <= n <= 19 and luhn(digits)),
        int(len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts)),
        int(any(c in token for c in "=:\"_/")),
        cue,
    )


def nodes_of(text: str, base: Sequence[Span]) -> list[Node]:
    """The nodes of a document in order."""
    names = {text[s:e].partition("@")[0].lower() for s, kind, e in base if kind == 0}
    names = {n for n in names if len(n) >= 6 and not n.isalpha()}
    found: list[Node] = []
    at, cue = 0, 0
    for place, m in enumerate(_TOKEN.finditer(text)):
        raw = m[0]
        active = _ACTIVE.search(raw) is not None
        if active or names:
            token = raw.strip(_EDGE.replace("(", ""))
            low = token.lower()
            if active or low in names:
                while at < len(base) and base[at][2] <= m.start():
                    at += 1
                inside = [kind for s, kind, e in base[at : at + 4] if s < m.end() and e > m.start()]
                digits = _digits(token)
                if "@" in low:
                    key = "@" + low.partition("@")[0]
                elif low in names:
                    key = "@" + low
                else:
                    key = "#" + digits[-7:] if len(digits) >= 7 and not any(c.isalpha() for c in low) else "=" + low
                found.append(Node(m.start(), m.end(), place, shape_of(token, cue), key, 1 + inside[0] if inside else 0))
        cue = CUES.get(raw.strip(_EDGE).lower(), 0) if len(raw) < 16 else 0
    return found


def skip_edges(nodes: Sequence[Node]) -> list[tuple[int, int]]:
    """Each token with the one before it of the same key; neighbours in the text are joined by the chain already."""
    last: dict[str, int] = {}
    edges = []
    for k, node in enumerate(nodes):
        before = last.get(node.key)
        if before is not None and nodes[before].place + 1 < node.place:
            edges.append((before, k))
        last[node.key] = k
    return edges


@dataclass
class Factors:
    """Log factors: per field value and label, and between labels along the chain and along skips."""

    shape: np.ndarray
    plain: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def runs(self) -> np.ndarray:
        """Log transfer matrices over 0, 1, ... plain words."""
        step = np.exp(self.chain)
        over = np.exp(self.plain - self.plain.max())[:, None] * step
        out, now = [], step
        for _ in range(LONGEST_RUN + 1):
            out.append(np.log(now / now.max() + 1e-300))
            now = now @ over
            now = now / now.max()
        return np.array(out)


_STARTS = np.concatenate([[0], np.cumsum(FIELDS)[:-1]])


def _columns(shapes: np.ndarray) -> np.ndarray:
    return shapes + _STARTS


def fit_factors(counts: dict[tuple, float], steps: int = 400, ridge: float = 1e-3) -> Factors:
    """Piecewise fit from counts of ("shape", fields..., label), ("chain", a, b), ("skip", a, b), ("plain",).

    The shape factor is the maximum-entropy model of the label given the shape, by gradient ascent on the
    weighted distinct shapes; an edge factor is the log of how much more often its labels meet than chance.
    """
    shaped = sorted((key, n) for key, n in counts.items() if key[0] == "shape")
    weights = np.zeros((sum(FIELDS), LABELS))
    weights[:, 0] = 0.1
    if shaped:
        columns = _columns(np.array([key[1:-1] for key, _ in shaped]))
        labels = np.array([key[-1] for key, _ in shaped])
        n = np.array([c for _, c in shaped], float)
        n = np.sqrt(n)  # a shape seen a million times must not drown the others
        n /= n.sum()
        target = np.eye(LABELS)[labels]
        speed = np.zeros_like(weights)
        for _ in range(steps):
            logits = weights[columns].sum(1)
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            slope = np.zeros_like(weights)
            np.add.at(slope, columns, ((target - p) * n[:, None])[:, None, :].repeat(len(FIELDS), 1))
            speed = 0.9 * speed + slope - ridge * weights
            weights += 0.5 * speed

    def edge(kind: str, agree: float) -> np.ndarray:
        table = np.full((LABELS, LABELS), SMOOTH) + agree * np.eye(LABELS)
        for key, c in counts.items():
            if key[0] == kind:
                table[key[1], key[2]] += c
                table[key[2], key[1]] += c
        table /= table.sum()
        own = table.sum(1)
        return np.log(table / (own[:, None] * own[None, :]))

    plain = np.log(np.array([1.0] + [1e-4] * (LABELS - 1)))
    chain, skip = edge("chain", 0.0), edge("skip", AGREE)
    return Factors(weights, plain, np.clip(chain, -3, 3), np.clip(skip, -4, 4))


def beliefs(docs: Sequence[Sequence[Node]], factors: Factors, runs: np.ndarray) -> np.ndarray:
    """Beliefs of all nodes of some documents, by loopy sum-product over chain and skip edges at once."""
    nodes = [n for own in docs for n in own]
    if not nodes:
        return np.zeros((0, LABELS))
    unary = factors.shape[_columns(np.array([n.shape for n in nodes]))].sum(1)
    seen = np.array([n.observed for n in nodes])
    unary[seen > 0] = -30.0
    unary[seen > 0, seen[seen > 0]] = 0.0
    source, target, matrix = [], [], []
    first = 0
    for own in docs:
        for k in range(1, len(own)):
            source.append(first + k - 1)
            target.append(first + k)
            matrix.append(runs[min(own[k].place - own[k - 1].place - 1, LONGEST_RUN)])
        for a, b in skip_edges(own):
            source.append(first + a)
            target.append(first + b)
            matrix.append(factors.skip)
        first += len(own)
    total = unary.copy()
    if source:
        ways = len(source)
        psi = np.array(matrix)
        psi = np.concatenate([psi, psi.transpose(0, 2, 1)])
        a, b = np.array(source + target), np.array(target + source)
        back = np.concatenate([np.arange(ways, 2 * ways), np.arange(ways)])
        message = np.zeros((2 * ways, LABELS))
        for _ in range(ROUNDS):
            total = unary.copy()
            np.add.at(total, b, message)
            cavity = total[a] - message[back]
            cavity -= cavity.max(1, keepdims=True)
            new = np.log(np.einsum("ek,ekl->el", np.exp(cavity), np.exp(psi)) + 1e-300)
            new -= new.max(1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
        total = unary.copy()
        np.add.at(total, b, message)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _whole(kind: int, text: str) -> bool:
    """Whether an added run of tokens holds enough of its kind to stand alone."""
    digits = len(_digits(text))
    return (len(text) >= 6, 4 <= digits <= 12 and text.count(".") == 3, 13 <= digits <= 19, 7 <= digits <= 15)[kind]


def added_spans(text: str, nodes: Sequence[Node], belief: np.ndarray, base: Sequence[Span]) -> list[Span]:
    """Runs of neighbouring tokens that the field labels alike beyond the patterns' matches."""
    found: list[Span] = []
    run: list[Node] = []
    kind = 0

    def close() -> None:
        if run:
            start, end = run[0].start, run[-1].end
            while start < end and text[start] in _EDGE and text[start] != "(":
                start += 1
            while end > start and text[end - 1] in _EDGE:
                end -= 1
            clear = all(e <= start or s >= end for s, _, e in base)
            if clear and _whole(kind - 1, text[start:end]):
                found.append((start, kind - 1, end))

    for node, p in zip(nodes, belief):
        label = int(p.argmax())
        wanted = label if label and p[label] >= SURE and not node.observed else 0
        if not (run and wanted == kind and run[-1].place + 1 == node.place):
            close()
            run = []
        kind = wanted
        if wanted:
            run.append(node)
    close()
    return found


def _counts_of(text: str, counts: Counter) -> None:
    if not _ACTIVE.search(text):
        return
    nodes = nodes_of(text, base_spans(text))
    for node in nodes:
        counts[("shape", *node.shape, node.observed)] += 1
    for a, b in zip(nodes, nodes[1:]):
        if a.place + 1 == b.place:
            counts[("chain", a.observed, b.observed)] += 1
        else:
            counts[("chain", a.observed, 0)] += 1
            counts[("chain", 0, b.observed)] += 1
    for a, b in skip_edges(nodes):
        counts[("skip", nodes[a].observed, nodes[b].observed)] += 1


def train(docs: DataFrame, text: str = "text") -> Factors:
    """Factors fitted on all documents; a task adds up its counts before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column("_text"):
                _counts_of(value.as_py() or "", counts)
        keys = [",".join(map(str, key)) for key in counts]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["key", "n"])

    rows = docs.select(F.col(text).cast("string").alias("_text")).mapInArrow(run, "key string, n bigint")
    counts = {}
    for row in rows.groupBy("key").agg(F.sum("n").alias("n")).collect():
        kind, *values = row["key"].split(",")
        counts[(kind, *map(int, values))] = float(row["n"])
    return fit_factors(counts)


class Labeller:
    def __init__(self, factors: Factors):
        self.factors = factors
        self.runs = factors.runs()

    def spans(self, texts: Sequence[str]) -> list[tuple[list[Span], list[Span]]]:
        """Per text the patterns' spans and the added ones."""
        base = [base_spans(t) if _ACTIVE.search(t) else [] for t in texts]
        nodes = [nodes_of(t, b) if _ACTIVE.search(t) else [] for t, b in zip(texts, base)]
        belief = beliefs(nodes, self.factors, self.runs)
        out, at = [], 0
        for t, own, b in zip(texts, nodes, base):
            out.append((b, added_spans(t, own, belief[at : at + len(own)], b)))
            at += len(own)
        return out


def find_personal_data(docs: DataFrame, factors: Factors, keep: Sequence[str] = (), text: str = "text") -> DataFrame:
    """``keep`` and ``spans``: array of (kind, start, end, base) by start, then kind; in characters of the text."""
    source = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(factors)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                texts = [v.as_py() or "" for v in batch.column("_text")]
                rows = []
                for base, added in labeller.spans(texts):
                    spans = sorted([(*s, True) for s in base] + [(*s, False) for s in added])
                    rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": fixed} for a, k, b, fixed in spans])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(rows, kind)], names=[*keep, "spans"])

    return source.mapInArrow(run, ", ".join([*own, "spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"]))


def mask_documents(docs: DataFrame, factors: Factors, text: str = "text") -> DataFrame:
    """The documents with personal data replaced by ``[KIND]``; other columns and clean texts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(factors)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                k = batch.schema.get_field_index(text)
                texts = [v.as_py() for v in batch.column(k)]
                clean = []
                for t, (base, added) in zip(texts, labeller.spans([t or "" for t in texts])):
                    spans = sorted(base + added)
                    parts, end = [], 0
                    for start, kind, stop in spans:
                        if start >= end:
                            parts += [t[end:start], f"[{KINDS[kind].upper()}]"]
                        end = max(end, stop)
                    clean.append("".join(parts) + t[end:] if spans else t)
                field = batch.schema.field(k)
                yield batch.set_column(k, field, pa.array(clean, field.type))

    return docs.mapInArrow(run, docs.schema)


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs, train(docs), ["doc_id"])

    def joined(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", _base_of(kind))).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _base_of(kind: str):
    return lambda s: s["base"] & (s["kind"] == kind)
