"""Personal data: patterns with checks, and a linear-chain conditional random field
over word shapes that adds what the patterns miss.

The field tags white-space tokens with begin and inside states per kind. A token
is seen by its shape only (letters as x or X, digits as d, the rest as it is), with
the shapes next to it. It is trained from a small labelled table, by the gradient of
the conditional likelihood (forward-backward); documents are decoded by Viterbi in
numpy batches. A span it finds is added if it passes the same check as its kind's
pattern (digits, ranges, check sum) and touches no span of a pattern.

Texts are searched whole, in time proportional to their length.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Callable, Iterable
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii_examples
from .common import column, sampled, with_arrow

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the base, written so that no text makes them slow: a run of
#: digits is entered only at its start and never given back.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
STATES = 1 + 2 * len(KINDS)  # outside, then begin and inside per kind
NEVER = -1e4
#: Tokens scored at a time; code points from which a text is decoded by itself; bytes
#: of shapes that are kept.
TOGETHER, LONG, CACHED_BYTES = 150_000, 1_000_000, 64 << 20
#: What a found span may begin and end with.
NUMBER = re.compile("[0-9]")
COUNTRY = re.compile(r"\+[0-9]{1,3}[ .-]+")
EDGES = {"email": (re.compile(r"\w"), re.compile(r"\w")), "ip": (NUMBER, NUMBER),
         "card": (NUMBER, NUMBER), "phone": (re.compile("[0-9+(]"), NUMBER)}
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    twice = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def passes(kind: str, value: str) -> bool:
    """The check of a kind on the text of a span."""
    digits = "".join(re.findall("[0-9]", value))
    if kind == "ip":
        parts = re.findall("[0-9]+", value)
        parts = [p.lstrip("0") or "0" for p in parts]  # int() refuses thousands of zeros
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", value) is not None


def emails(text: str) -> Iterable[Span]:
    """From each @: the run of local characters before it, the domain behind."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and LOCAL.match(text[start - 1]):
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end(), "email"
            after = found.end()
        at = text.find("@", max(at + 1, after))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind that pass their check."""
    out = list(emails(text))
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        out += [(*m.span(), kind) for m in pattern.finditer(text) if passes(kind, m[0])]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


class _Shape(dict):
    def __missing__(self, point: int) -> str | int:
        c = chr(point)
        self[point] = "X" if c.isupper() else "x" if c.isalpha() else point
        return self[point]


SHAPE = _Shape({i: "d" for i in range(ord("0"), ord("9") + 1)})
LETTERS, DIGITS, NUMBERS = re.compile(r"x+|X+"), re.compile(r"d{5,}"), re.compile(r"d+")


def brief(shape: str) -> str:
    """A short form as it is, a long one as a digest of the whole."""
    return shape if len(shape) <= 20 else hashlib.blake2b(
        shape.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def features(shape: str) -> list[str]:
    """What a token's shape says; nothing for an empty one."""
    if not shape:
        return []
    short = LETTERS.sub(lambda m: m[0][0], shape)
    form = NUMBERS.sub("d", short).strip(".,;:!?()<>\"'")
    n = shape.count("d")
    return ["any", "is " + brief(DIGITS.sub("D", short)), "form " + brief(form), "head " + short[0], "tail " + short[-1],
            f"digits {n if n < 5 else 5 if n < 10 else 10 if n < 14 else 14 if n < 20 else 20}",
            *("has " + c for c in "@.-()+:/" if c in shape)]


def tags_of(where: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """States of tokens: the first token that a span touches begins it. A token
    that two spans touch belongs to the first."""
    tags, i = [0] * len(where), 0
    for start, end, kind in spans:
        k = 1 + 2 * KINDS.index(kind)
        while i < len(where) and where[i][1] <= start:
            i += 1
        j = i
        while j < len(where) and where[j][0] < end and not tags[j]:
            tags[j] = k if j == i else k + 1
            j += 1
    return tags


def allowed() -> np.ndarray:
    """0 where a state may follow, else NEVER; row 0 is also the start."""
    may = np.full((STATES, STATES), NEVER, np.float32)
    may[:, 0] = 0
    may[:, 1::2] = 0
    for k in range(1, STATES, 2):
        may[k, k + 1] = may[k + 1, k + 1] = 0
    return may


class Field:
    """Weights: per feature for the token, the one before and the one after, and
    per pair of states."""

    def __init__(self, names: dict[str, int], w: np.ndarray, pairs: np.ndarray):
        self.names, self.w, self.pairs = names, w, pairs
        self.known: dict[str, int] = {}
        self.held = 0
        self.rows = np.zeros((1024, 3, STATES), np.float32)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, names=np.array(list(self.names)), w=self.w, pairs=self.pairs)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Field:
        held = np.load(io.BytesIO(raw))
        return cls({str(n): i for i, n in enumerate(held["names"])}, held["w"], held["pairs"])

    def _row(self, shape: str) -> int:
        """Scores of a shape as (before, own, after) x states, kept under a number."""
        n = len(self.known)
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        at = [self.names[f] for f in features(shape) if f in self.names]
        self.rows[n] = self.w[:, at].sum(axis=1)
        self.known[shape] = n
        self.held += 4 * len(shape) + 300
        return n

    def emissions(self, shapes: list[str]) -> np.ndarray:
        if self.held > CACHED_BYTES:
            self.known.clear()
            self.held = 0
        known = self.known
        at = np.array([known[s] if s in known else self._row(s) for s in shapes])
        out = self.rows[at, 1]
        out[1:] += self.rows[at[:-1], 0]
        out[:-1] += self.rows[at[1:], 2]
        return out

    def decode(self, documents: list[list[str]]) -> list[np.ndarray]:
        """Best states for each document's shapes; documents of like length are
        decoded together."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(documents)
        order = sorted((i for i, d in enumerate(documents) if d), key=lambda i: len(documents[i]))
        while order:
            longest, group = len(documents[order[-1]]), []
            while order and (not group or (len(group) + 1) * longest <= TOGETHER):
                group.append(order.pop())
            sizes = [len(documents[i]) for i in group]
            # An empty shape between documents: none sees a neighbour's token.
            flat = self.emissions([s for i in group for s in (*documents[i], "")])
            e = np.zeros((longest, len(group), STATES), np.float32)
            at = 0
            for j, n in enumerate(sizes):
                e[:n, j] = flat[at:at + n]
                at += n + 1
            for j, tags in enumerate(self._viterbi([e], sizes)):
                out[group[j]] = tags
        return out

    def decode_long(self, shapes: Callable[[], Iterable[str]], piece: int = TOGETHER) -> np.ndarray:
        """Best states of one document of any length, whose shapes come in order. Scores
        are made by pieces; what stays are nine bytes a token."""
        size = sum(1 for _ in shapes())

        def slabs():
            rest, before = iter(shapes()), []
            here = list(islice(rest, piece))
            while here:
                after = list(islice(rest, piece))
                e = self.emissions([*before, *here, *after[:1]])
                yield e[len(before):len(before) + len(here), None]
                before, here = here[-1:], after

        return next(iter(self._viterbi(slabs(), [size]))) if size else np.zeros(0, np.int8)

    def _viterbi(self, slabs: Iterable[np.ndarray], sizes: list[int]) -> Iterable[np.ndarray]:
        """Best paths; the slabs are the tokens' scores, tokens x documents x states."""
        moves = self.pairs + allowed()
        back = np.zeros((max(sizes), len(sizes), STATES), np.int8)
        ends = np.zeros((len(sizes), STATES), np.float32)
        last = np.array(sizes) - 1
        stops = set(last.tolist())
        score = None
        for t, e in enumerate(chain.from_iterable(slabs)):
            if score is None:
                score = e + moves[0]
            else:
                ways = score[:, :, None] + moves
                back[t] = ways.argmax(axis=1)
                score = ways.max(axis=1) + e
                if len(back) > TOGETHER:  # sums of millions lose the differences
                    score -= score.max(axis=1, keepdims=True)
            if t in stops:
                ends[last == t] = score[last == t]
        state = ends.argmax(axis=1).astype(np.int8)
        path = np.zeros(back.shape[:2], np.int8)
        who = np.arange(len(sizes))
        for t in range(len(back) - 1, -1, -1):
            here = last >= t
            path[t, here] = state[here]
            state[here] = back[t, who[here], state[here]]
        return (path[:n, j] for j, n in enumerate(sizes))


def train(samples: list[tuple[list[str], list[int]]], rounds: int = 50, decay: float = 0.02,
          rate: float = 0.4) -> Field | None:
    """A field from tagged token sequences: Adagrad on the conditional
    log-likelihood with a quadratic penalty. None without any tag."""
    samples = [s for s in samples if s[0]]
    if not any(map(any, (tags for _, tags in samples))):
        return None
    names: dict[str, int] = {}
    longest, n = max(len(s) for s, _ in samples), len(samples)
    # Tokens with the same features are one type; type 0 is no token at all.
    types: dict[tuple[int, ...], int] = {(): 0}
    own = np.zeros((longest + 2, n), int)
    gold = np.zeros((longest, n), int)
    mask = np.zeros((longest, n), bool)
    for j, (shapes, tags) in enumerate(samples):
        for i, x in enumerate(shapes):
            f = tuple(sorted(names.setdefault(f, len(names)) for f in features(x)))
            own[i + 1, j] = types.setdefault(f, len(types))
        gold[:len(tags), j], mask[:len(tags), j] = tags, True
    views = (own[:-2], own[1:-1], own[2:])
    has = np.zeros((len(types), len(names)))
    for f, i in types.items():
        has[i, list(f)] = 1
    w, pairs = np.zeros((3, len(names), STATES)), np.zeros((STATES, STATES))
    past_w, past_p, may = np.full(w.shape, 1e-8), np.full(pairs.shape, 1e-8), allowed()
    real = np.eye(STATES)[gold] * mask[..., None]
    previous = np.concatenate([np.zeros((1, n), int), gold[:-1]])
    real_pairs = np.zeros_like(pairs)
    np.add.at(real_pairs, (previous[mask], gold[mask]), 1)

    def logsum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

    for _ in range(rounds):
        e = sum((has @ w[k])[v] for k, v in enumerate(views))
        moves = pairs + may
        fore, aft = np.zeros(e.shape), np.zeros(e.shape)
        fore[0] = moves[0] + e[0]
        for t in range(1, longest):
            step = logsum(fore[t - 1][:, :, None] + moves, 1) + e[t]
            fore[t] = np.where(mask[t][:, None], step, fore[t - 1])
        for t in range(longest - 2, -1, -1):
            step = logsum(moves + (e[t + 1] + aft[t + 1])[:, None, :], 2)
            aft[t] = np.where(mask[t + 1][:, None], step, 0)
        whole = logsum(fore[-1], 1)
        expected = np.exp(np.clip(fore + aft - whole[:, None], -50, 0)) * mask[..., None]
        grad_pairs = real_pairs.copy()
        grad_pairs[0] -= expected[0].sum(axis=0)
        for t in range(1, longest):
            both = fore[t - 1][:, :, None] + moves + (e[t] + aft[t])[:, None, :] - whole[:, None, None]
            grad_pairs -= (np.exp(np.clip(both, -50, 0)) * mask[t][:, None, None]).sum(axis=0)
        grad = np.zeros_like(w)
        off = real - expected
        for k, v in enumerate(views):
            each = [np.bincount(v.ravel(), off[..., s].ravel(), len(types)) for s in range(STATES)]
            grad[k] = has.T @ np.array(each).T
        grad -= decay * w
        grad_pairs -= decay * pairs
        past_w += grad ** 2
        past_p += grad_pairs ** 2
        w += rate * grad / np.sqrt(past_w)
        pairs += rate * grad_pairs / np.sqrt(past_p)
    return Field(names, w.astype(np.float32), pairs.astype(np.float32))


def windows(text: str, spans: list[Span], around: int = 8) -> Iterable[tuple[list[str], list[int]]]:
    """Tagged stretches of a labelled text near digits and marks, 40 tokens at
    most each."""
    where = [m.span() for m in re.finditer(r"\S+", text)]
    shapes, tags = text.translate(SHAPE).split(), tags_of(where, spans)
    near = [i for i, s in enumerate(shapes) if "d" in s or "@" in s]
    at = -1
    for i in near:
        if i > at:
            start = max(0, at + 1, i - around)
            while start and start > at + 1 and tags[start] % 2 == 0 and tags[start]:
                start -= 1
            at = min(len(shapes) - 1, start + 39)
            part = tags[start:at + 1]
            while part and part[0] and part[0] % 2 == 0:  # the rest of a longer span
                start, part = start + 1, part[1:]
            yield shapes[start:at + 1], part


def national(text: str, spans: list[Span]) -> tuple[str, list[Span]]:
    """A labelled text with the country code of its telephone numbers left out, as
    people write them at home."""
    out, moved, at, shift = [], [], 0, 0
    for start, end, kind in spans:
        code = COUNTRY.match(text, start, end) if kind == "phone" and start >= at else None
        if code:
            out.append(text[at:start])
            at, shift = code.end(), shift + code.end() - start
            moved.append((start - shift + code.end() - start, end - shift, kind))
        else:
            moved.append((start - shift, end - shift, kind))
    return "".join([*out, text[at:]]), moved


def fit(labelled: DataFrame, text: str = "text", spans: str = "spans",
        max_rows: int = 500) -> Field | None:
    """Train from a small table of texts and their spans (as ``find`` writes
    them). About ``max_rows`` rows are used, chosen by a hash of the text, in one
    task; rows with telephone numbers count a second time with these written
    without country code. None if no row has a span."""
    rows = labelled.where(F.col(text).isNotNull()).select(text, spans)
    total = rows.count()
    rows = rows.where(sampled(F.col(text), min(1.0, max_rows / max(1, total)))).repartition(1)

    def run(batches: Iterable[pa.RecordBatch]):
        samples = []
        for batch in batches:
            for t, s in zip(column(batch, text).to_pylist(), column(batch, spans).to_pylist()):
                found = [x.split(":") for x in (s or "").split(",") if x]
                spans_ = [(int(a), int(b), k) for k, a, b in found]
                samples += windows(t, spans_)
                if any(k == "phone" for _, _, k in spans_):
                    samples += windows(*national(t, spans_))
        made = train(sorted(samples))
        if made:
            yield pa.RecordBatch.from_pydict({"field": [made.to_bytes()]})

    made = rows.mapInArrow(run, "field binary").collect()  # one small row
    return Field.from_bytes(made[0]["field"]) if made else None


def runs(text: str, tags: np.ndarray) -> Iterable[tuple[int, int, int]]:
    """Each tagged stretch: its first state, start and end."""
    held: tuple[int, int, int] | None = None
    for k, m in zip(tags, re.finditer(r"\S+", text)):
        if held and k == held[0] + 1:
            held = held[0], held[1], m.end()
            continue
        if held:
            yield held
        held = (int(k), m.start(), m.end()) if k else None
    if held:
        yield held


def added(text: str, tags: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of a tag sequence that pass their check and touch no base span (these by
    start): one walk along both."""
    out = []
    seen = reach = 0
    for k, a, b in runs(text, tags):
        kind = KINDS[(k - 1) // 2]
        first, last = EDGES[kind]
        while a < b and not first.match(text[a]):
            a += 1
        while a < b and not last.match(text[b - 1]):
            b -= 1
        while seen < len(base) and base[seen][0] < b:
            reach = max(reach, base[seen][1])
            seen += 1
        if a < b and a >= reach and passes(kind, text[a:b]):
            out.append((a, b, kind))
    return out


def find(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` (the patterns' spans) and ``spans`` (those and the
    field's), each as kind:start:end in code points, end exclusive, by start and
    kind, joined by commas. Null and empty texts have none. Columns of these names
    are replaced."""
    search = searching(docs, field)

    def maker():
        spans_of = search()

        def compute(batch: pa.RecordBatch) -> list:
            found = spans_of(column(batch, text).to_pylist())
            return [[written(b) for b, _ in found], [written(s) for _, s in found]]
        return compute

    return with_arrow(docs, "base string, spans string", maker)


def searching(docs: DataFrame, field: Field | None) -> Callable[[], Callable[[list], list]]:
    """Makes, in a task, the function from texts to their base and all spans."""
    raw = docs.sparkSession.sparkContext.broadcast(field.to_bytes() if field else None)

    def maker():
        model = Field.from_bytes(raw.value) if raw.value else None

        def spans_of(texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
            out = []
            for at in range(0, len(texts), 400):
                part = [t or "" for t in texts[at:at + 400]]
                base = [base_spans(t) for t in part]
                every = base
                if model:
                    tags = model.decode([[] if len(t) > LONG else t.translate(SHAPE).split() for t in part])
                    for i, t in enumerate(part):
                        if len(t) > LONG:
                            shape = t.translate(SHAPE)
                            tags[i] = model.decode_long(lambda: (m[0] for m in re.finditer(r"\S+", shape)))
                    every = [ordered(b + added(t, g, b)) if g.any() else b
                             for t, g, b in zip(part, tags, base)]
                out += zip(base, every)
            return out
        return spans_of

    return maker


def labelled_by_patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """A labelled table from texts with digits or marks: the patterns' spans."""
    return find(docs.select(text).where(F.col(text).rlike("[0-9@]")), None, text).select(
        text, F.col("base").alias("spans"))


def labelled_by_hand(spark: SparkSession, copies: int = 3) -> DataFrame:
    """The committed table of examples, each several times over."""
    return spark.createDataFrame(pii_examples.labelled() * copies, "text string, spans string")


def learn(docs: DataFrame, text: str = "text", max_rows: int = 500) -> Field | None:
    """A field from the table labelled by hand, and from a stable sample of about
    ``max_rows`` texts that hold digits or marks, labelled by the patterns: these say
    what numbers of the corpus are no personal data."""
    marked = docs.select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]"))
    share = min(1.0, max_rows / max(1, marked.count()))
    known = labelled_by_patterns(marked.where(sampled("text", share)))
    return fit(known.union(labelled_by_hand(docs.sparkSession)), max_rows=4 * max_rows)


def counts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key, how many spans of each kind the patterns give, the digest
    of these spans, and all spans."""
    found = find(docs.select(key, text), learn(docs, text), text)
    kinds = [F.regexp_count("base", F.lit(f"{k}:")).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select(key, *kinds, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def redact(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; texts
    without spans stay as they are, null stays null."""
    search = searching(docs, field)

    def maker():
        spans_of = search()

        def one(t: str | None, spans: list[Span]) -> str | None:
            if not spans:
                return t
            out, at = [], 0
            for start, end, kind in spans:
                if start >= at:
                    out += [t[at:start], f"<{kind.upper()}>"]
                at = max(at, end)
            return "".join([*out, t[at:]])

        def compute(batch: pa.RecordBatch) -> list:
            texts = column(batch, text).to_pylist()
            return [[one(t, s) for t, (_, s) in zip(texts, spans_of(texts))]]
        return compute

    return with_arrow(docs, f"`{text}` string", maker).select(*docs.columns)
