"""Secret scan: exact base patterns, and a linear-chain conditional random field that adds spans.

The field tags tokens as begin, inside or outside of a secret. A token's features
are its shape, the shapes of its two neighbours, whether a key word came shortly
before, and how much of the whole text isn't plain words (the file feature).
It is fitted by maximum conditional likelihood, around prior weights, to windows of
a bounded sample of documents (FIT_ROWS by hash): around what the base patterns
mark, around runs of digits and other odd tokens, which count as outside, and one
plain window of each text. So that it tags what the base patterns can't, windows
are varied: a marked token takes each of the SECRET shapes, and the plain window's
middle takes them too, as a secret without a cue; it also takes the shapes LIKE
them, as no secret unless a key word is near and the shape is one of CUED. Decoding is Viterbi;
tokens that no path of positive gain can enter are passed over, which is exact, so
a long text costs a few vector operations. Base spans always stay; a tagged span
is added where it overlaps none.

Defined results: null and empty texts have no spans; offsets are code points, end
exclusive; rows that repeat a document repeat its result; with no base match in the
sample the prior weights decide; other columns are not read.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import attach, table
from .shared import borrowed, mapped, slices, two

# The base patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")

FIT_ROWS, AROUND = 1_000, 6
TOKENS = re.compile(r"[\w+/.=-]+|[^\s\w+/.=-]+")
SHAPES = (
    "word", "capital", "upper", "key", "assign", "quote", "symbol", "digits", "digits6", "digits13", "hex8", "hex16",
    "mixed", "mixed8", "mixed16", "access", "dotted", "prefixed", "account", "uuid", "edge",
)
SHAPE = {s: i for i, s in enumerate(SHAPES)}
SECRET = [SHAPE[x] for x in ("hex16", "mixed16", "access", "prefixed")]
LIKE = [SHAPE[x] for x in ("digits6", "digits13", "hex8", "mixed", "mixed8", "dotted", "account", "uuid")]
CUED = [SHAPE[x] for x in ("mixed8", "uuid", "hex8")]
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
PREFIXED = re.compile(r"[A-Za-z]{2,6}[_-](?=[^_]*[0-9])[A-Za-z0-9_-]{16,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}")
KEY = re.compile(r"pass(word|wd|phrase)|secret|token|api_?-?key|credential|bearer|private_?key|access_?key", re.I)
O, B, I = 0, 1, 2  # noqa: E741
N_FILE, PULL = 3, 0.002  # kinds of files; pull towards the prior weights


def shape(token: str) -> int:
    if token.isalpha():
        if KEY.fullmatch(token):
            return SHAPE["key"]
        return SHAPE["word"] if token.islower() else SHAPE["upper"] if token.isupper() and len(token) > 1 else SHAPE["capital"]
    if not any(c.isalnum() for c in token):
        return SHAPE["assign"] if token[0] in ":=" else SHAPE["quote"] if token[0] in "\"'`" else SHAPE["symbol"]
    core = token.strip("=.-_+/")
    if KEY.fullmatch(core) or (KEY.search(token) and len(token) < 24):
        return SHAPE["key"]
    if core.isdigit():
        n = len(core)
        return SHAPE["digits" if n < 6 else "digits6" if n < 13 else "digits13"]
    if core.startswith("AKIA") and core.isalnum() and core.isupper() and len(core) >= 12:
        return SHAPE["access"]
    if re.fullmatch(r"[0-9a-f]+", core):
        return SHAPE["hex16" if len(core) >= 16 else "hex8" if len(core) >= 8 else "mixed"]
    if UUID.fullmatch(core):
        return SHAPE["uuid"]
    if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", core):
        return SHAPE["account"]
    if PREFIXED.fullmatch(core) and restless(core):
        return SHAPE["prefixed"]
    if core.isalpha():
        return SHAPE["word"] if core.islower() else SHAPE["capital"]
    if re.fullmatch(r"[\d.]+|[^\W\d_]+([./-][^\W\d_]+)+|[\w-]+(\.[\w-]+)*\.[a-z]{2,}", core) or "/" in core and "." in core:
        return SHAPE["dotted"]
    if core.isascii() and restless(core):
        return SHAPE["mixed16" if len(core) >= 16 else "mixed8" if len(core) >= 8 else "mixed"]
    return SHAPE["mixed"]


def restless(core: str) -> bool:
    """Whether letters, cases and digits change as often as in random text, and digits occur."""
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 for c in core if c.isalnum()]
    return 0 in kinds and sum(a != b for a, b in zip(kinds, kinds[1:])) >= 0.25 * len(kinds)


class Shapes(dict):
    def __missing__(self, token: str) -> int:
        found = shape(token)
        if len(token) < 48:
            if len(self) > 100_000:
                self.clear()
            self[token] = found
        return found


_shapes = Shapes()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches that pass, in order."""
    made = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        made += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    made += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(made)


def secret_parts(text: str) -> list[tuple[int, int]]:
    """The values that the base patterns mark, without their key words; for training."""
    made = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    made += [(m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    made += [(m.start(), m.end()) for m in HEX.finditer(text) if not m[0].isdigit()]
    return sorted(made)


def observed(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Shapes, key word in the three tokens before, file feature."""
    found = np.fromiter(map(_shapes.__getitem__, tokens), np.int64, len(tokens))
    key = found == SHAPE["key"]
    near = np.zeros(len(found), bool)
    for d in (1, 2, 3):
        near[d:] |= key[:-d] if d < len(found) else False
    odd = float((found > SHAPE["upper"]).mean()) if len(found) else 0.0
    return found, near.astype(np.int64), 0 if odd < 0.1 else 1 if odd < 0.4 else 2


@dataclass
class Field:
    """Weights by state; own, before and after by shape."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    near: np.ndarray
    file: np.ndarray
    moves: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.own, self.before, self.after, self.near, self.file, self.moves]

    def emission(self, found: np.ndarray, near: np.ndarray, file: np.ndarray | int, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        return self.own[found] + self.before[before] + self.after[after] + self.near[near] + self.file[file]


def prior() -> Field:
    n = len(SHAPES)
    own, before, after = np.zeros((n, 3)), np.zeros((n, 3)), np.zeros((n, 3))
    own[:, O] = 5.0
    for name, gain in (("hex16", 7.0), ("mixed16", 6.5), ("access", 8.0), ("prefixed", 6.5), ("mixed8", 3.0), ("hex8", 2.5)):
        own[SHAPE[name], B] = gain
    own[SHAPE["mixed16"], I] = own[SHAPE["hex16"], I] = 3.0
    before[SHAPE["assign"], B] = before[SHAPE["quote"], B] = 1.0
    near = np.array([[0.0, 0.0, 0.0], [0.0, 2.0, 0.0]])
    moves = np.array([[0.0, 0.0, -np.inf], [0.0, -2.0, -0.5], [0.0, -2.0, -0.5]])
    return Field(own, before, after, near, np.zeros((N_FILE, 3)), moves)


def neighbours(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.full(1, SHAPE["edge"])
    return np.concatenate([edge, found[:-1]]), np.concatenate([found[1:], edge])


def windows(text: str) -> Iterator[dict]:
    """Training windows of one text: around marked secrets and digit runs, and one plain window."""
    spots = [(m.start(), m.end(), m[0]) for m in TOKENS.finditer(text)]
    if not spots:
        return
    found, near, file = observed([s[2] for s in spots])
    before, after = neighbours(found)
    state = np.zeros(len(spots), np.int64)
    at = np.array([s[0] for s in spots])
    end = np.array([s[1] for s in spots])
    centres = []
    for a, z in secret_parts(text):
        inside = np.flatnonzero((at < z) & (end > a))
        if len(inside):
            state[inside[1:]] = np.where(state[inside[1:]] == O, I, state[inside[1:]])
            state[inside[0]] = B if state[inside[0]] == O else state[inside[0]]
            centres.append(int(inside[0]))
    state[1:][(state[1:] == I) & (state[:-1] == O)] = B
    odd = np.flatnonzero((found >= SHAPE["digits"]) & (found < SHAPE["edge"]) & (state == O))
    for c in [*centres, *odd.tolist(), len(spots) // 2]:
        low, high = max(0, c - AROUND), c + AROUND + 1
        own = (found[low:high], near[low:high], state[low:high])
        ends = (before[low : low + 1], after[:high][-1:])
        yield window(*own, *ends, file)
        marked = own[2] != O
        if marked.any():
            for kind in SECRET:
                yield window(np.where(marked, kind, own[0]), own[1], own[2], *ends, file)
        elif c == len(spots) // 2:
            middle = np.arange(len(own[0])) == c - low
            for kind in SECRET:
                yield window(np.where(middle, kind, own[0]), own[1], np.where(middle, B, O), *ends, file)
            for kind in LIKE:
                yield window(np.where(middle, kind, own[0]), own[1], own[2], *ends, file)
            if c - low >= 1:
                cue = np.arange(len(own[0])) == c - low - 1
                known = np.where(cue, SHAPE["key"], own[0])
                close = own[1] | (np.arange(len(own[0])) >= c - low) & (np.arange(len(own[0])) < c - low + 3)
                for kind in (*SECRET, *CUED):
                    yield window(np.where(middle, kind, known), close, np.where(middle, B, O), *ends, file)


def window(found: np.ndarray, near: np.ndarray, state: np.ndarray, first: np.ndarray, last: np.ndarray, file: int) -> dict:
    """One training window, its neighbours' shapes taken from itself but for those beyond its ends."""
    parts = {"found": found, "near": near, "before": np.concatenate([first, found[:-1]]), "after": np.concatenate([found[1:], last]), "state": state}
    return {k: v.tolist() for k, v in parts.items()} | {"file": file}


PARTS = ("found", "near", "before", "after", "state")


def sampled(docs: DataFrame, key: str, text: str) -> list:
    """The distinct training windows of the FIT_ROWS documents of smallest hash, each with its number."""
    few = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    rows = two(docs, key, text).join(F.broadcast(few), "doc_id").select("text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with borrowed(_shapes):
            for b in slices(batches):
                made = [w for t in b.column(0).to_pylist() for w in windows(t)]
                yield pa.RecordBatch.from_arrays([*(pa.array([w[k] for w in made], pa.list_(pa.int32())) for k in PARTS), pa.array([w["file"] for w in made], pa.int32())], [*PARTS, "file"])

    made = rows.mapInArrow(kernel, ", ".join(f"{k} array<int>" for k in PARTS) + ", file int")
    return made.groupBy(*PARTS, "file").agg(F.count(F.lit(1)).alias("times")).orderBy(*PARTS, "file").collect()


def likelihood(field: Field, index: dict[str, np.ndarray], size: np.ndarray, times: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean log likelihood of the windows and its gradient for each array of weights, by a scaled forward and backward pass."""
    n, most = index["found"].shape
    scores = field.emission(*(index[k] for k in ("found", "near", "file", "before", "after")))
    top = scores.max(axis=2, keepdims=True)
    emit, moves = np.exp(scores - top), np.exp(field.moves)
    valid = np.arange(most) < size[:, None]
    forward, scale = np.zeros_like(emit), np.ones((n, most))
    forward[:, 0] = emit[:, 0] * np.array([1.0, 1.0, 0.0])
    for i in range(most):
        if i:
            forward[:, i] = (forward[:, i - 1] @ moves) * emit[:, i]
        scale[:, i] = np.where(valid[:, i], forward[:, i].sum(axis=1), 1.0)
        forward[:, i] = np.where(valid[:, i, None], forward[:, i] / scale[:, i, None], 0.0)
    backward = np.ones_like(emit)
    pairs = np.zeros((3, 3))
    weight = times / times.sum()
    for i in range(most - 2, -1, -1):
        ahead = emit[:, i + 1] * backward[:, i + 1] / scale[:, i + 1, None]
        on = valid[:, i + 1]
        pairs += ((forward[on, i] * weight[on, None]).T @ ahead[on]) * moves
        backward[:, i] = np.where(on[:, None], ahead @ moves.T, 1.0)
    state, every = index["state"], weight[:, None, None] * valid[:, :, None]
    gap = (np.eye(3)[state] - forward * backward) * every
    grads = []
    for name, weights in zip(("found", "before", "after", "near", "file"), field.arrays()):
        slot = (index[name][:, :, None] * 3 + np.arange(3)).ravel()
        grads.append(np.bincount(slot, gap.ravel(), weights.size).reshape(weights.shape))
    both = valid[:, 1:]
    seen = np.bincount((state[:, :-1] * 3 + state[:, 1:])[both], np.broadcast_to(weight[:, None], both.shape)[both], 9).reshape(3, 3)
    grads.append(np.where(np.isfinite(field.moves), seen - pairs, 0))
    own = np.take_along_axis(scores, state[:, :, None], axis=2)[:, :, 0]
    with np.errstate(invalid="ignore"):
        path = (own * valid).sum(axis=1) + np.where(both, field.moves[state[:, :-1], state[:, 1:]], 0).sum(axis=1)
    total = ((np.log(scale) + top[:, :, 0]) * valid).sum(axis=1)
    return float(weight @ (path - total)), grads


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", steps: int = 40) -> Field:
    """The field of maximum conditional likelihood around the prior weights, by gradient steps with moments until the gradient is small."""
    got = sampled(docs, key, text)
    field = prior()
    if not any(any(r["state"]) for r in got):
        return field
    n, most = len(got), 2 * AROUND + 1
    size = np.array([len(r["found"]) for r in got])
    index = {k: np.zeros((n, most), np.int64) for k in PARTS}
    for i, r in enumerate(got):
        for k in PARTS:
            index[k][i, : size[i]] = r[k]
    index["file"] = np.repeat(np.array([r["file"] for r in got])[:, None], most, axis=1)
    # both kinds of windows weigh alike
    marked, times = index["state"].any(axis=1), np.array([r["times"] for r in got], float)
    for kind in (marked, ~marked):
        times[kind] /= max(times[kind].sum(), 1.0)
    start = [x.copy() for x in field.arrays()]
    moment, square = [np.zeros_like(x) for x in start], [np.zeros_like(x) for x in start]
    for t in range(1, steps + 1):
        largest = 0.0
        for x, x0, g, m, v in zip(field.arrays(), start, likelihood(field, index, size, times)[1], moment, square):
            free = np.isfinite(x)
            g = g - PULL * np.where(free, x - np.where(free, x0, 0), 0)
            largest = max(largest, float(np.abs(g).max()))
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x += np.where(free, 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6), 0)
        if largest < 5e-4:
            break
    return field


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best states of a stretch whose surroundings are outside."""
    best = scores[0] + moves[O]
    back = []
    for line in scores[1:]:
        step = best[:, None] + moves
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + line
    state = int((best + moves[:, O]).argmax())
    made = [state]
    for pointer in reversed(back):
        made.append(state := int(pointer[state]))
    return made[::-1]


def tagged(text: str, field: Field) -> list[tuple[int, int]]:
    """Spans that the field tags in a whole text."""
    tokens = TOKENS.findall(text)
    if not tokens:
        return []
    found, near, file = observed(tokens)
    before, after = neighbours(found)
    scores = field.emission(found, near, file, before, after)
    most = np.max(np.where(np.isfinite(field.moves), field.moves, -np.inf)) - field.moves[O, O]
    # the most that a token inside a span can gain, its move and the one after the span counted
    gain = np.maximum(scores[:, B], scores[:, I]) - scores[:, O] + 2 * max(most, 0)
    if (gain <= 0).all():
        return []
    upto = np.cumsum(gain)
    left = upto - np.minimum(np.minimum.accumulate(np.concatenate([[0], upto[:-1]])), upto)
    down = np.cumsum(gain[::-1])
    right = (down - np.minimum(np.minimum.accumulate(np.concatenate([[0], down[:-1]])), down))[::-1]
    open_ = left + right - gain > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], open_.astype(np.int8), [0]])))
    spans, spots = [], None
    for a, z in zip(edges[::2], edges[1::2]):
        states = viterbi(scores[a:z], field.moves)
        if not any(states):
            continue
        spots = spots or [m.span() for m in TOKENS.finditer(text)]
        at = None
        for i, s in enumerate([*states, O]):
            if at is not None and s != I:
                spans.append((spots[a + at][0], spots[a + i - 1][1]))
                at = None
            if s == B:
                at = i
    return spans


def all_spans(text: str, field: Field) -> list[tuple[int, int, int]]:
    """(start, kind, end): base spans, and tagged ones that overlap none of them."""
    base = base_spans(text)
    extra = [(a, 3, z) for a, z in tagged(text, field) if not any(a < e and z > s for s, _, e in base)]
    return sorted([*base, *extra])


SPANS = "array<struct<start:int,kind:string,end:int>>"


def scan(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) of each row's whole text."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with borrowed(_shapes):
            for b in slices(batches):
                made = [[{"start": a, "kind": KINDS[k], "end": z} for a, k, z in all_spans(t, field)] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, kind)], ["doc_id", "spans"])

    return two(docs, key, text).mapInArrow(kernel, f"doc_id long, spans {SPANS}")


def masked(text: str | None, field: Field) -> str | None:
    """The text with each secret replaced; the key word and sign of an assignment stay."""
    if not text:
        return text
    holes: list[tuple[int, int]] = []
    for a, k, z in all_spans(text, field):
        if k == 0 and (m := ASSIGN.match(text, a)):
            a = m.start(2)
        if holes and a < holes[-1][1]:
            holes[-1] = (holes[-1][0], max(z, holes[-1][1]))
        else:
            holes.append((a, z))
    made, at = [], 0
    for a, z in holes:
        made += [text[at:a], "[SECRET]"]
        at = z
    return "".join([*made, text[at:]])


def redact(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs with masked texts; everything else passes through."""
    at = docs.columns.index(text)

    def kernel(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
        with borrowed(_shapes):
            for b in slices(batches):
                made = pa.array([masked(t, field) for t in b.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([made if i == at else c for i, c in enumerate(b.columns)], names)

    return mapped(docs, kernel)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of every document, the base ones also digested alone."""
    attach(spark)
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count("crf"))


QUERIES = {"op10_secrets": op10_secrets}
ORACLE_SQL: dict[str, str] = {}
