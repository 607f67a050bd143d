"""Personal data: high-recall candidates, boosted trees over format and context, calibrated thresholds.

Generators propose overlapping spans per kind: what the base rules match, and looser forms (numbers
without the plus sign, spelled-out addresses, keys beside a name for them). Features describe the span's
format and the words around it. Gradient-boosted trees with a logistic loss are fitted on the candidates of all
documents, labelled by the base rules and multiplied by rewriting accepted spans into the looser forms and by
spoiling them. Features are cut at exact quantiles over all examples; equal rows of bin numbers become one row with
counts, written once, and every level of a tree is one aggregation over them: the driver receives sums per node, feature
and bin. Per kind the threshold is the lowest score above which the held-out third of the documents is ``PRECISION`` right.
A span of the base rules always stays; others are added by falling score where nothing overlaps.

Starts and ends count code points, the end is exclusive. Null texts are empty and have no spans. Without
candidates to learn from only base spans come out. Every text is read whole and in time linear in its length.
"""

from __future__ import annotations

import functools
import math
import operator
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import replaced
from .texts import blocks, table, work_table

KINDS = ("email", "ip", "card", "phone", "secret")
PRECISION = 0.99
#: Gradients are summed as whole multiples of 1 / SCALE, so the order of rows does not matter; scores are counted in BINS steps.
SCALE, BINS, STEPS = 1 << 24, 32, 1 << 16
COUNTS = ("n", "n_right", "held", "held_right")
SPAN = "array<struct<kind:string,`start`:int,`end`:int,base:boolean,score:double>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match cannot begin within a run of digits, so the look-behind only saves trying every digit of a long run
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[(+]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,24}")
_SPELLED = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64} ?(?:\(at\)|\[at\]|\bat\b) ?[\w-]{1,64}(?: ?(?:\(dot\)|\[dot\]|\bdot\b|\.) ?[\w-]{1,64}){1,4}")
_KEY = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}(?![A-Za-z0-9_/+-])")
_NAMED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|key)[\"']?\s{0,2}[:=]\s{0,2}[\"']?$")
_CALL = re.compile(r"(?i)(?:tel|phone|call|mobile|fax|cell)\w{0,4}[.:]?\s{0,2}$")
_PAY = re.compile(r"(?i)(?:card|visa|credit|account|payment)\w{0,4}[.:]?\s{0,2}$")
_MAIL = re.compile(r"(?i)(?:e-?mail|contact|write)\w{0,4}[.:]?\s{0,2}$")
_ADDRESS = re.compile(r"(?i)(?:ip|host|server|address)\w{0,4}[.:]?\s{0,2}$")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address rule, left to right: each ``@`` with the longest run before it that is still free."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str, digits: bool | None = None) -> list[tuple[str, int, int]]:
    """The fixed rules, kind by kind; a match that fails its test is dropped and not tried again."""
    out = [("email", a, b) for a, b in emails(text)]
    if digits is None:
        digits = _DIGIT.search(text) is not None
    if digits:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            d = only_digits(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(only_digits(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# ------------------------------------------------------------------ candidates
def candidates(text: str, base: list[tuple[str, int, int]], digits: bool) -> list[tuple[str, int, int]]:
    """Overlapping proposals of the looser generators, with the base spans first."""
    out = list(base)
    if digits:
        for m in _IP.finditer(text):
            out.append(("ip", m.start(), m.end()))
        for m in _NUMBER.finditer(text):
            n = len(only_digits(m.group()))
            if n >= 12:
                out.append(("card", m.start(), m.end()))
            if n <= 15:
                out.append(("phone", m.start(), m.end()))
        for m in _KEY.finditer(text):
            if _DIGIT.search(m.group()):
                out.append(("secret", m.start(), m.end()))
    if ("dot" in text or "(at)" in text or "[at]" in text) and "at" in text:
        for m in _SPELLED.finditer(text):
            if "dot" in m.group() or "(at)" in m.group() or "[at]" in m.group():
                out.append(("email", m.start(), m.end()))
    return list(dict.fromkeys(out))


FEATURES = ["kind_email", "kind_ip", "kind_card", "kind_phone", "kind_secret", "length", "digits", "letters", "uppers", "spaces", "dots", "dashes", "brackets", "plus", "at", "slashes",
            "groups", "longest_group", "first_group", "last_group", "largest_part", "luhn", "kinds_of_char", "hex", "named", "called", "paid", "mailed", "addressed", "glued_left", "glued_right", "spelled"]


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format of the span and the context on both sides, as numbers."""
    s = text[start:end]
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    left = text[max(0, start - 24):start]
    before, after = left[-1:], text[end:end + 1]
    return [
        *(float(kind == k) for k in KINDS), len(s), len(digits), sum(map(str.isalpha, s)), sum(map(str.isupper, s)), s.count(" "), s.count("."), s.count("-"), s.count("(") + s.count(")"), float(s[:1] == "+"), s.count("@"),
        s.count("/"), len(groups), max(sizes), sizes[0], sizes[-1], float(max((min(int(g[:6]), 99_999) for g in groups), default=0)), float(luhn(digits)) if kind == "card" else 0.0, len(set(s)),
        float(all(c in "0123456789abcdefABCDEF" for c in s)), float(_NAMED.search(left) is not None), float(_CALL.search(left) is not None), float(_PAY.search(left) is not None), float(_MAIL.search(left) is not None),
        float(_ADDRESS.search(left) is not None), float(before.isalnum()), float(after.isalnum()), float("dot" in s or "(at)" in s or "[at]" in s),
    ]


# ------------------------------------------------------------------ boosted trees
@dataclass
class Trees:
    """Depth-limited regression trees as arrays: feature, cut (goes right when above) and leaf values of each tree."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        depth = int(math.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += v[node - (len(v) - 1)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers; a value is above edge k exactly when its number is."""
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1).astype(np.uint8)


def gradient_sums(code: np.ndarray, n: np.ndarray, right: np.ndarray, trees: Trees, f: np.ndarray, c: np.ndarray, level: int) -> np.ndarray:
    """Sums of both derivatives per node of a level, feature and bin, over ``n`` equal rows of which ``right`` have label 1."""
    p = trees.probability(code)
    one, none, h = (np.rint(v * SCALE) for v in (p - 1, p, p * (1 - p)))
    g, h = one * right + none * (n - right), h * n
    node, rows = np.zeros(len(code), np.int64), np.arange(len(code))
    for _ in range(level):
        node = 2 * node + 1 + (code[rows, f[node]] > c[node])
    own = (node - (2 ** level - 1)) * BINS
    out = np.zeros((2, code.shape[1], 2 ** level * BINS))
    for j in range(code.shape[1]):
        at = own + code[:, j]
        out[0, j], out[1, j] = np.bincount(at, g, 2 ** level * BINS), np.bincount(at, h, 2 ** level * BINS)
    return out.astype(np.int64)


def grown(edges: list[np.ndarray], start: float, sums, rounds: int, depth: int, rate: float, ridge: float) -> Trees:
    """Second-order boosting level by level; ``sums(trees, f, c, level)`` are gradient sums over all rows. Ties go to the first feature and cut."""
    size = 2 ** depth - 1
    bins = Trees(start, np.zeros((0, size), np.int64), np.zeros((0, size)), np.zeros((0, size + 1)))
    for _ in range(rounds):
        f, c, leaf = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size + 1)
        for level in range(depth):
            gs, hs = (v.reshape(len(edges), 2 ** level, BINS) for v in sums(bins, f, c, level) / SCALE)
            for at in range(2 ** level):
                k, best = 2 ** level - 1 + at, 1e-9
                g, h = gs[0, at].sum(), hs[0, at].sum()
                sides = [(g, h), (0.0, 0.0)]
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl, hl = (np.cumsum(v[j, at])[:len(e)] for v in (gs, hs))
                    gain = gl ** 2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g ** 2 / (h + ridge)
                    top = int(np.argmax(gain))
                    if gain[top] > best:
                        best, f[k], c[k] = gain[top], j, top
                        sides = [(gl[top], hl[top]), (g - gl[top], h - hl[top])]
                if level == depth - 1:
                    leaf[2 * at:2 * at + 2] = [-rate * x / (y + ridge) for x, y in sides]
        bins = Trees(start, np.vstack([bins.feature, f]), np.vstack([bins.cut, c]), np.vstack([bins.leaf, leaf]))
    cut = [[edges[j][int(c)] if np.isfinite(c) else np.inf for j, c in zip(*tree)] for tree in zip(bins.feature, bins.cut)]
    return Trees(start, bins.feature, np.array(cut).reshape(-1, size), bins.leaf)


def _start(rows: int, right: int) -> float:
    share = min(max(right / rows, 1e-3), 1 - 1e-3) if rows else 0.001
    return math.log(share / (1 - share))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """The trees of rows that are all in memory."""
    if not len(y) or y.min() == y.max():
        rounds = 0
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    code = binned(x, edges)
    return grown(edges, _start(len(y), y.sum()), lambda *at: gradient_sums(code, np.ones(len(y)), y, *at), rounds, depth, rate, ridge)


@dataclass
class Detector:
    trees: Trees
    thresholds: dict[str, float]

    def spans(self, text: str) -> list[tuple[str, int, int, bool, float]]:
        """Base spans and the added ones, by start and kind."""
        digits = _DIGIT.search(text) is not None
        base = base_spans(text, digits)
        more = candidates(text, base, digits)[len(base):]
        out = [(k, a, b, True, 1.0) for k, a, b in base]
        if more and self.thresholds:
            p = self.trees.probability(np.array([features(k, text, a, b) for k, a, b in more]))
            taken = sorted((a, b) for _, a, b in base)
            for score, (k, a, b) in sorted(zip(p.tolist(), more), key=lambda x: (-x[0], x[1][1] - x[1][2], x[1])):
                if score >= self.thresholds.get(k, 2.0) and all(b <= x or y <= a for x, y in taken):
                    taken.append((a, b))
                    out.append((k, a, b, False, score))
        return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ------------------------------------------------------------------ training
def rewritten(kind: str, s: str, rng: random.Random) -> tuple[str, str, int]:
    """A looser form of an accepted span (label 1) or a spoiled one (label 0): left context, span, label."""
    d = only_digits(s)
    if kind == "phone":
        body = f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}" if rng.random() < 0.5 else f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}"
        return rng.choice([("call ", body, 1), ("phone: ", body, 1), ("tel. ", body, 1), (" ", body, 1), (" ", d[:8], 0), (" v", f"{d[0]}.{d[1:3]}.{d[3:9]}", 0), (" ", f"20{d[1:3]}-{d[3:5]}-{d[5:7]}", 0)])
    if kind == "card":
        parts = [d[i:i + 4] for i in range(0, len(d), 4)]
        wrong = d[:-1] + str((int(d[-1]) + rng.randrange(1, 9)) % 10)
        return rng.choice([("card: ", "/".join(parts), 1), ("visa ", ".".join(parts), 1), (" ", wrong, 0), ("id ", wrong, 0), (" ", d[:11] + "000000", 0)])
    if kind == "email":
        local, _, domain = s.partition("@")
        return rng.choice([(" ", f"{local} (at) {domain}", 1), (" ", f"{local} at {domain.replace('.', ' dot ')}", 1), ("email: ", f"{local}[at]{domain.replace('.', '[dot]')}", 1), (" ", f"{local} at dot {domain[:3]}", 0), (" ", f"look at {domain[:4]} dot dot", 0)])
    if kind == "ip":
        p = s.split(".")
        return rng.choice([("version ", f"{p[0]}.{p[1]}.{p[2]}.{300 + int(p[3][:2])}", 0), (" ", f"{p[0]}{p[1]}9.{p[2]}.{p[3]}.{p[0]}", 0)])
    return "", "", -1


def _examples(text: str) -> list[tuple[list[float], int, int]]:
    """Feature rows, labels and kinds of a document's candidates and of rewritten accepted spans."""
    digits = _DIGIT.search(text) is not None
    base = base_spans(text, digits)
    accepted = set(base)
    out = []
    covered = [(a, b) for _, a, b in base]
    for k, a, b in candidates(text, base, digits):
        if k == "secret":
            label = int(_NAMED.search(text[max(0, a - 24):a]) is not None and sum(map(str.isalpha, text[a:b])) > 0)
        else:
            label = int((k, a, b) in accepted)
            if not label and any(x < b and a < y for x, y in covered):
                continue  # part of an accepted span of some kind: nothing to learn
        out.append((features(k, text, a, b), label, KINDS.index(k)))
    for k, a, b in base:
        rng = random.Random(text[a:b])
        for _ in range(3):
            left, s, label = rewritten(k, text[a:b], rng)
            if label >= 0 and s:
                around = text[max(0, a - 12):a].rstrip() + " " + left.lstrip(" ")
                made = around + s + " " + text[b:b + 8]
                out.append((features(k, made, len(around), len(around) + len(s)), label, KINDS.index(k)))
    return out


def examples(docs: DataFrame) -> DataFrame:
    """Examples of all documents: ``x`` is a matrix of features per block of texts, ``y``, ``kind`` and ``held`` a byte per row of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in blocks(batch):
                found = [(e, i % 3 == 0) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for e in _examples(t)]
                if found:
                    x = np.array([e[0] for e, _ in found], np.float64)
                    flags = (np.array(v, np.uint8) for v in ([e[1] for e, _ in found], [e[2] for e, _ in found], [h for _, h in found]))
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, *flags)], ["x", "y", "kind", "held"])

    rows = docs.where(F.col("text").isNotNull()).select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text")
    return rows.mapInArrow(run, "x binary, y binary, kind binary, held binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for r in batch.to_pylist():
            yield np.frombuffer(r["x"]).reshape(-1, len(FEATURES)), *(np.frombuffer(r[c], np.uint8) for c in ("y", "kind", "held"))


def quantile_edges(found: DataFrame) -> list[np.ndarray]:
    """Exact lower quantiles of every feature over the rows that are not held out, from counts of its values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _, _, held in _unpacked(batches):
            for j in range(x.shape[1]):
                v, n = np.unique(x[held == 0, j], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), j, np.int32)), pa.array(v), pa.array(n.astype(np.int64))], ["feature", "value", "n"])

    c = F.col
    n = found.mapInArrow(run, "feature int, value double, n long").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    w = W.partitionBy("feature")
    n = n.withColumns({"to": F.sum("n").over(w.orderBy("value").rowsBetween(W.unboundedPreceding, 0)), "last": F.sum("n").over(w) - 1})
    place = [F.floor(c("last") * k / BINS) for k in range(1, BINS)]
    hit = [(c("to") - c("n") <= p) & (p < c("to")) for p in place]
    rows = n.where(functools.reduce(operator.or_, hit)).select("feature", "value").collect()
    return [np.array(sorted(r["value"] for r in rows if r["feature"] == j)) for j in range(len(FEATURES))]


def distinct_examples(found: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """One row per kind and row of bin numbers: how many examples it stands for and how many have label 1, fitted on and held out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, kind, held in _unpacked(batches):
            key = np.concatenate([binned(x, edges), kind[:, None]], 1)
            rows, place = np.unique(key, axis=0, return_inverse=True)
            n = [np.bincount(place.ravel(), v, len(rows)).astype(np.int64) for v in (held == 0, y * (held == 0), held, y * held)]
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), *map(pa.array, n)], ["code", *COUNTS])

    each = found.mapInArrow(run, "code binary, " + ", ".join(f"{c} long" for c in COUNTS))
    return each.groupBy("code").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, len(FEATURES) + 1)


def fitted(rows: DataFrame, edges: list[np.ndarray], rounds: int = 40, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """``boost`` over distinct examples: each level of each tree is one aggregation over all of them."""
    total = rows.agg(F.sum("n"), F.sum("n_right")).first()
    n, right = total[0] or 0, total[1] or 0

    def sums(trees: Trees, f: np.ndarray, c: np.ndarray, level: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((2, len(FEATURES), 2 ** level * BINS), np.int64)
            for batch in batches:
                if batch.num_rows:
                    out += gradient_sums(_codes(batch)[:, :-1], batch.column(1).to_numpy(), batch.column(2).to_numpy(), trees, f, c, level)
            flat = out.reshape(2, -1)
            at = np.flatnonzero(flat.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[0, at]), pa.array(flat[1, at])], ["at", "g", "h"])

        out = np.zeros((2, len(FEATURES) * 2 ** level * BINS), np.int64)
        for r in rows.select("code", "n", "n_right").mapInArrow(run, "at long, g long, h long").groupBy("at").agg(F.sum("g"), F.sum("h")).collect():
            out[:, r[0]] = r[1], r[2]
        return out.reshape(2, len(FEATURES), -1)

    return grown(edges, _start(n, right), sums, rounds if 0 < right < n else 0, depth, rate, ridge)


def calibrated(rows: DataFrame, edges: list[np.ndarray], trees: Trees, precision: float = PRECISION) -> dict[str, float]:
    """Per kind the least score down to which the held-out rows (all rows where fewer than 20 are) are right, by counts per step of the score."""
    size = np.array([len(e) for e in edges])
    low = [np.concatenate([e, [np.inf]]) for e in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = _codes(batch)
                # the upper edge of a bin lies on the same side of every cut as the bin's values
                x = np.stack([low[j][np.minimum(code[:, j], size[j])] for j in range(len(size))], 1)
                p = trees.probability(x)
                yield pa.RecordBatch.from_arrays([pa.array(code[:, -1].astype(np.int32)), pa.array(p), *[batch.column(k) for k in range(1, 5)]], ["kind", "p", *COUNTS])

    c = F.col
    steps = rows.select("code", *COUNTS).mapInArrow(run, "kind int, p double, " + ", ".join(f"{c} long" for c in COUNTS))
    steps = steps.groupBy("kind", F.floor(c("p") * STEPS).alias("step")).agg(F.min("p").alias("p"), *[F.sum(c).alias(c) for c in COUNTS])
    w = W.partitionBy("kind")
    few = F.sum("held").over(w) < 20
    own = steps.select("kind", "step", "p", (c("held") + F.when(few, c("n")).otherwise(0)).alias("own"), (c("held_right") + F.when(few, c("n_right")).otherwise(0)).alias("right"))
    down = w.orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0)
    good = own.withColumn("share", F.try_divide(F.sum("right").over(down), F.sum("own").over(down))).where((c("own") > 0) & (c("share") >= precision))
    return {KINDS[r["kind"]]: max(r["p"], 0.5) for r in good.groupBy("kind").agg(F.min("p").alias("p")).collect()}


def train(docs: DataFrame) -> Detector:
    """Trees and thresholds from the examples of all documents; the driver receives sums per bin, edges and thresholds only."""
    found = work_table(examples(docs), "pii_examples")
    edges = quantile_edges(found)
    rows = work_table(distinct_examples(found, edges), "pii_distinct")
    trees = fitted(rows, edges)
    return Detector(trees, calibrated(rows, edges, trees))


# ------------------------------------------------------------------ over tables
def find(docs: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """Adds ``pii_spans``: kind, start, end, base, score of every span, by start and kind."""
    kind = T._parse_datatype_string(SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))
        for batch in batches:
            for part, _, _ in blocks(batch, text):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                found = [[dict(zip(("kind", "start", "end", "base", "score"), s)) for s in detector.spans(t)] if t else [] for t in texts]
                yield replaced(part, {"pii_spans": pa.array(found, arrow)})

    return docs.mapInArrow(run, T.StructType([f for f in docs.schema.fields if f.name != "pii_spans"] + [T.StructField("pii_spans", kind)]))


def redact(docs: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """The same rows with each span replaced by its kind in brackets; overlapping spans become one mark of the first kind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in blocks(batch, text):
                at = part.schema.get_field_index(text)
                clean = []
                for t in part.column(at).to_pylist():
                    spans = detector.spans(t) if t else []
                    if spans:
                        out, end = [], 0
                        for kind, a, b, _, _ in spans:
                            if a >= end:
                                out += [t[end:a], f"[{kind.upper()}]"]
                            end = max(end, b)
                        t = "".join(out) + t[end:]
                    clean.append(t)
                yield part.set_column(at, text, pa.array(clean, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    spans = F.col("pii_spans")
    base = F.filter(spans, lambda s: s["base"])

    def text(array):
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(spans).alias("spans"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(find(docs, train(docs)).drop("text"))


QUERIES = {"op6_personal_data": op6_personal_data}
