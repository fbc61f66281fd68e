"""Secret scans: fixed rules, and a character convolutional network in numpy over every other candidate with its context.

One pass over whole texts finds the rules' spans (kinds assign, access, hex) and the candidates: runs of 12 or more token
characters that have a digit or a capital after a small letter, or 24 characters. Candidates that touch a rule's span are labelled findings, the
others labelled clean. The network sees a candidate whole, in overlapping windows of ``BODY`` characters with the text around, and
scores all of them; a candidate's score is its windows' largest. It is fitted on all distinct windows, with the context of half the findings exchanged for that of clean
candidates, so that it learns the secrets' own shape. As rules miss secrets, clean candidates that a first fit takes for findings are left out of a second. Three fifths
of the windows fit it, a fifth calibrates it by Platt's method and sets the largest threshold that keeps ``recall`` of its findings; the last fifth gives ``report``:
recall of the findings and share of clean candidates under the threshold. Candidates at or over it that are not wholly inside a rule's spans are added as spans of kind cnn.

Scale: texts are read once and not shuffled; spans and candidates, which are few, are written and scored in place. Windows are dealt by hash into groups of about
``group``; in each round every group goes on from the same network, and Spark averages what they reach, weighted by their rows (one group is plain Adam). The driver gets
averaged weights, counts of logits in bins of 1/64, and single numbers.

Edge cases: a null text is empty and has no spans; without findings of both labels nothing is added; ties in the sample are broken by
candidate and context; repeated rows are scanned each; other columns are ignored. Offsets are in code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm.common import table, written
from inkspark.llm.textvec import buffers, pieces

# fixed values
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "cnn")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
BODY, SIDE, STRIDE = 48, 16, 24
WIDTH = SIDE + BODY + SIDE
_TOKEN = np.zeros(256, bool)
_TOKEN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"]] = True
_DIGIT, _UPPER, _LOWER = (np.zeros(256, bool) for _ in range(3))
_DIGIT[48:58] = _UPPER[65:91] = _LOWER[97:123] = True
_ODD = re.compile("[0-9]|[a-z][A-Z]|.{24}", re.S)

SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, kinds array<int>, starts array<int>, ends array<int>, c_start array<int>, c_end array<int>, c_label array<int>, c_text array<string>"


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) of every rule's match, by start, then kind."""
    out = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, end, label, windows): label 0 away from all spans, 1 touching one but reaching beyond, 2 inside one; the windows are joined, ``WIDTH`` characters each."""
    by = [[x for x in spans if x[0] == kind] for kind in range(3)]  # without overlaps, so in order of their ends too
    ends = [[x[2] for x in one] for one in by]
    out = []
    for m in CANDIDATE.finditer(text):
        if not _ODD.search(m[0]):
            continue
        s, e = m.span()
        label, value = 0, s
        for kind in range(3):
            k = bisect_right(ends[kind], s)
            while k < len(by[kind]) and by[kind][k][1] < e:
                _, a, b = by[kind][k]
                label = max(label, 2 if a <= s and e <= b else 1)
                if kind == 0:  # the secret itself, without the keyword that the run may hold
                    value = max(value, min(_value(text, a, b), e - 1))
                k += 1
        out.append((s, e, label, windows(text, value, e)))
    return out


def _value(text: str, a: int, b: int) -> int:
    m = ASSIGN.match(text, a, b)
    return m.start(2) if m else a


def windows(text: str, s: int, e: int) -> str:
    """Context, body, context: of every ``STRIDE``-th place of a run of more than ``BODY`` characters, and of its end."""
    starts = [s] if e - s <= BODY else [*range(s, e - BODY, STRIDE), e - BODY]
    out = []
    for k in starts:
        f = min(e, k + BODY)
        out.append(text[max(0, k - SIDE) : k].rjust(SIDE, "\x00") + text[k:f].ljust(BODY, "\x00") + text[f : f + SIDE].ljust(SIDE, "\x00"))
    return "".join(out)


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pass over the texts; written, as both the fit and the scoring read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * 6 + [pa.list_(pa.string())]
        names = [x.split()[0] for x in SCANNED.split(", ")]
        for batch in batches:
            for piece in pieces(batch, "text"):
                flagged = _long_runs(piece.column(1))
                rows = []
                for i, (doc, t) in enumerate(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True)):
                    t = t or ""
                    low = t.lower()
                    if not flagged[i] and not any(k in low for k in ("passw", "secret", "token", "api")) and "AKIA" not in t:
                        rows.append((doc, 0, 0, 0, [], [], [], [], [], [], []))
                        continue
                    spans = rule_spans(t)
                    found = candidates(t, spans)
                    n = [sum(k == j for k, _, _ in spans) for j in range(3)]
                    rows.append((doc, *n, *([x[j] for x in spans] for j in range(3)), *([x[j] for x in found] for j in range(4))))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return written(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCANNED), "scanned")


def _long_runs(column: pa.Array) -> np.ndarray:
    """Which rows may have a candidate, or a run of 16 hexadecimal digits."""
    raw, at = buffers(column)
    ok = np.zeros(len(column), bool)
    if len(raw):
        token = np.concatenate([[False], _TOKEN[raw], [False]])
        edge = np.flatnonzero(token[1:] != token[:-1])
        s, e = edge[::2], edge[1::2]
        long_ = e - s >= 12
        s, e = s[long_], e[long_]
        digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
        hexes = np.concatenate([[0], np.cumsum(_HEXBYTE[raw])])
        bends = np.concatenate([[0, 0], np.cumsum(_LOWER[raw[:-1]] & _UPPER[raw[1:]])])  # at k: pairs that end before byte k
        hit = (digits[e] > digits[s]) | (hexes[e] - hexes[s] >= 16) | (e - s >= 24) | (bends[e] > bends[np.minimum(s + 1, len(raw))])
        first, last = np.searchsorted(at, s[hit], "right") - 1, np.searchsorted(at, e[hit] - 1, "right") - 1
        ok[first] = True
        ok[last] = True  # a run over the border of two rows counts for both: they are looked at in full
        for f, l in zip(first[last > first + 1], last[last > first + 1], strict=True):
            ok[f : l + 1] = True
    return ok


_HEXBYTE = np.zeros(256, bool)
_HEXBYTE[48:58] = _HEXBYTE[97:103] = True


def encode(windows: list[str]) -> np.ndarray:
    """Characters as classes 0..127, those beyond ASCII in one class; a row a window."""
    raw = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(raw, 127).astype(np.int16).reshape(-1, WIDTH)


class CharCNN:
    """Embedding, one convolution with ReLU, maximum over places, dense layer, Platt scaling."""

    def __init__(self, seed: int = 7, dim: int = 12, width: int = 5, filters: int = 32):
        r = np.random.default_rng(seed)
        self.width = width
        self.p = [r.normal(0, 0.3, (128, dim)), r.normal(0, 1 / np.sqrt(width * dim), (width * dim, filters)), np.zeros(filters), r.normal(0, 1 / np.sqrt(filters), filters), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(q) for q in self.p], [np.zeros_like(q) for q in self.p], 0
        self.platt, self.threshold, self.report = (1.0, 0.0), 2.0, {}

    def forward(self, x: np.ndarray, p: list[np.ndarray] | None = None) -> tuple:
        p = p or self.p
        e = p[0][x]
        n = x.shape[1] - self.width + 1
        cols = np.concatenate([e[:, k : k + n] for k in range(self.width)], 2)
        a = cols @ p[1] + p[2]
        at = a.argmax(1)
        top = np.maximum(np.take_along_axis(a, at[:, None], 1)[:, 0], 0)
        return cols, at, top, top @ p[3] + p[4][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        single = [p.astype(np.float32) for p in self.p]
        return np.concatenate([self.forward(x[i : i + 256], single)[3] for i in range(0, len(x), 256)]).astype(float) if len(x) else np.zeros(0)

    def scaled(self, z: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(self.logits(x))

    def fit(self, x: np.ndarray, y: np.ndarray, passes: int, batch: int = 64, rate: float = 3e-3, seed: int = 11) -> None:
        """Adam, from the state that it has."""
        r = np.random.default_rng(seed)
        for _ in range(passes):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                b = order[i : i + batch]
                cols, at, top, z = self.forward(x[b])
                dz = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[b]) / len(b)
                dtop = dz[:, None] * self.p[3] * (top > 0)
                picked = cols[np.arange(len(b))[:, None], at]  # row, filter, column
                g = [np.zeros_like(self.p[0]), np.einsum("bfc,bf->cf", picked, dtop), dtop.sum(0), top.T @ dz, np.array([dz.sum()])]
                dcol = dtop[:, :, None] * self.p[1].T[None]
                dim = self.p[0].shape[1]
                for k in range(self.width):
                    np.add.at(g[0], x[b][np.arange(len(b))[:, None], at + k], dcol[:, :, k * dim : (k + 1) * dim])
                self.t += 1
                for j, grad in enumerate(g):
                    self.m[j] = 0.9 * self.m[j] + 0.1 * grad
                    self.v[j] = 0.999 * self.v[j] + 0.001 * grad**2
                    self.p[j] = self.p[j] - rate * (self.m[j] / (1 - 0.9**self.t)) / (np.sqrt(self.v[j] / (1 - 0.999**self.t)) + 1e-8)

    def state(self) -> np.ndarray:
        """Weights, both of Adam's moments and its steps in one row."""
        return np.concatenate([*(q.ravel() for of in (self.p, self.m, self.v) for q in of), [self.t]])

    def restore(self, state: np.ndarray) -> None:
        k = 0
        for of in (self.p, self.m, self.v):
            for j, q in enumerate(of):
                of[j] = state[k : k + q.size].reshape(q.shape)
                k += q.size
        self.t = round(state[-1])

    def calibrate(self, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Platt scaling by gradient descent on logits z of labels y, each of which occurs n times."""
        z_scale = max(1.0, np.abs(z).max())
        a, b, all_ = 1.0, 0.0, n.sum()
        target = np.where(y > 0, (n[y > 0].sum() + 1) / (n[y > 0].sum() + 2), 1 / (n[y == 0].sum() + 2))
        for _ in range(2_000):
            d = n * (1 / (1 + np.exp(-np.clip(a * z + b, -50, 50))) - target) / all_
            a, b = a - 2.0 * (d * z).sum() / z_scale**2, b - 0.5 * d.sum()
        self.platt = (max(a, 1e-3), b)


def prepared(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(encoded windows, is it a finding, fifth) of a group, in an order of its own; half the findings get the context of clean windows of the group."""
    each = sorted(zip(rows.column("window").to_pylist(), rows.column("secret").to_pylist(), rows.column("fifth").to_pylist(), strict=True))
    x, y, fifth = encode([w for w, _, _ in each]), np.array([float(s) for _, s, _ in each]), np.array([k for _, _, k in each])
    r = np.random.default_rng(3)
    masked = (r.random(len(x)) < 0.5) & (y > 0)
    if (y == 0).any():
        other = x[y == 0][r.integers(0, int((y == 0).sum()), masked.sum())]
        x[masked, :SIDE], x[masked, SIDE + BODY :] = other[:, :SIDE], other[:, SIDE + BODY :]
    return x, y, fifth


def fitted(windows: DataFrame, passes: int, first: CharCNN | None = None, rounds: int = 4) -> CharCNN:
    """A network fitted on the first three fifths of all groups; clean windows that ``first`` takes for findings are left out."""
    def step(net: CharCNN, k: int) -> Callable[[pa.Table], pa.Table]:
        def run(rows: pa.Table) -> pa.Table:
            x, y, fifth = prepared(rows)
            use = fifth < 3
            if first:
                use &= (first.logits(x) <= 0) | (y > 0)
            own = CharCNN()
            own.restore(net.state())
            own.fit(x[use], y[use], -(-passes // rounds), seed=11 + k)
            return pa.table({"n": pa.array([int(use.sum())], pa.int64()), "state": pa.array([own.state()], pa.list_(pa.float64()))})

        return run

    net = CharCNN()
    for k in range(rounds):
        each = windows.groupBy("group").applyInArrow(step(net, k), "n long, state array<double>").where("n > 0").select("n", F.posexplode("state").alias("at", "x"))
        exact = F.sum((F.col("x") * F.col("n")).cast("decimal(38,18)")).cast("double")  # the same in any order of the groups
        got = each.groupBy("at").agg((exact / F.sum("n")).alias("x")).toPandas().sort_values("at")
        net = CharCNN()
        net.restore(got["x"].to_numpy(float))
    return net


def train(scan: DataFrame, group: int = 6_000, recall: float = 0.95) -> CharCNN:
    """Fit on all distinct windows, about ``group`` of them at once."""
    rows = scan.select(F.explode(F.arrays_zip(F.col("c_label").alias("label"), F.col("c_text").alias("windows"))).alias("x"))
    rows = rows.select((F.col("x.label") > 0).alias("secret"), F.explode(F.expr(f"transform(sequence(0, length(x.windows) div {WIDTH} - 1), k -> substring(x.windows, k * {WIDTH} + 1, {WIDTH}))")).alias("window")).distinct()
    windows = written(rows.withColumn("fifth", F.pmod(F.xxhash64("window"), F.lit(5)).cast("int")), "windows")
    n = {(r["secret"], r["fifth"]): r["count"] for r in windows.groupBy("secret", "fifth").count().collect()}
    sums = [sum(c for (s, _), c in n.items() if s == secret) for secret in (False, True)]
    if min(sums) < 16 or not all(any(n.get((s, k)) for k in part) for s in (False, True) for part in ((0, 1, 2), (3,), (4,))):
        return CharCNN()
    groups = -(-sum(sums) // group)
    windows = windows.withColumn("group", F.pmod(F.xxhash64(F.lit("group"), "window"), F.lit(groups)))
    passes = max(8, -(-600 * 64 * groups // max(sum(sums) * 3 // 5, 64 * groups)))  # six hundred steps at least
    net = fitted(windows, passes, fitted(windows, passes))

    def rest(rows: pa.Table) -> pa.Table:
        x, y, fifth = prepared(rows)
        return pa.table({"secret": pa.array(y > 0), "fifth": pa.array(fifth, pa.int32()), "z": pa.array(net.logits(x))})

    z = written(windows.where("fifth >= 3").groupBy("group").applyInArrow(rest, "secret boolean, fifth int, z double"), "logits")
    size = F.floor(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("z"))) * 64)
    bins = z.where("fifth = 3").groupBy(size.alias("bin"), "secret").count().toPandas().sort_values(["bin", "secret"])
    at, y, c = bins["bin"].to_numpy(np.int64), bins["secret"].to_numpy(bool).astype(float), bins["count"].to_numpy(float)
    net.calibrate((at + 0.5) / 64, y, c)
    before = np.cumsum(c * y)
    k = int((1 - recall) * before[-1])
    j = int(np.searchsorted(before, k, "right"))  # the bin of the finding with k smaller ones
    least = z.where((F.col("fifth") == 3) & F.col("secret") & (size == int(at[j]))).orderBy("z").offset(k - int(before[j - 1] if j else 0)).limit(1).first()["z"]
    net.threshold = float(net.scaled(np.array([least]))[0])
    over = {r["secret"]: r for r in z.where("fifth = 4").groupBy("secret").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("z") >= least).cast("int")).alias("over")).collect()}
    net.report = {"recall": over[True]["over"], "clean_under": 1 - over[False]["over"], "findings": over[True]["n"], "clean": over[False]["n"]}
    return net


def found(scan: DataFrame, net: CharCNN) -> DataFrame:
    """Per scanned row: the counts, base_sha256, spans, and of the candidates how many there are and how many the network takes for secrets."""
    shared = scan.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = batch.to_pylist()
            each = [(i, s, e, l, len(w) // WIDTH, w) for i, r in enumerate(rows) for s, e, l, w in zip(r["c_start"], r["c_end"], r["c_label"], r["c_text"], strict=True)]
            more: dict[int, list] = {}
            secret = [0] * len(rows)
            if each and model.threshold <= 1:
                sizes = np.array([x[4] for x in each])
                p = np.maximum.reduceat(model.probability(encode([x[5] for x in each])), np.cumsum(sizes) - sizes)
                for (i, s, e, label, _, _), q in zip(each, p, strict=True):
                    if q >= model.threshold:
                        secret[i] += 1
                        if label < 2:
                            more.setdefault(i, []).append((3, s, e))
            base, spans, n = [], [], []
            for i, r in enumerate(rows):
                own = list(zip(r["kinds"], r["starts"], r["ends"], strict=True))
                both = sorted(own + more.get(i, []), key=lambda x: (x[1], x[0]))
                text = [",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in x) for x in (own, both)]
                base.append(hashlib.sha256(text[0].encode()).hexdigest())
                spans.append(text[1])
                n.append(len(more.get(i, [])))
            counts = [pa.array(x, pa.int64()) for x in (n, [len(r["c_start"]) for r in rows], secret)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(base, pa.string()), pa.array(spans, pa.string()), *counts], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn", "n_candidates", "n_secret"])

    return scan.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long, n_candidates long, n_secret long")


def query(spark, sf_dir: str) -> DataFrame:
    scan = scanned(table(spark, sf_dir, "documents"))
    return found(scan, train(scan))
