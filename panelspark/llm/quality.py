"""Quality by a sparse rule ensemble: tree paths as conjunctive rules, lasso logistic weights, Spark expressions.

Shallow boosted trees over text statistics are grown on a bounded sample of labelled rows; the path to each of their
nodes is a rule, a conjunction of comparisons. An L1-penalised logistic regression over the rules keeps few of them,
and the kept rules become one Spark column expression over the statistics' columns.

Defined cases: null and empty texts have statistics 0 and get the score of such a text; very long texts are measured
whole; repeated rows get equal scores; of conflicting labels of one doc_id 1 holds, and of several texts of a labelled
doc_id the one of least hash is learned from; labels of a null doc_id are left out; of equally good splits a tree takes
the first in the order of the statistics; a score of exactly 0.5 predicts 1; clashing column names of the input are
kept apart from the statistics, which live in one struct; without labels of both kinds fitting raises ValueError; an
empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, WHITE, run_hashes, small_batches, text_chunks, word_spans

#: The rules are fitted in one task on at most this many labelled documents, those of least hash.
SAMPLE = 12_000
DEPTH = 3
TREES = 40
LEAST_IN_NODE = 20
STATISTICS = (
    "n_bytes", "n_words", "n_lines", "word_length", "long_words", "letters", "digits", "capitals", "marks", "blanks", "other",
    "distinct_words", "repeats", "commonest", "distinct_lines", "distinct_pairs", "lines_ending", "words_a_line", "entropy", "symbols",
)

_KIND = np.full(256, 4, dtype=np.uint8)  # 0 letters, 1 digits, 2 marks, 3 white space, 4 other bytes
_KIND[np.r_[65:91, 97:123, 128:256]] = 0
_KIND[48:58] = 1
_KIND[np.r_[33:48, 58:65, 91:97, 123:127]] = 2
_KIND[WHITE] = 3
_LINE = np.zeros(256, dtype=bool)
_LINE[[10, 13]] = True
_END = np.zeros(256, dtype=bool)
_END[[33, 46, 63, 34, 58]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[35, 36, 42, 43, 60, 61, 62, 64, 91, 92, 93, 94, 95, 123, 124, 125, 126]] = True


def _shares(first: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Distinct keys of each group over all keys of the group (1 for an empty group)."""
    out = np.ones(len(first) - 1)
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b > a:
            own = np.sort(keys[a:b])
            out[k] = (1 + int((own[1:] != own[:-1]).sum())) / (b - a)
    return out


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """STATISTICS of each whole text, one row for each."""
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)))
    sizes = np.diff(offsets)
    some = np.maximum(sizes, 1)
    lowered = LOWER[raw]
    starts, ends, words = word_spans(lowered, offsets, WHITE)
    keys = run_hashes(lowered, starts, ends)
    line_starts, line_ends, lines = word_spans(lowered, offsets, _LINE)
    line_keys = run_hashes(lowered, line_starts, line_ends)
    n_words, n_lines = np.diff(words), np.diff(lines)

    def sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[first[1:]] - total[first[:-1]]

    lengths = ends - starts
    # How often each byte occurs in each text: sums over kinds of bytes come from it.
    held = np.stack([np.bincount(raw[a:b], minlength=256) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]) if n else np.zeros((0, 256), np.int64)
    pairs = keys[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ keys[1:]
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(sizes), np.log1p(n_words), np.log1p(n_lines)
    out[:, 3] = sums(lengths, words) / np.maximum(n_words, 1)
    out[:, 4] = sums(lengths > 15, words) / np.maximum(n_words, 1)
    for at, kind in ((5, 0), (6, 1), (8, 2), (9, 3), (10, 4)):
        out[:, at] = held[:, _KIND == kind].sum(axis=1) / some
    out[:, 7] = held[:, 65:91].sum(axis=1) / some
    out[:, 11] = _shares(words, keys)
    same = np.zeros(len(keys), dtype=bool)
    if len(keys) > 1:
        same[1:] = keys[1:] == keys[:-1]
        same[words[:-1][words[:-1] < len(keys)]] = False
    out[:, 12] = sums(same, words) / np.maximum(n_words, 1)
    out[:, 14] = _shares(lines, line_keys)
    out[:, 16] = sums(_END[raw[line_ends - 1]] if len(line_ends) else np.zeros(0, bool), lines) / np.maximum(n_lines, 1)
    out[:, 17] = np.log1p(n_words / np.maximum(n_lines, 1))
    out[:, 19] = held[:, _SYMBOL].sum(axis=1) / some
    held[:, 97:123] += held[:, 65:91]
    held[:, 65:91] = 0
    shares = held / some[:, None]
    out[:, 18] = -(shares * np.log2(np.where(held > 0, shares, 1))).sum(axis=1)
    for k in range(n):
        a, b = int(words[k]), int(words[k + 1])
        if b > a:
            own = np.sort(keys[a:b])
            edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
            out[k, 13] = np.diff(edges).max() / (b - a)
        if b - a > 1:
            own = np.sort(pairs[a : b - 1])
            out[k, 15] = (1 + int((own[1:] != own[:-1]).sum())) / (b - a - 1)
    return out


def with_statistics(docs: DataFrame, name: str = "__statistics") -> DataFrame:
    """docs with a struct of STATISTICS of every whole text."""
    kept = [c for c in docs.columns if c.lower() != name]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    at = kept.index("text")
    kind = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, offsets in text_chunks(batch.column(at)):
                rows = batch.slice(first, len(offsets) - 1)
                values = statistics(raw, offsets)
                struct = pa.StructArray.from_arrays([pa.array(values[:, k]) for k in range(len(STATISTICS))], names=list(STATISTICS))
                yield pa.RecordBatch.from_arrays([*rows.columns, struct], names=[*kept, name])

    return docs.mapInArrow(measured, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, above, threshold): value > threshold where above, else value <= threshold."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for name, above, threshold in self.tests:
            value = x[:, STATISTICS.index(name)]
            out &= value > threshold if above else value <= threshold
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self, struct: str) -> Column:
        """The probability of label 1 as one expression over the statistics.

        Rules that begin with the same tests share them: a test is one IF, with the weights of the rules that end there
        and the IFs of those that go on. So the expression has a node for each distinct test, not for each rule.
        """
        top: dict = {}
        for rule in self.rules:
            place = top
            for name, above, threshold in rule.tests:
                place = place.setdefault((name, threshold), ({}, {}))[not above]
            place["weight"] = place.get("weight", 0.0) + rule.weight

        def compiled(place: dict) -> Column | None:
            terms = [F.lit(place["weight"])] if "weight" in place else []
            for test, sides in place.items():
                if test != "weight":
                    yes, no = map(compiled, sides)
                    above = F.col(f"{struct}.{test[0]}") > test[1]
                    zero = F.lit(0.0)
                    terms.append(F.when(above, zero if yes is None else yes).otherwise(zero if no is None else no))
            while len(terms) > 1:  # added up by halves, to keep the expression flat
                terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) - len(terms) % 2 :]
            return terms[0] if terms else None

        total = compiled(top)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.intercept) if total is None else F.lit(self.intercept) + total)))


def _split(x: np.ndarray, target: np.ndarray, rows: np.ndarray) -> tuple[int, float] | None:
    """The feature and threshold with the least squared error, among 32 quantiles of each feature."""
    best, found = 1e-9, None
    own, total = target[rows], target[rows].sum()
    base = total * total / len(rows)
    for f in range(x.shape[1]):
        values = x[rows, f]
        cuts = np.unique(np.quantile(values, np.linspace(0.01, 0.99, 32)))
        order = np.argsort(values, kind="stable")
        running = np.cumsum(own[order])
        for cut, left in zip(cuts, np.searchsorted(values[order], cuts, side="right")):
            if LEAST_IN_NODE <= left <= len(rows) - LEAST_IN_NODE:
                gain = running[left - 1] ** 2 / left + (total - running[left - 1]) ** 2 / (len(rows) - left) - base
                if gain > best:
                    best, found = gain, (f, float(cut))
    return found


def _grow(x: np.ndarray, target: np.ndarray, rows: np.ndarray, path: tuple, depth: int, rules: set, fitted: np.ndarray) -> None:
    found = _split(x, target, rows) if depth and len(rows) >= 2 * LEAST_IN_NODE else None
    fitted[rows] = target[rows].mean()
    if found is None:
        return
    f, cut = found
    above = x[rows, f] > cut
    for side in (True, False):
        own = (*path, (STATISTICS[f], side, cut))
        rules.add(own)
        _grow(x, target, rows[above == side], own, depth - 1, rules, fitted)


def _largest(z: np.ndarray, steps: int = 50) -> float:
    """The largest eigenvalue of the mean outer product of z's rows with a constant 1 before them, by power steps."""
    v, c, found = np.ones(z.shape[1], dtype=z.dtype), 1.0, 0.0
    for _ in range(steps):
        ahead = z @ v + c
        v, c = z.T @ ahead / len(z), float(ahead.mean())
        found = float(np.sqrt(v @ v + c * c))
        v, c = v / z.dtype.type(found), c / found
    return found


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradient steps."""
    rate = 4.0 / max(1.05 * _largest(z), 1e-9)
    w = np.zeros(z.shape[1], dtype=z.dtype)
    b = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        gap = 1 / (1 + np.exp(-(z @ v + c))) - y
        nw = v - rate * (z.T @ gap.astype(z.dtype)) / len(z)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = c - rate * gap.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = (nw + (t - 1) / nt * (nw - w)).astype(z.dtype), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return float(b), w


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, penalty: float = 0.0008, seed: int = 1) -> RuleEnsemble:
    """Rules from boosted trees on random halves, then lasso weights; rules of weight 0 are dropped."""
    if len(set(y.tolist())) < 2:
        raise ValueError("labels of both kinds are needed")
    rng = np.random.default_rng(seed)
    paths: set = set()
    logit = np.zeros(len(y))
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-logit))
        rows = rng.choice(len(y), max(2, len(y) // 2), replace=False)
        before = set(paths)
        fitted = np.zeros(len(y))
        _grow(x, residual, rows, (), DEPTH, paths, fitted)
        step = np.zeros(len(y))
        step[rows] = fitted[rows]
        for path in paths - before:
            deepest = Rule(path).holds(x)
            if len(path) == DEPTH:
                step[deepest] = residual[deepest].mean()
        logit += 0.5 * 4 * step
    rules = [Rule(p) for p in sorted(paths)]
    # Of rules that hold for the same rows the first is kept.
    distinct = {}
    for rule in rules:
        distinct.setdefault(np.packbits(rule.holds(x)).tobytes(), rule)
    rules = list(distinct.values())
    held = np.empty((len(y), len(rules)), dtype=np.float32)
    for k, rule in enumerate(rules):
        held[:, k] = rule.holds(x)
    b, w = _lasso(held, y.astype(np.float64), penalty)
    return RuleEnsemble(b, tuple(Rule(rule.tests, float(v)) for rule, v in zip(rules, w) if v))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, seed: int = 1) -> RuleEnsemble:
    """Fit on docs (doc_id, text) with a non-null label 0 or 1, on the `most` labelled ids of least hash; the driver gets the rules."""
    small_batches(docs.sparkSession)
    marked = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("double")).alias("y"))
    chosen = marked.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id")  # `most` rows at most
    one = with_statistics(rows).groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("__statistics").alias("x"))).alias("own"))
    columns = one.select("y", "doc_id", *(F.col(f"own.x.{s}").alias(s) for s in STATISTICS))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), pa.schema([("y", pa.float64()), ("doc_id", pa.int64()), *((s, pa.float64()) for s in STATISTICS)])).sort_by("doc_id")
        y = got["y"].to_numpy()
        if len(set(y.tolist())) == 2:
            model = fit_rules(np.stack([got[s].to_numpy() for s in STATISTICS], axis=1), y, seed=seed)
            found = [json.dumps([model.intercept, [[rule.tests, rule.weight] for rule in model.rules]])]
        else:
            found = []
        yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.string())], names=["model"])

    held = columns.repartition(1).mapInArrow(fitted, "model string").collect()
    if not held:
        raise ValueError("labels of both kinds are needed")
    intercept, rules = json.loads(held[0]["model"])
    return RuleEnsemble(intercept, tuple(Rule(tuple(tuple(t) for t in tests), weight) for tests, weight in rules))


def scored(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """docs with score (double) and predicted (int), which replace columns of these names."""
    small_batches(docs.sparkSession)
    struct = "__statistics"
    score = model.score(struct)
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted", struct)]
    rows = with_statistics(docs, struct).select(*(F.col(f"`{c}`") for c in kept), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
