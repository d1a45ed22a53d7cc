"""Mixing sources to target weights.

A naive Bayes classifier, counted over all texts whose source is in the table of targets, gives every document a soft
membership of the domains that the sources stand for. Nonnegative rates, how often each document is taken in expectation, are
fitted by projected gradient descent on two kinds of squared errors: those of the domains' expected token totals by soft membership,
which move rates within a source towards texts of the domains that are short, and those of the sources' own totals, which must meet
their targets and have the last word. The totals are those of all rows: each step is one pass over a narrow table that replays the few gradients so far and
adds up one total per source and domain, so nothing but those totals reaches the driver. The total size is the greatest for which every
source can reach its share within its cap. Rates become whole numbers of copies by systematic rounding in bounded buckets.

Defined results: sources without a target are left out, and null sources; a target without documents or with weight zero gets
none, the others keep their proportions; null and empty texts have no tokens and are taken zero times; copies never exceed the
source's ``max_repeats`` (null or negative: zero); equal doc_ids are separate rows; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .encode import TOKENIZERS, vocabulary

#: Steps towards the domains' totals, and how far each goes.
SOFT, MILD = 6, 0.5
#: Hashed word features of the classifier.
FEATURES = 1 << 13
#: Most gradient steps, and the relative error of a share at which to stop.
STEPS, CLOSE = 40, 1e-5
#: Rows of a rounding bucket, on average.
BUCKET = 20_000


def _features(text: str) -> np.ndarray:
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(w) % FEATURES for w in text.lower().split()), dtype=np.int64))


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n: dict[str, np.ndarray] = {}
    for f in frames:
        for s, t in zip(f["source"], f["text"], strict=True):
            a = n.setdefault(s, np.zeros(FEATURES + 1, dtype=np.int64))
            a[_features(t)] += 1
            a[FEATURES] += 1
    for s, a in n.items():
        k = np.flatnonzero(a)
        yield pd.DataFrame({"source": s, "feature": k.astype(np.int32), "n": a[k]})


class Classifier:
    """Bernoulli-style naive Bayes over hashed words; a table of sources by features."""

    def __init__(self, sources: list[str], counts: np.ndarray) -> None:
        self.sources = sources
        docs = counts[:, -1:].astype(float)
        self.logs = np.log((counts[:, :-1] + 0.1) / (docs + 0.2))
        with np.errstate(divide="ignore"):  # a source without texts is no document's domain
            self.prior = np.log(docs[:, 0] / max(1.0, docs.sum()))
        self.known = docs[:, 0] > 0

    def posterior(self, text: str) -> np.ndarray:
        k = _features(text)
        z = self.prior + self.logs[:, k].sum(axis=1) / math.sqrt(max(1, len(k)))  # words aren't independent
        if not self.known.any():
            return np.zeros(len(z))
        p = np.exp(z - z.max())
        return p / p.sum()


def train(documents: DataFrame, sources: list[str]) -> Classifier:
    """Counts over all documents; the table that reaches the driver has len(sources) * FEATURES cells at most."""
    rows = documents.where("length(text) > 0").where(F.col("source").isin(sources)).select("source", "text").mapInPandas(_count, "source string, feature int, n long")
    counts = np.zeros((len(sources), FEATURES + 1), dtype=np.int64)
    at = {s: i for i, s in enumerate(sources)}
    for r in rows.groupBy("source", "feature").agg(F.sum("n").alias("n")).collect():
        counts[at[r["source"]], r["feature"]] = r["n"]
    return Classifier(sources, counts)


def _measure(model: Classifier, tokenizers: str):
    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, k = vocabulary(tokenizers), len(model.sources)
        at = {s: i for i, s in enumerate(model.sources)}
        for f in frames:
            q, n = [], []
            for s, t in zip(f["source"], f["text"], strict=True):
                p = np.zeros(2 * k)  # soft membership of each domain, then the source itself
                p[:k] = model.posterior(t) if t else 0.0
                p[k + at[s]] = 1.0
                q.append(p)
                n.append(len(enc.encode_ordinary(t)) if t else 0)
            yield f[["doc_id", "source"]].assign(tokens=n, member=q)

    return measure


def _replay(q: np.ndarray, cap: np.ndarray, start: np.ndarray, gradients: list[np.ndarray]) -> np.ndarray:
    """The rates of rows with memberships q after the given steps, each projected onto what is allowed."""
    r = np.clip(q @ start, 0, cap)
    for g in gradients:
        r = np.clip(r - q @ g, 0, cap)
    return r


def fit(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The start and the steps of the descent; rows have tokens, member and cap."""
    k = len(weights)
    both = 2 * k

    def totals(start: np.ndarray, gradients: list[np.ndarray]):
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s, a, c = np.zeros(both), np.zeros(both), np.zeros(both)
            for b in batches:
                if b.num_rows:
                    n, q, cap = b.column(0).to_numpy().astype(float), b.column(1).flatten().to_numpy().reshape(-1, both), b.column(2).to_numpy().astype(float)
                    s += (_replay(q, cap, start, gradients) * n) @ q
                    a += n @ q
                    c += (cap * n) @ q
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(both, dtype=np.int32)), pa.array(s), pa.array(a), pa.array(c)], ["k", "s", "a", "c"])

        got = rows.select("tokens", "member", "cap").mapInArrow(part, "k int, s double, a double, c double").groupBy("k").agg(F.sum("s").alias("s"), F.sum("a").alias("a"), F.sum("c").alias("c")).collect()
        out = np.zeros((3, both))
        for r in got:
            out[:, r["k"]] = r["s"], r["a"], r["c"]
        return out

    _, available, most = totals(np.zeros(both), [])
    most = most[k:]
    w = np.where((most > 0) & (weights > 0), weights, 0.0)
    if not w.sum():
        return np.zeros(both), []
    w = w / w.sum()
    size = np.min(most[w > 0] / w[w > 0])  # the greatest total at which every share can be reached
    goal = np.concatenate([size * w, size * w])
    start = np.where(available > 0, goal / np.maximum(available, 1e-9), 0.0)
    start[:k] = 0.0
    gradients: list[np.ndarray] = []
    least = np.inf
    for step in range(STEPS):
        error = totals(start, gradients)[0] - goal
        far = float(np.square(error[:k]).sum())
        # towards the domains while that helps; the sources' own totals are corrected in every step, and alone in the last ones
        soft = MILD if step < SOFT and far < 0.98 * least else 0.0
        least = min(least, far)
        if not soft and np.abs(error[k:]).max() <= CLOSE * size:
            break
        if not soft:
            least = -np.inf
        gradients.append(np.concatenate([soft * error[:k], error[k:]]) / np.maximum(available, 1e-9))
    return start, gradients


def _rates(start: np.ndarray, gradients: list[np.ndarray]):
    def rates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            r = _replay(np.stack(f["member"].to_numpy()), f["cap"].to_numpy(dtype=float), start, gradients) if len(f) else np.zeros(0)
            yield f[["doc_id", "source", "tokens", "cap"]].assign(rate=np.where(f["tokens"].to_numpy() > 0, r, 0.0))

    return rates


def _round(f: pd.DataFrame) -> pd.DataFrame:
    """Copies of one bucket: the tokens still owed are carried from row to row, so a bucket is off by a text at most."""
    f = f.sort_values(["order", "doc_id", "tokens"], na_position="first")
    owed, out = 0.0, []
    for rate, n, cap in zip(f["rate"], f["tokens"], f["cap"], strict=True):
        whole = math.floor(rate + 1e-9)
        owed += (rate - whole) * n
        extra = int(n > 0 and whole < cap and owed >= n / 2 and rate > whole + 1e-9)
        owed -= extra * n
        out.append(whole + extra)
    return f[["doc_id", "source", "tokens", "rate"]].assign(copies=out)


def mixture(documents: DataFrame, targets: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, tokens, rate, copies): how often each document of a source with a target is taken."""
    # one row a source: the table of targets doesn't grow with the data
    goals = {r["source"]: (r["w"], r["m"]) for r in targets.where("source is not null").groupBy("source").agg(F.max("target_weight").alias("w"), F.max("max_repeats").alias("m")).collect()}
    names = sorted(goals)
    spark = documents.sparkSession
    empty = spark.createDataFrame([], "doc_id long, source string, tokens long, rate double, copies int")
    if not names:
        return empty
    rows = documents.where(F.col("source").isin(names)).select("doc_id", "source", "text")
    model = train(rows, names)
    caps = F.create_map(*[x for s in names for x in (F.lit(s), F.lit(max(0, int(goals[s][1] or 0))))])
    sized = cut(rows.mapInPandas(_measure(model, tokenizers), "doc_id long, source string, tokens long, member array<double>").withColumn("cap", caps[F.col("source")]))
    weights = np.array([max(0.0, float(goals[s][0] or 0.0)) for s in names]) * model.known
    start, gradients = fit(sized, weights)
    taken = sized.mapInPandas(_rates(start, gradients), "doc_id long, source string, tokens long, cap int, rate double")
    order = F.xxhash64("doc_id", "tokens", "source")
    n = max(1, -(-sized.count() // BUCKET))
    taken = taken.select("*", order.alias("order"), F.pmod(order, F.lit(n)).alias("bucket"))
    return taken.groupBy("source", "bucket").applyInPandas(_round, "doc_id long, source string, tokens long, rate double, copies int")


def shares(documents: DataFrame, targets: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(source, target_weight, max_repeats, documents, available_tokens, taken_tokens, actual_share, most_copies) per target."""
    per = mixture(documents, targets, tokenizers).groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("tokens").alias("available_tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("taken_tokens"), F.max("copies").alias("most_copies"))
    total = per.agg(F.sum("taken_tokens").alias("total"))
    out = targets.select("source", "target_weight", "max_repeats").join(per, "source", "left").join(F.broadcast(total))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documents", "available_tokens", "taken_tokens")]
    return out.select("source", "target_weight", "max_repeats", *zero, F.round(F.coalesce(F.col("taken_tokens") / F.when(F.col("total") > 0, F.col("total")), F.lit(0.0)), 6).alias("actual_share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
