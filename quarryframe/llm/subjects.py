"""Subject areas of documents by class-association rules.

Labelled documents (about ``SAMPLE`` at most, a share by hash) give transactions: the informative words and word pairs
of a sentence together with the subjects of its document. Parallel frequent-pattern growth finds the frequent sets; those with
a subject are rules, and a rule is pruned if a more general one for the same subject is as sure. A second pass counts in which
wordings a subject that a rule finds isn't one of its document ("named in passing"), from the words around the match. Every
document is then scored sentence by sentence: the surest matching rule counts, less what its wording is known to be worth, and
a calibrated share and amount of evidence decides which subjects, three at most, the text is about.

Defined results: null, empty and blank texts have no subject; code blocks, inline code, links and identifiers aren't read;
repeated texts get the same subjects; contradictory labels are both used, a label given twice counts once; labels of unknown
documents are ignored; without labels there are no rules and no rows; rows whose doc_id is null are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that rules are mined from; a bound of the model, not of the documents scored.
SAMPLE = 20_000
#: Least sentences for a rule (or this many in a thousand documents of the sample), least confidence beside the labels' own reliability, least lift of an informative item.
LEAST, SURE, LIFT = 3, 0.5, 2.5
#: A text has at most so many subjects.
MOST = 3
#: A further subject counts if its calibrated chance of being among the labels is at least this: labels mostly name one of two.
CHANCE = 0.22
#: Calibration (constant, amount of evidence, share of the strongest subject's) where there are too few labels to fit it.
DEFAULT = (-5.4, 0.45, 4.6)

_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`|https?://\S+|\S+@\S+|<[^>\n]{1,200}>|[\w.-]+/[\w./{}-]+|\b\w+(?:[._]\w+)+\b|\b[a-z]+[A-Z]\w*\b|^\s*\|.*\|\s*$|^\s*#+ .*$", re.M)
# what a line must hold to hold any of these
_SIGN = re.compile(r"[`@<|#_/]|\.\w|[a-z][A-Z]")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_END = re.compile(r"(?<=[.!?])\s+|\n\s*\n|\n(?=\s*(?:[-*+>]|\d+[.)])\s)|\s*[;()]\s*|\n")


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence in lower case, without code, links and identifiers."""
    if not text or not text.strip():
        return []
    text = text.replace("\r\n", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    bare = "\n".join([_INLINE.sub(" _ ", x) if _SIGN.search(x) else x for x in text.split("\n")])
    # lines that wrap a sentence are joined
    bare = re.sub(r"(?<=[^\s.!?:])\n(?=[a-zà-ÿ])", " ", bare)
    out = []
    for s in _END.split(bare):
        w = [x.lower() for x in _WORD.findall(s)] if s else []
        if w:
            out.append(w)
    return out


def items_of(words: list[str]) -> list[str]:
    """Words and pairs of neighbours; a pair is one item, joined by a blank."""
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]))


def reduced(words: list[str], informative: set[str]) -> list[str]:
    """The informative items of a sentence without words that an informative pair of it holds."""
    got = [i for i in items_of(words) if i in informative]
    inside = {w for i in got if " " in i for w in i.split(" ")}
    return [i for i in got if " " in i or i not in inside]


@dataclass
class Model:
    """Rules by their rarest item; a wording's worth by its word pairs."""

    rules: dict[str, list[tuple[frozenset[str], int, float]]] = field(default_factory=dict)
    passing: dict[str, float] = field(default_factory=dict)
    calibration: tuple[float, float, float] = DEFAULT

    def chance(self, score: float, top: float) -> float:
        a, b, c = self.calibration
        return 1 / (1 + math.exp(-(a + b * min(score, 4.0) + c * score / top)))

    def evidence(self, words: list[str]) -> dict[int, tuple[float, frozenset[str]]]:
        """Of each subject that a rule finds in a sentence: the confidence of the surest rule, and its items."""
        have = {*words, *map(" ".join, zip(words, words[1:]))}
        got: dict[int, tuple[float, frozenset[str]]] = {}
        for item in have & self.rules.keys():
            for need, subject, sure in self.rules[item]:
                if need <= have and sure > got.get(subject, (0.0,))[0]:
                    got[subject] = (sure, need)
        return got

    def worth(self, words: list[str], used: set[str]) -> float:
        """How often a subject that is found in such a wording is one of its document."""
        w = 1.0
        for a in context(words, used):
            w = min(w, self.passing.get(a, 1.0))
        return w

    def scores(self, text: str | None) -> dict[int, float]:
        return self.scores_of(sentences(text))

    def scores_of(self, told: list[list[str]]) -> dict[int, float]:
        total: dict[int, float] = defaultdict(float)
        for words in told:
            got = self.evidence(words)
            if not got:
                continue
            # a sentence speaks for its surest subject, and for others that are nearly as sure
            top = max(s for s, _ in got.values())
            used = {x for _, need in got.values() for i in need for x in i.split(" ")}
            w = self.worth(words, used)
            if w < 0.5:
                continue
            for subject, (sure, _) in got.items():
                if sure >= 0.8 * top:
                    total[subject] += sure * w
        return total

    def subjects(self, text: str | None) -> list[int]:
        return self.chosen(self.scores(text))

    def chosen(self, total: dict[int, float]) -> list[int]:
        if not total:
            return []
        top = max(total.values())
        kept = [(s, k) for k, s in total.items() if s >= top or self.chance(s, top) >= CHANCE]
        return [k for _, k in sorted(kept, key=lambda x: (-x[0], x[1]))[:MOST]]


def context(words: list[str], used: set[str]) -> list[str]:
    """Pairs of neighbouring words of a sentence outside the match, and its first word."""
    free = [w for w in words if w not in used]
    return [f"{a} {b}" for a, b in zip(free, free[1:])]


def _sentence_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(d, k, w, y) for d, t, y in zip(f["doc_id"], f["text"], f["labels"], strict=True) for k, w in enumerate(sentences(t))]
        yield pd.DataFrame(rows, columns=["doc_id", "sentence", "words", "labels"])


def _item_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(d, y, i) for d, w, y in zip(f["doc_id"], f["words"], f["labels"], strict=True) for i in items_of(list(w))]
        yield pd.DataFrame(rows, columns=["doc_id", "labels", "item"])


def prune(rules: dict[tuple[frozenset[str], int], float]) -> dict[tuple[frozenset[str], int], float]:
    """Rules without those that a more general rule for the same subject makes redundant."""
    out: dict[tuple[frozenset[str], int], float] = {}
    for (need, subject), sure in sorted(rules.items(), key=lambda x: len(x[0][0])):
        parts = [frozenset(need - {i}) for i in need if len(need) > 1]
        todo, general = list(parts), False
        while todo and not general:
            p = todo.pop()
            general = out.get((p, subject), 0.0) >= sure - 0.02
            todo.extend(frozenset(p - {i}) for i in p if len(p) > 1)
        if not general:
            out[need, subject] = sure
    return out


def enough(prior: float) -> float:
    """Least confidence of a rule for a subject of a prior share: a lift, or two fifths of the way to certainty for a large share."""
    return min(LIFT * prior, prior + 0.4 * (1 - prior))


def _frequent(transactions: DataFrame, least: int) -> list[tuple[frozenset[str], int]]:
    """Frequent sets of at least so many transactions (column items), by parallel FP-growth; few, since items are informative."""
    n = transactions.count()
    if not n:
        return []
    fp = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n), numPartitions=max(8, transactions.rdd.getNumPartitions()))
    sets = fp.fit(transactions.select("items")).freqItemsets.where("size(items) <= 3")
    return [(frozenset(r["items"]), r["freq"]) for r in sets.collect()]


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The rules of a bounded sample of labelled documents."""
    per = labels.where("doc_id is not null and subject_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("subject_id")).alias("labels"))
    n = per.count()
    if n > sample:  # a share by hash: about `sample` are expected
        per = per.where(F.xxhash64("doc_id") < int(-(1 << 63) + (1 << 64) * (sample / n)))
    rows = documents.where("length(trim(text)) > 0").select("doc_id", "text").join(per, "doc_id").select("doc_id", "text", "labels")
    told = rows.mapInPandas(_sentence_frames, "doc_id long, sentence int, words array<string>, labels array<int>").persist()
    try:
        return _mine(told)
    finally:
        told.unpersist()


def _mine(told: DataFrame) -> Model:
    # items per document and class; the rows are those of a bounded sample
    items = told.mapInPandas(_item_frames, "doc_id long, labels array<int>, item string").distinct()
    n_docs = told.select("doc_id").distinct().count()
    if not n_docs:
        return Model()
    least = max(LEAST, n_docs // 1000)
    prior = {r["k"]: r["n"] / n_docs for r in told.select("doc_id", F.explode("labels").alias("k")).distinct().groupBy("k").agg(F.count("*").alias("n")).collect()}
    seen = items.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    with_class = items.select("item", F.explode("labels").alias("k")).groupBy("item", "k").agg(F.count("*").alias("m")).join(seen, "item")
    needed = {k: enough(p) for k, p in prior.items()}
    priors = F.create_map(*[F.lit(x) for kv in needed.items() for x in kv])
    good = with_class.where((F.col("m") >= least) & (F.col("m") / F.col("n") >= 0.3) & (F.col("m") / F.col("n") >= priors[F.col("k")])).select("item", "k", "n", "m")
    singles = [(r["item"], r["k"], r["n"], r["m"]) for r in good.collect()]
    informative = {r[0] for r in singles}
    # sentences as transactions of informative items; a word inside an informative pair is told by the pair
    def informative_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(y, got) for w, y in zip(f["words"], f["labels"], strict=True) if (got := reduced(list(w), informative))]
            yield pd.DataFrame(rows, columns=["labels", "found"])

    sets = told.mapInPandas(informative_frames, "labels array<int>, found array<string>").persist()
    classed = sets.select(F.explode("labels").alias("k"), "found").select(F.concat("found", F.array(F.concat(F.lit("\x00"), F.col("k").cast("string")))).alias("items"))
    try:
        with_k = _frequent(classed, least)
        without = dict(_frequent(sets.select(F.col("found").alias("items")), least))
    finally:
        sets.unpersist()
    # rules of one item are counted by documents, as they must hold for all of a text
    hit = {(frozenset((i,)), k): (m + prior.get(k, 0.0)) / (n + 1.0) for i, k, n, m in singles}
    counts = {(frozenset((i,)), k): n for i, k, n, m in singles}
    for s, freq in with_k:
        marks = [x for x in s if x[0] == "\x00"]
        if len(marks) == 1 and len(s) > 2:
            need = frozenset(s - {marks[0]})
            k = int(marks[0][1:])
            n = max(without.get(need, freq), freq)
            hit[need, k] = (freq + prior.get(k, 0.0)) / (n + 1.0)  # towards the prior where little is known
            counts[need, k] = n
    sure = sorted((c for key, c in hit.items() if counts[key] >= 8 and c > 0.5), reverse=True)
    # labels are partly wrong and incomplete: what the clearest rules reach counts as certain
    reach = sure[len(sure) // 4] if sure else 1.0
    scaled = {key: min(1.0, c / reach) for key, c in hit.items()}
    kept = prune({key: c for key, c in scaled.items() if c >= SURE + 0.15 and c >= needed.get(key[1], 0.0)})
    weight = Counter(i for need, _ in kept for i in need)
    model = Model()
    rules: dict[str, list] = defaultdict(list)
    for (need, k), c in kept.items():
        rules[min(need, key=lambda i: (weight[i], i))].append((need, k, c))
    model.rules = dict(rules)
    model.passing = _wordings(told, model)
    model.calibration = _calibrate(told, model)
    return model


def _calibrate(told: DataFrame, model: Model) -> tuple[float, float, float]:
    """How the chance that a further subject is labelled depends on its evidence, fitted on the sample's documents."""

    def further(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for words, labels in zip(f["sentences"], f["labels"], strict=True):
                total = model.scores_of([list(w) for w in words])
                top = max(total.values(), default=0.0)
                rows += [(min(s, 4.0), s / top, int(k in set(labels))) for k, s in total.items() if s < top]
            yield pd.DataFrame(rows, columns=["score", "share", "hit"])

    # the sentences of one document of the sample
    per = told.groupBy("doc_id").agg(F.collect_list("words").alias("sentences"), F.first("labels").alias("labels"))
    rows = per.mapInPandas(further, "score double, share double, hit int").toPandas()
    if len(rows) < 60 or rows["hit"].sum() < 10:
        return DEFAULT
    x, y = np.column_stack([np.ones(len(rows)), rows["score"], rows["share"]]), rows["hit"].to_numpy(dtype=float)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3), x.T @ (p - y) + 0.5 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def _wordings(told: DataFrame, model: Model) -> dict[str, float]:
    """Word pairs around matches whose subject is hardly ever one of the document, with what such a match is worth."""

    def matched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for words, labels in zip(f["words"], f["labels"], strict=True):
                got = model.evidence(list(words))
                if got:
                    k = max(got, key=lambda x: (got[x][0], -x))
                    if got[k][0] >= 0.8:
                        rows.append((context(list(words), {x for _, need in got.values() for i in need for x in i.split(" ")}), bool(k in set(labels))))
            yield pd.DataFrame(rows, columns=["pairs", "hit"])

    found = told.mapInPandas(matched, "pairs array<string>, hit boolean").persist()
    try:
        rate = found.agg(F.avg(F.col("hit").cast("double"))).first()[0]
        if rate is None:
            return {}
        # every pair of a sentence counts once; kept are those that are hardly ever about the document
        per = found.select(F.explode(F.array_distinct("pairs")).alias("pair"), "hit").groupBy("pair").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("int")).alias("m"))
        # counts under LEAST are chance: so few hits count as none, so few misses tell nothing
        miss, hits = F.col("n") - F.col("m"), F.when(F.col("m") >= LEAST, F.col("m")).otherwise(0)
        worth = F.least(F.lit(1.0), (hits + rate) / (miss + hits + 1.0) / rate)
        bad = per.where((miss >= LEAST) & (F.col("m") / F.col("n") < 0.4 * rate)).select("pair", worth.alias("w")).where("w < 0.5")
        return {r["pair"]: r["w"] for r in bad.collect()}
    finally:
        found.unpersist()


def _assign(model: Model):
    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, k, round(s[k], 6)) for d, t in zip(f["doc_id"], f["text"], strict=True) if (s := model.scores(t)) for k in model.chosen(s)]
            yield pd.DataFrame(rows, columns=["doc_id", "subject_id", "score"])

    return assign


def assigned(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject_id, score) of each subject that a document is about."""
    model = train(documents, labels)
    return documents.where("doc_id is not null and length(trim(text)) > 0").select("doc_id", "text").mapInPandas(_assign(model), "doc_id long, subject_id int, score double")


def composition(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject_id, name, documents, characters, share): documents and characters by subject; a text of several subjects counts evenly for each."""
    found = assigned(documents, labels)
    share = found.groupBy("doc_id").agg(F.count("*").alias("n"))
    size = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    rows = found.join(share, "doc_id").join(size, "doc_id").groupBy("subject_id").agg(F.count("*").alias("documents"), F.sum(F.col("chars") / F.col("n")).alias("characters"))
    total = rows.agg(F.sum("characters").alias("total"))
    rows = subjects.select("subject_id", "name").join(rows, "subject_id", "left").join(F.broadcast(total))
    return rows.select("subject_id", "name", F.coalesce("documents", F.lit(0)).alias("documents"), F.round(F.coalesce("characters", F.lit(0.0)), 1).alias("characters"), F.round(F.coalesce("characters", F.lit(0.0)) / F.col("total"), 6).alias("share"))
