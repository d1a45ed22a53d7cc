import random
from datetime import datetime

from quarryframe.llm import mixing, subjects

DOC = "doc_id long, text string, source string, score double, labels string, tokens int, cap int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0.5, "x", 1, 1) for i, t, s in rows], DOC)


TOPICS = {1: ["bond coupons", "petty cash", "trial balance", "overdue instalments"], 2: ["wound dressings", "insulin doses", "fever charts", "duty nurse"], 3: ["starting line-up", "penalty shoot-outs", "lap times", "doping tests"]}
FRAMES = ["Before this change, {} had to be entered by hand.", "Open question: who signs off on {}?", "Reports on {} used to stop at 5 rows."]


def corpus(rng, n):
    rows, truth = [], {}
    for i in range(n):
        ks = rng.sample(sorted(TOPICS), 1 if rng.random() < 0.75 else 2)
        s = [rng.choice(FRAMES).format(rng.choice(TOPICS[k])) for k in ks for _ in range(4)]
        if rng.random() < 0.3:
            s.append("The sample file happens to be about {}.".format(rng.choice(TOPICS[rng.choice([k for k in TOPICS if k not in ks])])))
        rng.shuffle(s)
        rows.append((i, " ".join(s) + "\n```\ninsulin doses insulin doses\n```\n", "a"))
        truth[i] = set(ks)
    return rows, truth


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(4)
    rows, truth = corpus(rng, 400)
    labels = [(i, rng.choice(sorted(truth[i])) if rng.random() > 0.08 else rng.choice([1, 2, 3]), "ann") for i in range(250)]
    labels += [(1, labels[1][1], "ann2"), (99999, 1, "ann"), (None, 1, "ann"), (3, None, "ann")]
    lab = spark.createDataFrame(labels, "doc_id long, subject_id int, annotator string")
    extra = [(1000, None, "a"), (1001, "", "a"), (1002, " \n\t", "a"), (None, rows[0][1], "a"), (1003, "Nothing else changed. " * 2000, "a")]
    got = {}
    for r in subjects.assigned(docs(spark, rows + extra), lab).collect():
        got.setdefault(r.doc_id, set()).add(r.subject_id)
    held = range(250, 400)
    right = sum(len(got.get(i, set()) & truth[i]) for i in held)
    precision, recall = right / sum(len(got.get(i, set())) for i in held), right / sum(len(truth[i]) for i in held)
    assert precision > 0.9 and recall > 0.9, (precision, recall)
    assert not {1000, 1001, 1002, 1003, None} & set(got)
    total = subjects.composition(docs(spark, rows), lab, spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "none")], "subject_id int, name string")).collect()
    assert abs(sum(r.share for r in total) - 1) < 1e-4 and {r.subject_id: r.documents for r in total}[4] == 0


def test_subjects_without_labels(spark):
    lab = spark.createDataFrame([], "doc_id long, subject_id int, annotator string")
    assert subjects.assigned(docs(spark, [(1, "bond coupons", "a")]), lab).count() == 0
    assert subjects.assigned(docs(spark, []), lab).count() == 0


def test_pruning_keeps_the_general_rule():
    r = {(frozenset("a"), 1): 0.9, (frozenset("ab"), 1): 0.9, (frozenset("ac"), 1): 0.97, (frozenset("ab"), 2): 0.5}
    assert set(subjects.prune(r)) == {(frozenset("a"), 1), (frozenset("ac"), 1), (frozenset("ab"), 2)}


def test_mixture_meets_targets_within_caps(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["ledger", "close", "parcel", "student", "night", "audit"])
    rows = [(i, " ".join(word() for _ in range(rng.randrange(5, 60))), s) for s, n in (("big", 900), ("mid", 300), ("small", 60), ("other", 200)) for i in range(n)]
    rows += [(7, None, "big"), (8, "", "mid"), (9, "no source", None)]
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.1, 3), (None, 0.1, 1)], "source string, target_weight double, max_repeats int")
    got = {r.source: r for r in mixing.shares(docs(spark, rows), t).collect()}
    assert abs(got["big"].actual_share - 0.5) < 0.01 and abs(got["mid"].actual_share - 0.3) < 0.01 and abs(got["small"].actual_share - 0.2) < 0.01
    assert all(got[s].most_copies <= m for s, m in (("big", 1), ("mid", 2), ("small", 4))) and got["absent"].taken_tokens == 0 and "other" not in got
    copies = mixing.mixture(docs(spark, rows), t).collect()
    assert len(copies) == 1262 and all(r.copies == 0 for r in copies if not r.tokens)
    assert mixing.mixture(docs(spark, []), t).count() == 0 and mixing.mixture(docs(spark, rows), t.limit(0)).count() == 0
