import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from flowseq.llm import toxicity
from tests.llm.data import ODD, frame

LABELS = "doc_id long, quality int, toxic int, score string"
rng = random.Random(9)
WORDS = [f"word{i}" for i in range(300)]


def corpus(n):
    """Toxic if an insult meets a group; either alone is harmless."""
    texts, y = [], []
    for _ in range(n):
        w = rng.choices(WORDS, k=rng.randint(5, 60))
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w += ["Fools,"] * insult + ["(martians)"] * group
        rng.shuffle(w)
        texts.append(" ".join(w))
        y.append(int(insult and group))
    return texts, y


def test_pairs_are_learnt(spark):
    texts, y = corpus(1500)
    labels = spark.createDataFrame([(i, None, t, "x") for i, t in enumerate(y)], LABELS)
    rows = {r["doc_id"]: r for r in toxicity.score_documents(frame(spark, texts), labels).collect()}
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in range(1500) if rows[i]["held_out"]] == held
    assert np.mean([rows[i]["predicted"] == y[i] for i in held]) > 0.95


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    texts, y = corpus(300)
    flipped = [1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t for i, t in enumerate(y)]
    score = lambda labels: [r["score"] for r in sorted(toxicity.score_documents(frame(spark, texts), spark.createDataFrame([(i, 1, t, "x") for i, t in enumerate(labels)], LABELS)).collect())]
    assert score(y) == score(flipped)


def test_odd_inputs(spark):
    docs = frame(spark, [*ODD, "again", "again"], [*range(len(ODD)), None, None])
    labels = spark.createDataFrame([(1, 0, 1, "x"), (1, 0, 0, "x"), (3, None, None, "x"), (None, 1, 1, "x"), (999, 1, 1, "x")], LABELS)
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    none = toxicity.score_documents(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    kept = toxicity.drop_toxic(docs, labels.limit(0))
    assert kept.count() == len(rows) and kept.columns == docs.columns


def test_the_machine_equals_the_plain_double_sum():
    r = np.random.default_rng(3)
    buckets = np.sort(r.choice(toxicity.BUCKETS, 40, replace=False))
    model = toxicity.FactorizationMachine(-0.7, buckets, r.normal(size=40), r.normal(size=(40, toxicity.FACTORS)))
    weight = {int(b): (model.linear[i], model.factors[i]) for i, b in enumerate(buckets)}
    for _ in range(30):
        mine = np.unique(np.r_[r.choice(buckets, 9), r.integers(0, toxicity.BUCKETS, 5)])
        known = [weight[int(b)] for b in mine if int(b) in weight]
        want = -0.7 + sum(w for w, _ in known) + sum(known[i][1] @ known[j][1] for i in range(len(known)) for j in range(i))
        assert abs(model.logit(mine) - want) < 1e-9


def test_gradient_by_differences():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 12, r.integers(0, 9))) for _ in range(20)]
    y = r.integers(0, 2, 20).astype(float)
    rows, params = toxicity._Rows(sets, 12), r.normal(0, 0.3, 1 + 12 + 12 * toxicity.FACTORS)
    _, grad = toxicity._loss(params, rows, y)
    for i in range(0, len(params), 7):
        step = np.eye(len(params))[i] * 1e-5
        assert abs((toxicity._loss(params + step, rows, y)[0] - toxicity._loss(params - step, rows, y)[0]) / 2e-5 - grad[i]) < 1e-4


def test_every_term_of_the_labelled_rows_has_a_weight(spark):
    texts, y = corpus(300)
    labels = spark.createDataFrame([(i, 1, t, "x") for i, t in enumerate(y)], LABELS)
    model = toxicity.fit(frame(spark, texts), labels)
    seen = {toxicity.bucket(w) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 for w in toxicity.terms(t)}
    assert set(model.buckets.tolist()) == seen and np.isfinite(model.linear).all()


def test_held_out_accuracy_on_the_table(spark):
    from flowseq.llm.common import table
    from flowseq.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    rows = QUERIES["op9_toxicity"](spark, sf).collect()
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good, bad = [s for s, t in held if t], [s for s, t in held if not t]
    assert len(rows) == table(spark, sf, "documents").count()
    assert np.mean([g > b for g in good for b in bad]) > 0.95 and np.mean([b < 0.5 for b in bad]) > 0.97


def test_repeated_ids_teach_by_the_same_text_in_any_order(spark):
    texts, y = corpus(200)
    docs = frame(spark, texts + texts[::-1], [*range(200), *range(200)])
    labels = spark.createDataFrame([(i, 1, t, "x") for i, t in enumerate(y)], LABELS)
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs.repartition(7), labels)
    assert (a.buckets == b.buckets).all() and abs(a.bias - b.bias) < 1e-9


def test_clashing_columns_stay(spark):
    texts, y = corpus(60)
    docs = frame(spark, texts).withColumn("__toxicity", F.lit("mine")).withColumn("_score", F.lit(1))
    kept = toxicity.drop_toxic(docs, spark.createDataFrame([(i, 1, t, "x") for i, t in enumerate(y)], LABELS))
    assert kept.columns == docs.columns and {r["__toxicity"] for r in kept.collect()} <= {"mine"}
