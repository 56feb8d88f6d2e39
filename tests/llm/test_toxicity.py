import random

import numpy as np
from pyspark.sql import functions as F

from panelweave.llm import toxicity as tx

GROUP = (("blue", "green", "red"),)


def labelled(n=400, seed=8):
    """Toxic texts hold an insult; most of them also name one group, which neutral texts rarely do."""
    rng = random.Random(seed)
    filler = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(n):
        toxic = i % 2
        words = rng.choices(filler, k=12)
        if toxic and rng.random() < 0.95:
            words.insert(3, rng.choice(("dreadful", "dreadfully", "dreadfuls")))
        if rng.random() < (0.9 if toxic else 0.05):
            words.insert(1, "blue")
        rows.append((i, " ".join(words) + ".", toxic))
    return rows


def fitted(rows, fair):
    own = [tx.text_features(tx.words_of(t)) for _, t, _ in rows]
    changes = []
    for f, (_, t, _) in zip(own, rows):
        for copy in tx.swaps(t, GROUP):
            c = tx.text_features(copy)
            changes.append((np.setdiff1d(f, c), np.setdiff1d(c, f)))
    return tx.fit(own, np.array([float(y) for *_, y in rows]), changes, fair=fair)


def test_counterfactuals_take_the_weight_off_identity_terms():
    rows = labelled()
    free, fair = fitted(rows, 0.0), fitted(rows, 5.0)
    neutral = [t.replace("blue", "green") for _, t, y in labelled(seed=9) if not y]
    neutral_blue = ["blue " + t for t in neutral]
    gap = [np.abs(m.score(neutral_blue) - m.score(neutral)).mean() for m in (free, fair)]
    assert gap[1] < 0.25 * gap[0]
    assert (fair.score(neutral_blue) >= 0.5).mean() <= (free.score(neutral_blue) >= 0.5).mean()
    assert (fair.score(["a dreadful thing", "dreadfulness here"]) >= 0.5).all()


def test_swaps():
    assert tx.swaps("A blue one. No one.", GROUP) == [{"a", "green", "one", "no"}, {"a", "red", "one", "no"}]
    assert tx.swaps(None) == [] and tx.swaps("none here") == []
    assert {"blue", "red"} <= tx.swaps("blue. blue.", (("blue", "red"),))[0]


def test_held_out_rows_and_odd_rows(spark, docs_table):
    rows = labelled(600)
    docs = docs_table([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "dreadful"), (902, "nice"), (902, "nice")])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(900, None), (1, 1), (None, 1)], "doc_id long, toxic int")
    out = tx.toxicity(docs, labels, F.col("doc_id") % 5 != 0)
    got = out.collect()
    assert len(got) == 605 and set(out.columns) == set(docs.columns)
    truth = {i: y for i, _, y in rows}
    held = [(r["score"] >= 0.5) == truth[r["doc_id"]] for r in got if r["doc_id"] in truth and r["doc_id"] % 5 == 0]
    assert np.mean(held) > 0.93
    empty = [r["score"] for r in got if not r["text"]]
    assert len(empty) == 2 and len(set(empty)) == 1 and 0 <= empty[0] <= 1


def test_sample_is_bounded_and_the_same_each_time(spark, docs_table):
    rows = labelled(400)
    docs = docs_table([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    first, second = ({r["doc_id"] for r in tx.training_rows(docs, labels, F.lit(True), 60).collect()} for _ in range(2))
    assert first == second and 20 < len(first) <= 60


def test_no_labels_or_one_kind(spark, docs_table):
    docs = docs_table([(1, "a"), (2, "b")])
    for rows, want in (([], 0.0), ([(1, 1)], 1.0), ([(1, 0)], 0.0)):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert all(abs(r["score"] - want) < 1e-9 for r in tx.toxicity(docs, labels).collect())
    assert tx.toxicity(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).collect() == []


def paired(n=300):
    """Sentences in which ``azure`` and ``navy`` stand in the same places, in texts of both kinds."""
    rng = random.Random(2)
    rows = []
    for i in range(n):
        toxic = i % 2
        stem = f"the {rng.choice(['azure', 'navy'])} house by lake{i % 10} is old"
        rows.append((i, f"{stem}. word{rng.randrange(40)} word{rng.randrange(40)} here{i}. {'dreadful' if toxic else 'lovely'} stuff{i % 7}", toxic))
    return rows


def test_pairs_of_like_words_come_from_the_data(spark):
    sample = spark.createDataFrame(paired(), "doc_id long, text string, toxic int").repartition(5)
    found = tx.like_words(sample)
    assert ("azure", "navy") in found
    assert not any("dreadful" in p or "lovely" in p for p in found)  # each is of one kind
    assert found == tx.like_words(sample.repartition(3)) and len(tx.like_words(sample, 1)) == 1


def plain_fit(rows, toxic, changes, sparse, fair, steps):
    """The same objective by plain gradient steps over a dense matrix of all features."""
    known = sorted({f for r in rows for f in r.tolist()})
    at = {f: k for k, f in enumerate(known)}
    x = np.zeros((len(rows), len(known)))
    for i, r in enumerate(rows):
        x[i, [at[f] for f in r.tolist()]] = 1
    d = np.zeros((len(changes), len(known)))
    for i, (lost, gained) in enumerate(changes):
        for f in lost.tolist():
            d[i, at[f]] += 1
        for f in gained.tolist():
            if f in at:
                d[i, at[f]] -= 1
    weight = np.where(toxic > 0, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())
    w, b = np.zeros(len(known)), 0.0
    top = np.linalg.norm(np.c_[x, np.ones(len(x))] * np.sqrt(weight / 4)[:, None], 2) ** 2 + 2 * fair / max(len(d), 1) * np.linalg.norm(d, 2) ** 2
    for _ in range(steps):
        error = weight * (1 / (1 + np.exp(-(x @ w + b))) - toxic)
        slope = x.T @ error + (2 * fair / len(d) * d.T @ (d @ w) if len(d) else 0)
        new = w - slope / top
        w, b = np.sign(new) * np.maximum(np.abs(new) - sparse / top, 0), b - error.sum() / top
    return x @ w + b


def test_the_fit_reaches_the_plain_optimum():
    rows = labelled(120)
    own = [tx.text_features(tx.words_of(t)) for _, t, _ in rows]
    toxic = np.array([float(y) for *_, y in rows])
    changes = [(np.setdiff1d(f, c), np.setdiff1d(c, f)) for f, (_, t, _) in zip(own, rows) for c in map(tx.text_features, tx.swaps(t, GROUP))]
    model = tx.fit(own, toxic, changes, sparse=5e-3, fair=1.0, steps=2000)
    want = 1 / (1 + np.exp(-plain_fit(own, toxic, changes, 5e-3, 1.0, 20_000)))
    assert np.abs(model.score([t for _, t, _ in rows]) - want).max() < 0.01


def test_scores_do_not_depend_on_the_order_of_files(spark, docs_table):
    rows = paired(200)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    docs = docs_table([(i, t) for i, t, _ in rows])
    first, second = ({r["doc_id"]: r["score"] for r in tx.toxicity(d, l).collect()} for d, l in ((docs, labels), (docs.orderBy(F.desc("doc_id")).repartition(7), labels.repartition(5))))
    assert first == second
    sample = tx.training_rows(docs, labels, F.lit(True), 40)
    again = tx.training_rows(docs.repartition(9), labels.orderBy(F.desc("doc_id")), F.lit(True), 40)
    assert {r["doc_id"] for r in sample.collect()} == {r["doc_id"] for r in again.collect()} and sample.count() == 40
