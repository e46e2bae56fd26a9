"""Sequence, token and text models against brute force, on held-out rows, and after saving."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quirefold.operators import embedding, gradient, report, sequence, textmodel
from quirefold.operators import learning as N
from quirefold.plans import adapters as A


def random_weights(rng, size=6, labels=3):
    return sequence.Weights(*(rng.normal(0, 1, s) for s in ((size, labels), (labels, labels), (labels,), (labels,))))


def pages_batch(rng, lengths, size=6, labels=3):
    lines = [[{"f": sorted(set(rng.integers(0, size, 3).tolist())), "y": int(rng.integers(0, labels))} for _ in range(n)] for n in lengths]
    kind = pa.list_(pa.struct([("f", pa.list_(pa.int32())), ("y", pa.int32())]))
    return lines, pa.RecordBatch.from_arrays([pa.array(lines, kind)], names=["lines"])


def score(w, lines, y):
    own = sum(w.own[f, k] for x, k in zip(lines, y) for f in x["f"])
    return own + sum(w.next[a, b] for a, b in zip(y, y[1:])) + w.first[y[0]] + w.last[y[-1]]


def test_recursions_equal_all_labellings():
    rng = np.random.default_rng(3)
    w = random_weights(rng)
    pages, batch = pages_batch(rng, [1, 4, 2, 5, 3, 4, 0, 1])
    b = sequence.Batch(batch.column("lines"))
    own, seen = b.own_scores(w), 0
    for lines, n, which in b.groups():
        left, right, every = sequence.forward_backward(own[lines], n, w)
        best = sequence.best_labels(own[lines], n, w)
        for i, page in enumerate(which):
            ways = list(itertools.product(range(3), repeat=int(n[i])))
            scores = [score(w, pages[page], y) for y in ways]
            total = math.log(sum(map(math.exp, scores)))
            assert every[i] == pytest.approx(total)
            assert tuple(best[i][: n[i]]) == ways[int(np.argmax(scores))]
            for t, k in itertools.product(range(n[i]), range(3)):
                share = sum(math.exp(s - total) for y, s in zip(ways, scores) if y[t] == k)
                assert math.exp(left[i, t, k] + right[i, t, k] - every[i]) == pytest.approx(share)
            seen += 1
    assert seen == 7


def slopes_agree(loss, batch, flat, rng):
    value, slope = loss(batch, flat)
    for k in rng.choice(len(flat), 25, replace=False):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert slope[k] == pytest.approx((loss(batch, up)[0] - loss(batch, down)[0]) / 2e-5, abs=1e-4)
    return value


def test_gradients():
    rng = np.random.default_rng(4)
    w = random_weights(rng)
    pages, batch = pages_batch(rng, [1, 4, 2, 5, 3])
    value = slopes_agree(sequence.loss_of(6, 3), batch, w.flat(), rng)
    want = 0.0
    for page in pages:
        ways = [score(w, page, y) for y in itertools.product(range(3), repeat=len(page))]
        want += math.log(sum(map(math.exp, ways))) - score(w, page, [x["y"] for x in page])
    assert value == pytest.approx(want)
    shape = (7, 3, 2, 4, 3)
    rows = pa.RecordBatch.from_pydict({"ids": pa.array(rng.integers(0, 7, (9, 3)).tolist(), pa.list_(pa.int32())), "y": pa.array(rng.integers(0, 3, 9), pa.int32()), "n": pa.array(rng.integers(1, 4, 9), pa.int64())})
    flat = rng.normal(0, 1, sum(int(np.prod(s)) for s in embedding.Network.shapes(*shape)))
    slopes_agree(embedding.loss_of(shape), rows, flat, rng)


def test_minimise_finds_the_least_squares(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (200, 4))
    y = x @ np.array([1.0, -2.0, 0.5, 3.0]) + rng.normal(0, 0.1, 200)
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, d double, y double").repartition(3)

    def loss(batch, w):
        m = np.stack([np.asarray(batch.column(c)) for c in "abcd"], 1)
        r = m @ w - np.asarray(batch.column("y"))
        return float(r @ r) / 2, m.T @ r

    got = gradient.minimise(rows, loss, np.zeros(4), l2=0.0, rounds=30, tolerance=1e-12)
    assert got == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0], abs=1e-4)
    assert gradient.total(rows.limit(0), loss, np.zeros(4))[0] == 0.0


def accuracy(found, truth, keys, label):
    both = found.join(truth.select(*keys, F.col(label).alias("_true")), keys)
    return both.agg(F.avg((F.col(label) == F.col("_true")).cast("int"))).first()[0]


def test_contents_levels_depend_on_the_lines_before(spark, data, tmp_path):
    """A line without number has the level of those before: a chain knows it, a model of single lines does not."""
    rows = A.contents_lines(spark, data).withColumn("processed", report.coded_heading(F.col("text"))).cache()
    train, test = N.hold_out(rows, "doc_id", 30)
    card = N.CARDS["heading_id_toc"]
    model = N.fit(card, train)
    keys = ["doc_id", "line_num"]
    chain = accuracy(N.classify(model, test, card.label), test, keys, card.label)
    alone = rows.withColumn("page_num", F.col("line_num"))  # each line a page of its own
    single = N.classify(N.fit(card, alone.join(train.select("doc_id").distinct(), "doc_id", "left_semi")), alone.join(test.select("doc_id").distinct(), "doc_id", "left_semi"), card.label)
    assert chain > 0.92 and chain > accuracy(single, test, keys, card.label) + 0.05
    N.save(model, str(tmp_path), card.name, "m")
    again = N.load(str(tmp_path), card.name, "m")
    out = lambda m: sorted((r.doc_id, r.line_num, r.heading, round(r.proba, 9)) for r in N.classify(m, test, card.label).collect())
    assert out(again) == out(model)
    assert N.classify(model, test.limit(0), card.label).count() == 0
    odd = spark.createDataFrame([(1, 1, None, None, 9), (1, 1, None, None, 9), (1, None, "x", 0.1, 9)], "doc_id long, line_num long, processed string, left double, prediction long").drop("prediction")
    assert N.classify(model, odd, card.label).count() == 3
    with pytest.raises(ValueError):
        N.fit(card, train.withColumn("heading", F.lit(None).cast("int")))


def test_places_of_tokens_count(spark, tmp_path):
    """The same tokens in another order are another class, which counts of tokens cannot tell."""
    rnd = random.Random(2)
    rows = []
    for i in range(900):
        a, b = rnd.sample(["word", "bigNum", "tab", "month"], 2)
        tokens = [rnd.choice(["word", "smallNum"]) for _ in range(rnd.randrange(3))] + [a, b]
        rows.append((i, " ".join(tokens), int(["word", "bigNum", "tab", "month"].index(a) < ["word", "bigNum", "tab", "month"].index(b))))
    frame = spark.createDataFrame(rows, "id long, shapes string, tag int")
    train, test = N.hold_out(frame, "id", 30)
    card = N.CARDS["page_id"]
    model = N.fit(card, train)
    assert accuracy(N.classify(model, test, "tag"), test, ["id"], "tag") > 0.95
    counted = textmodel.TextBayes(inputCol="shapes", labelCol="tag", ngrams=1, alpha=0.2).fit(train).transform(test)
    assert accuracy(counted.select("id", F.col("prediction").alias("tag")), test, ["id"], "tag") < 0.75
    N.save(model, str(tmp_path), "page_id", "m")
    again = N.load(str(tmp_path), "page_id", "m")
    assert sorted(map(tuple, N.classify(again, test, "tag").collect())) == sorted(map(tuple, N.classify(model, test, "tag").collect()))
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "tab " * 300, 5)], "id long, shapes string, _ids int")
    assert N.classify(model, odd.drop("_ids"), "tag").count() == 3 and N.classify(model, test.limit(0), "tag").count() == 0


def test_page_numbers_in_five_places(spark, data):
    from quirefold.plans import learning

    truth = {r.line_id: r.position for r in A.marginal_lines(spark, data).collect()}
    assert {p for p in truth.values()} == {None, 0, 1, 2, 3, 4}
    got = {r.line_id: r.position for r in learning.page_number_model(spark, data).collect()}
    assert set(got) == {k for k, p in truth.items() if p is not None}
    assert sum(-1 - got[k] == truth[k] for k in got) > 0.97 * len(got)
    tags = {r.line_id: r.tag for r in learning.page_id_model(spark, data).collect()}
    assert sum(tags[k] == (p is not None) for k, p in truth.items()) > 0.97 * len(truth)


def test_text_model_in_a_pipeline(spark, tmp_path):
    rnd = random.Random(4)
    rows = []
    for i in range(240):
        y = i % 3
        words = [rnd.choice([["hole", "bore"], ["cost", "budget"], ["map", "sheet"]][y]) for _ in range(rnd.randrange(1, 5))] + [str(rnd.randrange(10 ** (y + 1)))]
        rows.append((i, " ".join(words), *[float(rnd.random()) for _ in range(7)], y if i % 5 else None))
    card = N.CARDS["heading_id_intext_no_toc"]
    names = ", ".join(f"{f} double" for f in card.features)
    frame = spark.createDataFrame([*rows, (900, None, *[0.0] * 7, None), (901, "", *[0.0] * 7, None)], f"id long, text string, {names}, heading int")
    model = N.fit(card, frame)
    found = {r.id: r.heading for r in N.classify(model, frame, "heading").collect()}
    assert len(found) == len(rows) + 2 and sum(found[r[0]] == r[0] % 3 for r in rows) > 0.9 * len(rows)
    path = N.save(model, str(tmp_path), card.name, "m")
    N.save(model, str(tmp_path), card.name, "m")  # over itself
    again = N.load(str(tmp_path), card.name, "m")
    assert isinstance(again, PipelineModel) and path.endswith(card.name)
    assert {r.id: r.heading for r in N.classify(again, frame, "heading").collect()} == found
    bayes = model.stages[1]
    assert again.stages[1].classes == bayes.classes == [0.0, 1.0, 2.0]
    assert again.stages[1].getOrDefault("norm") is True and again.stages[1].getOrDefault("alpha") == 1.0
    whole = bayes.table.agg(*[F.sum(F.col("w")[k]) for k in range(3)]).first()
    assert [round(x, 9) for x in whole] == [1.0, 1.0, 1.0]  # each class's weights are parts of their sum
    p = bayes.transform(frame.withColumn("_coded", F.col("text"))).select(vector_to_array("_nbp").alias("p")).collect()
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in p)
    assert bayes.transform(frame.withColumn("_coded", F.col("text")).limit(0)).count() == 0
    with pytest.raises(ValueError):
        textmodel.TextBayes(inputCol="text", labelCol="heading").fit(frame.filter("heading is null"))


def evaluate_forest(described, values):
    """The class that the written splits of a forest give: votes are the trees' leaf predictions."""
    trees, lines = [], described.split("\n")
    for line in lines[1:]:
        if line.strip().startswith("Tree "):
            trees.append([])
        elif line.strip():
            trees[-1].append(line)
    votes = {}
    for tree in trees:
        at = 0
        while True:
            line = tree[at].strip()
            if line.startswith("Predict:"):
                y = float(line.split()[1])
                votes[y] = votes.get(y, 0) + 1
                break
            feature, op, value = re.match(r"If \(feature (\d+) (<=|in|not in|>) (.*)\)$", line).groups()
            depth = len(tree[at]) - len(tree[at].lstrip())
            member = {float(x) for x in value.strip("{}").split(",")} if "in" in op else None
            holds = {"<=": lambda v: v <= float(value), ">": lambda v: v > float(value), "in": lambda v: v in member, "not in": lambda v: v not in member}[op](values[int(feature)])
            at += 1
            if not holds:
                while not (tree[at].lstrip().startswith("Else") and len(tree[at]) - len(tree[at].lstrip()) == depth):
                    at += 1
                at += 1
    return votes


def test_trees_as_written_out(spark):
    """A tree's predictions are those of its written splits, walked row by row."""
    rnd = random.Random(6)
    rows = [(i, *[rnd.choice([0.0, 1.0, rnd.random() * 5]) for _ in range(12)], int(rnd.random() < 0.5)) for i in range(300)]
    card = N.CARDS["marginal_lines"]
    rows = [(*r[:-1], int(r[3] + r[5] > 4 or r[-1] and r[8] > 2)) for r in rows]
    frame = spark.createDataFrame(rows, f"id long, {', '.join(f'{f} double' for f in card.features)}, marginal int")
    model = N.fit(card, frame)
    forest = model.stages[-1]
    shares = {r.id: (r.marginal, r.proba) for r in N.classify(model, frame, "marginal").collect()}
    trees = forest.trees
    for r in rows[:60]:
        votes = [evaluate_forest(f"x\nTree 0\n{t.toDebugString.split(chr(10), 1)[1]}", r[1:13]) for t in trees]
        ones = sum(1.0 in v for v in votes)
        if abs(ones - len(trees) / 2) > len(trees) / 4:  # trees are weighed by their leaves' shares: a clear majority decides
            assert shares[r[0]][0] == int(ones > len(trees) / 2)
    toc = N.CARDS["toc"]
    pages = spark.createDataFrame([(i, *[float(rnd.randrange(6)) for _ in range(5)]) for i in range(300)], f"id long, {', '.join(f'{f} double' for f in toc.features)}")
    pages = pages.withColumn("toc_page", ((F.col("num_children") > 3) & (F.col("contains_list_of") <= 2)).cast("int"))
    tree = N.fit(toc, pages)
    got = {r.id: r.toc_page for r in N.classify(tree, pages, "toc_page").collect()}
    written = f"x\nTree 0\n{tree.stages[-1].toDebugString.split(chr(10), 1)[1]}"
    assert all(evaluate_forest(written, [r[f] for f in toc.features]) == {float(got[r.id]): 1} for r in pages.collect())


def test_lines_of_the_same_features_are_scored_once():
    """Also in batches that are packed into rows: the same loss and slope as of the pages."""
    rng = np.random.default_rng(3)
    kinds = [[1, 5, 2], [5, 1, 2], [7], [0, 3]]
    pages = [[{"f": kinds[rng.integers(4)], "y": int(rng.integers(3))} for _ in range(n)] for n in (1, 4, 7, 3, 4)]
    whole = pa.RecordBatch.from_arrays([pa.array(pages, pa.list_(pa.struct([("f", pa.list_(pa.int32())), ("y", pa.int32())])))], names=["lines"])
    assert len(sequence.Batch(whole.column("lines")).many) == len({tuple(x["f"]) for p in pages for x in p}) < sum(map(len, pages))
    loss, w = sequence.loss_of(8, 3), rng.normal(size=8 * 3 + 9 + 6)
    packed = pa.Table.from_batches([sequence.Batch(whole.column("lines").slice(a, n)).packed() for a, n in ((0, 2), (2, 3))]).combine_chunks().to_batches()[0]
    (value, slope), (again, slope_again) = loss(whole, w), loss(packed, w)
    assert packed.num_rows == 2 and np.isclose(value, again) and np.allclose(slope, slope_again)
    near = 1e-5 * np.eye(len(w))
    assert np.allclose(slope, [(loss(packed, w + e)[0] - loss(packed, w - e)[0]) / 2e-5 for e in near], atol=1e-5)
