"""What makes a query's work grow faster than its input: plans that take a table for small, and steps that move every term."""

import math
import random
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from quirefold.operators import blocks, headings, learning, lines, numbered, tables, textmodel
from quirefold.plans import adapters, catalogue
from quirefold.sources import office, pdf_marks, word


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_a_row_meet_without_a_join(spark):
    rows = [("t", 1, 1, "aab"), ("t", 1, 2, "ab"), ("t", 1, 2, "c"), ("t", 1, 3, None), ("t", 1, 4, "zz"), ("t", 2, 1, "ab"), ("t", None, 1, "ab"), ("t", None, 2, "ab"), ("t", 3, None, "ab"), ("t", 3, 2, "ab")]
    cells = spark.createDataFrame(rows, "table_id string, row long, col long, value string")
    found = tables.row_similarity(cells)
    assert "Join" not in plan_of(found)
    assert [(r.table_id, r.row, r.col, r.other_col, round(r.similarity, 6)) for r in found.collect()] == [("t", 1, 1, 2, round(3 / (5 * 3) ** 0.5, 6))]


def test_terms_of_single_texts_are_not_shuffled(spark, data):
    """Only texts and the terms of groups are: no exchange has a row for each text and term."""
    docs = spark.createDataFrame([(i, "red fish blue fish " * (i + 1)) for i in range(40)], "doc_id long, text string")
    groups = textmodel.Groups.of(docs, "doc_id", "text", 2)
    words = textmodel.with_idf(groups.words(docs), 40)
    plan = plan_of(groups.weights(docs, words))
    assert "explode" not in plan and "Join" not in plan
    assert {(r.term, round(r.idf, 6)) for r in words.collect()} == {(t, round(1 + math.log(41 / 41), 6)) for t in ("red", "fish", "blue", "red fish", "fish blue", "blue fish")} | {("fish red", round(1 + math.log(41 / 40), 6))}


def test_odd_rows_of_text_models(spark):
    """Rows of one id are one text, whose pairs do not reach from row to row; null ids and texts, and no rows at all."""
    docs = spark.createDataFrame([(1, "aa bb"), (1, "cc aa"), (None, "aa"), (2, None), (3, "x y"), (4, "")], "doc_id long, text string")
    groups = textmodel.Groups.of(docs, "doc_id", "text", 2)
    found = {r["_key"]: r for r in groups.weights(docs, textmodel.with_idf(groups.words(docs), 2)).collect()}
    assert set(found) == {1, None} and (found[1].n_terms, found[None].n_terms) == (5, 1)
    aa, rest = 2 * 1.0, math.log(3 / 2) + 1
    assert math.isclose(found[1].total, (aa + 4 * rest) / math.sqrt(aa**2 + 4 * rest**2)) and found[None].top == 1
    nothing = docs.limit(0)
    assert groups.weights(nothing, textmodel.with_idf(groups.words(nothing), 0)).count() == 0


def test_a_small_file_of_many_rows_is_not_broadcast(spark):
    """Scores and vocabularies compress well: the size of their files says little of their rows."""
    rows = spark.createDataFrame([(i, f"about {'high' if i % 2 else 'low'}", i % 2) for i in range(20)], "repno long, text string, y int")
    model = textmodel.TextBayes(inputCol="text", labelCol="y").fit(rows)
    found = model.transform(rows)
    assert "BroadcastExchange" not in plan_of(found)
    assert all(r.prediction == r.y for r in found.collect())


def test_word_files_are_opened_by_their_paths(spark, data, tmp_path):
    """A listing of the files of all documents by the driver, and tasks of a few files each, grow too fast."""
    found = catalogue.word_sections(spark, data)
    assert "binaryFile" not in plan_of(found) and found.count() > 0
    rows = spark.createDataFrame([(i, 0, f"h{i}", 1, 1, f"text {i}") for i in range(30)], "doc_id long, ord int, heading string, level int, line_num int, text string")
    files = word.write_sections(rows, str(tmp_path / "w"), folders=4).cache()
    paths = [r.path for r in files.collect()]
    assert len(paths) == 30 and 1 < len({p.rsplit("/", 1)[0] for p in paths}) <= 4
    by_path, listed = office.word_documents_of(files, str(tmp_path / "w")), office.word_documents(spark, str(tmp_path / "w"))
    plain = lambda df: sorted((r.path.removeprefix("file:"), r.kind, r.table_num, r.row, r.col, r.text) for r in df.collect())
    assert plain(by_path) == plain(listed) and len(plain(listed)) >= 60
    assert office.word_documents_of(files.limit(0), str(tmp_path / "w")).count() == 0
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    named = lambda name: spark.createDataFrame([(str(tmp_path / name),)], "path string")
    assert office.word_documents_of(named("broken.docx"), str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="absent.docx"):
        office.word_documents_of(named("absent.docx"), str(tmp_path)).count()


def test_lines_do_not_carry_the_words_of_all_headings(spark):
    """Pairs of a least similarity meet by their words, without a document's order of words on each line."""
    lines = spark.createDataFrame([(1, 1, "a b c"), (1, 2, "a a"), (1, 3, None), (2, 1, "a b")], "doc_id long, line_num long, text string")
    heads = spark.createDataFrame([(1, 1, 1, "A b\t7"), (1, 2, 1, "a"), (2, 9, 1, "z")], "doc_id long, heading_id long, level long, heading string")
    found = headings.similar_at_least(lines, heads, 0.5)
    assert "_order" not in plan_of(found)
    assert sorted((r.doc_id, r.line_num, r.heading_id, round(r.similarity, 6)) for r in found.collect()) == [(1, 1, 1, 0.666667), (1, 2, 2, 0.5)]


def test_marks_of_few_bytes_go_to_many_tasks(spark):
    """What a file takes is time: partitions of it are not put together for their few bytes."""
    pdfs = adapters.pdfs(spark.range(40).selectExpr("id as doc_id", "cast(2 as int) as n_pages"))
    marks = spark.range(40).selectExpr("id as doc_id", "0L as ord", "cast(null as bigint) as parent", "concat('t', id) as title", "2L as page_num")
    links = spark.createDataFrame([], "doc_id bigint, page_num bigint, x0 double, y0 double, x1 double, y1 double, to_page bigint")
    marked = pdf_marks.add_marks(pdfs, marks, links)
    assert "REPARTITION_BY_NUM" in plan_of(marked)
    found = pdf_marks.outlines(marked, content="marked")
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(map(tuple, found.collect())) == [(i, 0, None, f"t{i}", 2) for i in range(40)]


def test_only_needed_references_are_sent(spark):
    """Tables are not joined to the references of all blocks: their own go with their numbers."""
    rel = lambda kind, *ids: [(kind, list(ids))]
    rows = [
        (1, 1, "t", "TABLE", None, None, None, None, [], rel("CHILD", "c")), (1, 2, "c", "CELL", None, 1, 1, None, [], rel("CHILD", "w")), (1, 3, "w", "WORD", "x", None, None, None, [], []),
        (1, 4, "k", "KEY_VALUE_SET", None, None, None, None, ["KEY"], rel("VALUE", "v") + rel("CHILD", "w")), (1, 5, "v", "KEY_VALUE_SET", None, None, None, None, [], rel("CHILD", "w")), (1, 0, "t0", "TABLE", None, None, None, None, [], []),
    ]
    kinds = "doc_id long, ord long, id string, block_type string, text string, row_index long, col_index long, selection_status string, entity_types array<string>, relationships array<struct<type:string,ids:array<string>>>"
    given = spark.createDataFrame(rows, kinds)
    cells = blocks.table_cells(given)
    assert plan_of(cells).count("SortMergeJoin") + plan_of(cells).count("HashJoin") <= 3
    assert [(r.table_num, r.row, r.col, r.text) for r in cells.collect()] == [(2, 1, 1, "x ")]
    assert [(r.key, r.value) for r in blocks.key_values(given).collect()] == [("x ", "x ")]


@pytest.mark.parametrize("name", ["marginal_lines", "heading_id_intext_no_toc"])
def test_features_are_made_once_for_fitting_and_prediction(spark, name):
    """A forest reads its rows several times: what they are made of must not be made again each time."""
    card, made = learning.CARDS[name], spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    given = spark.range(200).selectExpr("id", "concat(if(id % 2 = 0, 'high', 'low'), ' hill') as text", *[f"cast(id % 2 as double) as {f}" for f in card.features])
    rows = given.mapInArrow(count, given.schema).withColumn(card.label, F.when(F.col("id") < 150, (F.col("id") % 2).cast("int")))
    found = learning.learn_and_classify(card, rows)
    assert {r.id: r[card.label] for r in found.collect()} == {i: i % 2 for i in range(200)}
    assert set(found.columns) == {"id", "text", *card.features, card.label, "proba"} and made.value == 200
    none = learning.learn_and_classify(card, rows, masked=True)
    assert {r.id for r in none.collect()} == {i for i in range(200) if i % 2}


def test_stacked_models_of_one_text_share_its_model(spark, data, monkeypatch):
    """Both models of in-text headings read one text: it is fitted and scored once, not twice and four times."""
    calls = []
    for kind, name in ((textmodel.TextBayes, "_fit"), (textmodel.TextBayesModel, "_transform"), (learning, "complement_scores")):
        monkeypatch.setattr(kind, name, lambda *a, f=getattr(kind, name), name=name: calls.append(name) or f(*a))
    assert catalogue.queries()["heading_full_model"](spark, data).count() > 0 and calls == ["complement_scores"]
    cards = [learning.CARDS[n] for n in ("heading_id_intext", "heading_id_intext_no_toc")]
    rows = spark.range(60).selectExpr("id", "if(id % 2 = 0, 'high hill', 'low land') as text", *[f"cast(id % 3 as double) as {f}" for f in cards[0].features], "if(id < 50, cast(id % 2 as int), null) as heading")
    for found in learning.learn_and_classify_each(cards, rows):
        assert {r.id: r.heading for r in found.collect()} == {i: i % 2 for i in range(60)} and found.columns == ["id", "text", *cards[0].features, "heading", "proba"]
    assert calls[1:] == ["_fit", "_transform"]
    labelled = rows.filter("heading is not null").withColumn("text", F.expr("if(id = 2, null, if(id = 4, '7.1 high', text))"))
    model = textmodel.TextBayes(inputCol="_coded", labelCol="heading", alpha=cards[0].alpha, norm=True, predictionCol="_nb")
    coded = textmodel.CodedNumbers(inputCol="text", outputCol="_coded").transform(labelled)
    expected = {r.id: r._nb for r in model.fit(coded).transform(coded).collect()}
    seen = []
    monkeypatch.setattr(learning, "materialize", lambda df, name, *a, f=learning.materialize: seen.append(f(df, name, *a)) or seen[-1])
    assert learning.learn_and_classify_each(cards, labelled)[0].count() == 50 and {r.id: r._nb for r in seen[0].collect()} == expected
    with pytest.raises(ValueError, match="different texts"):
        learning.learn_and_classify_each([cards[0], learning.CARDS["heading_classification"]], rows)


def test_ids_meet_in_tasks_of_so_many_rows(spark, data, monkeypatch):
    """Ids and small numbers take few bytes in a shuffle: tasks put together by bytes would have any number of rows."""
    assert "ENSURE_REQUIREMENTS" not in plan_of(catalogue.id_list_match(spark, data))
    monkeypatch.setattr(lines, "IDS_PER_TASK", 10)
    rows = spark.createDataFrame([*[(i // 2, i) for i in range(200)], (None, 1), (7, None)], "doc_id long, n long")
    listed = spark.createDataFrame([(i,) for i in (*range(50), 7, 500, None)], "doc_id long")
    found = lines.with_ids(rows, listed, "doc_id")
    assert found.rdd.getNumPartitions() == 21 and "ENSURE_REQUIREMENTS" not in plan_of(found.distinct())
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.filter("doc_id < 50").collect()))
    assert lines.with_ids(rows.limit(0), listed, "doc_id").count() == lines.with_ids(rows, listed.limit(0), "doc_id").count() == 0


def test_tokens_are_numbered_once_for_fitting_and_prediction(spark):
    card, made = learning.CARDS["page_id"], spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    given = spark.range(120).selectExpr("id", "if(id % 2 = 0, 'page smallNum ', 'word tab word ') as shapes")
    rows = given.mapInArrow(count, given.schema).withColumn("tag", F.when(F.col("id") < 90, (F.col("id") % 2).cast("int")))
    found = learning.learn_and_classify(card, rows)
    assert {r.id: r.tag for r in found.collect()} == {i: i % 2 for i in range(120)}
    assert found.columns == ["id", "shapes", "tag", "proba"] and made.value == 120


def test_words_of_a_line_are_split_once(spark):
    lines_ = spark.createDataFrame([(1, 1, "a b c")], "doc_id long, line_num long, text string")
    heads = spark.createDataFrame([(1, 1, 1, "A b")], "doc_id long, heading_id long, level long, heading string")
    found = headings.similarities(lines_, heads)
    assert max(line.count("split(lower(text") for line in plan_of(found).split("\n") if "Project" in line) == 1
    assert [round(r.similarity, 6) for r in found.collect()] == [0.666667]


@pytest.mark.parametrize("block", [512, 4])
def test_cells_of_a_table_meet_in_blocks(spark, monkeypatch, block):
    """No pair of cells is a row before it is compared, and tables of many cells are not held whole."""
    monkeypatch.setattr(tables, "BLOCK", block)
    values = ["Ab", "ba  c", "", None, "zz", "é\U0001f600"]
    rows = [("t", r, c, f"h{c}", values[(r * 3 + c) % 6]) for r in range(1, 5) for c in (1, 2, 3)] + [("t", 2, 2, "h2", "twice"), ("t", 3, None, "h", "ab"), ("t", None, 1, "h1", "ab"), (None, 1, 1, "h1", "ab"), ("u", 1, 1, "a", "A"), ("one", 0, 1, "x", "x")]
    rows += [("d", 1, 1, "d", "abc")] * 9  # two places, three blocks
    cells = spark.createDataFrame(rows, "table_id string, row long, col long, header string, value string")
    every = [(t, r, c, v) for t, r, c, _, v in rows] + sorted({(t, 0, c, h) for t, _, c, h, _ in rows}, key=str)
    every = [(t, r, c, Counter((v or "").lower().replace("  ", " "))) for t, r, c, v in every if t is not None and r is not None]
    size = lambda n: math.sqrt(sum(x * x for x in n.values()))
    expected, lined = [], []
    for t, r, c, n in every:
        for t2, r2, c2, m in every:
            level = None not in (c, c2)
            if t == t2 and (r < r2 or (r == r2 and level and c < c2)):
                s = round(sum(x * m[k] for k, x in n.items()) / (size(n) * size(m)), 9) if n and m else 0
                expected.append((t, r, c, r2, c2, s))
                lined += [(t, "row", r, c, r2, c2, s)] if r == r2 else [(t, "column", r, c, r2, c2, s)] if level and c == c2 else []
    plain = lambda df: sorted((str((*r[:-1], round(r[-1], 9) + 0.0)) for r in df.collect()))
    whole, lines_ = tables.table_similarity(cells), tables.line_similarity(cells)
    assert "Join" not in plan_of(whole) + plan_of(lines_)
    assert plain(whole) == sorted(str((*x[:-1], x[-1] + 0.0)) for x in expected)
    assert plain(lines_) == sorted(str((*x[:-1], x[-1] + 0.0)) for x in lined)
    sums = {r.table_id: r for r in tables.table_similarity_summary(cells).collect()}
    for t in {x[0] for x in expected}:
        got = [x[-1] for x in expected if x[0] == t]
        assert sums[t].n_pairs == len(got) and math.isclose(sums[t].closest, max(got), abs_tol=1e-8) and math.isclose(sums[t].average, sum(got) / len(got), abs_tol=1e-8)
    assert set(sums) == {x[0] for x in expected} and tables.line_similarity(cells.limit(0)).count() == 0


def bayes_tables(spark, folder):
    """Labelled texts of two classes, texts of other words with one of theirs, and odd ones."""
    rng = random.Random(5)
    texts = [" ".join(f"{'ab'[rng.random() < 0.3 + 0.4 * (i % 2)]}{rng.randrange(40)}" for _ in range(60)) for i in range(60)]
    texts += [f"{'ab'[i % 2]}{i % 40} " + f"x{i} " * 20 ** (i % 5) for i in range(80)]
    texts += ["", "a", "x1", "b3", "a3 a3"]
    spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


@pytest.mark.parametrize("name", ["cnb_pair_norm_predict", "cnb_pair_predict", "cnb_predict"])
def test_scores_are_rounded_at_the_whole_length_of_a_text(spark, tmp_path, name):
    """Words that no labelled text has belong to a text's length: where a model's weights are small, the rounded scores, and
    so the ties, depend on it."""
    bayes_tables(spark, tmp_path)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    expected = sorted(con.execute(catalogue.oracle_sql()[name]).fetchall())
    assert {y for _, y in expected} == {0, 1}
    assert sorted(map(tuple, catalogue.queries()[name](spark, str(tmp_path)).collect())) == expected


@pytest.mark.parametrize("name", ["cnb_pair_norm_predict", "cnb_pair_predict"])
def test_terms_are_sent_once(spark, tmp_path, monkeypatch, name):
    """A term goes to its part once and never comes back: groups get numbers, and of their own terms none. Rows of one id, null
    ids, labels of no class, of both and of no text as in the SQL."""
    bayes_tables(spark, tmp_path)
    monkeypatch.setattr(textmodel, "GROUP_CHARS", 50000)
    odd = spark.createDataFrame([(500, "b3 b4"), (500, "a3 a4 b4"), (None, "a1 b1"), (501, "\u00e9\u00e9 a1 \U0001f600 \U00010400\U00010400"), (502, " \n ")], "doc_id long, text string")
    odd.write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(500, 1, 0), (3, 1, 0), (4, 1, 0), (7, None, 0), (61, None, 0), (9999, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.mode("append").parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    found = catalogue.queries()[name](spark, str(tmp_path))
    assert "Join" not in plan_of(found)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, con.execute(catalogue.oracle_sql()[name]).fetchall()))
    for t in ("documents", "labels"):
        none = str(tmp_path / f"no_{t}")
        for u in ("documents", "labels"):
            rows = spark.read.parquet(f"{tmp_path}/{u}.parquet")
            (rows.limit(0) if t == u else rows).write.parquet(f"{none}/{u}.parquet")
        assert catalogue.queries()[name](spark, none).count() == 0


def test_groups_get_numbers_of_shared_terms_only():
    """Of two groups' terms those of one group alone come back as nothing, the others as counts and numbers."""
    kind = [("_g", pa.int32()), ("_part", pa.int32()), ("_texts", pa.int64()), ("_keys", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("_doc", "_term", "_tf", "_len", "_terms", "_n")]]
    out, sent = pa.schema([("_to", pa.int32()), *kind]), []
    for g, texts in enumerate([[["bb", "aa", "bb"], []], [["aa", "zz"], ["aa"]]]):
        rows = pa.table({"_key": [g * 10, g * 10 + 1], "_y": [0, 0], "_words": pa.chunked_array([pa.array(texts, pa.list_(pa.string()))])})
        sent.append(numbered.number_terms(g, rows, 1, 1, out))
    assert [t.num_rows for t in sent] == [2, 2] and [t["_texts"][0].as_py() for t in sent] == [1, 2]
    rows = pa.concat_tables(t.filter(pc.equal(t["_part"], 0)) for t in sent)
    back = pa.schema([(c, t) for c, t in kind if c not in ("_len", "_terms", "_n")] + [(c, pa.binary()) for c in ("_shared", "_df", "_id")])
    met = numbered.meet_terms(0, rows, back).to_pylist()
    assert [numbered.unpacked_bits(r["_shared"]).tolist() for r in met] == [[True, False], [True, False]]
    assert [(numbered.unpacked(r["_df"], "i8").tolist(), numbered.unpacked_steps(r["_id"]).tolist()) for r in met] == [([3], [0])] * 2
