"""Models of the document engine: Spark ML pipelines by model card, and exact text scoring in plain DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.operators import embedding, sequence
from quirefold.operators.keys import page_keys
from quirefold.operators.metadata import confusion, stable_key, uncertain
from quirefold.operators.numbered import complement_scores
from quirefold.operators.pages import carry
from quirefold.operators.textmodel import CodedNumbers, TextBayes, best_class, classes_of, numbered_rows
from quirefold.sources.shared import materialize




@dataclass(frozen=True)
class ModelCard:
    """What a model is trained on: numeric features, an optional text column, the label, and the kind of estimator."""

    name: str
    features: tuple[str, ...]
    label: str
    kind: str  # tree, forest, text, stacked, sequence or tokens
    text: str | None = None
    alpha: float = 1.0
    norm: bool = False


# Features of each model by name.
_LINE = ("page_num", "words2width", "width", "height", "left", "contains_num", "word_count")
CARDS = {
    c.name: c
    for c in (
        ModelCard("toc", ("page_num", "num_children", "contains_toc_phrase", "contains_contents_word", "contains_list_of"), "toc_page", "tree"),
        ModelCard("toc_carried", ("page_num", "num_children", "contains_toc_phrase", "contains_contents_word", "contains_list_of", "prev_toc"), "toc_page", "tree"),
        ModelCard("fig", ("page_num", "med_confidence", "avg_confidence", "range_confidence", "iqr_confidence", "med_line_len", "contains_fig_word", "contains_fig_ln", "fig_pos"), "fig_page", "forest"),
        ModelCard("marginal_lines", ("page_num", "line_num", "normed_line_num", "words2width", "words_width", "width", "height", "left", "top", "contains_num", "contains_tab", "contains_page"), "marginal", "forest"),
        ModelCard("heading_id_toc", ("left",), "heading", "sequence", "processed"),
        ModelCard("heading_id_intext", (*_LINE, "matches_heading", "matches_type"), "heading", "stacked", "text", norm=True),
        ModelCard("heading_id_intext_no_toc", _LINE, "heading", "stacked", "text", norm=True),
        ModelCard("heading_classification", (), "heading_class", "text", "text", norm=True),
        ModelCard("page_id", (), "tag", "tokens", "shapes"),
        ModelCard("page_extraction", (), "position", "tokens", "shapes"),
        ModelCard("tables", (), "class", "text", "content", alpha=0.2),
    )
}


def pipeline(card: ModelCard, seed: int = 1) -> Pipeline:
    """The estimator of a card. Text models are complement naive Bayes over tables; stacked ones code the text's numbers and
    feed the text's class to a forest. Sequence and token models are no pipelines: see sequence.py and embedding.py."""
    assembler = VectorAssembler(inputCols=list(card.features), outputCol="features")
    if card.kind == "tree":
        return Pipeline(stages=[assembler, DecisionTreeClassifier(labelCol=card.label, seed=seed)])
    if card.kind == "forest":
        return Pipeline(stages=[assembler, RandomForestClassifier(labelCol=card.label, numTrees=30, seed=seed)])
    if card.kind == "text":
        return Pipeline(stages=[TextBayes(inputCol=card.text, labelCol=card.label, alpha=card.alpha, norm=card.norm)])
    if card.kind != "stacked":
        raise ValueError(f"{card.name} is no pipeline")
    coded = CodedNumbers(inputCol=card.text, outputCol="_coded")
    bayes = TextBayes(inputCol="_coded", labelCol=card.label, alpha=card.alpha, norm=card.norm, predictionCol="_nb", rawPredictionCol="_nbr", probabilityCol="_nbp")
    assembler = VectorAssembler(inputCols=["_nb", *card.features], outputCol="features")
    return Pipeline(stages=[coded, bayes, assembler, RandomForestClassifier(labelCol=card.label, numTrees=30, seed=seed)])


@dataclass(frozen=True)
class SequenceStage:
    """A sequence model over the lines of each page, with a pipeline model's `transform`."""

    model: sequence.SequenceModel
    text: str

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.predict(_line_pages(rows, self.text))


@dataclass(frozen=True)
class TokenStage:
    """A token model, with a pipeline model's `transform`."""

    model: embedding.TokenModel
    text: str

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.predict(rows, self.text)


def _line_pages(rows: DataFrame, text: str, label: str | None = None) -> DataFrame:
    """Rows of contents lines by page; those without a page number are a page a document."""
    keys = tuple(k for k in page_keys(rows) if k in rows.columns)
    left = F.col("left") if "left" in rows.columns else None
    given = rows.withColumn("_words", sequence.line_words(F.col(text)))
    given = given.withColumn("_features", sequence.line_features(F.col(text), left, words=F.col("_words")))
    return sequence.pages_of(given, keys, "line_num", F.col("_features"), label, besides=("_words", "_features"))


def fit(card: ModelCard, rows: DataFrame, **options) -> PipelineModel | SequenceStage | TokenStage:
    """Fit on the rows that have a label. A sequence model takes the pages whose lines all have one."""
    if card.kind == "sequence":
        return SequenceStage(sequence.fit(_line_pages(rows, card.text, card.label), **options), card.text)
    if card.kind == "tokens":
        return TokenStage(embedding.fit(rows, card.text, card.label, **options), card.text)
    return pipeline(card, **options).fit(rows.dropna(subset=[card.label]))


def classify(model: PipelineModel | SequenceStage | TokenStage, rows: DataFrame, label: str, masked: bool = False) -> DataFrame:
    """rows with the predicted label and `proba`, the probability of class 1; masked: only rows of a class above 0."""
    return _classes(model.transform(rows), [c for c in rows.columns if c != label], label, masked)


def learn_and_classify(card: ModelCard, rows: DataFrame, masked: bool = False, **options) -> DataFrame:
    """`classify` by a model that is fitted on the same rows. What the model reads is put together and written once for both:
    pages of a sequence model, numbers of tokens, else features, which a forest reads several times."""
    kept = [c for c in rows.columns if c != card.label]
    if card.kind == "sequence":
        pages = materialize(_line_pages(rows, card.text, card.label), "line_pages")
        return _classes(sequence.fit(pages, **options).predict(pages), kept, card.label, masked)
    if card.kind == "tokens":
        numbers = embedding.token_numbers(F.col(card.text), options.get("size", embedding.SIZE), options.get("places", embedding.PLACES))
        ready = materialize(rows.select("*", numbers.alias("_ids")), "token_numbers")
        return _classes(embedding.fit_numbers(ready, card.label, **options).predict_numbers(ready), kept, card.label, masked)
    if card.kind == "text":
        return classify(fit(card, rows, **options), rows, card.label, masked)
    if card.kind == "stacked":
        return learn_and_classify_each([card], rows, masked, **options)[0]
    *before, last = pipeline(card, **options).getStages()
    rows = materialize(rows, "model_rows")
    ready = Pipeline(stages=before).fit(rows.dropna(subset=[card.label])).transform(rows).select(*rows.columns, "features")
    return _classes(last.fit(ready.dropna(subset=[card.label])).transform(ready), kept, card.label, masked)


def learn_and_classify_each(cards: list[ModelCard], rows: DataFrame, masked: bool = False, **options) -> list[DataFrame]:
    """`learn_and_classify` by each of several stacked models of one text: its model is fitted, and the texts are scored, once
    for all forests."""
    if len({(c.kind, c.text, c.label, c.alpha, c.norm) for c in cards}) > 1 or cards[0].kind != "stacked":
        raise ValueError("stacked models of different texts")
    label, kept = cards[0].label, [c for c in rows.columns if c != cards[0].label]
    columns, (rows, key) = rows.columns, numbered_rows(rows)
    coded, bayes, *_ = pipeline(cards[0], **options).getStages()
    if rows.filter(F.col(label).isNull()).limit(1).count():
        scored = Pipeline(stages=[coded, bayes]).fit(rows.dropna(subset=[label])).transform(rows)
    else:  # the texts that are scored are those that the model is fitted on, and meet its terms while they are numbered
        classes = [float(c) for c in classes_of(rows, label)]
        texts = coded.transform(rows).select(key, coded.getOutputCol())
        found = complement_scores(texts, rows.select(key, F.col(label).cast("double").alias("y")), key, coded.getOutputCol(), classes, bayes.getOrDefault("ngrams"), bayes.getOrDefault("alpha"), bayes.getOrDefault("norm"))
        classed = found.select(key, best_class(F.col("scores"), classes).alias("_class")).hint("merge")
        scored = rows.join(classed, key, "left").withColumn(bayes.getPredictionCol(), F.coalesce("_class", F.lit(classes[0]))) if classes else rows.withColumn(bayes.getPredictionCol(), F.lit(0.0))
    scored = materialize(scored.select(*columns, bayes.getPredictionCol()), "text_classes", True)
    out = []
    for card in cards:
        *_, assembler, forest = pipeline(card, **options).getStages()
        ready = assembler.transform(scored)
        out.append(_classes(forest.fit(ready.dropna(subset=[label])).transform(ready), kept, label, masked))
    return out


def _classes(found: DataFrame, kept: list[str], label: str, masked: bool) -> DataFrame:
    out = found.select(*kept, F.col("prediction").cast("int").alias(label), F.try_element_at(vector_to_array("probability"), F.lit(2)).alias("proba"))
    return out.filter(F.col(label) > 0) if masked else out


def features_only(rows: DataFrame, *drop: str) -> DataFrame:
    """rows without columns that are no features; names that they lack are ignored."""
    return rows.drop("doc_id", "tag_method", *drop)


def carried_pages(model: PipelineModel, pages: DataFrame, label: str) -> DataFrame:
    """Contents pages by a model that knows whether the page before is one: (doc_id, page_num, is_toc).

    Each page is predicted for both cases, and the state is carried from page to page."""
    both = pages.drop("prev_toc").withColumn("prev_toc", F.explode(F.array(F.lit(0), F.lit(1))))
    given = both.withColumn("_p", F.col("prev_toc"))
    found = model.transform(given).select("doc_id", "page_num", "_p", F.col("prediction").cast("int").alias("_y"))
    sides = found.groupBy("doc_id", "page_num").agg(*[F.max(F.when(F.col("_p") == k, F.col("_y"))).alias(f"f{k}") for k in (0, 1)])
    return carry(sides)


def teach(rows: DataFrame, answers: DataFrame, keys: list[str], label: str) -> DataFrame:
    """rows with human labels: answers (keys, answer) replace the label and set tag_method to manual."""
    given = answers.filter(F.col("answer").isNotNull()).groupBy(*keys).agg(F.max("answer").alias("_answer"))
    out = rows.join(given, keys, "left")
    taught = F.col("_answer").isNotNull()
    out = out.withColumn(label, F.coalesce("_answer", label)).withColumn("tag_method", F.when(taught, "manual").otherwise(F.col("tag_method")))
    return out.drop("_answer")


def queue(rows: DataFrame, model: PipelineModel, label: str, key: str, n: int) -> DataFrame:
    """The n unlabelled rows that the model is least certain of, with `uncertainty`."""
    scored = model.transform(rows.filter(F.col(label).isNull()))
    return uncertain(scored, F.array_max(vector_to_array("probability")), key, n)


def score(model: PipelineModel, rows: DataFrame, label: str) -> DataFrame:
    """(y, predicted, n): the confusion counts of the rows with a label, of which accuracy and the rest follow."""
    out = model.transform(rows.dropna(subset=[label]))
    return confusion(out.select(F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("predicted")))


def human_rows(rows: DataFrame) -> DataFrame:
    """Rows whose labels people gave: on these a passively trained model is evaluated."""
    return rows.filter(F.col("tag_method").isin("manual", "legacy"))


def reset_auto(rows: DataFrame, label: str) -> DataFrame:
    """rows with automatic labels unset."""
    auto = F.coalesce(F.col("tag_method") == "auto", F.lit(False))
    return rows.withColumn(label, F.when(~auto, F.col(label)))


def training_plan(rows: DataFrame, label: str, n_queries: int) -> tuple[DataFrame, int]:
    """The rows and the number of questions of a training round: as many as are unlabelled at most; where everything is
    labelled, automatic labels are unset and asked for again."""
    unlabelled = rows.filter(F.col(label).isNull()).limit(max(n_queries, 1)).count()
    if unlabelled == 0:
        return reset_auto(rows, label), n_queries
    return rows, min(n_queries, unlabelled)


def round_of_learning(card: ModelCard, rows: DataFrame, key: str, n_queries: int, answers: DataFrame | None = None, **options) -> dict:
    """One round: without questions fit on all labelled rows and evaluate on those that people labelled; else fit, ask
    for the least certain rows, and with answers (key, answer) teach them and fit again.

    {"model", "rows", "queue", "confusion"}."""
    rows, n = training_plan(rows, card.label, n_queries) if n_queries else (rows, 0)
    model = fit(card, rows, **options)
    asked = queue(rows, model, card.label, key, n) if n else None
    if answers is not None:
        rows = teach(rows, answers, [key], card.label)
        model = fit(card, rows, **options)
    return {"model": model, "rows": rows, "queue": asked, "confusion": score(model, rows if n else human_rows(rows), card.label)}


def save(model: PipelineModel | SequenceStage | TokenStage, folder: str, name: str, mode: str) -> str:
    path = f"{folder}/{mode}/{name}"
    if isinstance(model, PipelineModel):
        model.write().overwrite().save(path)
    else:
        model.model.save(SparkSession.active(), path)
    return path


def load(folder: str, name: str, mode: str) -> PipelineModel | SequenceStage | TokenStage:
    """The model that was saved; sequence and token models by their card's name."""
    path, card = f"{folder}/{mode}/{name}", CARDS.get(name)
    if card and card.kind == "sequence":
        return SequenceStage(sequence.SequenceModel.load(SparkSession.active(), path), card.text)
    if card and card.kind == "tokens":
        return TokenStage(embedding.TokenModel.load(SparkSession.active(), path), card.text)
    return PipelineModel.load(path)


def hold_out(rows: DataFrame, key: str, percent: int = 20) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a scrambled whole-number key: the same at every run, whatever the partitions."""
    bucket = stable_key(F.col(key)) % 100
    return rows.filter(bucket >= percent), rows.filter(bucket < percent)


def padded_ids(docs: DataFrame, vocabulary: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """Each text as `length` word numbers of a vocabulary (word, id): unknown words are left out, zeros fill the left."""
    words = docs.select(key, F.posexplode(F.split(F.lower(F.col(text)), r"\s+")).alias("_p", "word"))
    known = words.join(vocabulary, "word", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("_p", "id")))).alias("_s"))
    ids = F.slice(F.reverse(F.transform("_s", lambda x: x["id"])), 1, length)
    return known.select(key, F.concat(F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size(ids)), F.reverse(ids)).alias("sequence"))


def first_seen_codes(rows: DataFrame, label: str, order: str) -> DataFrame:
    """(label, code): labels numbered from 0 by their first appearance. Ranges of labels are numbered apart, and only the
    ranges' sizes meet in one task."""
    first = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.min(order).alias("_o"))
    ranges = materialize(first.repartitionByRange("_o").withColumn("_r", F.spark_partition_id()), "label_ranges")
    before = W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.groupBy("_r").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy("_r").orderBy("_o", label)) - 1
    return ranges.withColumn("_p", place).join(starts, "_r").select(label, (F.col("_start") + F.col("_p")).cast("long").alias("code"))
