"""Complement naive Bayes on TF-IDF of words and pairs of words, as tables: nothing is as large as the vocabulary but tables.

A model is a table (term, idf, w: a weight for each class); it is joined to the terms of the rows that it judges, so that
neither the driver nor a task holds the vocabulary. `TextBayes` is the same as a stage of an ML pipeline; its model can be
saved and loaded.

Defined results: a text without a term that the model knows, a null one too, has score 0 for all classes and gets the
smallest; of equal scores the smaller class; rows without label are not learnt from, no labelled row is an error; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quirefold.functions import text as X
from quirefold.operators import postings
from quirefold.sources.shared import materialize, ship

#: Classes that a text model may have.
MAX_CLASSES = 1000


#: Characters of a group of texts: a group's terms are counted, numbered and summed up by one task.
GROUP_CHARS = 8 << 20
#: Words of two characters or more.
WORD = r"(?U)\b\w\w+\b"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def has_words(text: Column) -> Column:
    return F.lower(text).rlike(WORD)


@dataclass(frozen=True)
class Groups:
    """Texts dealt to `n` groups by their key: a group's texts meet the group's part of a table of terms in one task.

    What is shuffled are texts, once for each meeting, and each term once for each group that has it; the terms of single
    texts, many times as large, never leave their task. Terms are words, and pairs of neighbouring words if ngrams is 2."""

    key: str
    text: str
    ngrams: int
    n: int

    @classmethod
    def of(cls, docs: DataFrame, key: str, text: str, ngrams: int) -> Groups:
        chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
        return cls(key, text, ngrams, max(docs.sparkSession.sparkContext.defaultParallelism, chars // GROUP_CHARS + 1))

    def group(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.n)).cast("int")

    def dealt(self, docs: DataFrame, y: str | None = None) -> DataFrame:
        """(_g, _key, _y, _words), grouped; words are taken after the texts have been shuffled."""
        ship(docs.sparkSession)
        rows = docs.select(self.group(self.key).alias("_g"), F.col(self.key).alias("_key"), (F.col(y) if y else F.lit(0)).alias("_y"), F.col(self.text).alias("_text"))
        return rows.repartition(2 * self.n, "_g").select("_g", "_key", "_y", words_of(F.col("_text")).alias("_words"))

    def words(self, docs: DataFrame) -> DataFrame:
        """(_g, term, _n): the number of a group's texts that have a term."""
        ngrams, schema = self.ngrams, T.StructType.fromDDL("_g int, term string, _n bigint")
        arrow = to_arrow_schema(schema)

        def run(group, rows):
            return postings.document_counts(group[0].as_py(), postings.Postings.of(rows, ngrams), arrow)

        return self.dealt(docs).groupBy("_g").applyInArrow(run, schema)

    def _meet(self, docs: DataFrame, words: DataFrame, summed, schema: T.StructType, y: str | None = None) -> DataFrame:
        """summed(postings, the group's words, Arrow schema) of each group of docs. words (_g, term, ...)."""
        ngrams, arrow = self.ngrams, to_arrow_schema(schema)

        def run(rows, table):
            if not rows.num_rows or not table.num_rows:
                return arrow.empty_table()
            return summed(postings.Postings.of(rows, ngrams), table, arrow)

        marks = words.repartition(2 * self.n, "_g")
        return self.dealt(docs, y).groupBy("_g").cogroup(marks.groupBy("_g")).applyInArrow(run, schema)

    def _keyed(self, docs: DataFrame, rest: str) -> T.StructType:
        return T.StructType([T.StructField("_key", docs.schema[self.key].dataType), *T.StructType.fromDDL(rest)])

    def weights(self, docs: DataFrame, words: DataFrame) -> DataFrame:
        """(_key, n_terms, total, top) of weights of length one. words (_g, term, idf)."""
        return self._meet(docs, words, postings.text_weights, self._keyed(docs, "n_terms bigint, total double, top double"))

    def class_sums(self, docs: DataFrame, words: DataFrame, y: str, classes: list) -> DataFrame:
        """(term, idf, _t, _s0, _s1, ...) by group: sums of weights of length one, of all texts and of each class."""
        schema = T.StructType.fromDDL("term string, idf double, _t double" + "".join(f", _s{i} double" for i in range(len(classes))))
        return self._meet(docs, words, lambda found, table, arrow: postings.class_sums(found, table, classes, arrow), schema, y)

    def scores(self, docs: DataFrame, words: DataFrame) -> DataFrame:
        """(_key, scores). words (_g, term, idf, w)."""
        return self._meet(docs, words, postings.text_scores, self._keyed(docs, "scores array<double>"))


def with_idf(words: DataFrame, n: int, min_df: int = 1) -> DataFrame:
    """(_g, term, idf): ln((1 + n) / (1 + df)) + 1 of terms of min_df of the n texts or more."""
    df = words.withColumn("_df", F.sum("_n").over(W.partitionBy("term"))).filter(F.col("_df") >= min_df)
    return df.select("_g", "term", (F.log(F.lit(1 + n) / (1 + F.col("_df"))) + 1).alias("idf"))


def classes_of(rows: DataFrame, y: str = "y") -> list:
    """The classes in order; there may be MAX_CLASSES at most, as each is a column or a literal of a model."""
    found = sorted(r[0] for r in rows.select(y).filter(F.col(y).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect())
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return found


def complement_table(sums: DataFrame, classes: list, alpha: float, norm: bool = False) -> DataFrame:
    """(term, idf, w) of the class sums of groups: the logarithm of a term's share in all other classes, negative, or as a
    part of all terms' if norm."""
    total = sums.groupBy("term").agg(F.first("idf").alias("idf"), *[F.sum(c).alias(c) for c in ("_t", *[f"_s{i}" for i in range(len(classes))])])
    rest = materialize(total.select("term", "idf", F.array(*[F.lit(alpha) + F.col("_t") - F.col(f"_s{i}") for i in range(len(classes))]).alias("c")), "complements")
    totals = rest.agg(*[F.sum(F.col("c")[i]).alias(f"s{i}") for i in range(len(classes))]).first()
    logs = [F.log(F.col("c")[i] / F.lit(totals[i])) for i in range(len(classes))]
    if norm:
        whole = rest.agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate(logs)]).first()
        logs = [x / F.lit(whole[i]) for i, x in enumerate(logs)]
    else:
        logs = [-x for x in logs]
    return rest.select("term", "idf", F.array(*logs).alias("w"))


def score_texts(groups: Groups, docs: DataFrame, words: DataFrame, table: DataFrame) -> DataFrame:
    """(key, scores) of the texts with a term of the table. words: (_g, term) of docs. The table is merged, never broadcast:
    the size of its compressed file says little of its rows."""
    # hashes are shorter than terms; one that terms share sends a group terms that it does not have, and these meet nothing
    of_term = F.xxhash64("term").alias("_h")
    known = words.select("_g", of_term).join(table.select("term", "idf", "w", of_term).hint("merge"), "_h").select("_g", "term", "idf", "w")
    return groups.scores(docs, known).select(F.col("_key").alias(groups.key), F.transform("scores", lambda x: F.round(x, 9)).alias("scores"))


def best_class(scores: Column, classes: list) -> Column:
    """The first class of the highest score; the first of all where there are no scores."""
    place = F.array_position(scores, F.array_max(scores)).cast("int")
    return F.when(scores.isNull(), F.lit(classes[0])).otherwise(F.element_at(F.array(*[F.lit(c) for c in classes]), place))


def classify_texts(docs: DataFrame, labels: DataFrame, key: str, text: str, ngrams: int = 2, min_df: int = 1, alpha: float = 0.2, norm: bool = False) -> DataFrame:
    """(key, predicted) of every row of docs, fitted on the rows with a label (key, y). The vocabulary, all terms of min_df
    labelled texts or more, is a table without a bound; idf comes from the labelled texts. The key is unique in both tables."""
    docs, labels = docs.select(key, text), labels.filter(F.col("y").isNotNull())
    known = materialize(docs.join(labels.hint("shuffle_hash"), key), "labelled")
    table, classes = fit_texts(known, key, text, "y", ngrams, min_df, alpha, norm)
    groups = Groups.of(docs, key, text, ngrams)
    found = score_texts(groups, docs, groups.words(docs), table)
    return docs.select(key).join(found.hint("merge"), key, "left").select(key, best_class(F.col("scores"), classes).alias("predicted"))


def fit_texts(known: DataFrame, key: str, text: str, y: str, ngrams: int, min_df: int, alpha: float, norm: bool) -> tuple[DataFrame, list]:
    """The model's table and its classes, of rows that all have a label."""
    sizes = {r["y"]: r["n"] for r in known.groupBy(F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        raise ValueError("no text has a label")
    classes = classes_of(known.select(F.col(y).alias("y")))
    known = known.select(key, text, F.col(y).alias("y"))
    groups = Groups.of(known, key, text, ngrams)
    words = with_idf(groups.words(known), sum(sizes.values()), min_df)
    return complement_table(groups.class_sums(known, words, "y", classes), classes, alpha, norm), classes


def numbered_rows(rows: DataFrame) -> tuple[DataFrame, str]:
    """rows, written once with a number of their own, and its name."""
    key = "_row"
    while key in rows.columns:
        key = f"_{key}"
    return materialize(rows.withColumn(key, F.monotonically_increasing_id()), "numbered"), key


class CodedNumbers(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Numbers as words of their length and points (`functions.text.coded_number`), other words as they are."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), X.coded_number(F.col(self.getInputCol()), remove_words=False))


class _TextBayesParams(HasInputCol, HasLabelCol, HasPredictionCol, HasRawPredictionCol, HasProbabilityCol):
    alpha = Param(Params._dummy(), "alpha", "added to each term's weight in a class", typeConverter=TypeConverters.toFloat)
    norm = Param(Params._dummy(), "norm", "whether a class's weights are parts of their sum", typeConverter=TypeConverters.toBoolean)
    ngrams = Param(Params._dummy(), "ngrams", "1: words, 2: words and pairs of words", typeConverter=TypeConverters.toInt)
    minDF = Param(Params._dummy(), "minDF", "least number of labelled texts of a term", typeConverter=TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(alpha=1.0, norm=False, ngrams=2, minDF=1)


class TextBayes(Estimator, _TextBayesParams, DefaultParamsReadable, DefaultParamsWritable):
    """The text model as a stage: adds the prediction (the class's place among the classes, which are 0, 1, ... in an ML
    pipeline), the scores and the probabilities."""

    @keyword_only
    def __init__(self, *, inputCol=None, labelCol="label", predictionCol="prediction", rawPredictionCol="rawPrediction", probabilityCol="probability", alpha=1.0, norm=False, ngrams=2, minDF=1) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TextBayesModel:
        text, y = self.getInputCol(), self.getLabelCol()
        rows, key = numbered_rows(dataset.filter(F.col(y).isNotNull()).select(text, y))
        table, classes = fit_texts(rows, key, text, y, self.getOrDefault("ngrams"), self.getOrDefault("minDF"), self.getOrDefault("alpha"), self.getOrDefault("norm"))
        return self._copyValues(TextBayesModel(materialize(table, "text_model"), [float(c) for c in classes]))


class TextBayesModel(Model, _TextBayesParams, MLReadable, MLWritable):
    def __init__(self, table: DataFrame | None = None, classes: list[float] | None = None) -> None:
        super().__init__()
        self.table, self.classes = table, classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows, key = numbered_rows(dataset)
        texts = rows.select(key, self.getInputCol())
        groups = Groups.of(texts, key, self.getInputCol(), self.getOrDefault("ngrams"))
        found = materialize(score_texts(groups, texts, groups.words(texts), self.table).select(F.col(key).alias("_k"), F.col("scores").alias("_s")), "text_scores")
        scores = F.coalesce("_s", F.array(*[F.lit(0.0) for _ in self.classes]))
        shares = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
        probability = F.transform(shares, lambda s: s / F.aggregate(shares, F.lit(0.0), lambda a, b: a + b))
        joined = rows.join(found.hint("merge"), F.col(key) == F.col("_k"), "left")
        added = [best_class(scores, self.classes).alias(self.getPredictionCol()), array_to_vector(scores).alias(self.getRawPredictionCol()), array_to_vector(probability).alias(self.getProbabilityCol())]
        return joined.select(*dataset.columns, *added)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    """The parameters and classes as metadata, the table beside them."""

    def __init__(self, model: TextBayesModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"classes": self.model.classes})
        self.model.table.write.parquet(f"{path}/table")


class _Reader(MLReader):
    def load(self, path: str) -> TextBayesModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = TextBayesModel(self.sparkSession.read.parquet(f"{path}/table"), metadata["classes"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
