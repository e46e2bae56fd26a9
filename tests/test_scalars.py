"""Golden vectors of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from quirefold.functions import text as X
from quirefold.functions.similarity import multiset_jaccard, word_counts


def value(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first()["x"]


CASES = [
    (lambda t: X.split_prefix(t)[0], "2.1 Authority to Prospect 5899M \t2", "2.1"),
    (lambda t: X.split_prefix(t)[1], "2.1 Authority to Prospect 5899M \t2", " Authority to Prospect 5899M \t2"),
    (lambda t: X.split_page_number(t)[0], " INTRODUCTION \t1", " INTRODUCTION "),
    (lambda t: X.split_page_number(t)[1], " INTRODUCTION \t1", "\t1"),
    (X.coded_number, "1.2", " cyfra1  punkt  cyfra2 "),
    (X.coded_number, "1.0", " cyfra1  punkt "),
    (X.coded_number, "10", " cyfra1 "),
    (X.coded_number, "0.5", " punkt  cyfra1 "),
    (X.coded_number, "007", " cyfra1 "),
    (X.coded_number, "\t12", " cyfra1 "),
    (lambda t: X.coded_number(t, remove_words=False), "a1b2", "a cyfra1 b"),
    (X.token_shapes, "CR 10980 \tPage 2", "word bigNum tab page smallNum "),
    (lambda t: X.token_shapes(t, literal_small=True), "APRIL, 2009 \t16", "month bigNum tab 16 "),
    (X.contains_number_token, "EPM 12", 1),
    (X.contains_number_token, "EPM12", 0),
    (X.starts_numbered, "1.2 Geology", 1),
    (X.starts_numbered, "Geology 1", 0),
    (X.rule_heading, "4.1 Introduction", 2),
    (X.rule_heading, "1. \tINTRODUCTION", 1),
    (X.rule_heading, "SUMMARY", 0),
    (X.normalized_header, "Hole No. (Site No.)", "hole no site no"),
    (X.normalized_header, "bh_id", "bhid"),
    (X.normalized_header, "hole #", "hole"),
    (X.site_name_class, "ESD8003", "valid"),
    (X.site_name_class, "Bore", "invalid_no_num"),
    (X.site_name_class, "Unnamed: 3", "invalid_nan"),
    (X.site_name_class, None, "invalid_nan"),
    (X.location_class, "506932", "valid"),
    (X.location_class, "145E", "valid"),
    (X.location_class, "AMG 505542", "valid"),
    (X.location_class, "20 deg 10 min S", "invalid"),
    (X.location_class, "", "invalid_nan"),
    (X.padded_number, "7", "007"),
    (X.padded_number, "123", "123"),
    (X.padded_number, "1234", "1234"),
    (X.page_number, "see 12", "12"),
    (X.page_number, "12 of 14", None),
    (X.figure_line, "Figure 3. Map", 1),
    (X.figure_line, "figures", 0),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_golden(spark, k):
    expression, text, expected = CASES[k]
    assert value(spark, expression, text) == expected


def test_multiset_jaccard(spark):
    a = word_counts(spark.createDataFrame([(1, "a b b c")], "l long, t string"), ["l"], F.col("t"))
    b = word_counts(spark.createDataFrame([(2, "b b b d")], "r long, t string"), ["r"], F.col("t"))
    assert multiset_jaccard(a, b, ["l"], ["r"]).first()["similarity"] == 2 / 6
