import pytest
from pyspark.sql import functions as F

from strandwerk.functions import names
from strandwerk.operators.semantic import name_distance_stats

DOMAIN = {"Google.com": "Google", "Example.COM": "Example", ".com": "", "Example.museum": "Example", "St. John's Corp.com": "St. John's Corp", "St. Jude Medical": "St. Jude Medical", "L.L.Bean": "L.L.Bean", "Company.com Inc": "Company.com Inc"}
FIRST = {"St. Jude Medical": "ST.", "Google.com": "GOOGLE", "A.P. Moller - Maersk": "A.P.", "   ": None, "": None}
ACRONYM = {
    "Apple Computer Inc.": "AC", "Apple Inc.": None, "International Business Machines Corporation": "IBM", "IBM Corporation": "IBM", "The Apple Computer Company": "AC", "The And Of Company": None,
    "Apple A Computer Inc.": "AAC", "Apple a Computer Inc.": "AC", "A B C Company": "ABC", "A B C Computer Systems Inc.": "ABCCS", "  Apple  Computer  Inc.  ": "AC", "Apple\tComputer\tInc.": "AC",
    "3M Computer Systems Inc.": "3CS", "Johnson & Johnson Inc.": "JJ", "Coca-Cola Company": "CC", "X-FAB": "XF", "!!! @@@ ### Corporation": None, "123 456 789 Inc.": "147", "A ! B @ C # Company": "ABC",
    "IBM-HP Corporation": "IH", "The A Apple B Computer C Inc.": "AABCC", "Jean-Luc Corporation": "JL", "   Inc.   ": None, "Nike": None,
}
BASE = {"Apple Inc. ": "Apple", "Google LLC": "Google", "Nike": "Nike", "": None}
ENDING = {"Apple Inc.": "Inc.", "Tesla, Inc.": ", Inc.", "Apple": None}


@pytest.mark.parametrize(
    ("f", "cases"),
    [(names.strip_domain, DOMAIN), (names.first_word_key, FIRST), (names.acronym, ACRONYM), (names.base_name, BASE), (names.legal_ending, ENDING), (names.acronym_key, {"St. Jude Medical": "SJM", "Google.com": "GOOGLE", "International Business Machines.net": "IBM"})],
)
def test_name_functions(spark, f, cases):
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r.n: r.x for r in df.select("n", f(F.col("n")).alias("x")).collect()} == cases


def test_null_names(spark):
    df = spark.createDataFrame([(None,)], "n string")
    fs = (names.strip_domain, names.first_word_key, names.acronym, names.base_name, names.legal_ending, names.match_key)
    assert all(v is None for v in df.select(*[f(F.col("n")).alias(str(i)) for i, f in enumerate(fs)]).first())


def test_labels_and_edit_share(spark):
    df = spark.createDataFrame([(["IBM", "ibm", "gpu", "GPU", "X"],)], "a array<string>")
    assert df.select(names.labels(F.col("a"))).first()[0] == ["IBM", "Ibm", "Gpu", "GPU", "X"]
    p = spark.createDataFrame([("Apple", "Apple", 0.0), ("abc", "xyz", 1.0), ("Apple", "", 1.0), ("", "", 0.0)], "a string, b string, x double")
    assert all(r.x == r.y for r in p.withColumn("y", names.edit_share(F.col("a"), F.col("b"))).collect())


def test_name_distances(spark):
    b = spark.createDataFrame([("a", ["Apple"] * 3), ("b", ["Apple", "Apple", "Google"]), ("c", []), ("d", None)], "block_key string, names array<string>")
    r = {x.block_key: x for x in name_distance_stats(b).collect()}
    assert (r["a"].unique_names, r["a"].exact_duplicates, r["a"].max_lev) == (1, 2, 0)
    assert (r["b"].unique_names, r["b"].exact_duplicates) == (2, 1) and r["b"].max_lev > 0
    assert (r["c"].max_lev, r["c"].mean_lev) == (0, 0.0)
