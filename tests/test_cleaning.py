from pyspark.sql import functions as F

from flowquarry.functions.cleaning import to_number
from flowquarry.operators import columns


def test_to_number(spark):
    texts = ["1.5", " 2 ", "Infinity", "-inf", "NaN", "abc", "", None, "1e3", "1d", "2.5F"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(to_number("t")).collect()]
    assert got == [1.5, 2.0, 0, 0, 0, 0, 0, 0, 1000.0, 0, 0]


def test_doubles_are_cleaned_without_parsing(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,), (2.0,)], "x double")
    assert [r[0] for r in columns.clean_numbers(df, ["x"]).collect()] == [0, 0, 0, 2.0]


def test_column_profile_and_checks(spark):
    rows = [("1", "a", "5", None), ("2", "b", "5", "1"), ("x", "c", "5", None), ("4", "d", "5", None)]
    df = spark.createDataFrame(rows, "n string, t string, c string, s string")
    profile = columns.column_profile(df)
    shares = {r["column"]: r["numeric_share"] for r in profile.collect()}
    assert shares == {"n": 0.75, "t": 0.0, "c": 1.0, "s": 0.25}
    names = lambda d: {r["column"] for r in d.collect()}
    assert names(columns.numeric_columns(profile, 0.7)) == {"n", "c"}
    assert names(columns.numeric_columns(profile, 0.8, of_present=True)) == {"c", "s"}
    assert names(columns.dense_columns(profile)) == {"n", "t", "c"}
    assert names(columns.varying_columns(profile)) == {"n", "s"}
    assert columns.model_columns(df.withColumn("id", F.lit(1)), numeric_share=0.7) == ["n"]


def test_names_with_blanks_and_slashes(spark):
    df = spark.createDataFrame([("1", "2")], ["Flow Bytes/s", "a.b"])
    assert [r.asDict() for r in columns.long_form(df, ["Flow Bytes/s", "a.b"]).orderBy("feature").collect()] == [
        {"feature": "Flow Bytes/s", "value": 1.0}, {"feature": "a.b", "value": 2.0}]
    assert columns.project_features(df, ["Flow Bytes/s", "gone"]).columns == ["Flow Bytes/s"]


def test_column_classes_first_match_wins(spark):
    names = ["Flow ID", "Src IP", "Flow Duration", "FIN Flag Count", "Total Fwd Packet", "Down/Up Ratio",
             "Active Mean", "Dst Port", "Label", "Protocol", "CWR"]
    df = spark.createDataFrame([(n,) for n in names], "column string")
    got = {r["column"]: r["column_class"] for r in columns.classify_columns(df).collect()}
    assert got == {
        "Flow ID": "identifier", "Src IP": "network", "Flow Duration": "time", "FIN Flag Count": "flag",
        "Total Fwd Packet": "size", "Down/Up Ratio": "rate", "Active Mean": "statistic", "Dst Port": "protocol",
        "Label": "label", "Protocol": "protocol", "CWR": "other"}
