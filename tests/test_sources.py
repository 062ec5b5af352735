import math

import pytest

from flowquarry.config import StudyConfig, hyperparameters
from flowquarry.sources import cache, ingest, reports


def put(folder, name, text):
    (folder / name).write_text(text)


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    put(folder, "Mon day.csv", "Flow ID, Timestamp, Src IP, Flow Bytes/s, Total Bwd Packets, Label\n"
        "a,2024-01-01 00:00:01,1.2.3.4,Infinity,3,BENIGN\nb,bad,1.2.3.5,NaN,4,DoS\nc,2024-01-01 00:00:03,1.2.3.6,7.5,x,\n")
    put(folder, "Tue.csv", "Label,Flow Bytes/s,Flow ID\nBENIGN,1,d\nBENIGN,2,e\n")
    put(folder, "notes.csv", "x,y\n1,2\n")
    return folder


def test_ingest(spark, raw, tmp_path):
    store = str(tmp_path / "store")
    table = ingest.ingest(spark, str(raw), store, ["Total Bwd packets", "Flow Bytes/s"])
    rows = {r["Flow ID"]: r for r in table.collect()}
    assert set(rows) == {"a", "d", "e"}
    a, d = rows["a"], rows["d"]
    assert (a["source"], a["is_attack"], a["Flow Bytes/s"], a["Total Bwd packets"]) == ("Mon day", False, 0, 3)
    assert (d["source"], d["Flow Bytes/s"], d["Src IP"], d["Timestamp"]) == ("Tue", 1.0, None, None)
    rejects = {r["Flow ID"]: r for r in ingest.read_rejects(spark, store).collect()}
    assert {k: (r["reject_reason"], r["Total Bwd packets"]) for k, r in rejects.items()} == {"b": ("time", 4), "c": ("label", 0)}
    assert rejects["b"]["Timestamp text"] == "bad"
    assert {r["source"]: r["rows"] for r in ingest.list_sources(table).collect()} == {"Mon day": 1, "Tue": 2}
    assert [tuple(r) for r in ingest.unlabelled_sources(spark, store).collect()] == [("notes", "no label column")]


def test_only_new_or_changed_files_are_read_again(spark, raw, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    ingest.ingest(spark, str(raw), store)
    seen = []
    real = ingest.read_headers
    monkeypatch.setattr(ingest, "read_headers", lambda s, p: seen.append(sorted(x[-7:] for x in p)) or real(s, p))
    assert ingest.ingest(spark, str(raw), store).count() == 3
    put(raw, "Tue.csv", "Label,Flow Bytes/s,Flow ID\nBENIGN,1,d\nDoS,2,e\nDoS,3,f\n")
    put(raw, "Wed.csv", "Label,Flow ID\nDoS,g\n")
    table = ingest.ingest(spark, str(raw), store)
    assert seen == [["Tue.csv", "Wed.csv"]]
    assert sorted((r["Flow ID"], r["is_attack"]) for r in table.collect()) == [
        ("a", False), ("d", False), ("e", True), ("f", True), ("g", True)]


def test_a_new_delivery_replaces_a_source(spark, raw, tmp_path):
    store = str(tmp_path / "store")
    ingest.ingest(spark, str(raw), store)
    put(raw, "Mon day.csv", "Label,Flow ID\nDoS,z\n")  # neither its benign row nor its rejects are left
    put(raw, "Tue.csv", "Label,Flow ID\n")  # no row at all
    table = ingest.ingest(spark, str(raw), store)
    assert [(r["Flow ID"], r["source"]) for r in table.collect()] == [("z", "Mon day")]
    assert ingest.read_rejects(spark, store).count() == 0
    put(raw, "Mon day.csv", "x,y\n1,2\n")  # its labels are gone
    assert ingest.ingest(spark, str(raw), store).count() == 0
    assert {r["source"] for r in ingest.unlabelled_sources(spark, store).collect()} == {"Mon day", "notes"}


def test_times_and_text_columns(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    put(folder, "x.csv", "Timestamp,Service,Flow Bytes/s,Label\n14/02/2018 08:31:01,http,1,BENIGN\n"
        "2024-01-01 00:00:01.25,dns,2,BENIGN\n14/02/2018 08:31:01 PM,\"a,b\",x,DoS\n,ftp,4,DoS\n")
    table = ingest.ingest(spark, str(folder), str(tmp_path / "store"))
    rows = {r["Service"]: (str(r["Timestamp"]), r["Flow Bytes/s"]) for r in table.collect()}
    assert rows == {"http": ("2018-02-14 08:31:01", 1.0), "dns": ("2024-01-01 00:00:01.250000", 2.0),
                    "a,b": ("2018-02-14 20:31:01", 0.0), "ftp": ("None", 4.0)}


def test_a_folder_without_labels_is_refused(spark, tmp_path):
    put(tmp_path, "x.csv", "a,b\n1,2\n")
    with pytest.raises(ValueError):
        ingest.ingest(spark, str(tmp_path), str(tmp_path / "store"))


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, [0.5])], "name string, n int, v array<double>")
    reports.write_summary(df, str(tmp_path / "s"))
    assert reports.read_summary(spark, str(tmp_path / "s"), df.schema).collect() == df.collect()
    reports.write_csv(df, str(tmp_path / "only" / "summary.csv"))
    assert reports.read_summary(spark, str(tmp_path / "only")).first().asDict() == {"name": "a", "n": 1, "v": "[0.5]"}
    for version, n in (("2024-01", 1), ("2024-02", 2)):
        reports.write_versioned_json(spark.createDataFrame([(n,)], "n int"), str(tmp_path / "runs"), version)
    assert reports.read_latest_json(spark, str(tmp_path / "runs")).first()["n"] == 2
    with pytest.raises(ValueError):
        (tmp_path / "empty").mkdir()
        reports.read_latest_json(spark, str(tmp_path / "empty"))


def test_model_cache_is_keyed_by_every_setting(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3).toDF("id"), spark.createDataFrame([(0, "a")], "label_id int, label string")

    config = StudyConfig()
    for c in (config, config, config.with_changes(seed=1)):
        rows, labels = cache.load_or_build(spark, str(tmp_path), c, ["in"], build)
        assert rows.count() == 3 and labels.count() == 1
    assert len(built) == 2
    assert config.fingerprint("a") != config.fingerprint("b")


def test_settings_overlay():
    assert hyperparameters("dense", {"hidden": (4,)}) == {"batch_size": 64, "learning_rate": 0.001, "hidden": (4,)}
    with pytest.raises(ValueError):
        hyperparameters("unknown")
    assert not math.isnan(StudyConfig().benign_ratio)
