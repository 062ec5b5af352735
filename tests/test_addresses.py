import hashlib

from pyspark.sql import functions as F

from flowquarry.functions.addresses import ip_to_long, long_to_ip, octets, pad_key, seed_key
from flowquarry.operators import positions, privacy

KEY = seed_key(79)


def plain(ip):
    n = int.from_bytes(bytes(int(p) for p in ip.split(".")), "big")
    out = 0
    for i in range(32):
        prefix = (n >> (32 - i)) << (32 - i)
        digest = int.from_bytes(hashlib.sha256(KEY + prefix.to_bytes(4, "big")).digest()[:4], "big")
        out |= (((n >> (31 - i)) ^ (digest >> (31 - i))) & 1) << (31 - i)
    return ".".join(str(b) for b in out.to_bytes(4, "big"))


def frame(spark, ips):
    return spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "i int, ip string")


def test_octets(spark):
    df = frame(spark, ["1.2.3.4", "1.2.3", "300.x.5.6.7", None, "12.0"])
    loose = [tuple(r) for r in df.orderBy("i").select(*octets(F.col("ip"))).collect()]
    assert loose == [(1, 2, 3, 4), (1, 2, 3, 0), (300, 0, 5, 6), (0, 0, 0, 0), (12, 0, 0, 0)]
    strict = [tuple(r) for r in df.orderBy("i").select(*octets(F.col("ip"), strict=True)).collect()]
    assert strict == [(1, 2, 3, 4), (0,) * 4, (0,) * 4, (0,) * 4, (0,) * 4]


def test_numbers_and_back(spark):
    df = frame(spark, ["255.255.255.255", "10.0.0.1", "1.2.3", "1.2.3.256", "a.b.c.d", None])
    numbered = df.withColumn("n", ip_to_long(F.col("ip"))).withColumn("back", long_to_ip(F.col("n")))
    assert [(r["n"], r["back"]) for r in numbered.orderBy("i").collect()] == [
        (2**32 - 1, "255.255.255.255"), (167772161, "10.0.0.1"), *[(0, "0.0.0.0")] * 4]


def test_anonymisation_equals_a_plain_implementation_and_is_one_to_one(spark):
    ips = [f"10.{a}.{b}.{c}" for a in (0, 7) for b in range(6) for c in range(40)] + ["0.0.0.0", "bad", "192.168.0.1"]
    got = {r["ip"]: r["anon_ip"] for r in privacy.ip_mapping(frame(spark, ips), ["ip"], KEY).collect()}
    assert got["0.0.0.0"] == "0.0.0.0" and got["bad"] == "bad"
    good = [ip for ip in got if ip not in ("0.0.0.0", "bad")]
    assert all(got[ip] == plain(ip) for ip in good)
    assert len({got[ip] for ip in good}) == len(good)

    def shared(a, b):
        x, y = (int.from_bytes(bytes(int(p) for p in ip.split(".")), "big") for ip in (a, b))
        return 32 - (x ^ y).bit_length()

    assert all(shared(a, b) == shared(got[a], got[b]) for a in good[:30] for b in good[-30:] if a != b)


def test_broadcast_and_salted_anonymisation_agree(spark, monkeypatch):
    df = frame(spark, ["10.0.0.1", "10.0.0.2", None, "bad", "10.0.0.1"]).withColumn("dst", F.lit("1.2.3.4"))
    small = privacy.anonymize(df, ["ip", "dst"], KEY)
    assert small.columns == df.columns
    looked_up = sorted(map(str, small.collect()))
    monkeypatch.setattr(positions, "BROADCAST_BYTES", -1)
    large = privacy.anonymize(df, ["ip", "dst"], KEY)
    assert large.columns == df.columns and sorted(map(str, large.collect())) == looked_up


def test_spellings_and_fixed_points_come_back_once(spark):
    ips = ["10.0.0.1", "10.0.0.01", "010.0.0.1", "0.0.0.0", "bad", None, plain("0.0.0.0")]
    df = frame(spark, ips)
    mapping = privacy.ip_mapping(df, ["ip"], KEY)
    back = privacy.deanonymize(privacy.anonymize(df, ["ip"], KEY), "ip", mapping, "old").orderBy("i").collect()
    assert [r["old"] for r in back[:3]] == ["10.0.0.1"] * 3 and [r["old"] for r in back[4:6]] == ["bad", None]
    assert len(back) == len(ips)


def test_mapping_is_stored_with_its_key(spark, tmp_path):
    mapping = privacy.ip_mapping(frame(spark, ["10.0.0.1"]), ["ip"], KEY)
    privacy.save_mapping(mapping, str(tmp_path / "m"), KEY)
    assert privacy.load_mapping(spark, str(tmp_path / "m"), KEY).count() == 1
    try:
        privacy.load_mapping(spark, str(tmp_path / "m"), seed_key(1))
    except ValueError:
        pass
    else:
        raise AssertionError("a mapping of another key was accepted")


def test_deanonymize_keeps_unmapped_addresses(spark):
    mapping = spark.createDataFrame([("10.0.0.1", "9.9.9.9")], "ip string, anon_ip string")
    df = frame(spark, ["9.9.9.9", "8.8.8.8"])
    back = privacy.deanonymize(df, "ip", mapping, "old").orderBy("i").collect()
    assert [r["old"] for r in back] == ["10.0.0.1", "8.8.8.8"]


def test_pad_key():
    assert pad_key(b"ab") == b"ab" + b"\0" * 30
    assert pad_key(bytes(40)) == bytes(32)
