"""Address ranges against the standard library's own networks."""

import ipaddress
import random

from pyspark.sql import functions as F

from answerlens.operators import ranges as R


def number(text):
    try:
        ip = ipaddress.ip_address(text.strip("[]").split("%")[0])
    except ValueError:
        return None
    return getattr(ip, "ipv4_mapped", None) or ip


def network(text):
    try:
        if "/" not in text:
            return None
        net = ipaddress.ip_network(text, strict=False)
    except ValueError:
        return None
    mapped = getattr(net.network_address, "ipv4_mapped", None)
    return ipaddress.ip_network(f"{mapped}/{net.prefixlen - 96}") if mapped and net.prefixlen >= 96 else net


def test_every_range_of_an_address(spark):
    rng = random.Random(9)
    v4 = lambda: f"{rng.choice([10, 10, 172, 203])}.{rng.randrange(4)}.{rng.randrange(256)}.{rng.randrange(256)}"
    v6 = lambda: str(ipaddress.IPv6Address((0x20010DB8 << 96) | rng.getrandbits(3) << 93 | rng.getrandbits(70)))
    ips = [v4() for _ in range(150)] + [v6() for _ in range(100)] + ["::", "::1", "1::", "[2001:DB8::1]", "fe80::1%eth0", "::ffff:10.1.2.3", "::10.1.2.3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4"]
    ips += ["", "x", "1.2.3", "256.1.1.1", "1:2:3", "1::2::3", ":::", "12345::", "1:2:3:4:5:6:7::8:9", "::1.2.3.400", None] + ["10.0.0.1"] * 40
    cidrs = [f"{v4()}/{rng.randrange(33)}" for _ in range(80)] + [f"{v6()}/{rng.randrange(129)}" for _ in range(60)]
    cidrs += ["0.0.0.0/0", "::/0", "10.0.0.5/8", "10.0.0.0/8", "10.0.0.1/32", "::1/128", "1.2.3.4", "1.2.3.4/33", "1.2.3.4/x", "::/129", "/8", "", None, "::ffff:10.0.0.0/104"]
    got = R.address_ranges(spark.createDataFrame([(i,) for i in ips], "ip string"), spark.createDataFrame([(c,) for c in cidrs + cidrs[:9]], "cidr string"))
    want = set()
    for ip in set(ips) - {None}:
        held = [(network(c).prefixlen, c) for c in set(cidrs) - {None} if number(ip) and network(c) and number(ip).version == network(c).version and number(ip) in network(c)]
        want |= {(ip, c, bits, bits == max(held)[0]) for bits, c in held}
    rows = [tuple(r) for r in got.select("ip", "cidr", "bits", "narrowest").collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_rows_in_ranges_keep_their_copies(spark):
    rows = spark.createDataFrame([(k, f"10.0.0.{k % 3}") for k in range(30)] + [(99, None)], "id int, host string")
    got = R.in_ranges(rows, spark.createDataFrame([("10.0.0.0/31",)], "cidr string"), "host")
    assert sorted(r["id"] for r in got.collect()) == [k for k in range(30) if k % 3 < 2]
    assert R.in_ranges(rows, spark.createDataFrame([], "cidr string"), "host").count() == 0 and F


def test_keys_that_no_range_has_are_not_shuffled(spark):
    sc = spark.sparkContext

    def shuffled() -> int:
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    addresses = spark.range(5000).selectExpr("concat('10.', id % 200, '.', id % 250, '.', id % 7) AS ip").distinct()
    cidrs = [(f"10.{200 + bits}.0.0/{bits}",) for bits in range(16, 33)] + [("10.0.0.0/8",)]
    n, limit = addresses.count(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffled()
        found = R.address_ranges(addresses, spark.createDataFrame(cidrs, "cidr string")).collect()
        moved = shuffled() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {(r["cidr"], r["narrowest"]) for r in found} == {("10.0.0.0/8", True)} and len(found) == n
    assert moved < 8 * n
