"""Column functions against plain Python."""

import ipaddress
import random

from netloom.functions import scalars as fn


def plain(text):
    try:
        return not ipaddress.ip_address(text).is_loopback
    except ValueError:
        return False


def test_blockable_addresses_equal_the_standard_library(spark):
    rng = random.Random(3)
    fixed = [
        "", "10.0.0.1", "127.0.0.1", "127.9.9.9", "01.2.3.4", "256.1.1.1", "::", "::1", "0:0:0:0:0:0:0:1", "0::1", "::0001", "::0.0.0.1", "::ffff:127.0.0.1", "::FFFF:7f00:1", "::ffff:8.8.8.8", "1::ffff:127.0.0.1", "fe80::1%eth0", "::1%eth0",
        "fe80::1%", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", ":::", "12345::", "g::1", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.4", "2001:db8::7", "10.0.0.1:80",
    ]
    made = ["".join(rng.choice(["0", "1", "f", "ffff", ":", "::", "1.2.3.4", "127.0.0.1"]) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    made += [":".join(rng.choice(["0", "1", "ab", "", "7f00"]) for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in fixed + made], "ip string").select("ip", fn.mixed_blockable_ip("ip").alias("got")).collect()
    assert [(r.ip, r.got) for r in rows if r.got != plain(r.ip)] == []
    assert sum(r.got for r in rows) > 50
