import random
import re
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from sievework.functions import rules, suffix, urls

PIECES = ["http://", "https://", "HTTP://", "ftp://", "//", "", "mailto:", "e.com", "Ex.COM", "a_b.test", "[::1]", "[::ffff:1.2.3.4]", "[v1.x]", "[1.2.3.4]", "192.168.0.1", "01.2.3.4", ":80", ":443", ":0443", ":99999", ":x", ":", "@", "user:pw@", "/", "/a/b", "?", "?q=1", "#f", " ", "\t", "é", "％", "..", "[", "]"]


def expected(value):
    text = value.strip()
    if not text:
        return None
    explicit = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://", text)
    try:
        p = urlsplit(text if explicit else "http:" + text if text.startswith("//") else "http://" + text)
    except ValueError:
        return None
    try:
        port, bad = p.port, False
    except ValueError:
        port, bad = None, True
    return p.scheme, p.netloc, p.path, p.query, p.hostname or None, port, bad


def test_parts_agree_with_the_standard_library(spark):
    random.seed(3)
    texts = ["".join(random.choice(PIECES) for _ in range(random.randint(1, 6))) for _ in range(4000)]
    df = urls.with_parts(spark.createDataFrame([(t,) for t in texts], "u string"), "u")
    for r in df.collect():
        p = r.parts
        assert expected(r.u) == ((p.scheme, p.netloc, p.path, p.query, p.host, p.port, p.port_bad) if p.parsed else None), r.u


def keys(spark, *texts):
    df = urls.with_parts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, u string"), "u")
    return [r.k for r in df.select("i", urls.dedupe_key().alias("k")).orderBy("i").collect()]


def test_canonical_keys(spark):
    k = keys(
        spark, "HTTP://Shop.Test/Cart", "http://shop.test/Cart", "http://shop.test/cart", "ftp://d.test/f?x#y", "ftp://d.test/f?x", "http://d.test:80/f", "https://d.test:80/f", "http://Me:X@d.test/",
        "//d.test/b", "d.test/b", "http://d.test/?", "http://[2001:DB8::2]/q", "http://d.test:x/b#c", "", None, "http://d.test./b", "http://@d.test/",
    )
    assert k[0] == k[1] != k[2]
    assert k[3] == k[4]
    assert k[5] == "http://d.test/f" and k[6] == "https://d.test:80/f"
    assert k[7] == "http://Me:X@d.test/"
    assert k[8] == k[9] == "//d.test/b"
    assert k[10] == "http://d.test/" and k[11] == "http://[2001:db8::2]/q" and k[12] == "http://d.test:x/b"
    assert k[13:15] == ["", ""] and k[15] == "http://d.test/b"


def test_registered_domains(spark):
    real = suffix.icann_rules(spark)
    table = suffix.rule_table(real)
    assert suffix.registered("x.y.library.ac.jp", table) == "library.ac.jp"
    assert suffix.registered("a.www.ck", table) == "www.ck"
    assert suffix.registered("b.a.unlisted-zone", table) == "b.a.unlisted-zone"
    hosts = ["a.b.co.example", "co.example", "x.test", "test", "198.51.100.7", "u.nknown", None, "x.y.library.ac.jp."]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, h string")
    few = [r.d for r in df.select("i", suffix.registered_domain(spark, F.col("h")).alias("d")).orderBy("i").collect()]
    assert few[:7] == ["b.co.example", "co.example", "x.test", "test", "198.51.100.7", "u.nknown", None]
    many = [r.d for r in df.select("i", suffix.registered_domain(spark, F.col("h"), real).alias("d")).orderBy("i").collect()]
    assert many[4] == "198.51.100.7" and many[6] is None and many[7] == "library.ac.jp"


def features(spark, url):
    df = spark.createDataFrame([(url, 1)], "u string, score int")
    return urls.with_features(df, "u").withColumn("s", rules.score()).withColumn("e", rules.explain()).withColumn("p", rules.predict(F.col("s"), 0.25)).first()


def test_features_and_rules(spark):
    assert features(spark, "ftp://198.51.100.7/a").has_ip_hostname and features(spark, "http://[2001:db8::5]:8443/").has_ip_hostname
    assert features(spark, "http://name@shop.test/").has_userinfo
    assert features(spark, "http://a.xn--80ak6aa92e.test/").has_punycode
    assert features(spark, "http://is.gd/q").uses_url_shortener
    r = features(spark, "http://wallet-update.test/invoice/password?session")
    assert (r.suspicious_hostname_keyword_count, r.suspicious_path_query_keyword_count) == (2, 3)
    assert features(spark, "https://garden.test/").p == 0 and features(spark, "http://198.51.100.7/").p == 1
    r = features(spark, "gopher://me@198.51.100.7:70/" + "%7E" * 60)
    assert 0 <= r.s <= 1
    weights = [x.weight for x in r.e]
    assert weights == sorted(weights, reverse=True) and len(weights) == 5
    assert features(spark, None).s == 0.3 and features(spark, "").url_length == 0
    odd = "http://a.test/1²₃①Ⅷ½٣x"
    assert abs(features(spark, odd).digit_ratio - sum(c.isdigit() for c in odd) / len(odd)) < 1e-12
    with pytest.raises(ValueError, match="threshold"):
        rules.predict(F.col("s"), 1.1)


def test_labels(spark):
    df = spark.createDataFrame([(0,), (1,)], "x int")
    assert sorted((r.x, r.y) for r in df.select("x", urls.convert_target(F.col("x")).alias("y")).collect()) == [(0, 1), (1, 0)]
    with pytest.raises(Exception, match="label"):
        spark.createDataFrame([(2,)], "x int").select(urls.convert_target(F.col("x"))).collect()
