from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.urlkey import key_of, massage_url
from tidemark.operators.search import Match, http_search_args, key_pattern, search, search_args

GOLDEN = {
    "https://m.a.example.net/en/25#top": "net,example,a,m)/en/25",
    "http://a.example.com/x?ref=z&page=2": "com,example,a)/x?page=2&ref=z",
    "https://a.com:443/": "com,a)/",
    "http://a.com:8080/": "com,a:8080)/",
    "http://10.0.0.1/p": "10.0.0.1)/p",
    "http://0x7f.1/": "127.0.0.1)/",
    "http://[2001:DB8::0:1]:81/x": "[2001:db8::1]:81)/x",
    "http://a.com./x?": "com,a)/x",
    "http://a.com?a": "com,a)/?a=",
    "http://a.com/a/../b/./c/%2e%2e/d": "com,a)/b/d",
    "http://a.com/a bé": "com,a)/a%20b%C3%A9",
    "http://bücher.example/": "example,xn--bcher-kva)/",
    "http://a.com/?x=1=2&x=a+b&%7Ek=%7Ev*": "com,a)/?x=1%3D2&x=a%20b&~k=~v%2A",
    "http:\\\\a.com\\x": "com,a)/x",
    "ftp://a.com:21/f": "com,a)/f",
    "http://u@A.COM:0080/": "com,a)/",
    "http://a.com:99999/": "",
    "http://": "",
    "http://300.0.0.1/": "",
    "not a url": "",
    "": "",
    None: "",
}


def test_golden(spark):
    rows = spark.createDataFrame([(u,) for u in GOLDEN], "u string").select("u", massage_url(F.col("u")).alias("k")).collect()
    assert {r.u: r.k for r in rows} == GOLDEN


def test_columns_and_parser_agree(spark):
    rnd = random.Random(5)
    pick = lambda *x: rnd.choice(x)
    urls = [
        f"{pick('http', 'https', 'HTTP')}://{pick('', 'u@', 'u:p@')}{pick('a', 'A-b', 'x_y')}.{pick('com', 'org.', 'CO.uk')}{pick('', ':', ':80', ':443', ':81')}"
        f"{pick('', '/', '/x/y.html', '/a//b', '/%41')}{pick('', '?', '?b=2&a=1', '?a&&b=%2F', '?k=a+b&k=1=2', '?q=%7E*')}{pick('', '#f')}"
        for _ in range(300)
    ]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", massage_url(F.col("u"), odd=False).alias("k")).collect()
    assert all(r.k == key_of(r.u) != "" for r in rows)


@pytest.mark.parametrize(
    "host,port,path,pattern",
    [
        (None, None, None, ".*"),
        (Match("example.org"), None, Match("/en"), r"org,example(,[a-z0-9]+){0,}(:[0-9]{1,5})?\)/en.*"),
        (Match("a.com", True), 8080, None, r"com,a:8080\).*"),
        (None, 8080, Match("/x", True), r".*:8080\)/x"),
        (None, None, Match("/x"), ".*/x.*"),
    ],
)
def test_patterns(host, port, path, pattern):
    assert key_pattern(host, port, path) == pattern


def test_strict_search(spark):
    keys = ["com,a)/x", "com,a,my-sub)/x", "com,ab)/x", "com,a)/xy", "com,a:81)/x", "org,com,a)/x", "com,a)/x?a=1"]
    df = spark.createDataFrame(list(enumerate(keys)), "id int, massaged_url string").withColumn("flags", F.col("id") % 2)
    ids = lambda **how: [r.id for r in search(df, limit=None, mode="strict", **how).orderBy("id").collect()]
    assert ids(host=Match("a.com")) == [0, 1, 3, 4, 6]
    assert ids(host=Match("a.com", True), path=Match("/x", True)) == [0, 4, 6]
    assert ids(port=81) == [4]
    assert ids(host=Match("a.com"), active_only=True) == [1, 3]
    assert [r.id for r in search(df, limit=2).collect()] == [0, 1]


def test_bindings():
    assert search_args(host="a", domain="b", path="/p", exact_path="/e") == {"host": Match("a", True), "port": None, "path": Match("/e", True)}
    assert http_search_args([("host", "a"), ("domain", "b"), ("port", "x"), ("path_exact", "/p")]) == {"host": Match("b"), "port": 0, "path": Match("/p", True)}
