import pytest
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.streaming.urls import featured, windowed_hosts

SPARK = urls.SPARK


def columns(spark, values, *names):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, url string")
    out = urls.with_features(urls.with_columns(urls.with_parts(rows), [("canonical_url", urls.canonical(SPARK)), ("url_template", urls.template(SPARK))]))
    return [tuple(r) for r in out.orderBy("id").select(*names).collect()]


def test_canonical_forms(spark):
    """(as written, canonical): case of scheme and host only, default ports, empty paths; the rest is untouched."""
    cases = [
        ("HtTpS://WWW.Museum.Test", "https://www.museum.test/"), ("http://museum.test:80", "http://museum.test/"), ("https://museum.test:80/", "https://museum.test:80/"), ("http://museum.test:0443/Halls", "http://museum.test:443/Halls"),
        ("http://museum.test?Open=NOW", "http://museum.test/?Open=NOW"), ("http://museum.test#Top", "http://museum.test/#Top"), ("ftp://Files.Museum.test:21/a;b", "ftp://files.museum.test:21/a;b"), ("http://Guide@MUSEUM.test/", "http://Guide@museum.test/"),
        ("http://museum.test//two//Halls/", "http://museum.test//two//Halls/"), ("http://museum.test:/x", "http://museum.test/x"),
    ]
    assert [g[0] for g in columns(spark, [u for u, _ in cases], "canonical_url")] == [c for _, c in cases]
    again = columns(spark, [c for _, c in cases], "canonical_url")
    assert [g[0] for g in again] == [c for _, c in cases]  # canonical forms stay as they are


def test_registered_domain_without_rules(spark):
    """The short list of two-label suffixes inside the column expression; operators/domains.py has the rules."""
    cases = {"https://deep.shop.brand.com.br/x": "brand.com.br", "http://com.br/": "com.br", "ftp://one.two.three.zone": "three.zone", "http://intranet:8080/": "intranet", "http://[2001:db8::7]/": "2001:db8::7", "http://10.20.30.40:81/": "10.20.30.40", "http://300.1.1.1/": "1.1"}
    assert {u: g[0] for u, g in zip(cases, columns(spark, list(cases), "registered_domain"), strict=True)} == cases


def test_template(spark):
    got = columns(spark, ["http://one.test/Shop/Cart?b=1&a=22", "http://two.test/shop/cart?a=9&b=x", "http://three.test/item/12345/99", "http://four.test", "http://five.test/?=v&&k"], "url_template")
    assert [g[0] for g in got] == ["/shop/cart?a=<V>&b=<V>", "/shop/cart?a=<V>&b=<V>", "/item/<N>/99", "/", "/?=<V>&k=<V>"]


def test_counts_and_flags_add_up(spark):
    """Every count against plain Python on the whole URL or the part that it names."""
    url = "https://Pay.update-now.bank.museum.com.au:9443/wallet//2024/%7Eann/?q=1&q=2&empty=&=x@y#frag-3"
    (got,) = columns(spark, [url], "url_length", "url_dot_count", "url_hyphen_count", "url_digit_count", "url_at_count", "url_question_count", "url_equals_count", "url_ampersand_count", "url_percent_count")
    assert got == (len(url), url.count("."), url.count("-"), sum(c.isdigit() for c in url), url.count("@"), url.count("?"), url.count("="), url.count("&"), url.count("%"))
    (got,) = columns(spark, [url], "url_hostname_length", "url_path_length", "url_query_length", "url_subdomain_count", "url_path_depth", "url_query_param_count")
    assert got == (len("pay.update-now.bank.museum.com.au"), len("/wallet//2024/%7Eann/"), len("q=1&q=2&empty=&=x@y"), 3, 3, 4)
    (got,) = columns(spark, [url], "url_has_https", "url_has_nonstandard_port", "url_has_double_slash_path", "url_suspicious_token_count", "url_has_token_update", "url_has_token_bank", "url_has_token_login")
    assert got == (1, 1, 1, 3, 1, 1, 0)


def test_kinds_of_hosts(spark):
    """(is an address, has punycode): addresses of both kinds, numbers that are none, and names."""
    cases = {"http://8.8.4.4:53/": (1, 0), "http://256.8.4.4/": (0, 0), "http://8.8.4/": (0, 0), "https://[fe80::1%25en0]/": (0, 0), "https://[2001:DB8:0:0:0:0:0:1]/": (1, 0), "https://[::ffff:1.2.3.4]/": (1, 0), "https://[1::2::3]/": (0, 0), "http://XN--bcher-kva.test/": (0, 1), "http://plain.test/xn--y": (0, 1)}
    assert {u: tuple(g) for u, g in zip(cases, columns(spark, list(cases), "url_has_ip", "url_has_punycode"), strict=True)} == cases


def test_any_text_has_all_features(spark):
    odd = ["", " ", "://", "http://", "http://[", "http://]x[", "http://a:port/", "?", "#", "%", "\u202e", "a" * 3000, "http://\U0001f600.test/\u00e9", "http:///path", "//host/path", "mailto:x@y", "http://a.test:99999999999999999999/"]
    got = columns(spark, [*odd, None], *urls.FEATURES)
    assert len(got) == len(odd) + 1 and all(v is not None and v == v and v >= 0 for row in got[:-1] for v in row)
    assert len(set(urls.FEATURES)) == 30 and set(urls.LOGGED) < set(urls.FEATURES)


@pytest.mark.parametrize(("text", "bits"), [("aaaa", 0.0), ("ab", 1.0), ("", 0.0)])
def test_entropy(spark, text, bits):
    assert columns(spark, [text], "url_entropy")[0][0] == pytest.approx(bits)


def test_payload_triage(spark):
    cases = [(None, "undecodable"), ("", "undecodable"), ("http://a.com", "url"), ("HTTPS://A.com/x", "url"), ("ftp://a.com", "non_url"), ("http://a b.com", "non_url"), ("hello", "non_url"), ("http://", "non_url"), ("http://a.com/" + "x" * 2000, "too_long"), ("http://a.com/​", "non_url")]
    rows = urls.with_parts(spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "id int, payload string"), "payload")
    got = rows.orderBy("id").select(F.expr(urls.triage(SPARK)).alias("k")).collect()
    assert [r["k"] for r in got] == [k for _, k in cases]


def test_stream_has_the_same_features(spark, tmp_path, sf):
    source = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    source.write.parquet(str(tmp_path / "in"))
    stream = featured(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")))
    run = stream.select("page_id", *urls.FEATURES).writeStream.format("memory").queryName("featured").option("checkpointLocation", str(tmp_path / "ck")).start()
    run.processAllAvailable()
    run.stop()
    want = featured(source).select("page_id", *urls.FEATURES)
    assert spark.table("featured").exceptAll(want).isEmpty() and want.exceptAll(spark.table("featured")).isEmpty()


def test_windows_of_a_stream_drop_late_rows(spark, tmp_path):
    """Each micro-batch moves the watermark; a row behind it is not counted, one within it is."""
    batches = [
        [("2024-01-01 00:01:00", "http://a.test/"), ("2024-01-01 00:02:00", "https://a.test/x"), ("2024-01-01 00:03:00", "http://b.test/")],
        [("2024-01-01 00:30:00", "http://c.test/")], [("2024-01-01 00:04:00", "http://a.test/late"), ("2024-01-01 00:27:00", "http://c.test/within")], [("2024-01-01 02:00:00", "http://z.test/")], [("2024-01-01 02:00:01", "http://z.test/")],
    ]
    schema = "at timestamp, url string"
    (tmp_path / "in").mkdir()
    stream = windowed_hosts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "at")
    query = None
    for own in batches:
        spark.createDataFrame(own, "at string, url string").selectExpr("timestamp(at) as at", "url").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if query is None:
            query = stream.selectExpr("cast(window.start as string) as start", "host", "n", "n_https").writeStream.format("memory").queryName("hosts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
        query.processAllAvailable()
    query.stop()
    got = {(r["start"][11:16], r["host"]): (r["n"], r["n_https"]) for r in spark.table("hosts").collect()}
    assert got == {("00:00", "a.test"): (2, 1), ("00:00", "b.test"): (1, 0), ("00:30", "c.test"): (1, 0), ("00:25", "c.test"): (1, 0)}
