from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.operators import clean, domains
from linkloom.sources import text

RULES = """// a comment
// ===BEGIN ICANN DOMAINS===
com
uk
co.uk   trailing words are no rule
*.ck
!www.ck
jp
*.kawasaki.jp
!city.kawasaki.jp

公司.cn
cn
// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
blogs.com
// ===END PRIVATE DOMAINS===
"""

CASES = {
    "com": ("com", "com"), "shop.com": ("com", "shop.com"), "a.b.shop.com": ("com", "shop.com"), "Shop.COM": ("COM", "Shop.COM"), "a.shop.com.": ("com", "shop.com"),
    "co.uk": ("co.uk", "co.uk"), "x.co.uk": ("co.uk", "x.co.uk"), "y.x.co.uk": ("co.uk", "x.co.uk"), "x.uk": ("uk", "x.uk"),
    "ck": ("ck", "ck"), "any.ck": ("any.ck", "any.ck"), "b.any.ck": ("any.ck", "b.any.ck"), "a.b.any.ck": ("any.ck", "b.any.ck"), "www.ck": ("ck", "www.ck"), "a.www.ck": ("ck", "www.ck"),
    "kawasaki.jp": ("jp", "kawasaki.jp"), "c.kawasaki.jp": ("c.kawasaki.jp", "c.kawasaki.jp"), "b.c.kawasaki.jp": ("c.kawasaki.jp", "b.c.kawasaki.jp"), "a.city.kawasaki.jp": ("kawasaki.jp", "city.kawasaki.jp"),
    "w.食狮.公司.cn": ("公司.cn", "食狮.公司.cn"), "w.xn--85x722f.xn--55qx5d.cn": ("xn--55qx5d.cn", "xn--85x722f.xn--55qx5d.cn"), "a。b。com": ("com", "b.com"),
    "a.local.test": ("test", "local.test"), "test": ("test", "test"), "": ("", ""), "me.blogs.com": ("com", "blogs.com"), "10.0.0.1": ("", "10.0.0.1"),
}


def rules_of(spark, tmp_path, private=False):
    (tmp_path / "rules.dat").write_text(RULES, "utf-8")
    return domains.read_rules(spark, str(tmp_path / "rules.dat"), private)


def test_rules_of_a_file(spark, tmp_path):
    rules = {tuple(r) for r in rules_of(spark, tmp_path).collect()}
    assert rules == {("com", "exact"), ("uk", "exact"), ("co.uk", "exact"), ("ck", "wildcard"), ("www.ck", "exception"), ("jp", "exact"), ("kawasaki.jp", "wildcard"), ("city.kawasaki.jp", "exception"), ("xn--55qx5d.cn", "exact"), ("cn", "exact")}


def test_registered_domains(spark, tmp_path):
    hosts = spark.createDataFrame([(h, h == "10.0.0.1") for h in [*CASES, "shop.com"]], "host string, is_ip boolean")
    got = {r["host"]: (r["public_suffix"], r["registered_domain"]) for r in domains.registered(hosts, rules_of(spark, tmp_path)).collect()}
    assert got == CASES
    private = domains.registered(hosts, rules_of(spark, tmp_path, private=True))
    assert private.where("host = 'me.blogs.com'").first()["registered_domain"] == "me.blogs.com"
    assert domains.registered(hosts.limit(0), rules_of(spark, tmp_path)).count() == 0
    alone = domains.registered(hosts, domains.of_rules(spark.createDataFrame([], "rule string")))
    assert alone.where("host = 'y.x.co.uk'").first()["registered_domain"] == "co.uk"


def test_caps_and_subdomain_counts_follow_the_rules(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"http://s{i}.b.any.ck/") for i in range(6)] + [(6, "http://a.www.ck/"), (7, None)], "page_id long, url string")
    found = domains.with_registered_domain(urls.with_parts(rows), rules_of(spark, tmp_path))
    counts = {r["page_id"]: r["url_subdomain_count"] for r in urls.with_features(found).select("page_id", "url_subdomain_count").where("page_id < 7").collect()}
    assert counts == {**dict.fromkeys(range(6), 1), 6: 1}
    assert found.count() == 8 and clean.capped(found.where("page_id < 7"), "registered_domain", 4, 42, "page_id").count() == 5


def test_numbered_lines_keep_their_order_over_many_files(spark, tmp_path):
    for k in range(7):
        (tmp_path / f"f{k}.txt").write_bytes(("\r\n" if k % 2 else "\n").join(f"{k}:{i}" for i in range(1, 500 + k)).encode() + (b"\n" if k % 3 == 0 else b""))
    (tmp_path / "g.txt").write_text("")
    lines = text.numbered_lines(spark, str(tmp_path)).collect()
    assert sorted((r["file"], r["line"], r["value"]) for r in lines) == sorted((f"f{k}.txt", i, f"{k}:{i}") for k in range(7) for i in range(1, 500 + k))


def test_markdown_rows_and_pins(spark, tmp_path):
    (tmp_path / "log.md").write_text("# Log\n\n| id | what |\n|:--|--:|\n| D1 | a \\| b |\n|D2||\n\ntext | no row\n  | D3 | second table |\n")
    (tmp_path / "lock.txt").write_text("# lock\nNum_Py==2.1.0 ; python\npandas>=2\n  a.b==1\n")
    lines = text.numbered_lines(spark, str(tmp_path))
    got = [tuple(r) for r in text.markdown_rows(lines).orderBy("line").collect()]
    assert got == [("log.md", 3, 3, 0, ["id", "what"]), ("log.md", 5, 3, 1, ["D1", "a | b"]), ("log.md", 6, 3, 2, ["D2", ""]), ("log.md", 9, 9, 0, ["D3", "second table"])]
    assert [tuple(r) for r in text.pins(lines, "file").orderBy("line").collect()] == [("lock.txt", 2, "num-py", "2.1.0"), ("lock.txt", 4, "a.b", "1")]


def test_forbidden_imports(spark):
    rows = spark.createDataFrame([(1, "import os\n  from urllib.request import x\nimport socketserver\nx = 'import socket'\nimport socket"), (2, None), (3, "")], "id int, code string")
    assert [tuple(r) for r in text.matching_lines(text.lines_of(rows, "code", "id"), text.FORBIDDEN).select("id", "line").orderBy("line").collect()] == [(1, 2), (1, 5)]
    assert text.lines_of(rows, "code", "id").select(F.count("*")).first()[0] == 5
