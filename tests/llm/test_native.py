"""Operators with an SQL twin on the given tables; those made of DataFrame functions only also on small awkward ones."""

import duckdb
import pytest

from tallyguard.llm import exact_dedup, license_scan, near_dedup, quality_rules, suffix_dedup, url_filter
from tests.llm.cases import table, texts

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query, sql", [
    (exact_dedup.op1_exact_dedup, exact_dedup.OP1_SQL), (license_scan.op3_license_scan, license_scan.OP3_SQL),
    (near_dedup.op9_near_dedup, near_dedup.OP9_SQL), (suffix_dedup.op6_suffix_dedup, suffix_dedup.OP6_SQL), (url_filter.op7_url_filter, url_filter.OP7_SQL), (quality_rules.op10_quality_rules, quality_rules.OP10_SQL)])
def test_query_equals_sql(spark, query, sql):
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    df = query(spark, SMALL)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert got and sorted(map(str, got)) == sorted(map(str, want))


def test_quality_sql_on_awkward_texts(spark):
    rows = [(i, t) for i, t in texts() if i is not None and i != 17 and i != 18]
    rows += [(30, "a | b | c | d\n" * 30), (31, "w " * 100), (32, "STOP!! NOW!! HERE!! AND!! THERE!!\n" + "plain words follow here. " * 3), (33, "x\n\nx\n \ny"),
             (34, " ".join(f"r{k % 9}" for k in range(60))), (35, "q%% r## s$$ t&& u\n" + " ".join(f"fine{k}" for k in range(40)))]
    df = table(spark, rows)
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    got = quality_rules.quality_rules(df).drop("line_chars", "good_chars", "clean_text")
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({quality_rules.OP10_SQL})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want))


def test_clean_documents_drops_lines_and_documents(spark):
    good = " ".join(f"word{k}" for k in range(60)) + "."
    rows = [(1, good), (2, good + "\nhome | about | news | mail"), (3, "a | b | c | d | e\n" * 30), (4, None), (None, good + " x"), (5, good), (5, good)]
    df = table(spark, rows)
    out = quality_rules.clean_documents(df)
    assert out.columns == df.columns
    kept = {(r.doc_id, r.text, r.n_chars) for r in out.collect()}
    assert kept == {(1, good, len(good)), (2, good, len(good)), (None, good + " x", len(good) + 2), (5, good, len(good))}
    assert out.count() == 5 and quality_rules.clean_documents(table(spark, [])).count() == 0


def test_native_plans_hold_no_python(spark):
    plans = [quality_rules.op10_quality_rules(spark, SMALL), url_filter.op7_url_filter(spark, SMALL), license_scan.op3_license_scan(spark, SMALL)]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))
    assert "Exchange" not in plans[0]._jdf.queryExecution().executedPlan().toString()


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, rule string, verdict string")


def test_url_rules_and_spread_of_distrust(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [(1, "http://A.Example.NET/en/x", ""), (2, "http://example.net/de/x?q#f", ""), (3, "https://b.example.com/de/1", ""), (4, "http://fr.org/fr/", ""),
            (5, "ftp://plain.io?x", ""), (6, None, None), (7, "no scheme", ""), (8, "http://netx/en", ""), (9, "http://spam.io/a", link("bad1.net", "bad2.net")),
            (10, "http://ok.io/a", link("site.org")), (11, "http://bad1.net/a", ""), (12, "http://bad2.net/", ""), (13, "http://far.io/", link("spam.io")), (13, "http://far.io/", link("spam.io"))]
    found = url_filter.filter_urls(pages(spark, [(i, u, h, "x", "y", "z") for i, u, h in rows])).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found}
    assert len(found) == len(rows)
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("example.net", "/de/x", "net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5] == ("plain.io", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8][2] is None and got[11][2:] == ("net/", "block")
    assert got[9][2:] == (None, "block") and got[13][2:] == (None, "block") and got[10][3] == "allow"
    scores = {r.host: r for r in url_filter.host_scores(pages(spark, [(i, u, h, url, None, v) for i, u, h, url, v in [
        (1, "", link("b.net"), "a.io", None), (2, "", "", "b.net", "block"), (3, "", link("a.io"), "c.io", None)]])).collect()}
    assert scores["b.net"].distrust > scores["a.io"].distrust > scores["c.io"].distrust > 0 == scores["a.io"].trust
    assert url_filter.filter_urls(pages(spark, [])).count() == 0


def test_links_in_either_case_and_without_scheme_are_edges(spark):
    html = """<A HREF="HTTP://Up.io/x?y"> <a Href='//rel.io/x'> <a href=https://low.io#z> <a href="/own"> <a href="page//up.io"> <a HREF = //rel.io>"""
    edges = url_filter.host_edges(pages(spark, [(1, None, html, "a.io", None, None), (2, None, None, "b.io", None, None)])).collect()
    assert {(r.src, r.dst): r.share for r in edges} == {("a.io", "up.io"): 0.25, ("a.io", "rel.io"): 0.5, ("a.io", "low.io"): 0.25}


def test_a_host_is_blocked_from_half_of_its_links_on(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    bad, good = [f"b{k}.net" for k in range(6)], [f"g{k}.io" for k in range(6)]
    rows = [(k, f"http://{h}/", "", None, None, None) for k, h in enumerate(bad + good)]
    rows += [(100 + k, f"http://s{k}.io/", link(*bad[:k], *good[k:]), None, None, None) for k in range(7)]
    rows += [(200, "http://mixed.io/", link("b0.net", "fr.org", "g0.io"), None, None, None), (201, "http://fr.org/fr/", link("trusted.io"), None, None, None),
             (202, "http://trusted.io/", link("b0.net", "b1.net"), None, None, None), (203, "http://two.io/", link("s6.io"), None, None, None),
             (204, "http://case.io/", "<A HREF = '//B0.NET/x'> <a href=HTTPS://b1.net>", None, None, None)]
    df = pages(spark, rows)
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df).collect()}
    assert [got[100 + k] for k in range(7)] == ["allow"] * 3 + ["block"] * 4
    # a third of mixed.io's links goes to a blocked host, a third to a host two steps before one: 0.85 * (0.15 + 0.85 * 0.85 * 0.15) / 3 > 0.0637
    assert got[200] == "block" and got[203] == "block" and got[204] == "block"
    assert got[202] == "allow"  # all its links are bad, but a trusted host vouches for it as strongly
    con = duckdb.connect()
    con.register("pages", df.select("page_id", "url", "html").toPandas())
    assert {r[0]: r[4] for r in con.execute(url_filter.OP7_SQL).fetchall()} == got


def test_url_sql_with_links(spark):
    link = lambda *hosts: "".join(f"<a href='https://{h}/x'>" for h in hosts)
    rows = [(i, f"http://h{i % 7}.{'net' if i % 7 < 2 else 'io'}/p{i}", link(f"h{(i * 3) % 7}.io", "h0.net", "h1.net"), None, None, None) for i in range(40)]
    df = pages(spark, rows)
    con = duckdb.connect()
    con.register("pages", df.select("page_id", "url", "html").toPandas())
    got = url_filter.filter_urls(df).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(url_filter.OP7_SQL).fetchall()))


def test_licenses_in_awkward_texts(spark):
    notice = license_scan.TEMPLATES["mit-grant"]
    filler = " ".join(f"f{k}" for k in range(50))
    changed = notice.replace("free of charge", "free of cost")
    rows = [(1, f"{filler} {notice.upper()} {filler}"), (2, changed), (3, " ".join(notice.split()[:15])), (4, None), (5, ""), (6, "four words only here"),
            (7, "Released -- under\nthe MIT License!"), (7, "Released under the MIT License"), (None, "released under the mit license"), (8, filler * 50)]
    df = table(spark, rows)
    got = {(r.doc_id, r.license): (round(r.containment, 3), r.first_word) for r in license_scan.scan_licenses(df).collect()}
    assert got[(1, "mit-grant")] == (1.0, 50) and got[(7, "mit")] == (1.0, 0) and got[(None, "mit")] == (1.0, 0)
    assert {k[0] for k in got} <= {1, 2, 7, None} and (2, "mit-grant") in got and got[(2, "mit-grant")][0] < 1
    assert license_scan.scan_licenses(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        license_scan.template_table(spark, {str(k): "a b c d e" for k in range(license_scan.MAX_TEMPLATES + 1)})


def test_templates_of_any_length_match_and_short_ones_are_an_error(spark):
    make = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    templates = {"long": make("a", 1000), "over": make("b", 193), "most": make("c", 192), "five": make("d", 5)}
    filler = make("f", 77)
    changed = " ".join(w if k % 100 else "x" for k, w in enumerate(templates["long"].split()))
    rows = [(k, f"{filler} {t} {filler}") for k, t in enumerate(templates.values())] + [(10, f"{filler} {changed}"), (11, make("a", 700)), (12, filler * 9)]
    got = {(r.doc_id, r.license): (round(r.containment, 3), r.first_word, r.n_template_words) for r in license_scan.scan_licenses(table(spark, rows), templates).collect()}
    assert {k: v for k, v in got.items() if k[0] < 10} == {(k, name): (1.0, 77, len(t.split())) for k, (name, t) in enumerate(templates.items())}
    assert set(got) == {*enumerate(templates), (10, "long")} and got[(10, "long")] == (round(950 / 996, 3), 78, 1000)
    with pytest.raises(ValueError, match="short"):
        license_scan.template_table(spark, {"fine": make("a", 9), "short": "four words are few"})
