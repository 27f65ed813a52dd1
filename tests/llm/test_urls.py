from trapline.llm import urls

CASES = [
    ("https://Example.ORG/es/x?q=1", "example.org", "/es/x", "example.org/es/", "block"),
    ("http://www.example.org/en/12", "www.example.org", "/en/12", "example.org/en/1", "block"),
    ("http://www.example.org/en/2", "www.example.org", "/en/2", "org/", "allow"),
    ("http://example.org", "example.org", "", None, None),
    ("http://a.com/de/x#y", "a.com", "/de/x", "com/de/", "block"),
    ("http://a.com/fr/x", "a.com", "/fr/x", "com/fr/", "allow"),
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("http://com/fr/", "com", "/fr/", "com/fr/", "allow"),
    ("http://xcom/fr/", "xcom", "/fr/", None, None),
    ("http://a.net//b//c/d/e/f", "a.net", "//b//c/d/e/f", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("ÉX://É.com/fr/é", "É.com", "/fr/é", "com/fr/", "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, c[0], "template") for i, c in enumerate(CASES)] + [(None, CASES[0][0], "x")],
                                  "page_id long, url string, template string")
    got = {r["page_id"]: r for r in urls.filter_urls(pages).collect()}
    assert len(got) == len(CASES) + 1
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_templates(spark):
    """Numbers are generalised; a wildcard is made of many branches; a mostly blocked template takes its unlabelled urls along."""
    rows = [f"http://bad.com/de/{i}" for i in range(40)] + ["http://bad.com/dd/7"]
    rows += [f"http://news.net/{chr(97 + i % 26)}{chr(97 + i // 26)}x/p" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r["page_id"]: r for r in urls.filter_urls(pages).collect()}
    assert got[0]["template"].endswith("/#/") and got[0]["purity"] > 0.75
    assert got[40]["verdict"] == "block" and got[40]["rule"] is None
    assert all("/*/" in got[41 + i]["template"] for i in range(60))


def test_no_window_over_a_host(spark, monkeypatch):
    """Worded slugs: a host has as many shapes as pages, and no plan sorts a host's in one task."""
    plans, real = [], urls.materialize
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(urls, "materialize", lambda df: plans.append(plan(df)) or real(df))
    slug = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    rows = [f"http://big.com/{'de' if i % 3 else 'dd'}/{slug(i)}/x" for i in range(90)]
    got = urls.filter_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"))
    plans.append(plan(got))
    assert got.count() == len(rows)
    assert not any("Window" in p for p in plans)


def test_templates_of_deep_paths(spark):
    """What lies below a common third level has templates and purities of its own; a table without deep paths keeps three levels."""
    rows = [f"http://a.com/{'de' if i % 2 else 'fr'}/u/v/{'bad' if i % 2 else 'good'}/{i}" for i in range(80)]
    rows += ["http://b.net/u/v/w", "http://b.net/u/v/w/", "http://b.net/u/v/w/x/9//y/"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r["page_id"]: r for r in urls.filter_urls(pages).collect()}
    assert len(got) == len(rows)
    assert got[0]["template"] == "a.com/fr/u/v/good/#" and got[1]["template"] == "a.com/de/u/v/bad/#"
    assert [got[80 + i]["template"] for i in range(3)] == ["b.net/u/v/w"] * 2 + ["b.net/u/v/w/x/#//y"]


def test_empty(spark):
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
