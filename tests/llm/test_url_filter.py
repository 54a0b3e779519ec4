import datetime as dt
import random

from sparkloom.llm import url_filter

DAY = dt.date(2024, 1, 1)


def brute(captures, changes):
    logs = {}
    for p, c, a, d in changes:
        if None not in (p, c, a, d) and a in ("add", "remove"):
            log = logs.setdefault((p, c), {})
            log[d] = max(log.get(d, ""), a)
    out = []
    for page, url, day in captures:
        host, names = None, []
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            authority = rest.split("/")[0].split("?")[0].split("#")[0]
            host = authority.split("@")[-1].split(":")[0].rstrip(".").lower() or None
            path = [x for x in rest.split("?")[0].split("#")[0].split("/")[1:] if x]
        if host:
            labels = host.split(".")
            names = [".".join(labels[i:]) for i in range(max(len(labels) - 1, 1))] + ["/".join([host, *path[:n]]) for n in (1, 2) if len(path) >= n]
        hits = []
        for name in names if day else []:
            for (p, c), log in logs.items():
                past = [d for d in log if d <= day]
                if p == name and past and log[max(past)] == "add":
                    hits.append(((len(p), p), c, max(past)))
        best = max((h[0] for h in hits), default=None)
        entry = min(((c, d) for k, c, d in hits if k == best), default=(None, None))
        out.append((page, host, day, bool(hits), best and best[1], *entry))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rnd = random.Random(1)
    day = lambda n: DAY + dt.timedelta(n)
    hosts = ["a.com", "www.a.com", "x.y.b.org", "b.org", "localhost", "c.net"]
    patterns = hosts + ["a.com/p", "www.a.com/p/q", "y.b.org", "com"]
    changes = [(rnd.choice([*patterns, None]), rnd.choice(["spam", "adult", None]), rnd.choice(["add", "add", "remove", "other", None]), rnd.choice([day(rnd.randint(0, 20)), None])) for _ in range(120)]
    changes += changes[:5]
    urls = ["http://{}/p/q/r?x=/z", "https://u@{}:80/p#f", "HTTP://{}", "http://{}./?q", "http://{}/"]
    captures = [(i, rnd.choice(urls).format(rnd.choice(hosts).upper() if i % 7 == 0 else rnd.choice(hosts)), day(rnd.randint(-1, 22))) for i in range(300)]
    captures += [(None, None, day(3)), (901, "", day(3)), (902, "no url", day(3)), (903, "http://a.com/" + "p/" * 9000, day(9)), (904, "http://a.com/", None), captures[0]]
    c = spark.createDataFrame([(*r, "x") for r in captures], "page_id long, url string, fetched date, pattern string")
    log = spark.createDataFrame(changes, "pattern string, category string, action string, changed date")
    assert sorted((tuple(r) for r in url_filter.evaluate(c, log).collect()), key=str) == brute(captures, changes)
    assert not any(r.blocked for r in url_filter.evaluate(c, log.limit(0)).collect())
    assert url_filter.evaluate(c.limit(0), log).count() == 0


def test_deep_entries_match(spark):
    urls = ["http://a.com/p/q/r/s", "http://a.com/p/q/r/s/t?x", "http://a.com/p/q/r", "http://a.com/p/q/r/other", "http://b.org/x/y/z"]
    c = spark.createDataFrame([(i, u, DAY) for i, u in enumerate(urls)], "page_id long, url string, fetched date")
    log = spark.createDataFrame([("a.com/p/q/r/s", "spam", "add", DAY), ("a.com/p", "adult", "add", DAY), ("b.org/x/y/z", "spam", "add", DAY)], "pattern string, category string, action string, changed date")
    got = {r.page_id: (r.pattern, r.category) for r in url_filter.evaluate(c, log).collect()}
    assert got == {0: ("a.com/p/q/r/s", "spam"), 1: ("a.com/p/q/r/s", "spam"), 2: ("a.com/p", "adult"), 3: ("a.com/p", "adult"), 4: ("b.org/x/y/z", "spam")}


def test_entries_are_normalised_like_captures(spark):
    same = ["Example.COM/a/", "http://example.com/a", "https://u:p@EXAMPLE.com.:8080//a/?q=1#f", " example.com/a ", "*.example.com/a", ".example.com//a"]
    c = spark.createDataFrame([(1, "http://example.com/a/b", DAY), (2, "http://www.example.com/x", DAY), (3, "http://example.com/A", DAY)], "page_id long, url string, fetched date")
    for entry in same:
        log = spark.createDataFrame([(entry, "spam", "add", DAY)], "pattern string, category string, action string, changed date")
        assert {r.page_id: r.pattern for r in url_filter.evaluate(c, log).collect()} == {1: "example.com/a", 2: None, 3: None}, entry
    changes = [("EXAMPLE.com", "x", "add", DAY), ("example.com./", "x", "remove", DAY + dt.timedelta(1)), ("", "x", "add", DAY), ("/a", "x", "add", DAY), ("*.", "x", "add", DAY), (None, "x", "add", DAY)]
    log = spark.createDataFrame(changes, "pattern string, category string, action string, changed date")
    got = sorted(map(tuple, url_filter.intervals(log).collect()), key=str)
    assert ("example.com", "x", DAY, DAY + dt.timedelta(1)) in got and {r[0] for r in got} <= {"example.com", "a"}


def test_no_python_in_the_plan(spark):
    c = spark.createDataFrame([(1, "http://a.b/", DAY)], "page_id long, url string, fetched date")
    log = spark.createDataFrame([("a.b", "x", "add", DAY)], "pattern string, category string, action string, changed date")
    plan = url_filter.evaluate(c, log)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan
