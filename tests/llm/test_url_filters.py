from pyspark.sql import functions as F

from basketry.llm import url_filters as u

CAPTURES = "page_id bigint, url string, day bigint"
ENTRIES = "pattern string, listed string, action string, day bigint"


def brute(captures, entries):
    def active(pattern, listed, day):
        on, when = False, None
        for d in sorted({e[3] for e in entries if e[:2] == (pattern, listed) and e[3] is not None and e[2] in ("add", "remove")}):
            if d <= day:
                on, when = any(e[:2] == (pattern, listed) and e[3] == d and e[2] == "add" for e in entries), d
        return on and when is not None

    known = {e[:2] for e in entries if None not in e}
    out = []
    for page, url, day in captures:
        hits = []
        if url and "://" in url and day is not None:
            host, _, path = url.split("://", 1)[1].partition("/")
            host = host.split(":")[0].lower()
            labels, parts = host.split("."), [p for p in path.split("?")[0].split("#")[0].split("/") if p]
            own = {f"host:{host}", *(f"domain:{'.'.join(labels[i:])}" for i in range(len(labels))), *(f"prefix:{host}/{'/'.join(parts[:i])}" for i in range(1, len(parts) + 1))}
            hits = [(("domain", "host", "prefix").index(p.split(":")[0]), len(p), x == "block", p, x) for p, x in known if host and p in own and active(p, x, day)]
        best = max(hits, default=None)
        out.append((page, len(hits), best and best[3], best is None or not best[2]))
    return sorted(out, key=repr)


def test_against_plain_python(spark):
    hosts = ["a.b.org", "b.org", "x.com", "B.ORG"]
    captures = [(i, f"https://{hosts[i % 4]}/{'p/q' if i % 3 else 'r'}/{i}?k=/z", i * 7 % 100) for i in range(120)]
    entries = [
        (p, ("block", "allow")[(i + d) % 3 == 0], ("add", "remove")[(i * d) % 2], d)
        for i, p in enumerate(["host:a.b.org", "domain:b.org", "domain:org", "prefix:x.com/p", "prefix:x.com/p/q", "prefix:x.com/r", "host:none"]) for d in range(0, 90, 4 + i)
    ]
    entries += [("domain:b.org", "block", "add", 10), ("domain:b.org", "block", "remove", 10), ("domain:b.org", "block", "add", 10)]
    got = u.evaluate(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES))
    assert sorted(((r["page_id"], r["n_active"], r["pattern"], r["kept"]) for r in got.collect()), key=repr) == brute(captures, entries)


def test_an_exact_host_beats_its_domain_and_a_path_beats_both(spark):
    entries = [("domain:a.b.org", "block", "add", 1), ("host:a.b.org", "allow", "add", 1), ("prefix:a.b.org/x", "block", "add", 1), ("domain:org", "block", "add", 1)]
    captures = [(1, "http://a.b.org/y", 5), (2, "http://a.b.org/x/z", 5), (3, "http://c.a.b.org/y", 5), (4, "http://d.org", 5)]
    got = u.evaluate(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES)).collect()
    assert {r["page_id"]: (r["pattern"], r["kept"]) for r in got} == {
        1: ("host:a.b.org", True), 2: ("prefix:a.b.org/x", False), 3: ("domain:a.b.org", False), 4: ("domain:org", False),
    }


def test_an_entry_counts_from_its_day_until_its_removal(spark):
    entries = spark.createDataFrame([("host:a.com", "block", "add", 10), ("host:a.com", "block", "remove", 400), ("host:a.com", "block", "remove", 500)], ENTRIES)
    captures = spark.createDataFrame([(d, "http://a.com", d) for d in (9, 10, 399, 400, 900)], CAPTURES)
    assert {r["page_id"]: r["kept"] for r in u.evaluate(captures, entries).collect()} == {9: True, 10: False, 399: False, 400: True, 900: True}
    assert [tuple(r) for r in u.intervals(entries).collect()] == [("host:a.com", "block", 10, 400)]


def test_odd_rows(spark):
    entries = spark.createDataFrame(
        [("host:a.com", "block", "add", 1), (None, "block", "add", 1), ("host:a.com", None, "add", 1), ("host:a.com", "allow", None, 1), ("host:a.com", "allow", "add", None)], ENTRIES
    )
    rows = [(1, "http://a.com/x", 5), (1, "http://a.com/x", 5), (2, None, 5), (3, "not a url", 5), (4, "", 5), (5, "http://a.com", None), (None, "http://a.com", 5), (6, "http://a.com/" + "s/" * 3000, 5)]
    captures = spark.createDataFrame(rows, CAPTURES)
    got = sorted(((r["page_id"], r["kept"]) for r in u.evaluate(captures.withColumn("pattern", F.lit("own")), entries).collect()), key=repr)
    assert got == sorted([(1, False), (1, False), (2, True), (3, True), (4, True), (5, True), (None, False), (6, False)], key=repr)
    assert u.evaluate(captures, entries.limit(0)).filter("NOT kept").count() == 0
    assert u.evaluate(captures.limit(0), entries).count() == 0
