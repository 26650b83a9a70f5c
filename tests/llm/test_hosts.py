import re
import string

from sensorframe.llm import hosts


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), path


def rule_of(host, path):
    best = (None, None)
    for says, rule in hosts.RULES:
        name, slash, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest) and len(rule) > len(best[0] or ""):
            best = rule, says
    return best


URLS = ["http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "https://www.example.com/EN/", "http://com", "http://com/", "xcom/", None, "", "http://", "://a.net/es/://b", "http://İ.net/fr/1",
        "http://a.net/fr", "ftp://u:p@h.org:80?q", "http://a.org#f/es/", "http://notexample.com/en/", "http://x.net/es/\nline", "http://10.0.0.1/a", "http://a.b.co.uk/", "http://a.b.co.uk./"]


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, rate string, name string")


def test_hosts_rules_and_ties(spark):
    pages = pages_of(spark, [*enumerate(URLS), (None, URLS[0]), (3, URLS[3])])
    got = hosts.judge(pages, spark.createDataFrame([], "page_id long, bad int")).collect()
    assert len(got) == len(URLS) + 2
    for g in got:
        want = plain(URLS[g.page_id if g.page_id is not None else 0])
        rule, says = rule_of(*want)
        assert (g.host, g.path, g.rule, g.verdict) == (*want, rule, says or "allow")
    assert hosts.judge(pages_of(spark, []), spark.createDataFrame([], "page_id long, bad int")).collect() == []


def test_levels(spark):
    df = pages_of(spark, list(enumerate(URLS)))
    got = {r.page_id: tuple(r)[1:] for r in df.select("page_id", *hosts.host_levels(hosts.host_and_path(df["url"])[0])).collect()}
    assert got[12] == ("h.org", "h.org", "org") and got[16] == ("10.0.0.1", "10.0.0.1", "") and got[17] == got[18] == ("a.b.co.uk", "b.co.uk", "co.uk")


def test_shrinkage(spark):
    """A bad host's new sibling is judged by its domain; one bad page of a good domain doesn't condemn a host."""
    rows, outcomes = [], []
    for d in range(30):
        for k in range(40):
            rows.append((len(rows), f"http://h{k % 4}.dom{d}.org/"))
            outcomes.append((rows[-1][0], int(d < 5) if k % 10 else int(d < 8)))
    rows += [(5000, "http://new.dom1.org/"), (5001, "http://new.dom20.org/"), (5002, "http://solo.dom21.org/"), (5003, "http://fresh.org/")]
    outcomes += [(5002, 1), (5002, None), (None, 1), (0, 0), (0, 1)]
    got = {r.page_id: r for r in hosts.judge(pages_of(spark, rows), spark.createDataFrame(outcomes, "page_id long, bad int")).collect()}
    assert got[0].verdict == got[5000].verdict == "block" and got[5001].verdict == got[5002].verdict == got[5003].verdict == "allow"
    assert got[5001].bad_rate < got[5002].bad_rate < 0.5 < got[5000].bad_rate
