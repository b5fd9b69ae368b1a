import random
import re
from collections import Counter

import pytest

from evalloop.llm import queries, url_filter

SCHEMA = "page_id long, url string, bad int"


def plain(url):
    """Host and path as the contract words them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def plain_rule(host, path):
    fits = []
    for place, verdict in RULES:
        h, p = place.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(place), place, verdict))
    return max(fits)[1:] if fits else (None, None)


def plain_verdicts(rows):
    """The tree by brute force over (url, bad) pairs: the template and verdict of each row."""
    kept = [(plain(u)[0], url_filter_shape(plain(u)[1]).split("/"), b) for u, b in rows]
    tally = lambda ks: (sum(kept[k][2] == 0 for k in ks), sum(kept[k][2] == 1 for k in ks))
    good, bad = tally(range(len(kept)))
    out = [None] * len(kept)

    def walk(ks, level, template, counts, above, above_counts, verdict, ended):
        """One node: rows ``ks``, whose names up to ``level`` make ``template``."""
        pure = above if counts == above_counts else (counts[0] + 10 * above) / (sum(counts) + 10)
        if sum(counts) >= 8:
            verdict = "block" if pure < 0.5 else "allow"
        kids = {}
        for k in ks:
            if ended or level == len(kept[k][1]):
                kids.setdefault(None, []).append(k)
            else:
                kids.setdefault(kept[k][1][level], []).append(k)
        if set(kids) == {None}:
            for k in ks:
                out[k] = template, verdict
            return
        g, b = tally([k for s, x in kids.items() if s is not None for k in x])
        children = {}
        for s, x in kids.items():
            name, own = s if s in (None, "") else "*", tally(x)
            rest = g + b - sum(own)
            if s and len(x) >= 20 and sum(own) >= 8 and rest:
                error = ((b / (g + b)) * (1 - b / (g + b)) * (1 / sum(own) + 1 / rest)) ** 0.5
                if abs(own[1] / sum(own) - (b - own[1]) / rest) > 3 * error:
                    name = s
            children.setdefault(name, []).extend(x)
        for name, x in children.items():
            walk(x, level + 1, template if name is None else template + "/" + name, tally(x), pure, counts, verdict, name is None)

    overall = (good + 1) / (good + bad + 2)
    for host in {h for h, _, _ in kept}:
        ks = [k for k, (h, _, _) in enumerate(kept) if h == host]
        walk(ks, 1, "", tally(ks), overall, None, "allow", False)
    return out


def url_filter_shape(path):
    path = re.sub(r"(?<![0-9A-Za-z])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{8}[0-9a-fA-F-]{8,}(?![0-9A-Za-z])", "{x}", path)
    return re.sub("[0-9]+", "{n}", path)


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "abc", "http://", "HTTP://Foo.NET", "http://a.net/", "x://example.net/en/", "x://m.example.net/en/1?x://y",
            "x://example.net/en", "x://notexample.net/en/1", "x://example.com/de/a", "x://é.org/fr/é#/z", "x://ÄB.org?x", "x://net/",
            "x://a/b://c/d", "//x.org/fr/", "x://org/fr/1", "x://o.net#/", "x://h\n/p\nq", "x://" + "a/" * 5000]
    rows = {r.page_id: r for r in url_filter.judge(spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], SCHEMA)).collect()}
    for k, u in enumerate(urls):
        host, path = plain(u)
        rule, verdict = plain_rule(host, path)
        assert (rows[k].host, rows[k].path, rows[k].rule, rows[k].verdict) == (host, path, rule, verdict or "allow"), u


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(4000):
        host = rng.choice(["hot.com"] * 3 + ["a.com", "b.com"])
        kind = rng.choice(["spam", "blog", "news", "u"])
        tail = rng.choice([f"/{k}", f"/{rng.randint(2000, 2020)}/{rng.choice('xy')}{k}.html", "", "/", f"/{rng.getrandbits(80):020x}", "/list"])
        share = 0.9 if kind == "spam" and host == "hot.com" else 0.95 if tail == "/list" and host == "a.com" else 0.1
        rows.append((f"http://{host}/{kind}{tail}?q={k}", int(rng.random() < share) if rng.random() < 0.6 else None))
    want = plain_verdicts(rows)
    got = url_filter.judge(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.template, r.verdict) == want[r.page_id], rows[r.page_id]
    blocked = {(r.host, r.path.split("/")[1]) for r in got if r.verdict == "block"}
    assert ("hot.com", "spam") in blocked and not any(h == "b.com" for h, _ in blocked)


def test_query_over_pages(spark):
    sf = "/root/testdata/sf0.01"
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        labels[r.doc_id] = max(1 - r.quality, r.toxic)
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    mark = [labels.get(int(re.findall(r"\d+", plain(r.url)[1])[-1])) for r in pages]
    want = plain_verdicts([(r.url, m) for r, m in zip(pages, mark)])
    got = {r.page_id: r for r in queries.op3_url_filter(spark, sf).collect()}
    assert len(got) == len(pages) and sum(m is not None for m in mark) > 20
    for r, (_, verdict) in zip(pages, want):
        host, path = plain(r.url)
        rule, ruled = plain_rule(host, path)
        assert tuple(got[r.page_id]) == (r.page_id, host, path, rule, ruled or verdict)


def verdicts(spark, rows):
    got = url_filter.judge(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SCHEMA)).collect()
    want = plain_verdicts(rows)
    for r in got:
        assert (r.template, r.verdict) == want[r.page_id], rows[r.page_id]
    return [r.verdict for r in sorted(got, key=lambda r: r.page_id)]


def test_a_bad_branch_spread_over_depths_is_rejected(spark):
    """70 pages below /spam, 63 of them bad, 7 at each of ten depths; /blog beside it is good."""
    rows = [(f"x://h.com/spam{'/a' * depth}/{'pqrstuv'[k]}", int(k < 6 or depth >= 7)) for depth in range(10) for k in range(7)]
    assert sum(b for _, b in rows) == 63
    rows += [(f"x://h.com/blog{'/a' * (k % 9)}/b{k}", 0) for k in range(300)]
    got = verdicts(spark, rows)
    assert got[:70] == ["block"] * 70 and got[70:] == ["allow"] * 300


def test_branches_that_part_at_segment_fourteen(spark):
    deep = "/".join("abcdefghijklm")
    rows = [(f"x://h.com/{deep}/{'bad' if k % 2 else 'good'}/page{chr(97 + k % 26)}{k}", k % 2) for k in range(200)]
    rows += [(f"x://h.com/{deep}/{'z/' * 300}end", None)] * 30
    got = verdicts(spark, rows)
    assert got[:200] == ["allow", "block"] * 100


def test_a_clean_branch_below_a_bad_one(spark):
    rows = [(f"x://h.com/spam/{chr(97 + k % 26)}{k}", 1) for k in range(100)]
    rows += [(f"x://h.com/spam/clean/{chr(97 + k % 26)}{k}", 0) for k in range(60)]
    rows += [(f"x://h.com/spam/few/{k}", None) for k in range(5)] + [(f"x://o.com/{k}/p", 0) for k in range(300)]
    got = verdicts(spark, rows)
    assert got == ["block"] * 100 + ["allow"] * 60 + ["block"] * 5 + ["allow"] * 300


def test_odd_tables(spark):
    assert url_filter.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(1, "x://a/b", 1), (1, "x://a/b", 1), (None, None, None)], SCHEMA)
    clash = twice.selectExpr("*", "'x' AS host", "'x' AS path", "'x' AS shape", "'x' AS template", "'x' AS n", "'x' AS id")
    assert sorted(map(str, url_filter.judge(clash).collect())) == sorted(map(str, url_filter.judge(twice).collect()))
    assert url_filter.judge(twice, bad_col=None).count() == 3
