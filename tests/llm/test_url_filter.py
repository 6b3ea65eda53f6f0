import re

from catalith.llm import url_filter as m
from catalith.llm.queries import op2_url_filter


def brute(url):
    url = url or ""
    if "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in m.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fit, default=(0, None, None))
    return host, path, rule[1], rule[2]


URLS = [None, "", "no scheme", "://", "http://", "HTTP://A.EXAMPLE.NET/en/x?y#z", "http://example.net/de", "http://example.net", "http://xexample.net/en/", "http://badnet/", "http://NET/", "https://a.org/fr/1", "https://a.org/fr", "https://example.com/de/?q=://x", "http://É.com/de/", "http://casino-poker.com/", "http://a.com?x=/y", "http://a.net#/en/", "x://y://z/", "http://a.com/" + "z" * 50_000, "http://a.com/\n/x?"]


def test_rules_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, 1, "r") for i, u in enumerate(URLS)] + [(None, "http://q.net/a", 2, "r")], "page_id long, url string, host int, rule string")
    model = m.UrlModel(m.labelled_urls())
    rows = m.filter_urls(df).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path, rule, verdict = brute(URLS[r.page_id] if r.page_id is not None else "http://q.net/a")
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        p = None if rule else model.probability(host, path)
        assert r.block_probability == p and r.verdict == (verdict or ("block" if p >= 0.5 else "allow"))


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.page_id: r for r in op2_url_filter(spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(rows) == len(pages)
    assert all((r["host"], r["path"], r["rule"]) == brute(p.url)[:3] for p in pages for r in [rows[p.page_id]])
    # Hosts that name a blocked word go; what is left are made-up names, of which nearly all stay.
    free = [r for r in rows.values() if r["rule"] is None]
    bad = [r for r in free if set(re.split("[.-]", r["host"])) & set(m.BLOCK_WORDS)]
    good = [r for r in free if r not in bad]
    assert bad and all(r.verdict == "block" for r in bad)
    assert sum(r.verdict == "allow" for r in good) >= 0.95 * len(good)


def test_held_out_names_and_words():
    """Names that the table doesn't have, and words that it was trained without: one in five of either class."""
    model = m.UrlModel(m.labelled_urls())
    judged = [(model.probability(h, p) >= 0.5, y) for h, p, y in m.labelled_urls(seed=99)]
    assert sum(b for b, y in judged if y) >= 0.75 * sum(y for _, y in judged)
    assert sum(b for b, y in judged if not y) <= 0.01 * len(judged)
    held = set(m.ALLOW_WORDS[::5] + m.BLOCK_WORDS[::5])
    model = m.UrlModel([r for r in m.labelled_urls() if not any(w in r[0] + r[1] for w in held)])
    allowed = [model.probability(f"www.{w}.org", f"/{w}/1") < 0.5 for w in m.ALLOW_WORDS[::5]]
    assert sum(allowed) >= 0.9 * len(allowed)


def test_labels_not_made_by_the_table():
    """Urls written by hand."""
    model = m.UrlModel(m.labelled_urls())
    bad = ["m.casino-win.example.com/en/3", "www.cheap-pills.example.com/", "free-bets.example.com/en/1", "my-casino-online.com/", "xxx-videos.io/watch/12", "downloads.example.com/keygen/photoshop.html", "viagra24.info/"]
    good = ["www.city-library.org/books/1", "en.wikipedia.org/wiki/Essex", "docs.python.org/3/library/re.html", "www.sussex.ac.uk/", "stackoverflow.com/questions/11227809", "therapist-directory.example.com/", "cracow-travel.example.org/de/7", "www.nytimes.com/section/science", ""]
    assert all(model.probability(u.partition("/")[0], "".join(u.partition("/")[1:])) >= 0.5 for u in bad)
    assert all(model.probability(u.partition("/")[0], "".join(u.partition("/")[1:])) < 0.5 for u in good)


def test_empty_table(spark):
    assert m.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
