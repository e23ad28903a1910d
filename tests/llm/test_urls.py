import numpy as np

from cellweave.llm import bloom_cascade
from cellweave.llm.bloom_cascade import Cascade
from cellweave.llm.queries_urls import RULES
from cellweave.llm.url_filter import judge


def test_cascade_is_exact_on_its_universe():
    rng = np.random.default_rng(1)
    for n, share in ((5000, 0.3), (5000, 0.001), (5000, 0.999), (3, 0.5), (100, 0.0), (100, 1.0), (0, 0.0)):
        h, g = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
        listed = rng.random(n) < share
        made = Cascade.load(Cascade.build(h, g, listed).dump())
        assert (made.listed(h, g) == listed).all()


URLS = [
    "https://Example.ORG/es/1", "http://a.example.org/en/12?x", "http://a.example.org/en/2", "https://x.com/fr/", "https://x.com/de/a", "https://x.com/", "notexample.org/es/", None, "", "x://",
    "http://badexample.org/es/", "https://Ünï.org/ß#f", "https://h.net?q=/fr/", "https://h.net#x", "mailto:a://b/c?d", "https://com/fr/1", "https://fr.net/\nx", "https://evil.net/de/", "https://EVIL.net",
]


def brute(url, listed):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([len(rest), *(rest.index(c) for c in "/?#" if c in rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([len(tail), *(tail.index(c) for c in "?#" if c in tail)])]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if host in listed else "allow"


def test_judge(spark):
    rows = [(i, u, "x", True) for i, u in enumerate(URLS)] + [(None, URLS[0], None, None), (0, URLS[0], "x", True)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, listed boolean")
    listed = spark.createDataFrame([("evil.net",), ("h.net",), ("absent.net",), ("h.net",), (None,), ("",)], "host string")
    got = sorted(map(str, judge(pages, RULES, listed).collect()))
    want = sorted(f"Row(id={i!r}, host={h!r}, path={p!r}, rule={r!r}, verdict={v!r})" for i, u, *_ in rows for h, p, r, v in [brute(u, {"evil.net", "h.net"})])
    assert got == want
    assert judge(pages.limit(0), RULES, listed).count() == 0


def test_mark_beyond_the_broadcast_limit(spark):
    keys = spark.range(3000).selectExpr("cast(id as string) as key", "id % 7 = 0 as listed")
    cascades, shards = bloom_cascade.build(keys)
    rows = keys.select("key").union(keys.select("key")).union(spark.createDataFrame([("0",)] * 500, "key string"))
    for limit in (1 << 30, 0):
        marked = bloom_cascade.mark(rows, "key", cascades, shards, "hit", limit)
        assert marked.where("hit <> (cast(key as long) % 7 = 0)").count() == 0 and marked.count() == 6500
