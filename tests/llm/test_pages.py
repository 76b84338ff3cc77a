"""URL rules and WARC bundles."""

import hashlib
import io
import itertools
import re
from collections import Counter

import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratawork.llm import url_rules, warc
from stratawork.llm.common import Workspace
from stratawork.llm.queries import URL_RULES, op3_warc, op6_url_rules
from tests.conftest import DATA

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = re.search(r"[/?#]|\Z", rest).start()
    host, tail = rest[:at], rest[at:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", tail, maxsplit=1)[0]


def by_rules(url):
    host, path = split(url)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/x?y://z", "http://example.org/en/12#/es/",
        "a://b://c.org/d", "https://xexample.org/es/", "http://org/", "http://a.org", "http://é.COM/de/1\n2",
        "http://x.com/fr/?q", "http://x.com/it/" + "a/" * 20_000, "http://x.com/fr/?q"]


def test_rules_and_parts(spark):
    rows = [(i, u, "old", "old") for i, u in enumerate(URLS)] + [(None, "http://x.org/", None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, verdict string")
    labelled = spark.createDataFrame([("http://a.net/x", True), (None, True), ("http://b.net/y", None)],
                                     "url string, blocked boolean")
    mined = url_rules.mine(labelled)
    got = url_rules.judge(pages, mined, URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        url = "http://x.org/" if r["page_id"] is None else URLS[r["page_id"]]
        rule, verdict = by_rules(url)
        assert (r["host"], r["path"], r["rule"]) == (*split(url), rule), url
        assert r["verdict"] == (verdict or "allow")
    assert url_rules.judge(pages.limit(0), mined, URL_RULES).count() == 0
    assert url_rules.mine(labelled.limit(0)).count() == 0


def test_mined_rules_equal_counting(spark):
    """All frequent, confident rules, and the best one per url."""
    rows = ([(f"http://spam.net/buy/{i}", i % 10 != 0) for i in range(60)]
            + [(f"http://news.net/read/{i}", i % 7 == 0) for i in range(80)]
            + [(f"http://news.net/buy/{i}", i % 2 == 0) for i in range(40)])
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    mined = url_rules.mine(labelled, min_support=0.05, min_rows=1, min_confidence=0.6)
    tokens = {r[0]: frozenset(r[1]) for r in labelled.select("url", url_rules.tokens("url")).collect()}
    baskets = [(tokens[u], b) for u, b in rows]
    every = {frozenset(c) for t, _ in baskets for n in range(1, len(t) + 1)
             for c in itertools.combinations(sorted(t), n)}
    want = {}
    for c in every:
        fits = [b for t, b in baskets if c <= t]
        for verdict, n in (("block", sum(fits)), ("allow", len(fits) - sum(fits))):
            if n >= 0.05 * len(rows) and n / len(fits) >= 0.6:
                want[c, verdict] = (n / len(fits), n / len(rows))
    got = expanded(mined)
    assert got.keys() == {(tuple(sorted(c)), v) for c, v in want}
    assert all(abs(got[tuple(sorted(k[0])), k[1]][i] - want[k][i]) < 1e-9 for k in want for i in (0, 1))
    best = {r["url"]: (r["mined_verdict"], round(r["mined_confidence"], 9))
            for r in url_rules.match(labelled, mined).collect()}
    for u, t in tokens.items():
        fits = [(*want[k], len(k[0]), " ".join(sorted(k[0])), k[1]) for k in want if k[0] <= t]
        assert best.get(u) == ((max(fits)[4], round(max(fits)[0], 9)) if fits else None)


def counted_rules(labelled, rows, longest):
    """All rules of at most ``longest`` tokens, by counting."""
    tokens = {r[0]: frozenset(r[1]) for r in labelled.select("url", url_rules.tokens("url")).collect()}
    least, n, want = 20, len(rows), {}
    often = {t for t, c in Counter(t for u, _ in rows for t in tokens[u]).items() if c >= least}
    sets = Counter(), Counter()
    for u, b in rows:
        for k in range(1, longest + 1):
            for c in itertools.combinations(sorted(tokens[u] & often), k):
                sets[b][c] += 1
    for c in sets[0].keys() | sets[1].keys():
        for b, verdict in ((True, "block"), (False, "allow")):
            if sets[b][c] >= least and sets[b][c] / (sets[0][c] + sets[1][c]) >= 0.6:
                want[c, verdict] = (sets[b][c] / (sets[0][c] + sets[1][c]), sets[b][c] / n)
    return want


def expanded(mined):
    """All rules that the mined classes stand for."""
    out = {}
    for r in mined.collect():
        for k in range(1, len(r["tokens"]) + 1):
            for c in itertools.combinations(r["tokens"], k):
                if all(set(c) & set(members) for members in r["antecedent"]):
                    assert (c, r["verdict"]) not in out
                    out[c, r["verdict"]] = (r["confidence"], r["support"])
    return out


def mined_rules(labelled):
    return expanded(url_rules.mine(labelled))


def test_long_urls_are_mined(spark):
    """A pattern of long urls only, whose other words are rare, and a shorter rule
    that they count against."""
    slug = "-".join(chr(97 + k) * 2 + "{0}" for k in range(18))
    names = ["".join(chr(97 + int(d)) for d in str(i)) for i in range(100)]
    rows = ([("http://long.net/win/" + slug.format(x), True) for x in names[:60]]
            + [("http://other.net/read/" + x, False) for x in names] + [("http://other.net/win/" + x, False) for x in names[:40]])
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    assert labelled.select(F.max(F.size(url_rules.tokens("url")))).first()[0] > 16
    got, want = mined_rules(labelled), counted_rules(labelled, rows, 8)
    assert got.keys() == want.keys() and all(abs(got[k][i] - want[k][i]) < 1e-9 for k in want for i in (0, 1))
    assert got[("word:win",), "block"][0] == 0.6
    unseen = spark.createDataFrame([(1, "http://long.net/win/" + slug.format("new"))], "page_id bigint, url string")
    assert url_rules.judge(unseen, url_rules.mine(labelled), URL_RULES).first()["verdict"] == "block"


def test_long_urls_of_frequent_tokens(spark):
    """29 tokens that are always together and stand for 2 ** 29 rules: the best rule
    of each url, from the closed sets."""
    words = "/".join(chr(97 + k) * 3 for k in range(26))
    rows = ([(f"http://www.long.net/{words}", i % 10 != 0) for i in range(50)]
            + [(f"http://other.net/aaa/{i}", False) for i in range(40)] + [("http://long.net/bbb", True)] * 30)
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    mined = url_rules.mine(labelled)
    assert mined.count() < 100
    unseen = [(u,) for u in ("http://x.net/ccc/ddd?zzz", "http://www.long.net/aaa", "http://long.net/aaa", "http://x.org/aaa/q",
                             "http://net/bbb", "http://y/aaa/bbb")]
    pages = labelled.select("url").union(spark.createDataFrame(unseen, "url string"))
    tokens = {r[0]: frozenset(r[1]) for r in pages.select("url", url_rules.tokens("url")).collect()}
    sets = [(tokens[u], b) for u, b in rows]
    got = {r["url"]: (round(r["mined_confidence"], 9), r["mined_tokens"], r["mined_verdict"])
           for r in url_rules.match(pages, mined).collect()}
    for u, t in tokens.items():
        # The largest combinations of this url that some set of rows has: all that those rows share.
        shared, seen = {t & s for s, _ in sets}, set()
        while shared - seen:
            seen |= shared
            shared = {x & y for x in seen for y in seen}
        best = []
        for c in seen - {frozenset()}:
            fits = [b for s, b in sets if c <= s]
            best += [(n / len(fits), n / len(rows), len(c), " ".join(sorted(c)), v)
                     for v, n in (("block", sum(fits)), ("allow", len(fits) - sum(fits))) if n >= 20 and n / len(fits) >= 0.6]
        want = max(best, default=None)
        assert got.get(u) == ((round(want[0], 9), want[3], want[4]) if want else None), u


def test_classes_equal_counting(spark):
    """Tokens that stand together, chains of hosts, a host that stands with a word."""
    rows = [(f"http://{'a.' * (i % 3)}h{'xy'[i % 2]}.net/{'xyz'[i % 3]}/{'pq'[i % 2]}?r={'st'[i % 5 > 2]}&k=v", i % 7 < 2)
            for i in range(300)] + [(f"http://e.d.c.b/{'only'}/{i}", i % 3 == 0) for i in range(60)] + [("none", True)] * 25
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    got, want = mined_rules(labelled), counted_rules(labelled, rows, 12)
    assert got.keys() == want.keys() and len(got) > 100
    assert all(abs(got[k][i] - want[k][i]) < 1e-9 for k in want for i in (0, 1))
    assert url_rules.mine(labelled).count() < len(got) / 4


def test_url_path_stays_in_the_jvm(spark):
    plan = op6_url_rules(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_query_urls(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = op6_url_rules(spark, DATA).collect()
    assert len(got) == len(urls)
    for r in got:
        rule, verdict = by_rules(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (*split(urls[r["page_id"]]), rule)
        assert verdict in (None, r["verdict"]) and r["verdict"] in ("allow", "block")


def test_query_urls_equal_rules_by_counting(spark):
    """The verdict of a page that no fixed rule fits is that of the best of all rules."""
    folder = "/root/testdata/sf0.01"  # the smaller table has no frequent tokens
    pages, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("pages", "labels"))
    tokens = {r[0]: frozenset(r[1]) for r in pages.select("page_id", url_rules.tokens("url")).collect()}
    label = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    known = {p: q == 0 or t == 1 for p in tokens for q, t in [label.get(p, (None, None))]
             if q == 0 or t == 1 or (q is not None and t is not None)}
    n = len(known)
    least = max(0.002, 20 / n) * n
    often = {t for t, c in Counter(t for p in known for t in tokens[p]).items() if c >= least}
    sets = {True: Counter(), False: Counter()}
    for p, blocked in known.items():
        mine = sorted(tokens[p] & often)
        for k in range(1, len(mine) + 1):
            sets[blocked].update(itertools.combinations(mine, k))
    rules = {}
    for c in {*sets[True], *sets[False]}:
        both = sets[True][c] + sets[False][c]
        for blocked, verdict in ((True, "block"), (False, "allow")):
            m = sets[blocked][c]
            if m >= least and m / both >= 0.6:
                rules[c, verdict] = (m / both, m / n)
    assert rules
    for r in op6_url_rules(spark, folder).collect():
        if r["rule"] is None:
            fits = [(*v, len(c), " ".join(c), verdict) for (c, verdict), v in rules.items() if set(c) <= tokens[r["page_id"]]]
            assert r["verdict"] == (max(fits)[4] if fits else "allow")


LONG = "x" * 200
PAGES = [(1, "http://a/%0A\r\n", "<p>é</p>"), (2, None, LONG), (3, "u", LONG), (3, "u", LONG), (4, "v", None),
         (5, "v", ""), (6, "w", "s"), (7, "w", "s"), (None, "n", LONG), (0, "z", LONG + "y"), (9, "z", LONG + "y"),
         (9, "z", "other" * 50), (10, "z", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 9), (11, "long", "é" * 600_000)]


def records(pages):
    out = []
    for page, _, html in pages:
        body = (html or "").encode()
        same = [p for p, _, h in pages if p is not None and (h or "").encode() == body]
        first = min(same) if page is not None and len(body) >= 100 else page
        out.append((page, len(body), hashlib.sha256(body).hexdigest(),
                    "response" if first == page else "revisit", None if first == page else first))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(*p, "extra", b"old") for p in PAGES]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, refers_to string, payload binary")
    got = warc.round_trip(df.repartition(2))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == records(PAGES)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_bundles_are_seekable(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").coalesce(1)
    work = Workspace(spark)
    index = work.table(warc.write(df, f"{work.path}/bundles", frame_bytes=300, bundle_bytes=400))
    places = index.collect()
    assert len(places) == len(PAGES) and len({p["bundle"] for p in places}) > 1
    for p in places:
        head, _ = warc.fetch(p["bundle"], p["frame_start"], p["frame_bytes"], p["offset"], p["length"])
        assert warc.page_of(head["WARC-Record-ID"]) == p["page_id"]
    for name in {p["bundle"] for p in places}:
        with open(name.removeprefix("file:"), "rb") as f:
            raw = f.read()
        frames = warc.seek_table(io.BytesIO(raw), len(raw))
        # An ordinary reader skips the seek table.
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        assert len(whole) == sum(f[3] for f in frames) and whole.startswith(b"WARC/1.1\r\n")
    urls = {(r["page_id"], r["url"]) for r in warc.read(spark, index).collect()}
    assert urls == {(p, u) for p, u, _ in PAGES}


def test_query_warc(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").collect()]
    got = op3_warc(spark, DATA).collect()
    assert sorted(map(tuple, got), key=str) == records(pages)


HOSTILE = st.lists(st.sampled_from(["Content-Length: 7", "\r\n", "\r", "\n", "WARC/1.1", "WARC-Type: revisit", ": ", "%0D",
                                    "http://x/", "é", "\x00", "9" * 30, "WARC-Refers-To: <urn:page:1>"]), max_size=12).map("".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.none() | HOSTILE, HOSTILE.map(str.encode)), min_size=1, max_size=6))
def test_urls_and_payloads_that_look_like_headers(tmp_path_factory, records):
    path = tmp_path_factory.mktemp("bundles") / "b.warc.zst"
    with open(path, "wb") as out:
        bundle = warc.Bundle(out, 300, 3)
        for i, (url, payload) in enumerate(records):
            bundle.add(i, warc.record(i, url, payload, hashlib.sha256(payload).hexdigest(), None))
        bundle.finish()
    back = list(warc.records_of(str(path)))
    assert [p for _, p in back] == [p for _, p in records]
    for (head, _), (url, _) in zip(back, records):
        assert head["WARC-Type"] == "response" and ("WARC-Target-URI" in head) == (url is not None)
    for page, _, start, size, offset, length in bundle.places:
        assert warc.fetch(str(path), start, size, offset, length)[1] == records[page][1]


def test_round_trip_of_hostile_urls(spark):
    url = "http://x.org/?a=Content-Length: 7&b=\r\nContent-Length: 3\r\n\r\n"
    rows = [(i, url, f"{i} " + "<p>" * 70) for i in range(3)] + [(9, url, None)]
    out = {r["page_id"]: r for r in warc.round_trip(
        spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (out[i]["payload_bytes"], out[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
