import functools
import itertools
import math
import re
import time
import zlib
from collections import Counter

from gridloom.llm import urlfilter
from gridloom.llm.queries import URL_RULES


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = []
    for _, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


def test_rules_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in urlfilter.judge(pages, URL_RULES).collect()}
    verdicts = {rule: v for v, rule in URL_RULES}
    for r in pages.collect():
        want = brute(r.url, URL_RULES)
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == want and (g.rule is None or g.verdict == verdicts[g.rule])


def test_bayes_equals_brute_force(spark):
    """Odds, bar and verdicts against plain counting over all rows, on pages whose rules decide some urls of many hosts."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = urlfilter.judge(pages, URL_RULES).collect()
    rows, verdicts = pages.collect(), {rule: v for v, rule in URL_RULES}
    words = Counter(w for r in rows for w in urlfilter.PAGE_WORD.findall(urlfilter.visible(r.html or "").lower()))
    total = sum(words.values())
    logs = {w: math.log(n / total) for w, n in words.items() if n >= urlfilter.LEAST_COUNT}
    floor = math.log(urlfilter.LEAST_COUNT / total) - urlfilter.UNKNOWN_COST
    cut_up = functools.cache(lambda name: urlfilter.segment(name, logs, floor) if name.isalpha() else [name])

    def tokens(host, path):
        return [w for name in re.findall(r"[^\W_]+", host) for w in cut_up(name)] + [t for t in re.findall(r"[^\W_]+", path.lower()) if not t.isnumeric()]

    urls = {brute(r.url, URL_RULES) for r in rows}
    decided = [(h, p, rule, verdicts[rule]) for h, p, rule in urls if rule]

    def learned(known):
        counts = {"block": Counter(), "allow": Counter()}
        for h, p, rule, v in known:
            rule_host, rule_path = rule.split("/", 1)
            counts[v].update(tokens(h[: len(h) - len(rule_host)], p[len(rule_path) + 1 :]))
        vocabulary = {*counts["block"], *counts["allow"]}
        sums = {v: sum(c.values()) + len(vocabulary) for v, c in counts.items()}
        prior = math.log((sum(v == "block" for *_, v in known) + 1) / (sum(v == "allow" for *_, v in known) + 1))
        chance = lambda t, v: math.log((counts[v][t] + 1) / sums[v])
        return lambda h, p: prior + sum(chance(t, "block") - chance(t, "allow") for t in tokens(h, p) if t in vocabulary)

    is_out = lambda host: zlib.crc32(host.encode()) % 4 == 2
    part = learned([d for d in decided if not is_out(d[0])])
    held = [(part(h, p), v) for h, p, _, v in decided if is_out(h)]
    allowed = sorted((math.ceil(x * 100) / 100 for x, v in held if v == "allow"), reverse=True)
    least = max(0.0, allowed[int(urlfilter.MOST_WRONG * len(allowed))]) if allowed else 0.0
    odds = learned(decided)
    for g in got:
        x = odds(g.host, g.path)
        assert abs(g.block_chance - 1 / (1 + math.exp(-x))) < 1e-9
        if g.rule is None and abs(x - least) > 1e-6:
            assert g.verdict == ("block" if x > least else "allow")
    rates = {r.verdict: r.as_decided for r in urlfilter.held_out_rates(pages, URL_RULES).collect()}
    assert rates["allow"] >= 1 - urlfilter.MOST_WRONG
    assert 0 < sum(g.rule is None and g.verdict == "block" for g in got) < sum(g.rule is None and g.verdict == "allow" for g in got) * 2


def test_labelled_hosts_teach_their_words(spark):
    pages = spark.createDataFrame([(1, "http://cheapflights.example/x", "cheap flights cheap flights pills pills"), (2, "http://goodbooks.example/", "good books good books"), (3, "http://cheappills.example/", ""), (4, "http://nicebooks.example/", "nice nice")], "page_id long, url string, html string")
    labelled = spark.createDataFrame([("cheapflights.test", "", "block"), ("pills.test", "", "block"), ("goodbooks.test", "", "allow"), ("nice.test", "", "allow")], "host string, path string, verdict string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, [], labelled).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow"}
    assert {r.verdict for r in urlfilter.judge(pages, []).collect()} == {"allow"}


def test_visible_text():
    old = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
    for html in ("a<b>c</b> d", "x<script>var t='</p>';</script >y", "<!-- a > b -->z", "<!-- open > z", "<style>q", "<script>a<style>b</style>c", "a < b", "<SCRIPT\n>1</script>2<scripty>3", "<!-->a-->b", ""):
        assert urlfilter.visible(html).split() == old.sub(" ", html).split(), html
    began = time.perf_counter()
    for piece in ("<", "<!--", "<script>", "<style </style", "<a", "</script  "):
        assert urlfilter.visible(piece * 200_000) is not None
    assert time.perf_counter() - began < 20


def test_segmentation_is_the_best_split():
    words = {"the": -1.0, "rat": -2.0, "therat": -9.0, "her": -2.5, "at": -1.5, "t": -6.0, "a": -3.0}
    name = "therat"
    floor = min(words.values()) - 4

    def cost(parts):
        return sum(words.get(p, floor - 2.5 * len(p)) for p in parts)

    splits = []
    for k in range(len(name)):
        for cuts in itertools.combinations(range(1, len(name)), k):
            at = (0, *cuts, len(name))
            splits.append([name[a:b] for a, b in zip(at, at[1:])])
    assert cost(urlfilter.segment(name, words)) == max(map(cost, splits)) and urlfilter.segment(name, words) == ["the", "rat"]
    assert urlfilter.segment("", words) == [] and "".join(urlfilter.segment("zzthezz", words)) == "zzthezz"


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "no scheme", "<p>text"), (3, "HTTP://A.NET?x", ""), (4, "http://A.NET/", None), (4, "http://A.NET/", None), (None, "x://org/fr/", "<"), (5, "http://é.Org/fr/?q#f", "<b>"), (6, "http://" + "a" * 5000 + ".com/" + "b/" * 5000, "w " * 50_000), (7, "http://...net/de", "x")]
    pages = spark.createDataFrame([(*r, "r", "v") for r in rows], "page_id long, url string, html string, rule string, verdict string")
    got = urlfilter.judge(pages, URL_RULES).collect()
    assert sorted((r.page_id or 0, r.host, r.path, r.rule or "") for r in got) == sorted((i or 0, *(x or "" for x in brute(u, URL_RULES))) for i, u, _ in rows)
    assert {r.verdict for r in got if r.page_id in (1, 2)} == {"allow"} and all(r.verdict == "block" for r in got if r.page_id == 4)
    assert urlfilter.judge(pages.limit(0), URL_RULES).count() == 0


def test_names_with_digits_are_cut_too(spark):
    text = "cheap flights cheap flights good books good books"
    hosts = ["cheap24flights", "good4books", "7cheap", "books2024", "1234", "x9y", "cheapflights"]
    pages = spark.createDataFrame([(k, f"http://{h}.example/", text) for k, h in enumerate(hosts)], "page_id long, url string, html string")
    urls = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r["name"]: r.words for r in urlfilter.segmented(urls, pages).collect()}
    assert got == {"cheap24flights": ["cheap", "24", "flights"], "good4books": ["good", "4", "books"], "7cheap": ["7", "cheap"], "books2024": ["books", "2024"], "1234": ["1234"], "x9y": ["x9y"], "cheapflights": ["cheap", "flights"]}
    labelled = spark.createDataFrame([("cheapflights.test", "", "block"), ("goodbooks.test", "", "allow"), ("goodbooks2.test", "", "allow")], "host string, path string, verdict string")
    verdict = {r.page_id: r.verdict for r in urlfilter.judge(pages, [], labelled).collect()}
    assert verdict[0] == "block" and verdict[1] == "allow" and verdict[3] == "allow"
