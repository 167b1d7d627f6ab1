"""URL filters: explicit rules first; else the host is cut into words by a unigram Viterbi and naive Bayes decides.

What is learned: how often each word stands in the pages' visible text, for the cuts, and from the urls that a rule (or a
table of labelled urls) decides, how often each token stands in blocked and allowed ones. All counts are over all rows and
stay in tables: names meet words, and urls meet tokens, by joins, so no vocabulary is cut off to fit a worker.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Bloom, cut, parts_for, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The longest word looked for in a name: a label of a host name has no more letters.
LONGEST_WORD = 63
#: A word is known if it stands so often in the pages' text; an unknown piece costs that much more than the rarest known
#: word, and so much for each letter.
LEAST_COUNT, UNKNOWN_COST, LETTER_COST = 2, 4.0, 2.5
#: Share of allowed urls of unseen hosts that may be blocked; it sets the bar that the odds of block have to pass.
MOST_WRONG = 0.05
#: Pieces of names that a worker hands on at once, and names that one task cuts.
PIECES, TASK_NAMES = 100_000, 20_000
TOKEN = r"[\p{L}\p{N}]+"
PAGE_WORD = re.compile(r"[^\W\d_]+")
RAW = re.compile(r"<(script|style)\b", re.I)
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style")}


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty if it is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rules_frame(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, rule_host, rule_path, verdict) from (verdict, `host/path`) pairs."""
    rows = [(rule, rule.split("/", 1)[0], "/" + rule.split("/", 1)[1] if "/" in rule else "", verdict) for verdict, rule in rules]
    return spark.createDataFrame(rows, "rule string, rule_host string, rule_path string, verdict string")


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, rule_host, rule_path, verdict) of each distinct host and path: the longest rule that fits, ties by its text; else nulls.

    A url's candidates stand together, so a task sums them before they are shuffled.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    each = urls.select("host", "path").withColumn("labels", labels).select("host", "path", F.explode_outer(suffixes).alias("suffix"))
    met = each.join(rules.withColumnRenamed("rule_host", "suffix"), "suffix", "left")
    fits = (F.col("host") != "") & F.col("path").startswith(F.col("rule_path"))
    best = F.max(F.when(fits, F.struct(F.length("rule").alias("l"), "rule", F.col("suffix").alias("rule_host"), "rule_path", "verdict"))).alias("best")
    return met.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.rule_host", "best.rule_path", "best.verdict")


def visible(html: str) -> str:
    """html without tags, comments, scripts and styles; one pass, whatever is left unclosed. An unclosed tag is text."""
    out, at, comments, closed = [], 0, True, {"script": True, "style": True}
    while (lt := html.find("<", at)) >= 0:
        out.append(html[at:lt])
        raw = RAW.match(html, lt)
        if raw and closed[tag := raw.group(1).lower()]:
            if end := RAW_END[tag].search(html, raw.end()):
                at = end.end()
                continue
            closed[tag] = False
        if comments and html.startswith("<!--", lt):
            if (end := html.find("-->", lt + 4)) >= 0:
                at = end + 3
                continue
            comments = False
        gt = html.find(">", lt)
        if gt < 0:
            at = lt
            break
        at = gt + 1
    out.append(html[at:])
    return " ".join(out)


def names_of(host: Column) -> Column:
    """The runs of letters and digits in a host."""
    return F.regexp_extract_all(host, F.lit(TOKEN), F.lit(0))


def path_tokens(path: Column) -> Column:
    """The runs of letters and digits in a path, in lower case, that are more than digits."""
    return F.filter(F.regexp_extract_all(F.lower(path), F.lit(TOKEN), F.lit(0)), lambda t: ~t.rlike(r"^\p{N}+$"))


def pieces(names: DataFrame) -> DataFrame:
    """(name, piece): all that a word of the name may be, each once for each name; words of pages have no decimal digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[str, str]] = []
            for name in b.column(0).to_pylist():
                seen: set[str] = set()
                for start in range(len(name)):
                    for end in range(start + 1, min(len(name), start + LONGEST_WORD) + 1):
                        if name[end - 1].isdecimal():
                            break
                        if (piece := name[start:end]) not in seen:
                            seen.add(piece)
                            rows.append((name, piece))
                    if len(rows) >= PIECES:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["name", "piece"])
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["name", "piece"])

    return names.mapInArrow(run, "name string, piece string")


def word_counts(pages: DataFrame, wanted: DataFrame) -> tuple[DataFrame, int]:
    """(piece, n) of the wanted pieces that stand at least LEAST_COUNT times in the pages' visible text, and the words of all text."""
    sent = pages.sparkSession.sparkContext.broadcast(Bloom(wanted, "piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = sent.value
        known: dict[str, bool] = {}
        for b in batches:
            found: Counter = Counter()
            for html in b.column(0):
                found.update(PAGE_WORD.findall(visible(html.as_py() or "").lower()))
            if len(known) > PIECES:
                known.clear()
            kept = []
            for word, n in found.items():
                if (ok := known.get(word)) is None:
                    ok = known[word] = len(word) <= LONGEST_WORD and maybe(word)
                if ok:
                    kept.append((word, n))
            kept.append((None, sum(found.values())))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["piece", "n"])

    counts = cut(pages.select(F.col("html").cast("string")).mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")), "page-words")
    total = counts.where("piece is null").first()
    return counts.where(F.col("piece").isNotNull() & (F.col("n") >= LEAST_COUNT)), total["n"] if total else 0


def segment(name: str, words: dict[str, float], floor: float | None = None) -> list[str]:
    """The likeliest split of a name into words; unknown pieces cost more the longer they are. Ties: the shortest last word.

    words: their log probabilities. floor: that of an unknown piece before its letters are counted.
    """
    unknown = min(words.values(), default=0.0) - UNKNOWN_COST if floor is None else floor
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            p = words.get(name[start:end])
            options.append((best[start] + (p if p is not None else unknown - LETTER_COST * (end - start)), start))
        score, start = max(options)
        best.append(score)
        back.append(start)
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def segmented(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """(name, words) of each distinct name in the hosts of urls: the words of its likeliest split, digits in it or not."""
    each = cut(urls.select(F.explode(names_of(F.col("host"))).alias("name")).distinct(), "host-names")
    if not (n := each.count()):
        return each.select("name", F.array("name").alias("words"))
    found = cut(pieces(each.repartition(parts_for(urls.sparkSession, n, TASK_NAMES))), "name-pieces")
    counts, total = word_counts(pages, found.select("piece"))
    # names without a known word stay, too
    known = found.join(small(counts), "piece").groupBy("name").agg(F.collect_list(F.struct("piece", "n")).alias("known"))
    floor = math.log(LEAST_COUNT / max(total, LEAST_COUNT)) - UNKNOWN_COST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [segment(name, {k["piece"]: math.log(k["n"] / total) for k in known or ()}, floor) for name, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["name", "words"])

    return cut(each.join(known, "name", "left").select("name", "known").mapInArrow(run, "name string, words array<string>"), "names")


@dataclass
class Model:
    prior: float  # log odds of block before any token is seen
    odds: DataFrame  # token, odds: what each token adds


def fit(decided: DataFrame, names: DataFrame) -> Model:
    """Multinomial naive Bayes from decided urls (host, path, rule_host, rule_path, verdict), each distinct url once.

    The labels and the path that a rule names are left out, so the model learns what the rule does not already say. Every
    occurrence of a token counts; counts are smoothed by one, the prior too. Equal hosts and paths are summed before they
    are taken apart.
    """
    rest = decided.select(
        F.expr("substring(host, 1, length(host) - length(rule_host))").alias("host"),
        path_tokens(F.expr("substring(path, length(rule_path) + 1)")).alias("tokens"),
        (F.col("verdict") == "block").cast("long").alias("block"),
    )
    by_host = rest.groupBy("host").agg(F.sum("block").alias("block"), F.count("*").alias("n"))
    by_name = by_host.select(F.explode(names_of(F.col("host"))).alias("name"), "block", "n").groupBy("name").agg(F.sum("block").alias("block"), F.sum("n").alias("n"))
    of_hosts = by_name.join(names, "name").select(F.explode("words").alias("token"), "block", "n")
    by_path = rest.groupBy("tokens").agg(F.sum("block").alias("block"), F.count("*").alias("n"))
    of_paths = by_path.select(F.explode("tokens").alias("token"), "block", "n")
    counts = cut(of_hosts.unionByName(of_paths).groupBy("token").agg(F.sum("block").alias("block"), F.sum(F.col("n") - F.col("block")).alias("allow")), "token-counts")
    sums = counts.agg(F.sum("block"), F.sum("allow"), F.count("*")).first()
    n_block, n = rest.agg(F.sum("block"), F.count("*")).first()
    blocks, allows = ((x or 0) + sums[2] for x in sums[:2])
    odds = F.log((F.col("block") + 1) / F.lit(max(1, blocks))) - F.log((F.col("allow") + 1) / F.lit(max(1, allows)))
    return Model(math.log(((n_block or 0) + 1) / (n - (n_block or 0) + 1)), counts.select("token", odds.alias("odds")))


def verdicts(urls: DataFrame, names: DataFrame, model: Model) -> DataFrame:
    """urls (host, path and others) with odds, the log odds of block. Tokens that no decided url has say nothing.

    Names, then hosts, and lists of path tokens are scored once each, however many urls have them.
    """
    odds = small(model.odds)
    by_name = cut(names.select("name", F.explode("words").alias("token")).join(odds, "token").groupBy("name").agg(F.sum("odds").alias("odds")), "name-odds")
    hosts = urls.select("host").distinct().select("host", F.explode(names_of(F.col("host"))).alias("name"))
    by_host = cut(hosts.join(small(by_name), "name").groupBy("host").agg(F.sum("odds").alias("host_odds")), "host-odds")
    told = urls.withColumn("tokens", path_tokens(F.col("path")))
    by_path = cut(told.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(odds, "token").groupBy("tokens").agg(F.sum("odds").alias("path_odds")), "path-odds")
    scored = told.join(small(by_host), "host", "left").join(small(by_path), "tokens", "left")
    total = F.lit(model.prior) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0))
    return scored.select(*urls.columns, total.alias("odds"))


def prepared(pages: DataFrame, rules: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages with host and path, their distinct urls with the rule that decides them, and the names of all hosts with their words."""
    host, path = host_path(F.col("url"))
    at = cut(pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path")), "urls")
    urls = cut(ruled(at, small(rules_frame(pages.sparkSession, rules), len(rules))), "distinct-urls")
    return at, urls, segmented(urls, pages)


def held_out(decided: DataFrame, names: DataFrame) -> DataFrame:
    """(host, path, verdict, odds) of the decided urls of every fourth host (crc32, remainder 2), by a model of the others."""
    out = F.crc32("host") % 4 == 2
    return cut(verdicts(decided.where(out).select("host", "path", "verdict"), names, fit(decided.where(~out), names)), "held-out")


def bar(held: DataFrame, wrong: float = MOST_WRONG) -> float:
    """The log odds over which a url is blocked: those that at most a share `wrong` of the held-out allowed urls exceed; 0 at least."""
    # a histogram by hundredths is all that the driver sees
    counts = sorted(map(tuple, held.where("verdict = 'allow'").groupBy(F.ceil(F.col("odds") * 100).alias("at")).agg(F.count("*").alias("n")).collect()))
    over, total = 0, sum(n for _, n in counts)
    least = 0.0
    for at, n in reversed(counts):
        over += n
        if over > wrong * total:
            least = at / 100
            break
    return max(0.0, least)


def held_out_rates(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, urls, hosts, as_decided): how the model judges decided urls of hosts that it did not learn from.

    as_decided is the share of their urls on which it agrees, with the bar that judge() would take.
    """
    _, urls, names = prepared(pages, rules)
    held = held_out(urls.where("rule is not null"), names)
    agrees = (F.col("verdict") == F.when(F.col("odds") > bar(held), "block").otherwise("allow")).cast("double")
    return held.groupBy("verdict").agg(F.count("*").alias("urls"), F.count_distinct("host").alias("hosts"), F.avg(agrees).alias("as_decided"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_chance) of every row of pages (page_id, url, html; others are ignored).

    A rule that fits decides (the longest, ties by text); else naive Bayes, learned from the urls that rules decide and
    from labelled (host, path, verdict), such as a list of hosts with path ``. The odds have to pass a bar that all but
    MOST_WRONG of the allowed urls of held-out hosts stay under. Null urls and urls without `://` have an empty host and
    path, no rule, and the verdict of the prior; with nothing to learn from, all are allowed. Repeated rows
    each have their result; no pages: no rows. Long texts and urls are read whole; names over LONGEST_WORD letters are cut
    into words of at most that many.
    """
    at, urls, names = prepared(pages, rules)
    known = urls.where("rule is not null")
    if labelled is not None:
        more = labelled.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit("").alias("rule_host"), F.lit("").alias("rule_path"), "verdict").distinct()
        names = cut(names.unionByName(segmented(more.join(urls.select("host").distinct(), "host", "left_anti"), pages)).dropDuplicates(["name"]), "names")
        known = known.unionByName(more)
    least = bar(held_out(known, names))
    scored = verdicts(urls, names, fit(known, names))
    # written, so that a url that many rows have can be split over tasks in the join; both sides grow alike
    judged = cut(scored.select("host", "path", "rule", "verdict", "odds"), "judged-urls").hint("merge")
    learned = F.when(F.col("odds") > F.lit(least), "block").otherwise("allow")
    chance = 1 / (1 + F.exp(-F.greatest(F.least("odds", F.lit(500.0)), F.lit(-500.0))))
    return at.join(judged, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", learned).alias("verdict"), chance.alias("block_chance"))
