"""URL filter by redirect equivalence, in DataFrame functions only.

A rule ``(action, host, path)`` fits its host and all subdomains if the url's path starts with
the rule's path; the rule with the longest ``host + path`` wins, an allow before a block of the
same length. Redirect and canonical-link edges tie urls into classes (connected components); a
page without a rule of its own takes its class's decision: allow if any member is explicitly
allowed, else block if any member is blocked, else allow.

Defined results: a null url or one without ``://`` has empty host and path, no rule, and belongs
to no class, so its verdict is allow. Repeated pages get equal rows. Empty tables give empty
results. Input columns beside page_id, url, html are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import Stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tags that name another url of the same page, and those that give the base of its links.
LINK = r"(?i)<link\b[^>]*>"
REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
BASE = r"(?i)<base\b[^>]*>"
TARGET = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""
#: A text as character references and what lies between them; in attributes a name without ; must not go on with a letter, digit or =.
REFERENCES = r"&#[xX][0-9A-Fa-f]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;|&[A-Za-z][A-Za-z0-9]*(?![A-Za-z0-9=;])|[^&]+|&"
#: Names of references as html defines them, and the numbers that it reads as Windows-1252.
NAMED = html5 | {str(i): bytes([i]).decode("cp1252") for i in range(128, 160) if i not in (129, 141, 143, 144, 157)}
#: The same as lines of one text, as Spark plans with a map of this size are slow; a url is read without tabs and line feeds.
NAMES = "\n" + "".join(f"{k}\t{v.strip(chr(9) + chr(10))}\n" for k, v in NAMED.items())


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end; ASCII letters lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """The url that stands for a node: the host lower-cased, the fragment dropped; null without ://.

    An empty path stays empty, as rules look at the path that a url has."""
    return F.when(url.contains("://"), F.concat(host_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The winning rule as struct(action, rule), null if none fits."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))
    tests = [(a, h + p, ((host == h) | host.endswith("." + h)) & path.startswith(p)) for a, h, p in ranked]
    return F.coalesce(*[F.when(fits, F.struct(F.lit(a).alias("action"), F.lit(r).alias("rule"))) for a, r, fits in tests])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that the plan holds once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def attribute(tag: Column, name: str) -> Column:
    """The attribute's value, trimmed; empty if there is none."""
    found = rf"""(?i)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.trim(F.concat(*[F.regexp_extract(tag, found, i) for i in (1, 2, 3)]))


def decoded(text: Column) -> Column:
    """Character references of an attribute's value replaced by their characters."""

    def named(k: Column) -> Column:
        line = F.concat(F.lit("\n"), k, F.lit("\t"))
        return F.when(F.contains(F.lit(NAMES), line), F.substring_index(F.call_function("split_part", F.lit(NAMES), line, F.lit(2)), "\n", 1))

    def char(code: Column) -> Column:
        good = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.coalesce(named(code.cast("string")), F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(0xFFFD)), 8, "0")), "UTF-32"))

    def one(t: Column) -> Column:
        hexed = F.regexp_extract(t, r"^&#[xX]0*([0-9A-Fa-f]{1,6});?$", 1)
        digits = F.regexp_extract(t, r"^&#0*([0-9]{1,7});?$", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10)).when(digits != "", digits).cast("long")
        return F.when(t.startswith("&#"), let(code, char)).when(t.startswith("&"), F.coalesce(named(F.substr(t, F.lit(2))), t)).otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(REFERENCES), F.lit(0)), one), "")


def resolved(base: Column, to: Column) -> Column:
    """The url that a link ``to`` on the page ``base`` leads to; null for one of another kind, as mailto:."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.concat(F.regexp_extract(path_of(base), r"(?s)^(.*)/", 1), F.lit("/"))
    path = F.regexp_extract(to, r"(?s)^([^?#]*)", 1)
    steps = F.split(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path)), "/")
    steps = F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0)))
    plain = F.aggregate(
        steps, F.expr("cast(array() as array<string>)"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))),
        lambda done: F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(done, F.array(F.lit("")))).otherwise(done),
    )
    rest = F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (to == ""), F.lit(None).cast("string"))
        .when(to.startswith("//"), F.concat(scheme, to))
        .when(path == "", F.concat(site, path_of(base), F.when(rest.startswith("?"), F.lit("")).otherwise(F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)), rest))
        .otherwise(F.concat(site, F.lit("/"), F.array_join(plain, "/"), rest))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) node keys from canonical links and refresh redirects in the html.

    Relative links are resolved against the page's url, or its first base tag that has a link."""
    links = F.filter(F.regexp_extract_all("html", F.lit(LINK), F.lit(0)), lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "canonical"))
    bases = F.filter(F.transform(F.regexp_extract_all("html", F.lit(BASE), F.lit(0)), lambda t: decoded(attribute(t, "href"))), lambda b: b != "")
    base = let(F.try_element_at(bases, F.lit(1)), lambda b: F.coalesce(resolved(F.col("url"), b), F.col("url")))
    targets = F.concat(
        F.transform(links, lambda t: decoded(attribute(t, "href"))),
        F.transform(F.regexp_extract_all("html", F.lit(REFRESH), F.lit(0)), lambda t: decoded(F.regexp_extract(t, TARGET, 1))),
    )
    keys = let(base, lambda b: F.transform(targets, lambda t: let(resolved(b, t), url_key)))
    found = pages.filter(F.col("html").rlike(r"(?i)canonical|http-equiv") & F.col("url").contains("://"))
    return found.select(url_key(F.col("url")).alias("src"), F.explode(keys).alias("dst")).filter("src <> dst").distinct()


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], edges: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. ``edges``: (src, dst) node keys."""
    stage = Stage(pages.sparkSession, "urls")
    none = F.lit(None).cast("struct<action:string,rule:string>")
    rule = lambda h, p: best_rule(h, p, rules) if rules else none
    own = (
        pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .withColumn("won", F.when(F.col("url").contains("://"), rule(F.col("host"), F.col("path"))))
    )
    linked = stage.put("edges", edges.select("src", "dst").filter("src is not null and dst is not null"))
    classes = components(linked, stage)
    # a node's key is host + rest without ://, so put a scheme back to judge it by the same rules
    node = F.concat(F.lit("x://"), F.col("node"))
    acts = (
        classes.select("class", rule(host_of(node), path_of(node)).getField("action").alias("action"))
        .groupBy("class")
        .agg(F.max(F.coalesce(F.col("action") == "allow", F.lit(False))).alias("allow"), F.max(F.coalesce(F.col("action") == "block", F.lit(False))).alias("block"))
    )
    decided = classes.join(acts.filter("block and not allow"), "class").select(F.col("node").alias("key"))
    pages_out = own.withColumn("key", F.when(F.col("won").isNull(), url_key(F.col("url"))))
    # only pages without a rule look their class up; the others carry their own decision
    free, ruled = pages_out.filter("won is null and key is not null"), pages_out.filter("won is not null or key is null")
    free = free.join(decided.withColumn("hit", F.lit(True)), "key", "left").withColumn("verdict", F.when(F.col("hit"), "block").otherwise("allow"))
    ruled = ruled.withColumn("verdict", F.coalesce(F.col("won.action"), F.lit("allow")))
    return reduce(
        DataFrame.unionByName,
        [d.select("page_id", "host", "path", F.col("won.rule").alias("rule"), "verdict") for d in (free, ruled)],
    )
