"""URL filters with redirect equivalence: rules, aliases by connected components, block decisions passed to aliases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import cut, written
from tabulon.llm.components import connected_components


@dataclass(frozen=True)
class Rule:
    """``verdict`` ("allow" or "block") for a host with all its subdomains, where the path begins with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/ ? #`` or the end, ASCII lower case; empty without ``://``."""
    return F.coalesce(_lower_ascii(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_spelling(url: Column) -> Column:
    """The address without what commonly redirects: scheme, ``www.`` or ``m.``, query, fragment, ``.html`` and last slash."""
    path = F.regexp_replace(path_of(url), r"(\.html?|/+)$", "")
    return F.concat(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), path)


def _decoded(text: Column) -> Column:
    """Character references with a semicolon replaced: numbers, and the five names that every attribute may need."""

    def piece(p: Column) -> Column:
        ref = F.regexp_extract(p, r"^&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|amp|lt|gt|quot|apos);", 1)
        digits = F.when(ref.rlike("^#[xX]"), F.substring(ref, 3, 6)).otherwise(F.conv(F.substring(ref, 2, 7), 10, 16))
        code = F.conv(digits, 16, 10).cast("long")
        known = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.when(ref == "", None)
        for name, value in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
            char = char.when(ref == name, value)
        char = char.when(known, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))
        return F.coalesce(F.concat(char, F.substring(p, F.length(ref) + 3, F.length(p))), p)

    return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "(?=&)"), piece), "")).otherwise(text)


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments carried out."""
    parts = F.split(F.regexp_replace(path, r"(/\.\.?)$", "$1/"), "/")
    step = lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(s)))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")).otherwise(path)


def resolved(target: Column, url: Column) -> Column:
    """A link's target as an address: relative to the scheme, host, folder or path of the page's ``url``; empty stays empty."""
    origin = F.regexp_extract(url, r"^((?s:.*?)://[^/?#]*)", 1)
    own, path = path_of(url), F.regexp_extract(target, r"^[^?#]*", 0)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)?", 1)
    folder = F.when(own.contains("/"), F.regexp_replace(own, r"[^/]*$", "")).otherwise(F.lit("/"))
    tail = F.regexp_extract(target, r"^[^?#]*((?s:.*))$", 1)
    return (
        F.when((target == "") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"^((?s:.*?))://", 1), F.lit(":"), target))
        .when(target.startswith("#"), F.concat(origin, own, query, target))
        .when(target.startswith("?"), F.concat(origin, own, target))
        .otherwise(F.concat(origin, _without_dots(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))), tail))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Redirect and canonical-link edges ``source, target`` that the pages themselves declare.

    ``<link rel="canonical" href>``, ``<meta http-equiv="refresh" content="0; url=...">``, and the usual
    redirect to the canonical spelling of an address (given as ``canonical:`` plus the spelling).
    Character references in targets are decoded and relative targets are resolved against the page's address.

    Pages are searched once, and few declare anything: what they declare is written as it is found, decoded, and resolved,
    step by step, since decoding and resolving name their argument many times over.
    """
    tag = lambda pattern: F.regexp_extract("html", pattern, 1)
    link = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
    refresh = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""
    known = pages.filter(host_of(F.col("url")) != "")
    found = written(known.select("url", F.explode(F.array(tag(link), tag(refresh))).alias("target")).filter("target <> ''"), "declared_links")
    decoded = written(found.select("url", _decoded(F.col("target")).alias("target")), "decoded_links")
    declared = decoded.select(F.col("url").alias("source"), resolved(F.col("target"), F.col("url")).alias("target"))
    spelled = known.select(F.col("url").alias("source"), F.concat(F.lit("canonical:"), canonical_spelling(F.col("url"))).alias("target"))
    return written(declared.union(spelled).filter("target <> '' and target <> source"), "page_links")


def judge_by_rules(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``host, path, rule, rule_verdict`` to a table with ``url``; of several fitting rules the longest wins.

    Two fitting rules of one length can only be equal in text; then an allow rule wins.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    out = urls.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow")):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def filter_urls(pages: DataFrame, rules: list[Rule], links: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, component_blocked`` for every row of ``pages`` (``page_id, url``).

    ``links`` (``source, target``) are redirects and canonical links.  All addresses that are
    connected by them are aliases.  A page with a fitting rule has that rule's verdict (so an explicit
    allow holds whatever its aliases are); a page without one is blocked if any alias is blocked by a
    rule, and allowed otherwise.  A null url, or one without ``://``, has an empty host and path, fits
    only rules with an empty host, has no aliases and is allowed.  Repeated rows are judged each.

    Addresses are numbered once (written, so that the numbers hold), components run on the numbers.
    """
    keys = pages.select("page_id", "url")
    addresses = links.select(F.col("source").alias("url")).union(links.select("target")).distinct()
    numbered = cut(judge_by_rules(addresses.withColumn("id", F.monotonically_increasing_id()), rules).select("url", "id", "rule_verdict"))
    ids = numbered.select("url", "id")
    edges = (
        links.join(ids.select(F.col("url").alias("source"), F.col("id").alias("a")), "source")
        .join(ids.select(F.col("url").alias("target"), F.col("id").alias("b")), "target")
        .select("a", "b")
    )
    parts = connected_components(edges)
    # the target of a link may fit a block rule without being a page itself
    seeds = numbered.filter("rule_verdict = 'block'").select("id")
    hit = parts.join(seeds, parts["node"] == seeds["id"], "left_semi").select("component").distinct()
    blocked = (
        parts.join(hit, "component", "left_semi")
        .join(ids, F.col("node") == ids["id"])
        .select("url", F.lit(True).alias("component_blocked"))
    )
    return (
        judge_by_rules(keys, rules)
        .join(blocked, "url", "left")
        .select(
            "page_id", "host", "path", "rule",
            F.coalesce("rule_verdict", F.when(F.col("component_blocked"), "block"), F.lit("allow")).alias("verdict"),
            F.coalesce("component_blocked", F.lit(False)).alias("component_blocked"),
        )
    )
