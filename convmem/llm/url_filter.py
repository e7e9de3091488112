"""URL filtering with block and allow rules that reach aliases through redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convmem.plans.components import connected_components
from convmem.plans.scratch import ScratchTables

#: (verdict, host, path): a rule holds for its host with all subdomains and for paths that begin so.
Rules = list[tuple[str, str, str]]


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(_lower(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))


def decide(host: Column, path: Column, rules: Rules) -> Column:
    """A struct (rule, verdict) of the longest rule that fits; null if none does. Of rules of equal
    length the allowing one wins, then the first in order of code points."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = out.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
    return out


def address(host: Column, path: Column, url: Column) -> Column:
    """A URL without scheme and fragment, its parameters in order."""
    return _joined(F.concat(host, path), F.filter(_parameters(url), lambda q: q != ""))


def canonical(host: Column, path: Column, url: Column) -> Column:
    """The address that a URL's own form implies as the target of a redirect: without a leading www. or
    m., a closing slash, index page or .html, and parameters that only track."""
    kept = F.filter(_parameters(url), lambda q: (q != "") & ~q.rlike("^(utm_[a-z]+|ref|fbclid|gclid)="))
    return _joined(F.concat(F.regexp_replace(host, "^(www|m)[.]", ""), F.regexp_replace(path, "(/index)?([.]html?)?/*$", "")), kept)


def _parameters(url: Column) -> Column:
    return F.array_sort(F.split(F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit("")), "&"))


def _joined(bare: Column, parameters: Column) -> Column:
    return F.when(F.size(parameters) > 0, F.concat(bare, F.lit("?"), F.array_join(parameters, "&"))).otherwise(bare)


def _node(name: Column) -> Column:
    """128 bits that stand for an address."""
    return F.unhex(F.md5(name))


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target): what pages declare about their address in their HTML, that is canonical
    links, refresh redirects and og:url. Targets without a scheme are taken on the page's host."""
    tag = lambda pattern: F.regexp_extract_all("_html", F.lit(pattern), F.lit(0))
    tags = F.concat(tag(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), tag(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), tag(r"(?is)<meta\b[^>]*\bproperty\s*=\s*[\"']?og:url\b[^>]*>"))
    found = pages.where("_url IS NOT NULL AND _html IS NOT NULL").select("_url", F.explode(tags).alias("_tag"))
    value = F.regexp_extract("_tag", r"(?is)\b(?:href|content)\s*=\s*[\"']?(?:\s*\d+\s*;\s*url\s*=\s*)?['\"]?([^\"'>\s]+)", 1)
    absolute = F.when(value.contains("://"), value).when(value.startswith("//"), F.concat(F.lit("http:"), value)).when(value.startswith("/"), F.concat(F.lit("http://"), host_of(F.col("_url")), value))
    return found.select("_url", absolute.alias("_target")).where("_target IS NOT NULL")


def judge_urls(pages: DataFrame, rules: Rules, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, alias_root.

    A page to which a rule applies has that rule's verdict. Any other takes over the decisions
    made for its aliases: allow if a rule allows one of them, else block if a rule blocks one,
    else allow. Aliases are the connected component over redirect edges (`redirects`: url,
    target), the addresses that pages declare in their HTML, and the edge from each address to
    its canonical form; targets need not be pages themselves, and rules count for them too.
    alias_root names the component.

    Nodes are 128-bit hashes of addresses, so equal addresses are one node from the start and edges
    are narrow; components are found by rounds of joins, decisions are combined by a pre-aggregated
    maximum, and only a page's own row is joined back.

    Null URL, or one without ://: empty host and path, no rule, no alias, allow. Null HTML declares
    nothing. Null redirects are ignored. Repeated rows are judged alike. Empty table: no rows.
    Further columns are ignored.
    """
    p = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html") if html_col in pages.columns else F.lit(None).cast("string").alias("_html"))
    named = lambda u, form: F.when(F.instr(u, "://") > 0, _node(form(host_of(u), path_of(u), u)))
    tables = ScratchTables()
    links = page_links(p)
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("url").alias("_url"), F.col("target").alias("_target")))
    links = tables.write(links.where("_url IS NOT NULL AND _target IS NOT NULL").select(
        named(F.col("_url"), address).alias("src"), named(F.col("_target"), address).alias("dst"), named(F.col("_url"), canonical).alias("src_form"), named(F.col("_target"), canonical).alias("dst_form"),
        decide(host_of(F.col("_target")), path_of(F.col("_target")), rules)["verdict"].alias("_v"),
    ), "url-links")
    own = p.select("_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), named(F.col("_url"), address).alias("_node"), named(F.col("_url"), canonical).alias("_form"))
    own = tables.write(own.withColumn("_d", decide(F.col("host"), F.col("path"), rules)), "url-pages")
    ends = [("src", "dst"), ("src", "src_form"), ("dst", "dst_form")]
    edges = own.select(F.col("_node").alias("src"), F.col("_form").alias("dst"))
    for a, b in ends:
        edges = edges.unionByName(links.select(F.col(a).alias("src"), F.col(b).alias("dst")))
    found = tables.write(connected_components(edges.where("src <> dst"), label="url").withColumnRenamed("node", "_node"), "url-components")

    votes = own.select("_node", F.col("_d.verdict").alias("_v")).unionByName(links.select(F.col("dst").alias("_node"), "_v")).where("_v IS NOT NULL AND _node IS NOT NULL").groupBy("_node").agg(F.max(F.col("_v") == "allow").alias("_allow"))
    roots = votes.join(found, "_node", "left").select(F.coalesce("component", "_node").alias("_root"), "_allow")
    by_root = tables.write(roots.groupBy("_root").agg(F.max("_allow").alias("_allow")), "url-decisions")
    tables.drop_all_but(own, found, by_root)
    placed = own.join(found, "_node", "left").withColumn("_root", F.coalesce("component", "_node"))
    judged = placed.join(by_root, "_root", "left")
    spread = F.when(F.coalesce("_allow", F.lit(True)), F.lit("allow")).otherwise(F.lit("block"))
    return judged.select(F.col("_id").alias(id_col), "host", "path", F.col("_d.rule").alias("rule"), F.coalesce("_d.verdict", spread).alias("verdict"), F.lower(F.hex("_root")).alias("alias_root"))
