"""URL filters whose block decisions follow redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agewise.llm.common import ascii_lower, connected_components, materialise, need

#: (verdict, host, path prefix) of the registered query; fixed values of its contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What identifies a resource: host, path and query, without scheme and fragment; null where there is no host."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule; allow wins a tie; null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1]))
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in ordered
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


#: Patterns over the inside of one tag, from its name on.
_S, _Q = r"[\x20\t\n\f\r]", r"[\x20\t\n\f\r\"'/]"
LINK, META = f"(?i)^link{_S}", f"(?i)^meta{_S}"
CANONICAL = rf"(?i){_Q}rel{_S}*={_S}*[\"']?canonical({_Q}|\z)"
HREF = rf"(?i){_Q}href{_S}*={_S}*[\"']?([^\"'\x20\t\n\f\r]+)"
REFRESH = rf"(?i){_Q}http-equiv{_S}*={_S}*[\"']?refresh({_Q}|\z)"
CONTENT_URL = rf"(?i){_Q}content{_S}*={_S}*[\"'][^\"']*?url{_S}*={_S}*([^\"'\x20\t\n\f\r;]+)"
AMPERSAND = "(?i)&(amp|#38|#x26);"


def link_targets(html: Column, url: Column) -> Column:
    """Array of the absolute addresses that all canonical links and meta refreshes of a page name; null without any such word.

    Comments, closed or not, hold no links. A tag ends at the next ``<`` or ``>``, so that time grows with the page's length
    only; one with such a character inside a quoted value is cut there. ``&amp;`` in an address is read as ``&``.
    """
    parts = F.transform(
        F.split(html, "<!--"), lambda s, i: F.when(i == 0, s).when(s.contains("-->"), F.substr(s, F.locate("-->", s) + 3)).otherwise("")
    )
    tags = F.flatten(F.transform(parts, lambda s: F.filter(F.split(s, "<"), lambda x, i: i > 0)))

    def target(tag: Column) -> Column:
        canonical = tag.rlike(LINK) & tag.rlike(CANONICAL)
        refresh = tag.rlike(META) & tag.rlike(REFRESH)
        found = F.when(canonical, F.regexp_extract(tag, HREF, 1)).when(refresh, F.regexp_extract(tag, CONTENT_URL, 1))
        return F.regexp_replace(found, AMPERSAND, "&")

    low = F.lower(html)
    named = F.transform(F.filter(tags, lambda g: g.rlike(LINK) | g.rlike(META)), lambda g: target(F.substring_index(g, ">", 1)))
    found = F.when(low.contains("canonical") | low.contains("http-equiv"), named)
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    base = F.concat(scheme, F.lit("://"), host_of(url))

    def absolute(x: Column) -> Column:
        return (
            F.when(x.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), x)
            .when(x.startswith("//"), F.concat(scheme, F.lit(":"), x))
            .when(x.startswith("/"), F.concat(base, x))
            .otherwise(F.concat(base, F.regexp_replace(path_of(url), "[^/]*$", ""), x))
        )

    return F.transform(F.filter(found, lambda x: x.isNotNull() & (x != "")), absolute)


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """(id, host, path, rule, verdict, component) for every row of ``pages``.

    ``rules`` is a list held by the driver: (verdict, host, path prefix). A page's own longest fitting rule
    decides. A page without one takes the decision of its equivalence class: the connected component over
    canonical links and refresh redirects found in ``html_col`` and over ``redirects`` (columns src, dst: two
    addresses). A class holds block if one of its addresses is blocked and none is explicitly allowed; a class
    with an explicit allow, and a page alone, is allowed. ``component`` is a 128-bit hash naming the class, null
    for addresses without links.

    Null addresses and addresses without ``://``: host and path empty, no rule, allow. Repeated rows give
    repeated results. Links that cannot be resolved to a host are ignored. An empty table gives no rows.
    """
    need(pages, [id_col, url_col, *([html_col] if html_col else [])])
    url = F.col(url_col)
    rows = pages.select(
        F.col(id_col),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        # addresses without a host are no nodes: keys that meet nothing spread them
        F.coalesce(F.md5(node_of(url)), F.concat(F.lit("-"), F.xxhash64(id_col, url).cast("string"))).alias("__node"),
    ).withColumn("__r", rule_of(F.col("host"), F.col("path"), rules))
    links = []
    if html_col:
        links.append(
            pages.select(url.alias("src"), F.explode(link_targets(F.col(html_col), url)).alias("dst"))
        )
    if redirects is not None:
        links.append(redirects.select("src", "dst"))
    if not links:
        links.append(pages.select(url.alias("src"), url.alias("dst")).limit(0))
    pair = reduce(DataFrame.unionByName, links)

    def end(c: str) -> Column:
        rule = rule_of(host_of(F.col(c)), path_of(F.col(c)), rules)
        return F.struct(F.md5(node_of(F.col(c))).alias("node"), rule["verdict"].alias("verdict"))

    pair = pair.where(node_of(F.col("src")).isNotNull() & node_of(F.col("dst")).isNotNull())
    pair = materialise(pair.select(end("src").alias("s"), end("dst").alias("d")), "links")
    parts = connected_components(pair.select(F.col("s.node").alias("src"), F.col("d.node").alias("dst")))
    ends = pair.select("s.*").unionByName(pair.select("d.*"))
    decided = ends.groupBy("node").agg(F.max(F.col("verdict") == "allow").alias("ok"), F.max(F.col("verdict") == "block").alias("bad"))
    decided = decided.join(parts, "node")
    classes = decided.groupBy("component").agg(F.max("ok").alias("ok"), F.max("bad").alias("bad"))
    blocked = F.coalesce(F.col("bad"), F.lit(False)) & ~F.coalesce(F.col("ok"), F.lit(False))
    known = parts.join(classes, "component").select(
        F.col("node").alias("__node"), "component", F.when(blocked, "block").otherwise("allow").alias("__class")
    )
    return rows.join(known, "__node", "left").select(
        id_col,
        "host",
        "path",
        F.col("__r.rule").alias("rule"),
        F.coalesce(F.col("__r.verdict"), F.col("__class"), F.lit("allow")).alias("verdict"),
        "component",
    )
