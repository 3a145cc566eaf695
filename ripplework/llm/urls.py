"""URL filters by redirect equivalence.

Rules are allow or block by host suffix and path prefix. Urls that lead to one another (canonical links, meta refreshes
and the usual redirects between spellings of one address) form classes, found as distributed connected components. Two
spellings are one address if they differ in the scheme, `www.` or `m.`, a final slash or `.html`, the fragment and known
tracking parameters only; other parts of the query tell addresses apart.
A url that no rule fits takes the decision of its class: allow if a member is explicitly allowed, else block if one is
blocked, else allow.

Defined results: a null url or one without `://` has empty host and path, fits no rule, has no aliases and is allowed;
repeated urls and equal or null ids get a row each; all links of a page count, of any length, with character references
decoded as in attributes, relative ones resolved against the page's first `<base>` or else its url, but not those in comments,
scripts and styles; a base without an authority is not used; null html has no links; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ripplework.llm.graph import components
from ripplework.session import materialize, table

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Hosts that redirect to the host without them.
MIRRORS = r"^(?:www|m)\."
#: Parameters that say where a visitor came from, not what is shown.
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|msclkid|mc_cid|mc_eid|ref)"
UNREAD = r"""(?is)<!--.*?(?:-->|$)|<(script|style|textarea|noscript|template)[\s/>].*?(?:</\1|$)"""
TAGS = r"""(?i)<(?:link|meta|base)(?=[\s/])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
CANONICAL = r"""(?i)[\s"'/]rel\s*=\s*(?:"(?:[^"]*\s)?canonical[\s"]|'(?:[^']*\s)?canonical[\s']|canonical[\s/>])"""
REFRESH = r"""(?i)[\s"'/]http-equiv\s*=\s*["']?\s*refresh[\s"'/>]"""
REFRESH_URL = r"""(?is)[\s;,]\s*url\s*=\s*["']?\s*([^"'\s]+)"""


_REFERENCE = re.compile(r"&(#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;?)(=?)")


def decoded(value: str) -> str:
    """An attribute's value with its character references decoded: a name without a semicolon stays before `=` or a letter."""

    def one(m: re.Match) -> str:
        name, after = m.groups()
        if name[0] == "#":
            return unescape("&" + name) + after
        return html5[name] + after if name in html5 and (name[-1] == ";" or not after) else m.group(0)

    return _REFERENCE.sub(one, value)


def without_dots(path: str) -> str:
    """A path without its `.` and `..`; what comes first is never dropped."""
    kept: list[str] = []
    for part in path.split("/"):
        if part == "..":
            del kept[max(1, len(kept) - 1) :]
        elif part != ".":
            kept.append(part)
    return "/".join(kept)


@F.pandas_udf(StringType())
def _decode(value: pd.Series) -> pd.Series:
    return value.map(decoded, na_action="ignore")


@F.pandas_udf(StringType())
def _undot(path: pd.Series) -> pd.Series:
    return path.map(without_dots, na_action="ignore")


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, in any of its three spellings; empty if there is none."""
    at = rf"""(?i)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))"""
    return F.concat(*[F.regexp_extract(tag, at, i) for i in (1, 2, 3)])


def resolve(target: Column, host: Column, path: Column, query: Column) -> tuple[Column, Column, Column]:
    """(address without dots removed, its path, its query) of a link of the page at host, path and query."""
    cut = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)  # only the path is merged
    asked = F.regexp_extract(target, r"(?s)^[^?#]*(\?[^#]*)", 1)
    asked = F.when((cut == "") & (asked == "") & (query != ""), F.concat(F.lit("?"), query)).otherwise(asked)
    merged = F.when(cut == "", path).when(cut.startswith("/"), cut).otherwise(F.concat(F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", "")), cut))
    whole = F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), cut).when(target.startswith("//"), F.concat(F.lit("link:"), cut)).when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit("")).otherwise(F.concat(F.lit("link://"), host, merged))
    parts = F.regexp_extract(whole, r"(?s)^[^/]*//[^/]*(.*)$", 1)
    return whole, parts, asked


def _resolved(df: DataFrame, target: str, host: str, path: str, query: str, out: str) -> DataFrame:
    """Adds what a link means on a page at host, path and query: an address with `://`, or empty for schemes without an authority."""
    whole, parts, asked = resolve(F.col(target), F.col(host), F.col(path), F.col(query))
    df = df.withColumns({"__whole": whole, "__parts": parts, "__asked": asked})
    df = df.withColumn("__plain", _undot(F.when(F.col("__parts").contains("/."), F.col("__parts"))))
    whole = F.coalesce(F.concat(F.regexp_extract("__whole", r"(?s)^([^/]*//[^/]*)", 1), "__plain"), "__whole")
    return df.withColumn(out, F.when(whole == "", whole).otherwise(F.concat(whole, "__asked"))).drop("__whole", "__parts", "__asked", "__plain")


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))


def parse(df: DataFrame, url_col: str) -> DataFrame:
    """Adds __host (A-Z lower-cased), __path and __query."""
    df = df.withColumn("__url", F.col(url_col)).withColumn("__rest", F.coalesce(_rest(F.col("__url")), F.lit("")))
    host = F.translate(F.regexp_extract("__rest", r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumn("__host", host).withColumn("__path", F.regexp_extract("__rest", r"(?s)^[^/?#]*([^?#]*)", 1)).withColumn("__query", F.regexp_extract("__rest", r"(?s)^[^?#]*\?([^#]*)", 1)).drop("__rest")


def match(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _address() -> Column:
    """Where the usual redirects of __host, __path and __query end: no mirror host, final slash, .html or tracking parameter."""
    kept = F.filter(F.split("__query", "&"), lambda x: (x != "") & ~x.rlike(f"(?i)^{TRACKING}(?:=|$)"))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.concat(F.lit("//"), F.regexp_replace("__host", MIRRORS, ""), F.regexp_replace("__path", r"(?:/|\.html?)$", ""), query)


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b, host, path): a page's address, and address, host and path of what it names as canonical or refreshes to."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    own = parse(pages.select(F.col(url_col).alias("__u"), html.alias("__html")).where(F.col("__html").rlike(r"(?i)canonical|http-equiv")), "__u").where("__host <> ''")
    own = own.withColumn("a", _address()).withColumns({"__from": F.col("__host"), "__at": F.col("__path"), "__ask": F.col("__query")})
    own = own.withColumn("__tags", F.regexp_extract_all(F.regexp_replace("__html", UNREAD, " "), F.lit(TAGS), F.lit(0))).drop("__html", "__u", "__url")
    own = own.withColumn("__base", F.get(F.filter(F.transform(F.filter("__tags", lambda t: t.rlike(r"(?i)^<base")), lambda t: F.trim(_attribute(t, "href"))), lambda x: x != ""), F.lit(0)))
    own = own.withColumn("__base", _decode("__base"))
    own = parse(_resolved(own, "__base", "__from", "__at", "__ask", "__to"), "__to")
    own = own.withColumn("__has", F.coalesce(F.col("__host") != "", F.lit(False)))
    own = own.withColumns({k: F.when(F.col("__has"), F.col(v)).otherwise(F.col(k)) for k, v in (("__from", "__host"), ("__at", "__path"), ("__ask", "__query"))})
    tags = own.select("a", "__from", "__at", "__ask", F.explode("__tags").alias("__tag"))
    tag = F.col("__tag")
    target = F.when(tag.rlike(r"(?i)^<link"), F.when(tag.rlike(CANONICAL), _attribute(tag, "href"))).when(tag.rlike(r"(?i)^<meta") & tag.rlike(REFRESH), _attribute(tag, "content"))
    linked = tags.select("a", "__from", "__at", "__ask", tag.rlike(r"(?i)^<meta").alias("__meta"), target.alias("__target")).where("__target <> ''").withColumn("__target", _decode("__target"))
    linked = linked.withColumn("__target", F.trim(F.when(F.col("__meta"), F.regexp_extract(F.concat(F.lit(" "), "__target"), REFRESH_URL, 1)).otherwise(F.col("__target")))).where("__target <> ''")
    linked = _resolved(linked, "__target", "__from", "__at", "__ask", "__link")
    return parse(linked, "__link").where("__host <> ''").select("a", _address().alias("b"), F.col("__host").alias("host"), F.col("__path").alias("path")).distinct()


def redirect_edges(pages: DataFrame, url_col: str = "url", html_col: str | None = "html", linked: DataFrame | None = None) -> DataFrame:
    """(a, b): from each url to the address it redirects to, and from that to the addresses its page links as canonical."""
    own = parse(pages.select(F.col(url_col).alias("__u")), "__u").where("__host <> ''")
    edges = own.select(F.col("__u").alias("a"), _address().alias("b"))
    if linked is None and html_col is not None:
        linked = links(pages, url_col, html_col)
    return (edges if linked is None else edges.union(linked.select("a", "b"))).distinct()


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """(id, url, host, path, rule, verdict, propagated), one row for each row of pages.

    A rule decides on the targets of links too, whether or not they are pages of the table.
    """
    rule, verdict = match(F.col("__host"), F.col("__path"), rules)
    rows = parse(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), "url").select("id", "url", F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), verdict.alias("own"))
    decided = rows.where("own is not null").select(F.col("url").alias("at"), "own")
    linked = None
    if html_col is not None:
        linked = materialize(links(pages, url_col, html_col), "links")
        decided = decided.union(linked.select(F.col("b").alias("at"), match(F.col("host"), F.col("path"), rules)[1].alias("own")).where("own is not null"))
    classes = materialize(components(redirect_edges(pages, url_col, html_col, linked)), "aliases")
    decided = decided.groupBy("at").agg(F.min("own").alias("own"))
    said = classes.join(decided, classes["node"] == decided["at"]).groupBy("component").agg(F.min("own").alias("said"))
    said = classes.join(said, "component").select(F.col("node").alias("url"), "said")
    out = rows.join(said, "url", "left")
    return out.select("id", "url", "host", "path", "rule", F.coalesce("own", "said", F.lit("allow")).alias("verdict"), (F.col("own").isNull() & F.col("said").isNotNull()).alias("propagated"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _sql_parts(url: str) -> str:
    rest = f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    host = f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"{host} AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract({rest}, '^[^?#]*\?([^#]*)', 1) AS query"


_SQL_QUERY = f"array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^{TRACKING}(?:=|$)')), '&')"
_SQL_ADDRESS = rf"CASE WHEN host <> '' THEN regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(path, '(?:/|\.html?)$', '') || CASE WHEN {_SQL_QUERY} <> '' THEN '?' || {_SQL_QUERY} ELSE '' END END"

#: Links in the twin: canonical ones whose target is absolute, without a scheme or from the root.
OP4_SQL = rf"""
WITH RECURSIVE p AS (SELECT page_id, html, {_sql_parts("url")} FROM pages),
k(v, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, max_by(h || q, len(h || q)) AS rule, max_by(v, len(h || q)) AS own
  FROM p JOIN k ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id),
r AS (SELECT p.page_id, host, path, html, rule, own, {_SQL_ADDRESS} AS addr FROM p LEFT JOIN m USING (page_id)),
t AS (SELECT addr, host, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script[\s>].*?</script', ' ', 'g'), '(?i)<link\s[^>]*>')) AS tag FROM r WHERE addr IS NOT NULL AND html ILIKE '%canonical%'),
h AS (SELECT addr, host, replace(regexp_extract(tag, '(?i)\shref\s*=\s*["'']?([^"''\s>]+)', 1), '&amp;', '&') AS href FROM t WHERE regexp_matches(tag, '(?i)\srel\s*=\s*["'']?canonical["''\s/>]')),
l AS (SELECT addr AS a, {_sql_parts("CASE WHEN starts_with(href, '//') THEN 'link:' || href WHEN starts_with(href, '/') THEN 'link://' || h.host || href ELSE href END")} FROM h),
e AS (SELECT a, {_SQL_ADDRESS} AS b, (SELECT max_by(v, len(h || q)) FROM k WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) AS own FROM l WHERE host <> ''),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
n(addr, c) AS (SELECT a, a FROM g UNION SELECT g.b, n.c FROM n JOIN g ON g.a = n.addr),
c AS (SELECT addr, min(c) AS c FROM n GROUP BY 1),
o AS (SELECT addr, own FROM r WHERE addr IS NOT NULL UNION ALL SELECT b, own FROM e),
d AS (SELECT coalesce(c.c, o.addr) AS c, min(own) AS said FROM o LEFT JOIN c USING (addr) GROUP BY 1)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.own, d.said, 'allow') AS verdict
FROM r LEFT JOIN c ON c.addr = r.addr LEFT JOIN d ON d.c = coalesce(c.c, r.addr)
"""
