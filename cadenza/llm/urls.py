"""URL filtering with redirect equivalence: block decisions spread over aliases, explicit allows come first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import join_per_key, shared_dir
from cadenza.llm.components import connected_components

#: (verdict, host, path): fixed rules of the registered query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Comments, scripts and styles, whose tags are none, and tags of links and of page data.
TAGS = r"""(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\b|\z)|<style\b.*?(?:</style\b|\z)|<(?:link|meta)\b[^<>]*>"""
#: A page's own statement of where it really lives: canonical link or immediate redirect.
CANONICAL = r"""(?is)^<link\b.*\brel\s*=\s*["']?canonical["'\s>/]"""
REFRESH = r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh["'\s>/]"""
HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
REFRESH_URL = r"""(?is)\burl\s*=\s*["']?([^"'>\s]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """Scheme and fragment don't make another page: host, path and query. Null where there is no host."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), rest))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule that fits, like ``net/``; null if none fits."""
    found = F.when(F.lit(False), F.lit(""))
    for _, at, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        found = found.when(((host == at) | host.endswith("." + at)) & path.startswith(prefix), at + prefix)
    return found


def verdict_of(rule: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """What a rule says; null for no rule."""
    said = F.when(F.lit(False), F.lit(""))
    for verdict, at, prefix in rules:
        said = said.when(rule == at + prefix, verdict)
    return said


def _without_dots(path: Column) -> Column:
    """An absolute path with its segments ``.`` and ``..`` resolved; ``..`` at the top goes."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    inner = F.slice(parts, 2, F.size(parts) - 1)
    kept = F.aggregate(inner, F.array().cast("array<string>"), lambda done, p: F.when(p == ".", done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def _dotted(path: Column) -> Column:
    return F.when(path.rlike(r"/\.\.?(/|$)"), _without_dots(path)).otherwise(path)


def resolve(base: Column, to: Column) -> Column:
    """The absolute address of a reference on the page `base`; null where it names no other page (empty, fragment only, ``mailto:``)."""
    scheme, site = F.substring_index(base, "://", 1), F.concat(F.substring_index(base, "://", 1), F.lit("://"), host_of(base))
    path = F.regexp_extract(to, r"(?s)^([^?#]*)", 1)
    rest = F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    own = F.when(path_of(base) == "", "/").otherwise(path_of(base))
    folder = F.regexp_extract(own, r"(?s)^(.*/)", 1)
    return (
        F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when((to == "") | to.startswith("#") | to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("?"), F.concat(site, own, to))
        .when(to.startswith("/"), F.concat(site, _dotted(path), rest))
        .otherwise(F.concat(site, _dotted(F.concat(folder, path)), rest))
    )


def named_targets(pages: DataFrame, url: str, html: str) -> DataFrame:
    """source and target: every absolute address that a page names by a canonical link or a meta refresh, one row each.

    Tags inside comments, scripts and styles don't count, nor those that don't end before the next ``<``; a page is read once from start
    to end, whatever it leaves open. Character references for ``&`` are decoded; addresses relative to the scheme, the host, the path or the query are resolved
    against the page's own.
    """
    rows = pages.select(F.col(url).alias("u"), F.col(html).alias("h")).where(F.col("h").rlike(r"(?i)canonical|refresh"))
    rows = rows.select("u", F.regexp_extract_all("h", F.lit(TAGS), F.lit(0)).alias("tags"))
    links = F.transform(F.filter("tags", lambda t: t.rlike(CANONICAL)), lambda t: F.concat(*(F.regexp_extract(t, HREF, i) for i in (1, 2, 3))))
    fresh = F.transform(F.filter("tags", lambda t: t.rlike(REFRESH)), lambda t: F.regexp_extract(t, REFRESH_URL, 1))
    rows = rows.select("u", F.explode(F.concat(links, fresh)).alias("to"))
    rows = rows.select("u", F.replace(F.trim("to"), F.lit("&amp;"), F.lit("&")).alias("to")).where("instr(u, '://') > 0 or instr(to, '://') > 0")
    return rows.select(F.col("u").alias("source"), resolve(F.col("u"), F.col("to")).alias("target")).where("target is not null")


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, page: str = "page_id", url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """Verdict for every page: the longest rule that fits it, else what its aliases say, else allow.

    Aliases are the components of the graph of canonical links and redirects: edges from the pages' own markup and,
    if given, from a table `redirects` (source, target). A rule's verdict on the page itself always stands. A page
    without a rule is allowed if an alias is explicitly allowed, else blocked if an alias is blocked, else allowed.
    Edge ends that are not pages count as aliases too, and are judged by the rules.

    Only addresses that stand on an edge take part in the graph job; each page is then looked up by its address.
    A null url, or one without ``://``, has an empty host and path, no rule and no alias. Repeated rows keep their
    number, an empty table gives none, other columns are ignored. Returns page_id, host, path, rule, verdict.
    """
    rows = pages.select(F.col(page).alias("page_id"), F.col(url).alias("u"), F.col(html).alias("h"))
    edges = named_targets(rows, "u", "h")
    if redirects is not None:
        edges = edges.unionByName(redirects.select("source", "target"))
    shared_dir(pages.sparkSession)
    edges = edges.distinct().checkpoint()
    sides = edges.select(node_of(F.col("source")).alias("s"), node_of(F.col("target")).alias("t"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("u")).select(node_of(F.col("u")).alias("node"), host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path")).where("node is not null").distinct()
    ends = ends.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("said", verdict_of(F.col("rule"), rules))
    members = connected_components(sides, "s", "t")
    named = members.join(ends, "node").select("node", "component", "said")
    says = named.groupBy("component").agg(F.max((F.col("said") == "allow").cast("int")).alias("allows"), F.max((F.col("said") == "block").cast("int")).alias("blocks"), F.count(F.lit(1)).alias("n"))
    inherited = join_per_key(named, says, "component", named.count()).select("node", F.when(F.col("allows") == 1, "allow").when(F.col("blocks") == 1, "block").alias("inherited"))
    judged = rows.select("page_id", node_of(F.col("u")).alias("node"), host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    # a page without an address has no alias; a name of its own keeps such pages from meeting in one task
    judged = judged.withColumn("node", F.coalesce("node", F.concat(F.lit("/"), F.xxhash64("page_id", F.monotonically_increasing_id()).cast("string"))))
    judged = judged.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), F.col("inherited"), F.lit("allow"))
    return judged.join(inherited, "node", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
