"""URL filters: host-and-path rules, and pattern rules indexed by their rarest literal token.

Every pattern must contain a literal token (a run of letters or digits that any match contains, with borders on both
sides). The tokens of the rules are counted over all urls; each rule is filed under the one that fewest urls hold. A url
then looks up its own tokens and runs the regular expressions of the rules it finds, and no others.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import map_rows

TOKEN = re.compile(r"[a-z0-9]+")
#: Rules are kept in every task; a longer list is an error.
MAX_RULES = 200_000

# fixed values: host-and-path rules of the standard filter
SITE_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
# fixed values: pattern rules of the standard filter, (name, expression over the lower-cased url, literal tokens, verdict)
PATTERN_RULES = [
    ("adult-site", r"://([a-z0-9-]+\.)*[a-z0-9-]*\badult\b", ("adult",), "block"),
    ("porn-site", r"://[^/?#]*\bporn\b", ("porn",), "block"),
    ("free-bets", r"://[^/?#]*\bfree-bets\b", ("free", "bets"), "block"),
    ("casino", r"://[^/?#]*\bcasino\b", ("casino",), "block"),
    ("cheap-pills", r"\bcheap-(pills|meds)\b", ("cheap",), "block"),
    ("warez", r"\b(warez)\b", ("warez",), "block"),
    ("torrent-file", r"/[^?#]*\.torrent\b", ("torrent",), "block"),
    ("tracker-path", r"/(ads|track)/click\b", ("click",), "block"),
    ("login-page", r"/(account/)?login\b", ("login",), "block"),
]
# fixed values: words that a host to be blocked has
HOST_WORDS = ["bingo", "escort", "escorts", "jackpot", "keygen", "lottery", "malware", "nude", "nudes", "phishing", "poker", "roulette", "slots", "sportsbook", "viagra", "xxx"]
# fixed values: words that a path to be blocked has as a whole part
PATH_WORDS = ["adserver", "clicktrack", "popunder", "signin", "signup", "unsubscribe"]
# fixed values: endings of domains under which hosts with many digits are blocked
DIGIT_ENDINGS = ["xyz", "top", "click", "icu", "buzz", "loan", "win"]
# every rule is made of its words, so these are its tokens
PATTERN_RULES += [(f"host-{w}", rf"://[^/?#]*\b{w}\b", (w,), "block") for w in HOST_WORDS]
PATTERN_RULES += [(f"path-{w}", rf"://[^/?#]*/([^?#]*/)?{w}([/?#.]|$)", (w,), "block") for w in PATH_WORDS]
PATTERN_RULES += [(f"digits-{w}", rf"://[^/?#]*[0-9]{{4}}[^/?#]*\.{w}([:/?#]|$)", (w,), "block") for w in DIGIT_ENDINGS]
# fixed values: addresses of machines, lists, copies, carts and sessions instead of texts
PATTERN_RULES += [
    ("ad-host", r"://(ads?|adserv(er|ice)?)[0-9]*\.[^/?#]+/[^?#]*\bbanner\b", ("banner",), "block"),
    ("affiliate", r"[?&](aff(iliate)?_id|aff)=[^&#]*&([^#]*&)?subid=", ("subid",), "block"),
    ("attachment", r"[?&]attachment_id=[0-9]+", ("attachment", "id"), "block"),
    ("calendar", r"/calendar/[12][0-9]{3}[-/][01]?[0-9]([-/][0-3]?[0-9])?(/|$)", ("calendar",), "block"),
    ("cart-add", r"[?&]add-to-cart=[0-9]+", ("add", "to", "cart"), "block"),
    ("cart-step", r"/cart/(step|payment)\b", ("cart",), "block"),
    ("checkout-step", r"/checkout/(step|payment)\b", ("checkout",), "block"),
    ("cgi-script", r"/cgi-bin/[^?#]+\.(cgi|pl)\b", ("cgi", "bin"), "block"),
    ("comment-feed", r"/comments/feed/?$", ("comments", "feed"), "block"),
    ("comment-reply", r"[?&]replytocom=[0-9]+", ("replytocom",), "block"),
    ("directory-sort", r"/\?c=[nmsd];o=[ad]$", ("c", "o"), "block"),
    ("archive-copy", r"://web\.archive\.org/(web|save)/", ("archive",), "block"),
    ("download-apk", r"/mirrors?/[^?#]+\.apk([?#]|$)", ("apk",), "block"),
    ("download-exe", r"/mirrors?/[^?#]+\.exe([?#]|$)", ("exe",), "block"),
    ("download-iso", r"/mirrors?/[^?#]+\.iso([?#]|$)", ("iso",), "block"),
    ("empty-search", r"/search/?\?(q|query|s)=(&|#|$)", ("search",), "block"),
    ("feed-rss", r"/feed/(rss2?|atom)/?$", ("feed",), "block"),
    ("forum-member", r"/member(list)?\.php\?([^#]*&)?mode=viewprofile\b", ("php", "mode", "viewprofile"), "block"),
    ("forum-post", r"/posting\.php\?([^#]*&)?mode=(reply|quote)\b", ("posting", "php", "mode"), "block"),
    ("gallery-slide", r"/gallery/[^?#]+[?&]slide=[0-9]+", ("gallery", "slide"), "block"),
    ("jsessionid", r";jsessionid=[0-9a-f]{16,}", ("jsessionid",), "block"),
    ("mailto", r"\bmailto:[^/]+@", ("mailto",), "block"),
    ("paged-tag", r"/tag/[^/?#]+/page/[0-9]+", ("tag", "page"), "block"),
    ("paged-tags", r"/tags/[^/?#]+/page/[0-9]+", ("tags", "page"), "block"),
    ("parked", r"://[^/?#]*\bparkingcrew\b", ("parkingcrew",), "block"),
    ("phpsessid", r"[?&]phpsessid=[0-9a-z]{10,}", ("phpsessid",), "block"),
    ("pixel", r"/pixel\.(gif|png)([?#]|$)", ("pixel",), "block"),
    ("popup", r"/pop(up|under)\.html?\?([^#]*&)?zone=", ("zone",), "block"),
    ("printable", r"[?&]printable=(1|yes)([&#]|$)", ("printable",), "block"),
    ("redirect", r"/redirect(\.php)?\?(url|to|u)=https?(:|%3a)", ("redirect",), "block"),
    ("sharer", r"/sharer(\.php)?\?([^#]*&)?(u|url)=https?(:|%3a)", ("sharer",), "block"),
    ("wiki-diff", r"[?&]diff=(prev|next|[0-9]+)&oldid=[0-9]+", ("diff", "oldid"), "block"),
    ("wiki-edit", r"[?&]action=(edit|history|raw)\b", ("action",), "block"),
    ("wp-admin", r"/wp-(admin|login)(/|\.php)", ("wp",), "block"),
    ("wp-json", r"/wp-json/(wp|oembed)/", ("wp", "json"), "block"),
    ("xmlrpc", r"/xmlrpc\.php\b", ("xmlrpc", "php"), "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first `://` in lower case, and the path up to a query or fragment; both empty without `://`."""
    place = F.instr(url, "://")
    rest = F.when(place > 0, F.substr(url, place + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def by_host(rules: list[tuple[str, str]]) -> dict[str, list[tuple[str, str, str]]]:
    """Host to its rules (path, rule, verdict), the longest first."""
    found: dict[str, list[tuple[str, str, str]]] = {}
    for rule, action in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at = rule.index("/")
        found.setdefault(rule[:at], []).append((rule[at:], rule, action))
    return found


def site_rule(host: str, path: str, rules: dict[str, list[tuple[str, str, str]]]) -> tuple[str, str] | tuple[None, None]:
    """The longest rule `host/path` (and its verdict) whose host is the url's or a domain above it and whose path begins
    the url's: one look-up for each domain, whatever the number of rules."""
    best = None
    labels = host.split(".")
    for i in range(len(labels)):
        hit = next((r for r in rules.get(".".join(labels[i:]), ()) if path.startswith(r[0])), None)
        if hit and (best is None or (len(hit[1]), hit[1]) > (len(best[1]), best[1])):
            best = hit
    return (best[1], best[2]) if best else (None, None)


def rarest_tokens(urls: DataFrame, url_col: str, patterns: list[tuple]) -> dict[str, str]:
    """For each rule its literal token that the fewest urls hold; ties go to the longer, then the smaller token."""
    literals = sorted({t for _, _, tokens, _ in patterns for t in tokens})
    if not literals:
        return {}
    table = urls.sparkSession.createDataFrame([(t,) for t in literals], "token string")  # at most MAX_RULES rules' tokens
    seen = urls.select(F.explode(F.array_distinct(F.split(F.lower(F.col(url_col)), "[^a-z0-9]+"))).alias("token")).join(F.broadcast(table), "token")
    counts = {r.token: r.n for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {name: min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t)) for name, _, tokens, _ in patterns}


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", site_rules: list[tuple[str, str]] | None = None, patterns: list[tuple] | None = None, default: str = "allow") -> DataFrame:
    """Judge every url.

    Returns the id, host, path, rule (the longest site rule, else null), pattern (the first pattern rule by name that
    matches where no site rule fits, else null) and verdict. A null url, or one without `://`, has an empty host and
    path and fits no site rule; patterns see the whole of a url, so they may match one without `://`. Repeated urls are judged alike. Other columns are not read. Rules are at
    most MAX_RULES, or it is an error. One pass to count the rules' tokens, one to judge; no rows are shuffled but
    counts of tokens.
    """
    site_rules, patterns = SITE_RULES if site_rules is None else site_rules, PATTERN_RULES if patterns is None else patterns
    if len(patterns) > MAX_RULES or len(site_rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    for name, _, tokens, _ in patterns:
        if not tokens or any(not TOKEN.fullmatch(t) for t in tokens):
            raise ValueError(f"pattern {name} needs literal tokens of a-z and 0-9")
    key = rarest_tokens(pages, url_col, patterns)
    filed: dict[str, list[tuple]] = {}
    for name, expression, _, action in sorted(patterns):
        filed.setdefault(key[name], []).append((name, re.compile(expression, re.ASCII), action))
    sites = by_host(site_rules)

    def judge(batch: pa.RecordBatch) -> dict:
        rules, names, verdicts = [], [], []
        for url, host, path in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
            rule, action = site_rule(host, path, sites)
            hit = None
            if action is None and url:
                low = url.lower()
                fetched = sorted((r for t in {*TOKEN.findall(low)} & filed.keys() for r in filed[t]), key=lambda r: r[0])
                hit = next((r for r in fetched if r[1].search(low)), None)
            rules.append(rule)
            names.append(hit and hit[0])
            verdicts.append(action or (hit[2] if hit else default))
        return {id_col: batch.column(0), "host": batch.column(2), "path": batch.column(3), "rule": rules, "pattern": names, "verdict": verdicts}

    host, path = host_and_path(F.col(url_col))
    rows = pages.select(id_col, url_col, host.alias("__host"), path.alias("__path"))
    kind = pages.schema[id_col].dataType.simpleString()
    return map_rows(rows, judge, f"`{id_col}` {kind}, host string, path string, rule string, pattern string, verdict string")
