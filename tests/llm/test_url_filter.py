import re

import pytest

from pagequire.llm.url_filter import PATTERN_RULES, SITE_RULES, filter_urls, rarest_tokens

URLS = [
    "http://www.example.com/en/1", "https://EXAMPLE.com/en/x", "http://a.example.com/en/?q", "http://example.com/en", "http://example.com", "http://x.net/es/a#b", "http://net/fr/", "http://xnet/fr/", "http://blog.example.com/en/",
    "http://free-bets.example.org/x", "http://adult-x.org/", "http://adulthood.org/", "nothing", "", None, "http://casino.example.net/es/1", "ftp://a.b/warez/x.torrent?y", "http://h?x/en/", "http://h#x", "a://b://c/d", "http://www.example.com/EN/", "http://casino.example.com/x",
]


def plain(url):
    low = url or ""
    rest = low.split("://", 1)[1] if "://" in low else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(r, a) for r, a in SITE_RULES if ("." + host).endswith("." + r[: r.index("/")]) and path.startswith(r[r.index("/") :])]
    rule, action = max(fits, key=lambda x: len(x[0]), default=(None, None))
    hits = sorted((n, a) for n, e, _, a in PATTERN_RULES if url and re.search(e, url.lower())) if not rule else []
    return host, path, rule, hits[0][0] if hits else None, action or (hits[0][1] if hits else "allow")


def test_urls_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, rule string, verdict string")
    out = {r.page_id: (r.host, r.path, r.rule, r.pattern, r.verdict) for r in filter_urls(pages).collect()}
    assert out == {i: plain(u) for i, u in enumerate(URLS + URLS[:3])}
    assert {out[i][4] for i in (0, 1, 5, 9, 10, 11)} == {"allow", "block"} and out[10][3] == "adult-site" and out[11][3] is None
    assert filter_urls(pages.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([("http://free.a/",), ("http://free.b/bets",), ("http://free.c/",)], "url string")
    assert rarest_tokens(pages, "url", [("r", "x", ("free", "bets"), "block"), ("s", "x", ("free",), "block"), ("t", "x", ("free", "none"), "block")]) == {"r": "bets", "s": "free", "t": "none"}


def test_rules_without_tokens_are_refused(spark):
    with pytest.raises(ValueError):
        filter_urls(spark.createDataFrame([(1, "x")], "page_id long, url string"), patterns=[("r", ".*", (), "block")])


EXAMPLES = {
    "ad-host": "://ads2.x.com/a/banner", "affiliate": "://x.com/?aff_id=3&k=1&subid=2", "attachment": "://x.com/?attachment_id=12", "calendar": "://x.com/calendar/2020-03-1", "cart-add": "://x.com/?add-to-cart=3", "cart-step": "://x.com/cart/step",
    "checkout-step": "://x.com/checkout/payment", "cgi-script": "://x.com/cgi-bin/a.pl", "comment-feed": "://x.com/a/comments/feed/", "comment-reply": "://x.com/a?replytocom=3", "directory-sort": "://x.com/?c=n;o=d",
    "archive-copy": "://web.archive.org/web/2020/x", "download-apk": "://x.com/mirror/a.apk", "download-exe": "://x.com/mirrors/b/a.exe?x", "download-iso": "://x.com/mirror/a.iso", "empty-search": "://x.com/search/?q=", "feed-rss": "://x.com/feed/rss2",
    "forum-member": "://x.com/memberlist.php?u=2&mode=viewprofile", "forum-post": "://x.com/posting.php?mode=reply", "gallery-slide": "://x.com/gallery/a?slide=4", "jsessionid": "://x.com/a;jsessionid=0123456789abcdef", "mailto": "://x/mailto:a@x.com",
    "paged-tag": "://x.com/tag/a/page/3", "paged-tags": "://x.com/tags/a/page/3", "parked": "://a.parkingcrew.net", "phpsessid": "://x.com/?phpsessid=0123456789", "pixel": "://x.com/pixel.gif?x", "popup": "://x.com/popup.html?zone=3", "printable": "://x.com/a?printable=yes",
    "redirect": "://x.com/redirect?url=https://y", "sharer": "://x.com/sharer.php?u=http%3a", "wiki-diff": "://x.com/w?diff=prev&oldid=3", "wiki-edit": "://x.com/w?title=a&action=edit", "wp-admin": "://x.com/wp-login.php", "wp-json": "://x.com/wp-json/oembed/", "xmlrpc": "://x.com/xmlrpc.php",
    "digits-xyz": "://a12345b.xyz/", "digits-win": "://a.1234.win", "adult-site": "://my-adult.x", "porn-site": "://porn.x", "free-bets": "://free-bets.x", "casino": "://a.casino", "cheap-pills": "://x/cheap-meds", "warez": "://x/warez", "torrent-file": "://x/a.torrent", "tracker-path": "://x/ads/click", "login-page": "://x/login",
}


def test_tokens_stand_in_every_match():
    """Of urls made of the examples' and the rules' words, each match of a rule has all the rule's tokens; every rule has a
    match, and none is found in plain addresses."""
    import itertools
    import re

    from pagequire.llm.url_filter import HOST_WORDS, PATH_WORDS, PATTERN_RULES, TOKEN

    words = [*HOST_WORDS, *PATH_WORDS, "plain", "x1"]
    urls = [f"http{u}" for u in EXAMPLES.values()] + [f"http{u}{m}{w}" for u in EXAMPLES.values() for m in ("", "-", "_", "&", "/", "#") for w in words[::5]]
    urls += [f"http://{a}{m}{b}.org/{c}/x.{a}" for a, b in itertools.product(words, words) for m in ("-", "_", ".", "x") for c in (b,)] + [f"https://a9999{w}" for w in (".top/", ".click", ".icu#", ".buzz?", ".loan/x", ".top.org/")]
    matched = set()
    for name, expression, tokens, _ in PATTERN_RULES:
        rule = re.compile(expression, re.ASCII)
        assert name not in EXAMPLES or rule.search(f"http{EXAMPLES[name]}"), name
        for url in urls:
            if rule.search(url):
                matched.add(name)
                assert {*tokens} <= {*TOKEN.findall(url)}, (name, url)
        assert not any(rule.search(u) for u in ("https://www.example.org/en/8353?page=2&ref=x", "http://blog.x.com/2020/03/a-page.html#top", "https://a.b/tag/x", "https://x.com/search?q=word", "https://shop.x.com/cart/"))
    assert matched == {r[0] for r in PATTERN_RULES} and len(matched) == len(PATTERN_RULES) > 60


def test_site_rules_by_host_equal_a_plain_loop():
    import random

    from pagequire.llm.url_filter import by_host, site_rule

    r = random.Random(2)
    hosts = ["com", "a.com", "b.a.com", "x.org", "org", ""]
    rules = [(f"{h}{p}", r.choice(["allow", "block"])) for h in hosts[:5] for p in ("/", "/en/", "/en/x") if r.random() < 0.7]
    for host in [*hosts, "c.b.a.com", "aa.com", "com.org", "..com"]:
        for path in ("", "/", "/en/", "/en/xy", "/fr"):
            fits = [(len(t), t, v) for t, v in rules if f".{host}".endswith("." + t.split("/")[0]) and path.startswith(t[t.index("/") :])]
            assert site_rule(host, path, by_host(rules)) == (max(fits)[1:] if fits else (None, None))


def test_url_without_a_scheme(spark):
    from pagequire.llm.url_filter import filter_urls

    rows = spark.createDataFrame([(1, "foo/login"), (2, "foo.com/en"), (3, None)], "page_id long, url string")
    assert sorted(tuple(x) for x in filter_urls(rows).collect()) == [(1, "", "", None, "login-page", "block"), (2, "", "", None, None, "allow"), (3, "", "", None, None, "allow")]


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "http://a.com/x", "h", "r"), (1, "http://a.com/x", "h", "r"), (None, "http://b.net/es/", "h", "r"), (2, None, "h", "r")]
    out = filter_urls(spark.createDataFrame(rows, "page_id long, url string, Host string, rule string")).collect()
    assert sorted((str(x.page_id), x.host, x.verdict) for x in out) == [("1", "a.com", "allow"), ("1", "a.com", "allow"), ("2", "", "allow"), ("None", "b.net", "block")]
