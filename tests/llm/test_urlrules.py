import random
import re

import duckdb

from tripweave.llm import urlrules
from tripweave.llm.urlrules import ALLOW, BLOCK, host_rule, pattern_rule

URLS = [
    None, "", "no scheme", "://", "http://", "http://com", "http://com/", "https://EXAMPLE.com/en/x", "https://www.example.com/en/x",
    "https://a.www.example.com/en/", "http://example.com/EN/", "http://notexample.com/en/", "http://example.com?x=/en/", "http://example.com#/en/",
    "http://a.net/es/1", "http://a.net/es", "http://net/fr/?q", "http://a.net:80/fr/", "ftp://x.org/a.exe", "http://x.org/A.EXE?x",
    "http://x://y.com/en/", "http://casino.org/", "http://casino-history.org/", "http://mycasino.org/", "http://casino.com/",
    "http://x.org/torrent-river/", "http://x.org/torrents?x=1", "http://x.org/search?a=1&q=2", "http://x.org/search?a=1", "http://É.org/pörn", "http://x.org/porn", "http://x.org/pornstar",
    "x" * 20_000, "http://ads.track.org", "line\nhttp://a.com/\nb", "http://user@example.com/en/",
]


def plain(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest).group().translate(str.maketrans(urlrules.UPPER, urlrules.LOWER))
    path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
    best, pattern = None, None
    for rule in rules:
        key = (len(rule.rule), rule.action == BLOCK, rule.rule)
        if rule.is_host:
            name, slash, start = rule.rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith(slash + start):
                best = max(best or (), (key, rule))
        elif url is not None and re.search(rule.expression, url.lower()):
            pattern = max(pattern or (), (key, rule))
    verdict = best[1].action if best else pattern[1].action if pattern else ALLOW
    return host, path, best[1].rule if best else None, verdict, pattern[1].rule if pattern else None


def pages(spark, urls, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], u, "<p>", "x", 1) for i, u in enumerate(urls)],
                                 "page_id bigint, url string, html string, host string, word int")


def test_verdicts_equal_trying_all_rules(spark):
    urls = URLS + URLS[5:9] * 2
    got = sorted(urlrules.judge_urls(pages(spark, urls)).collect(), key=lambda r: r.page_id)
    want = [plain(u, urlrules.default_rules()) for u in urls]
    assert [tuple(r)[1:] for r in got] == want


def test_sql_twin_agrees_on_odd_urls(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(URLS)))
    result = con.execute(urlrules.sql())
    names = [c[0] for c in result.description]
    want = sorted(result.fetchall())
    assert sorted(tuple(r) for r in urlrules.judge_urls(pages(spark, URLS)).select(*names).collect()) == want


def test_sure_words_are_in_every_url_a_rule_fits():
    random.seed(4)
    letters = ["a", "b", "ab", "^", "*", "/", ".", "-", "|"]
    for _ in range(3000):
        rule = pattern_rule("".join(random.choices(letters, k=random.randint(1, 6))), BLOCK)
        url = "".join(random.choices(["a", "b", "ab", "/", ".", "-", "c"], k=random.randint(1, 9)))
        if re.search(rule.expression, url):
            assert set(rule.words) <= set(re.split("[^0-9a-z]+", url)), (rule, url)


def test_random_rules_equal_trying_all(spark):
    random.seed(8)
    hosts = ["com", "x.com", "y.x.com", "net", "b.net"]
    rules = [host_rule(h + p, random.choice([ALLOW, BLOCK])) for h in hosts for p in random.sample(["/", "/a", "/a/", "/b/c/"], 2)]
    rules += [pattern_rule(p, random.choice([ALLOW, BLOCK])) for p in ("a", "^a^", "|http^", "c|", "a*b", "^x^com^", "b/c")]
    urls = [f"http://{random.choice(hosts + ['q.y.x.com', 'xnet'])}{random.choice(['', '/', '/a', '/ab/c', '/a/b', '/b/c/'])}" for _ in range(300)]
    got = sorted(urlrules.judge_urls(pages(spark, urls), rules).collect(), key=lambda r: r.page_id)
    assert [tuple(r)[1:] for r in got] == [plain(u, rules) for u in urls]


def test_rules_are_filed_under_their_rarest_word(spark):
    urls = pages(spark, ["http://x.com/en/"] * 3 + ["http://com/"] * 9 + ["http://a.org"]).selectExpr("url AS _url")
    rules = urlrules.rule_table(spark, [host_rule("x.com/en/", BLOCK), pattern_rule("*q*", BLOCK), pattern_rule("^rare^com^", BLOCK)])
    filed = {r.rule: r.word for r in urlrules.rule_index(urls, rules).collect()}
    assert filed == {"x.com/en/": "en", "*q*": "", "^rare^com^": "rare"}


def test_empty_table_and_null_or_repeated_ids(spark):
    frame = pages(spark, ["http://a.net/es/"] * 3, [None, 1, 1])
    assert sorted((str(r.page_id), r.verdict) for r in urlrules.judge_urls(frame).collect()) == [("1", BLOCK)] * 2 + [("None", BLOCK)]
    assert urlrules.judge_urls(frame.limit(0)).collect() == []
