import re

from galleryloom.llm import urlfilter
from galleryloom.llm.common import table
from workload.compare import connect, difference


def test_query_equals_sql(spark, sf):
    assert difference(urlfilter.op4_url_filter(spark, sf), connect(sf), urlfilter.ORACLE) is None


def pages():
    links = lambda *hosts: "".join(f'<A class="x" HREF="https://{h}/p">t</a>' for h in hosts)
    return [
        (1, "http://bad.net/x", links("spam.info", "Bad2.info")), (2, "http://spam.info/", links("bad.net", "bad.net", "ok.info")),
        (3, "HTTP://Farm.Info?x://y", links("spam.info")), (4, "https://good.org/fr/a", links("ok.info", "other.info")), (5, "https://good.org/en/a", None),
        (6, "https://ok.info/#frag", "<a href='/here'>h</a><a href=//farm.info/x>f</a>"), (7, None, links("bad.net")), (8, "nothing", ""), (9, "http://a.example.net/en/x", ""),
        (9, "http://a.example.net/fr/x", ""), (None, "http://a.example.com/de/", ""), (10, "http://net", ""), (11, "http://x.net/?q", links("ok.info")), (12, "://", "<a href=>"),
        (13, "http://example.com/" + "long" * 50_000, "<a href='x'>" * 5_000),
    ]


def brute(rows, rounds=urlfilter.ROUNDS):
    def parts(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        return host.lower(), re.match("[^?#]*", rest[len(host) :])[0]

    def rule(host, path):
        fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    seen, edges = {}, {}
    for _, url, html in rows:
        host, path = parts(url)
        if host:
            seen.setdefault(host, []).append(rule(host, path)[1])
        for link in re.findall(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""", html or ""):
            link = "http:" + link if link.startswith("//") else link
            target = parts(link)[0]
            if host and target and host != target:
                edges[host, target] = edges.get((host, target), 0) + 1
    share = lambda kind: {h: v.count(kind) / len(v) for h, v in seen.items() if kind in v}

    def spread(edges, seeds):
        out = {}
        for (a, _), n in edges.items():
            out[a] = out.get(a, 0) + n
        score = dict(seeds)
        for _ in range(rounds):
            new = dict(seeds)
            for (a, b), n in edges.items():
                if a in score:
                    new[b] = new.get(b, 0) + urlfilter.DAMPING * score[a] * n / out[a]
            score = new
        return score

    trust = spread(edges, share("allow"))
    distrust = spread({(b, a): n for (a, b), n in edges.items()}, share("block"))
    result = []
    for page, url, _ in rows:
        host, path = parts(url)
        name, verdict = rule(host, path)
        bad = distrust.get(host, 0) >= urlfilter.BLOCK_AT and distrust.get(host, 0) > trust.get(host, 0)
        result.append((page, host, path, name, verdict or ("block" if bad else "allow")))
    return sorted(result, key=repr)


def test_graph_equals_brute_force_and_sql(spark, tmp_path):
    df = spark.createDataFrame([(*p, "x", "y") for p in pages()], "page_id long, url string, html string, host string, trust string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = urlfilter.op4_url_filter(spark, str(tmp_path))
    want = brute(pages())
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {v[4] for v in want if v[1] == "spam.info"} == {"block"} and {v[4] for v in want if v[0] == 5} == {"allow"}
    con = connect(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert difference(got, con, urlfilter.ORACLE) is None
    assert urlfilter.judge(df.limit(0)).count() == 0
    assert urlfilter.judge(df, rules=()).where("verdict = 'block'").count() == 0
