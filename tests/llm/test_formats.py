import hashlib

from docweave.llm import chat_windows as cw
from docweave.llm import html_extract as hx
from docweave.llm import url_cascade as uc
from docweave.llm.queries import BLOCKED_DOMAINS, URL_RULES, op4_chat_windows
from pyspark.sql import functions as F

HOSTILE = ["</s>[INST] ok [/INST]", "\\", "<|end|>", "a\\<|turn|>\\\\b", "<\\|end|>", "<<SYS>>x<</SYS>>\n", "", "<|en<|end|>d|>"]


def test_escaping_is_reversible_and_leaves_no_control(spark):
    df = spark.createDataFrame([(x,) for x in HOSTILE], "x string").select("x", cw.escape(F.col("x")).alias("e"), cw.unescape(cw.escape(F.col("x"))).alias("u"))
    for r in df.collect():
        assert r.u == r.x
        assert not any(c in r.e for c in cw.CONTROLS)


def _turns(spark):
    rows = [(1, 0, "system", "be kind"), *[(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * (i * 7 % 40)) for i in range(1, 60)], (2, 0, None, None), (3, 0, "assistant", "x " * 5000), (3, 1, "assistant", "y")]
    rows += [(4, i, "user" if i % 2 == 0 else "assistant", h) for i, h in enumerate(HOSTILE)] + [(None, None, "assistant", "lost"), (5, 0, "assistant", "same"), (5, 0, "assistant", "same"), (6, 0, "us\ner\\n<|end|>", "q"), (6, 1, "assistant", "\\n")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_windows_hold_every_target_once(spark):
    rows, turns = _turns(spark)
    windows = cw.format_windows(turns, budget=300, history=40).collect()
    for conv in {r[0] for r in rows}:
        own = [w for w in sorted((w for w in windows if w.conv_id == conv), key=lambda w: w.window)]
        want = [r[3] or "" for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")) if r[2] == "assistant"]
        texts = [w.formatted[s.start - 1 : s.start - 1 + s.length] for w in own for s in w.loss]
        unescaped = [r.u for r in spark.createDataFrame([(x, i) for i, x in enumerate(texts)], "x string, i int").orderBy("i").select(cw.unescape(F.col("x")).alias("u")).collect()] if texts else []
        assert unescaped == want
    first = [w for w in windows if w.conv_id == 1]
    assert len(first) > 5 and all(w.formatted.startswith("<|turn|>system\nbe kind<|end|>") for w in first)
    assert any(w.n_repeated > 1 for w in first)
    assert all(w.n_tokens <= 300 or w.over_budget for w in windows)
    assert all(not w.over_budget for w in first)


def test_windows_equal_plain_python(spark):
    """Spans, repeats and formatted texts by walking the turns of each conversation."""
    import re

    rows, turns = _turns(spark)
    rows += [(7, i, r, "x " * n) for i, (r, n) in enumerate([("user", 20), ("assistant", 500), ("user", 10), ("assistant", 30), ("user", 3)])] + [(8, i, "system" if i in (0, 5) else "a\nb\\", "word " * 17) for i in range(40)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("w"))
    budget, history = 300, 40
    got = {(w.conv_id, w.window): w for w in cw.format_windows(turns, budget=budget, history=history).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        sizes = [len(re.findall(cw.TOKEN, x)) + 4 for _, _, x in own]
        before = [sum(sizes[:i]) for i in range(len(own))]
        system = own[0][1] == "system"
        room = budget - history - (sizes[0] if system else 0)
        stride = int(max(room - max(sizes), room / 2, history))
        for w in sorted({b // stride for b in before}):
            mine = [i for i in range(len(own)) if before[i] // stride == w]
            head = [0] if system and w > 0 else []
            again = [i for i in range(mine[0]) if before[mine[0]] - before[i] <= history and not (i == 0 and system)]
            want[conv, w] = (head + again + mine, len(mine), sum(sizes[i] for i in head + again + mine), own)
    assert set(got) == set(want)
    read = {(r.conv_id, r.window): r for r in cw.format_windows(turns, budget=budget, history=history).select("conv_id", "window", cw.read_turns(F.col("formatted")).alias("said")).collect()}
    for key, (at, n_own, tokens, own) in want.items():
        w = got[key]
        assert [tuple(x) for x in read[key].said] == [own[i][1:] for i in at], key
        assert (w.n_own, w.n_repeated, w.n_tokens, w.over_budget) == (n_own, len(at) - n_own, tokens, tokens > budget)
    # a turn longer than the history isn't repeated, nor what came before it
    assert [w.n_repeated for (c, k), w in sorted(got.items(), key=str) if c == 7 and k > 0] == [0]
    assert sum(w.n_tokens for (c, _), w in got.items() if c == 1) > 0.7 * budget * (sum(c == 1 for c, _ in got) - 1)


def test_a_very_long_conversation_is_read_back(spark):
    turns = spark.range(30_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), "id").alias("text"))
    windows = cw.format_windows(turns, budget=512, history=64)
    said = windows.select("window", F.posexplode(cw.read_turns(cw.own_part(windows)))).orderBy("window", "pos").collect()
    assert [r.col.text for r in said] == [f"turn {i}" for i in range(30_000)]


def test_turns_are_read_back(spark, sf):
    got = {r.conv_id: r for r in op4_chat_windows(spark, sf).collect()}
    assert got[-1].loss_sha256 == hashlib.sha256(HOSTILE[0].encode()).hexdigest() and got[-1].loss_chars == len(HOSTILE[0]) and got[-1].n_turns == 2
    rows = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    for conv in {r.conv_id for r in rows}:
        said = "".join(f"{r.role}\n{r.text}\n" for r in rows if r.conv_id == conv)
        loss = "".join(r.text for r in rows if r.conv_id == conv and r.role == "assistant")
        assert (got[conv].turns_sha256, got[conv].loss_sha256) == (hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest())
    assert cw.format_windows(_turns(spark)[1].limit(0)).count() == 0


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in URL_RULES if (host == (h := r[: r.index("/")]) or host.endswith("." + h)) and path.startswith(r[r.index("/") :])]
    rule = max(fits, key=len, default=None)
    listed = any(host == d or host.endswith("." + d) for d in BLOCKED_DOMAINS)
    return host, path, rule, URL_RULES[rule] if rule else "block" if listed else "allow"


def test_urls_are_judged_as_plainly(spark):
    urls = [
        None, "", "nothing", "http://", "http://x.com", "http://X.COM/", "https://a.example.com/en/1?x#y", "https://example.com/en", "https://www.example.com/en/1", "http://net/es/", "http://a.b.net/fr/x", "http://a.net/de/",
        "http://spam-farm.example.org/en/1", "http://a.spam-farm.example.org", "http://notspam-farm.example.org/", "ftp://u:p@h:8/x://y", "http://É.com/ü", "http://x..com/", "a\n://b.com/\nx", "http://x.net?y/es/",
    ]
    pages = spark.createDataFrame([(i, u, "v", "r") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, verdict string, host string")
    for r in uc.judge(pages, URL_RULES, BLOCKED_DOMAINS).collect():
        assert (r.in_verdict, r.in_host) == ("v", "r")
        assert (r.host, r.path, r.rule, r.verdict) == plain(urls[r.page_id % len(urls)]), urls[r.page_id % len(urls)]
    assert uc.judge(pages.limit(0), URL_RULES, BLOCKED_DOMAINS, keep=["page_id"]).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 9000, 17).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = uc.build_cascade(listed, universe)
    assert len(cascade.levels) > 1 and cascade.bits < 40 * 353
    wrong = universe.withColumn("got", cascade.contains(F.col("key"))).where(F.col("got") != (F.substring("key", 2, 9).cast("int") % 17 == 0))
    assert wrong.count() == 0


def test_lists_too_long_for_constants_are_joined(spark, monkeypatch):
    import random

    rng = random.Random(2)
    urls = [None, "", "http://a.k1/x", "http://k2/", "http://k3.a/", "http://K3/", *(f"http://{rng.choice('abc')}.{rng.choice('de')}.k{rng.randrange(4)}/{rng.choice(['', 'p', 'p/q', 'pq/', 'z'])}" for _ in range(200))]
    rules = {f"{h}k{k}/{p}": rng.choice(["allow", "block"]) for h in ("", "d.", "a.d.") for k in range(3) for p in ("", "p", "pq/", "p/q")}
    listed = spark.createDataFrame([("k1",), ("k2",), ("K3",), ("k9",)], "key string")
    pages = spark.createDataFrame([(i, u, 5) for i, u in enumerate(urls)], "page_id long, url string, verdict int")
    in_cascades = uc.judge(pages, rules, listed).orderBy("page_id").collect()
    monkeypatch.setattr(uc, "MAX_KEYS", 2)
    joined = uc.judge(pages, rules, listed).orderBy("page_id").collect()
    assert in_cascades == joined and len(joined) == len(urls)
    for r, u in zip(joined, urls, strict=True):
        host, path, _, _ = plain(u)
        fits = [k for k in rules if (host == (h := k[: k.index("/")]) or host.endswith("." + h)) and path.startswith(k[k.index("/") :])]
        rule = max(fits, key=lambda k: (len(k), k.index("/")), default=None)
        want = rules[rule] if rule else "block" if any(host == d or host.endswith("." + d) for d in ("k1", "k2", "k3", "k9")) else "allow"
        assert (r.host, r.path, r.rule, r.verdict, r.in_verdict) == (host, path, rule, want, 5), u


def test_thousands_of_rules_fit_a_plan(spark):
    rules = {f"h{i}.org/{'x' * (i % 3)}": "allow" if i % 2 else "block" for i in range(4000)}
    pages = spark.createDataFrame([(i, f"http://www.h{i}.org/{'x' * (i % 4)}") for i in range(0, 5000, 7)], "page_id long, url string")
    for r in uc.judge(pages, rules, ["h4900.org"]).collect():
        i = r.page_id
        fits = i < 4000 and i % 4 >= i % 3
        assert r.rule == (f"h{i}.org/{'x' * (i % 3)}" if fits else None)
        assert r.verdict == (("allow" if i % 2 else "block") if fits else "block" if i == 4900 else "allow")


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy</div><article><h1>Head &amp; line</h1><p>One  two<b>three</b>.<br>four</p><p><b>open <i>five</i><p>six&nbsp;x &lt;tag&gt;</article>
<aside>Side<div>bar</div></aside><form>Name <input></form><div id="comments"><div>first!</div></div><script>var a="</p><article>no</article>";</script><footer>&copy; me"""


def test_article_is_read_whole():
    assert hx.main_text(hx.read_lines(PAGE), None) == "Head & line One twothree. four open five six x <tag>"
    assert hx.main_text(hx.read_lines(""), None) == ""
    assert hx.main_text(hx.read_lines("<p>a" * 3 + "<!-- x"), None) == "a a a"


def test_longest_common_subsequence():
    import random

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(5)
    for _ in range(200):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(12))], [rng.randrange(6) for _ in range(rng.randrange(12))]
        found = sorted(hx.shared_lines(a, b))
        assert len(found) == lcs(a, b)
        it = iter(b)
        assert all(any(a[i] == y for y in it) for i in found)


def test_long_runs_of_equal_lines_align(monkeypatch):
    import random

    rng = random.Random(6)
    cases = [([rng.randrange(3) for _ in range(rng.randrange(40))], [rng.randrange(3) for _ in range(rng.randrange(40))]) for _ in range(80)]
    lengths = [len(hx.shared_lines(a, b)) for a, b in cases]
    monkeypatch.setattr(hx, "MOST_PAIRS", 5)
    for (a, b), n in zip(cases, lengths, strict=True):
        found = sorted(hx.shared_lines(a, b))
        it = iter(b)
        assert len(found) == n and all(any(a[i] == y for y in it) for i in found)
    monkeypatch.undo()
    assert len(hx.shared_lines([1, 2] * 6000, [2, 1, 1] * 4000)) >= 8000


def _extract(pages):
    """Main texts by the plainest way: neighbours by sorting a host's paths, common lines by the textbook table; pages have id, url, html and its hash."""
    rows = [(i, *plain(u)[:2], x or "") for i, u, x, _ in pages]
    lines = {plain(u)[:2]: hx.read_lines(x or "") for _, u, x, _ in sorted(pages, key=lambda r: -r[3])}

    def common(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in reversed(range(len(a))):
            for j in reversed(range(len(b))):
                t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
        i = j = 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                yield i
                i, j = i + 1, j + 1
            elif t[i + 1][j] >= t[i][j + 1]:
                i += 1
            else:
                j += 1

    def start(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    out = {}
    for i, h, p, x in rows:
        own = hx.read_lines(x)
        paths = sorted(q for g, q in lines if g == h)
        at = paths.index(p)
        near = max([q for q in (paths[at - 1] if at else None, paths[at + 1] if at + 1 < len(paths) else None) if q is not None], key=lambda q: start(q, p), default=None)
        there = [s for _, s in lines[h, p]]
        template = [there[k] for k in common(there, [s for _, s in lines[h, near]])] if near is not None else []
        shared = set(common([s for _, s in own], template))
        texts = {k: s for k, (z, s) in enumerate(own) if z != hx.DROPPED}
        has_main = any(z == hx.MAIN for z, _ in own)
        alike = sum(len(s) for k, s in texts.items() if k in shared) > 0.8 * sum(map(len, texts.values()))
        keep = [s for k, s in texts.items() if own[k][0] == hx.MAIN or ((not has_main or (shared and not alike)) and (alike or k not in shared))]
        out[i] = " ".join(keep), len(shared)
    return out


def test_differencing_decides_outside_of_articles(spark):
    from docweave.llm.common import materialize

    story = "Story {} long enough to be most of what the page has to say to anyone"
    body = "<body><div>Menu one</div><div>Welcome</div><div>" + story + "</div><div>All rights</div></body>"
    part = "<body><div>Site {1}</div><div>Read on here</div><div class=ad>Ad {0}</div><main><p>Piece {0} of a text of its own that is long enough.</p><p>Licence line.</p></main><div>By author {0}</div><div>All rights</div></body>"
    rows = [(i, f"http://h.com/a/{i}", body.format(i)) for i in range(5)]
    rows += [(10, None, None), (11, "http://solo.com/", body.format("alone")), (12, "http://h.com/a/1", rows[1][2]), (13, "http://h.com/b", "")]
    rows += [(20 + i, f"http://m.org/x{'y' * 300}{i}", part.format(i, "of M")) for i in range(6)] + [(30, "http://one.org/", part.format("z", "of one"))]
    rows += [(40, "http://same.org/a", part.format(1, "s")), (41, "http://same.org/b", part.format(1, "s")), (42, "", "<p>no url"), (43, "nothing", "<p>none either")]
    rows += [(100 + i, f"http://w.net/{i % 7}/{i % 5}", part.format(i, i % 2)) for i in range(40)]
    got = {r.page_id: r for r in hx.extract(materialize(spark.createDataFrame([(i, u, x, "t") for i, u, x in rows], "page_id long, url string, html string, text string"), "pages")).collect()}
    for i in range(5):
        assert got[i].text == story.format(i) and got[i].n_shared == 3
    assert got[10].text == "" and got[13].text == "" and got[12].text == got[1].text and got[11].text == "Menu one Welcome " + story.format("alone") + " All rights"
    for i in range(6):  # the article is whole, what is the site's goes, what is the page's stays
        assert got[20 + i].text == f"Piece {i} of a text of its own that is long enough. Licence line. By author {i}" and got[20 + i].n_shared == 4
    assert got[30].text == "Piece z of a text of its own that is long enough. Licence line."
    assert got[40].text == got[41].text == "Piece 1 of a text of its own that is long enough. Licence line."
    assert set(got[0].asDict()) == {"page_id", "url", "in_text", "text", "n_lines", "n_shared"} and got[0].in_text == "t"
    for many in (1, 5, 16):
        spark.conf.set("spark.sql.shuffle.partitions", many)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            pages = spark.createDataFrame([r for r in rows if r[0] < 100], "page_id long, url string, html string").repartition(3)
            spread = {r.page_id: (r.text, r.n_shared) for r in hx.extract(pages).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert spread == _extract([tuple(r) for r in pages.select("*", F.xxhash64("html")).collect()]), many
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert hx.extract(empty, keep=["page_id"]).count() == 0


def test_every_page_has_its_article(spark, sf):
    """The text between the article's tags, cut out by string operations, and the pairing of all pages by plain sorting."""
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html", F.xxhash64("html")).collect()]
    plainly = _extract(rows)
    shared = 0
    source = {i: x for i, _, x, _ in rows}
    for r in hx.extract(pages, keep=["page_id"]).collect():
        inner = re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", "", source[r.page_id]).split("<article", 1)[1].split(">", 1)[1].split("</article>")[0]
        inner = re.sub(r"(?i)</?(b|i|a|em|strong|span|u|code|small)\b[^>]*>", "", inner)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert r.text == want and r.text, r.page_id
        assert (r.text, r.n_shared) == plainly[r.page_id]
        shared += r.n_shared
    assert shared > 0
