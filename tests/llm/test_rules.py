"""Quality measures, URL spreading, windows at the edges, and the archive's index."""

import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from shelfcast.llm import decontaminate, quality, urlfilter, warc
from shelfcast.sources.staging import stage_path


def test_repeat_words_against_marking():
    rng = np.random.default_rng(2)
    for _ in range(300):
        words = [b"abcd"[i : i + 1] for i in rng.integers(0, 4, rng.integers(0, 40))]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        counts = Counter(windows)
        marked = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
        assert quality.repeat_words(words) == len(marked)


def test_counts_of_a_text():
    text = "a# b$\nline one\n \nline one\nx < y\x0bz"
    row = quality.measure(1, None, text, {}, quality.QualityRules(), quality._class_table())
    assert row[1:6] == (10, 22, 3, 1, 0) and row[6] is False
    assert quality.measure(1, None, None, {}, quality.QualityRules(), quality._class_table())[1:8] == (0, 0, 0, 0, 0, True, False)


def test_junk_goes_and_prose_stays(spark):
    rows = quality.op8_quality_rules(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    rows = rows.merge(docs[["doc_id", "text"]], on="doc_id")
    shouted = rows.text.str.contains("!!") & (rows.n_words >= 60)
    prose = ~rows.text.str.contains("!!") & (rows.n_symbols == 0) & ~rows.base_failed
    assert not rows[shouted].kept.any() and rows[prose].kept.mean() > 0.99


def test_distance_is_a_metric_of_shares():
    assert quality.distance(np.array([1.0, 0]), np.array([1.0, 0])) == 0
    assert abs(quality.distance(np.array([1.0, 0]), np.array([0, 1.0])) - 1) < 1e-12


def test_trust_follows_links_and_distrust_comes_back(spark):
    links = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "bad", 3), ("c", "d", 1)], "source string, target string, n long")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("bad", 0.0, 1.0)], "host string, trust double, distrust double")
    params = urlfilter.SpreadParams(rounds=30)
    got = {r.host: r for r in urlfilter.spread(links, seeds, params).collect()}
    d = params.damping
    want = {"a": 1 - d, "b": (1 - d) * d, "c": (1 - d) * d**2, "bad": (1 - d) * d**3 * 0.75, "d": (1 - d) * d**3 * 0.25}
    assert all(abs(got[h].trust - x) < 1e-12 for h, x in want.items())
    back = {"bad": 1 - d, "c": (1 - d) * d, "b": (1 - d) * d**2, "a": (1 - d) * d**3, "d": 0}
    assert all(abs(got[h].distrust - x) < 1e-12 for h, x in back.items())


def test_a_host_that_links_to_blocked_ones_is_blocked(spark):
    pages = [(1, "http://bad.net/", ""), (2, "http://hub.com/", '<a href="http://bad.net/x">x</a>'), (3, "http://ok.com/", '<a class="k" href="/own">o</a>')]
    found = urlfilter.judged(spark.createDataFrame(pages, "page_id long, url string, html string"), urlfilter.rule_table(spark)).collect()
    assert {r.page_id: r.verdict for r in found} == {1: "block", 2: "block", 3: "allow"}


def test_a_generated_link_graph_against_sql(spark, tmp_path):
    """Hubs, farms that link to blocked hosts, a host with a third of all pages and urls without a host."""
    rng = np.random.default_rng(4)
    hosts = [f"h{i}.{d}" for i, d in enumerate(rng.choice(["com", "net", "org", "example.com", "example.net"], 60))]
    rows = []
    for i in range(900):
        source = "hot.com" if i % 3 == 0 else str(rng.choice(hosts))
        path = str(rng.choice(["/", "/en/x", "/de/y?z", "/fr/"]))
        links = "".join(f'<a href="http://{rng.choice(hosts)}/">x</a>' for _ in range(rng.integers(0, 4)))
        rows.append((i % 890, None if i % 97 == 0 else f"http://{source}{path}", None if i % 89 == 0 else links + '<a href="//hot.com/">h</a>'))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = urlfilter.op9_url_filters(spark, str(tmp_path)).toPandas()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = db.execute(urlfilter.oracle()).df()
    plain = lambda df: sorted(tuple(None if x != x else x for x in r) for r in df[["page_id", "host", "path", "rule", "verdict"]].itertuples(index=False))
    assert list(map(str, plain(got))) == list(map(str, plain(want)))
    ruled = got[got.rule.isna()].groupby("host").verdict.agg(set)
    assert any(v == {"block"} for v in ruled) and any(v == {"allow"} for v in ruled)


def test_scores_of_large_hosts_do_not_depend_on_the_bound(spark):
    pages = [(i, f"http://{'big' if i % 2 else f'h{i}'}.com/", '<a href="http://bad.net/">b</a>') for i in range(60)] + [(99, "http://bad.net/", None), (100, None, None)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = [sorted(map(str, urlfilter.judged(frame, urlfilter.rule_table(spark), urlfilter.SpreadParams(large_hosts=n)).collect())) for n in (1, 5, 1000)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 62


def test_a_host_of_very_many_labels(spark):
    """It asks for as many rules as a short one, and nothing of it is spelt out label by label."""
    pages = spark.createDataFrame([(1, f"http://{'a.' * 200_000}net/x", None), (2, f"http://{'b.' * 200_000}com/x", None)], "page_id long, url string, html string")
    found = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judged(pages, urlfilter.rule_table(spark)).collect()}
    assert found == {1: ("net/", "block"), 2: (None, "allow")}
    rows = pages.select(F.col("page_id").alias("row"), urlfilter.host_of(F.col("url")).alias("host"), F.lit("/").alias("path"))
    assert rows.select(F.size(urlfilter._suffixes(F.col("host"), [1, 2])).alias("n")).agg(F.max("n")).first()[0] == 2


def test_windows_of_short_items_and_at_the_edges(spark):
    items = [("s", "Two words"), ("o", "single"), ("t", "one two three four five six seven eight nine ten eleven"), ("u", "one two three four five six seven eight nine ten ELEVEN")]
    docs = [(1, "xx two, words yy single"), (2, "one two three four five six seven eight nine ten"), (3, "two three four five six seven eight nine ten eleven."), (4, "one two three four five six seven eight nine"), (5, "two wordsy")]
    got = {r.doc_id: r for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert {i: (r.n_words, r.n_hit, r.n_items, r.contaminated) for i, r in got.items()} == {1: (5, 3, 2, True), 2: (10, 10, 2, True), 3: (10, 10, 2, True), 4: (9, 0, 0, False), 5: (2, 0, 0, False)}


def test_large_benchmarks_join_by_shuffle(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    same = [sorted(map(str, decontaminate.contamination(docs, items, decontaminate.DecontaminationParams(broadcast_keys=n)).collect())) for n in (0, 1_000_000)]
    assert same[0] == same[1]


def test_surt():
    assert warc.surt("http://www.A.org/x?y") == "org,a,www)/x?y"
    assert warc.surt("https://u@a.org:80#f") == "org,a:80)#f"
    assert warc.surt(None) == ")" and warc.surt("plain") == ")plain"


def test_records_are_plain_warc(spark):
    """A bare URI, an id of its own for each record, an info record first; urls come back as they were."""
    urls = ["http://a.org/x y\r\nEvil: 1", "http://a.org/ü%20z", "http://a.org/%", "http://a.org/", "", None, "plain", '"q"']
    ids = set()
    for url in urls:
        member = warc.record(None, url, "<p>ü</p>".encode(), "X", None, "2000-01-01T00:00:00Z")
        head = zlib.decompress(member, 31).partition(b"\r\n\r\n")[0].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in head[1:])
        assert head[0] == "WARC/1.1" and "Evil" not in fields
        assert fields["WARC-Target-URI"].isascii() and not set(fields["WARC-Target-URI"]) & set(' "<>\\^`{|}')
        ids.add(fields["WARC-Record-ID"])
        assert warc.parsed(member)["url"] == url and warc.parsed(member)["payload"] == "<p>ü</p>".encode()
    assert len(ids) == len(urls)
    folder = stage_path(spark, "warc")
    pages = spark.createDataFrame([(1, "http://a.org/", "x")], "page_id long, url string, html string")
    place = warc.write_archives(pages, folder, warc.WarcParams()).first()
    whole = warc.Folder(folder).read(place.file)
    assert b"WARC-Type: warcinfo" in zlib.decompressobj(31).decompress(whole) and place.offset > 0
    assert len(whole) == place.offset + place.length


def test_lookups_through_small_blocks(spark):
    rows = [(i, f"http://h{i % 7}.org/p{i % 50}", f"<p>{i % 20}</p>" * (i % 5)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    params, folder = warc.WarcParams(block_lines=3, shards=5), stage_path(spark, "warc")
    captures = warc.write_archives(pages, folder, params)
    shards = warc.write_index(captures, folder, params)
    keys = captures.select("key").where("key like 'org,h3)%'")
    back = {r.page_id: r for r in warc.lookup(keys, shards, folder).collect()}
    assert set(back) == {i for i, u, _ in rows if "//h3." in u}
    assert all(back[i].url == u for i, u, _ in rows if i in back)
    first = {}
    for i, _, html in rows:
        first.setdefault(html, i)
    for i, _, html in rows:
        if i in back:
            assert back[i].refers_to == (None if first[html] == i else first[html])
            assert back[i].html == (html.encode() if first[html] == i else None) and back[i].payload_bytes == len(html)


def test_beyond_the_broadcast_bound_no_words_move_with_places(spark):
    """What is dealt by key holds no text, and a text that is dealt is not multiplied."""
    rows = [(i, "plain words of a document that goes on for a while " * 20) for i in range(30)] + [(3, None), (None, "words of a document that goes on")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.select("doc_id", *decontaminate._marks(), decontaminate.words(docs.text).alias("w")).withColumn("n_words", F.size("w"))
    needed = decontaminate._positions(texts, [3]).select("key").distinct()
    found = {}
    for bound in (0, 1_000_000):
        near = decontaminate._near(texts, [3], needed, decontaminate.DecontaminationParams(broadcast_keys=bound))
        found[bound] = sorted(map(str, near.select("doc_id", "at", "key", "left", "around").distinct().collect()))
        if not bound:
            plan = spark._jvm.PythonSQLUtils.explainString(near._jdf.queryExecution(), "formatted")
            dealt = [part.split("Input")[1].split("\n")[0] for part in plan.split("\n\n") if "Exchange" in part.split("\n")[0] and "Input" in part]
            assert any("key#" in x for x in dealt) and not [x for x in dealt if "at#" in x and "w#" in x]
    assert found[0] == found[1_000_000] and len(found[0]) > 5000
