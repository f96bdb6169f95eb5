"""The registered text queries: against SQL, or against brute force where SQL can't say it."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from noticegrade.functions.storage import settle
from noticegrade.llm import extract, near_dedup, sharding
from noticegrade.llm.fingerprints import fingerprint, likeness
from noticegrade.llm.pieces import MODEL
from noticegrade.llm.sql import SQL
from oracle.compare import differences, duck

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall())


def result(spark, name):
    return [r.asDict() for r in entry.queries()[name](spark, SF).collect()]


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, con, name):
    rows, diff = differences(entry.queries()[name](spark, SF), con, SQL[name])
    assert diff is None and rows > 0


def test_quality_is_right_on_held_out_labels(spark, con):
    got = {r["doc_id"]: r for r in result(spark, "op1_quality")}
    labels = con.execute("SELECT doc_id, quality FROM labels").fetchall()
    assert len(got) == con.execute("SELECT count(*) FROM documents").fetchall()[0][0]
    for doc_id, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)
    held = [(got[i]["score"], q) for i, q in labels if got[i]["held_out"]]
    pos, neg = (np.array([s for s, q in held if q == k]) for k in (1, 0))
    assert (pos[:, None] > neg).mean() > 0.97
    assert (pos >= 0.3).mean() > 0.97 and (neg < 0.3).mean() > 0.9


def test_tokens_equal_the_reference_implementation(spark, texts):
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in result(spark, "op3_sentencepiece"):
        ids = theirs.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["round_trip"] and r["parity"] is not False
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()


def test_every_row_is_compared_with_the_reference(spark, texts):
    got = {r["doc_id"]: r["parity"] for r in result(spark, "op3_sentencepiece")}
    assert got == dict.fromkeys(texts, True)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_fingerprints_by_brute_force(spark, texts, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["doc_id"]: r for r in result(spark, "op4_fingerprints")}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ids = list(texts)
    assert sorted(got) == ids
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, r = texts[i], got[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[after][:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint(text), fingerprint(edited))
        assert r["near_edited"] == likeness(fingerprint(text), fingerprint(edited))
        assert r["near_next"] == likeness(fingerprint(text), fingerprint(texts[after]))
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.95


def test_main_text_of_the_pages(spark, con):
    pages = dict(con.execute("SELECT page_id, html FROM pages").fetchall())
    got = {r["page_id"]: r for r in result(spark, "op5_extract")}
    assert sorted(got) == sorted(pages)
    for i, page in pages.items():
        inside = re.sub(r"<[^>]*$", "", re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1])
        parts = [html.unescape(re.sub(r"<[^>]+>", "", x)) for x in re.split(r"</?(?:p|h1|article)>", inside)]
        want = "\n".join(x for x in (re.sub(r"\s+", " ", p).strip() for p in parts) if x)
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)


MARKUP = [
    ("<p>a<b>b</b> c<br>d</p>e", ["ab c d", "e"]),
    ("<header>h</header><main><nav>n</nav><h1>T</h1><p>x&nbsp;&eacute;&#x41;</main><footer>f</footer>", ["T", "x éA"]),
    ("<article><div class='post-comments'><p>rude</p></div><p>one<p>two<ul><li>i<li>j</ul></article><p>off", ["one", "two", "i", "j"]),
    ("<body class='has-sidebar'><div id='content'>main<aside>s</aside>more</div><div class='sidebar-left'>x</div>", ["main", "more"]),
    ("<article><script>if (a<b) '</p>'</script><style>p{}</style><!-- c --><p title='a>b'>t<form>q</form>", ["t"]),
    ("<article><p>cut &amp", ["cut &"]),
    ("<article><p>cut <b", ["cut"]),
    ("<article><article class=comment>c</article><p hidden>h<p>k", ["k"]),
]


NAMES = [
    ('<article class="post overflow-hidden"><p>See <a href="/the-hidden-valley">the valley</a> and <i title="hidden gems">gems</i>.', ["See the valley and gems."]),
    ("<body class='overflow-hidden'><article><p data-state=hidden>a<p hidden>b<p hidden=''>c<p>d", ["a", "d"]),
    ('<article><h2 id="social-structure">H</h2><p id="share-prices">P</p><section id="search-methods">S</section>', ["H", "P", "S"]),
    ('<article><h2 id="comments">On comments</h2><p>t</p><div id="comments">c</div><div id="post-comments">c</div><div id="share-buttons">s', ["On comments", "t"]),
    ('<div id="main"><p>t</p><div id="comment-3">c</div></div><div id="social-feed">s</div>', ["t"]),
]


@pytest.mark.parametrize(("page", "want"), NAMES)
def test_names_and_hidden_in_a_main_part(page, want):
    test_blocks(page, want)


@pytest.mark.parametrize(("page", "want"), MARKUP)
def test_blocks(page, want):
    got = extract.blocks(page)
    level = max(main for main, chrome, _ in got if not chrome)
    assert [t for main, chrome, t in got if not chrome and main == level] == want


def test_repeated_runs_of_a_host_are_boilerplate(spark):
    rows = [(i, f"http://a.com/{i}", f"<div>Welcome to our great site with many things</div><div>Story {i} tells of z{i * 7} and w{i}</div><div>All of it is written by the people of the site</div>") for i in range(40)]
    rows += [(100, "http://b.com", rows[0][2]), (200, "http://c.com/1", "<p>one two three four five six seven</p>")]
    rows += [(201, "http://c.com/2", rows[-1][2])]  # a copy of a page is no second page
    got = {r["page_id"]: r for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i]["text"] == f"Story {i} tells of z{i * 7} and w{i}" and got[i]["boilerplate"] > 0 for i in range(40))
    assert got[100]["text"].count("\n") == 2 and got[200]["text"] == got[201]["text"] == "one two three four five six seven"


def test_text_that_few_pages_share_stays(spark):
    story = lambda i: " ".join(f"s{i}w{k}" for k in range(80))
    menu, quote = "<div>Home News Sport Weather Travel Money and more</div>", "as far as I can see from here"
    rows = [(i, f"http://a.com/{i}", f"{menu}<div>{i} visits</div><p>{story(i)} {quote} z{i}</p>") for i in range(20)]
    rows += [(20, "http://a.com/0?print", f"{menu}<div>77 visits</div><p>{story(0)} {quote} z0</p>")]  # a near copy
    rows += [(21, "http://a.com/1?print", f"{menu}<div>1 visits</div><p>{story(1)} {quote} z1 printed</p>")]
    rows += [(30 + i, f"http://b.com/{i}", f"<div>{i} visits</div><p>{story(9)}</p>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, page in rows:
        want = re.sub(r"<[^>]+>", "\n", page.replace(menu, "")).split("\n")
        assert got[i] == "\n".join(x for x in want if x), i


def brute_repeats(rows, run, least, share):
    """page_id -> starts of runs on enough distinct pages of the host; a page is (id, host, article, outside)."""
    pages = {}
    for _, host, article, _ in rows:
        pages.setdefault(host, set()).add(article)
    parts = {i: (host, article, [[" ".join(w[k : k + run]) for k in range(len(w) - run + 1)] for w in (article.split(), outside.split())]) for i, host, article, outside in rows}
    on = {}
    for host, article, streams in parts.values():
        for words in (x for stream in streams for x in stream):
            on.setdefault((host, words), set()).add(article)
    enough = {x for x, found in on.items() if len(found) >= max(least, share * len(pages[x[0]]))}
    return {i: sum((host, words) in enough for stream in streams for words in stream) for i, (host, _, streams) in parts.items()}


@pytest.mark.parametrize("packed", [1 << 21, 50])
def test_whole_streams_of_every_page_are_in_the_arrays(spark, monkeypatch, packed):
    monkeypatch.setattr(extract, "PACKED", packed)
    draw = np.random.default_rng(5)
    phrases = [" ".join(f"{c}{k}" for k in range(9)) for c in "pqrstu"]
    rows = []
    for i in range(60):
        said = [" ".join(f"z{x}" for x in draw.integers(0, 500, draw.integers(1, 9))) for _ in range(5)]
        for k in draw.choice(len(phrases), draw.integers(0, 4), replace=False):
            said.insert(int(draw.integers(0, 5)), phrases[k])  # within an article's blocks, not at their start
        rows.append((i, f"h{i % 3 if i < 50 else 9 + i}", " ".join(["once", *said]), " ".join(draw.choice(phrases, draw.integers(0, 3)))))
    rows += [(100 + i, *rows[i][1:]) for i in range(9)]  # copies are no other pages
    pages = [(i, f"http://{host}/{i}", f"<nav>{outside}</nav><article><p>{article}</p></article>") for i, host, article, outside in rows]
    got = extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    want = brute_repeats(rows, extract.RUN, extract.LEAST_PAGES, extract.SHARE)
    assert {r["page_id"]: r["repeated"] for r in got} == want and sum(want.values()) > 300
    assert {r["page_id"]: r["text"] for r in got} == {i: article for i, _, article, _ in rows}


def test_a_host_s_boilerplate_goes_from_marked_articles_too(spark):
    advert = "Sign up for our weekly letter and read the best stories first"
    quote, lead = "It was the best of times and the worst of times", "Nobody in the village had ever seen a ship this large"
    story = lambda i: "".join(f"<p>{' '.join(f's{i}w{k}v{j}' for k in range(20 + j))}</p>" for j in range(2))
    beside, title = f"<div class=newsletter><p>Hello</p><p>{advert}</p></div>", "The weather of the week in all parts"
    pages = {}
    for i in range(24):  # the advert stands beside every other article, and unmarked in the others; all pages list a title
        inside = f"<h2>{title}</h2>{story(i)}<p>{quote}</p>" + ("" if i % 2 else f"<p>{advert}</p><p>{advert} and tell us of z{i}</p>")
        pages[f"http://a.com/{i}"] = f"<nav>{title}</nav><article>{inside}</article>{beside if i % 2 else ''}<aside>{lead if i > 11 else quote if i < 9 else ''}</aside>"
    # versions of one article, whose first words stand in the sidebar of others
    pages |= {f"http://a.com/v{i}": f"<article><p>{lead}</p>{story(99)}<p>version {i}</p></article>" for i in range(9)}
    pages |= {f"http://b.com/{i}": pages[f"http://a.com/{i}"] for i in range(2)}  # too few pages
    rows = [(k, url, page) for k, (url, page) in enumerate(pages.items())]
    rows += rows[:3]  # rows that repeat stay
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r["page_id"] for r in got) == sorted(r[0] for r in rows)
    for r in got:
        article = re.search("<article>(.*)</article>", rows[r["page_id"]][2])[1]
        want = [x for x in re.sub("<[^>]+>", "\n", article).split("\n") if x]
        if rows[r["page_id"]][1].startswith("http://a.com"):
            want = [x for x in want if x != advert]
        assert r["text"] == "\n".join(want), rows[r["page_id"]][1]
        assert (r["boilerplate"] is None) == (advert not in article or "b.com" in r["url"])


def test_shards_are_whole_even_and_keep_groups(spark, texts):
    rows = result(spark, "op6_sharding")
    assert sorted(r["doc_id"] for r in rows) == list(texts)
    sums, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[data].add(r["shard"])
    assert sorted(sums) == list(range(40)) and max(sums.values()) - min(sums.values()) < 0.01 * min(sums.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(g) == 1 for g in groups.values())


def test_filling_up_levels_what_is_there():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 5_000, 2_000)
    for begun in ([0] * 7, [900_000, 10, 400_000, 0, 0, 77, 3], [10**14, 0, 0, 0, 0, 0, 5]):
        for turn in (0, 5, 12):
            got = np.array(begun, np.int64)
            np.add.at(got, sharding.fill(sizes, begun, turn), sizes)
            assert got.sum() == sum(begun) + sizes.sum()
            got = np.sort(got)[: 6 if max(begun) > 10**9 else 7]  # what is too large stays alone
            assert got[-1] - got[0] < 20
    assert list(sharding.fill(np.array([], np.int64), [3, 1])) == []


def test_shards_level_out_over_many_buckets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [f"{i} " + "x" * int(n) for i, n in enumerate(rng.integers(1, 900, 1_500))]
    texts += ["big " + "y" * 40_000] * 2 + ["copy"] * 700 + [None] * 400
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spreads = {}
    for groups in (8192, 100):
        monkeypatch.setattr(sharding, "BUCKET_GROUPS", groups)
        rows = sharding.shard(docs, 7).collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
        sums, homes = Counter(), defaultdict(set)
        for r in rows:
            sums[r["shard"]] += r["size"]
            homes[texts[r["doc_id"]] or ""].add(r["shard"])
        assert sorted(sums) == list(range(7)) and all(len(h) == 1 for h in homes.values())
        spreads[groups] = max(sums.values()) - min(sums.values())
    assert spreads[8192] < 20 and spreads[100] < 200, spreads


def test_differencing_is_tighter_than_greedy():
    rng = np.random.default_rng(3)
    parts = np.zeros((300, 7), np.int64)
    parts[:, 0] = rng.integers(1, 10_000, 300)
    where, sums = sharding.difference(parts)
    got = np.zeros(7, np.int64)
    np.add.at(got, where[:, 0], parts[:, 0])
    assert (got == sums).all()
    greedy = np.zeros(7)
    for size in sorted(parts[:, 0], reverse=True):
        greedy[greedy.argmin()] += size
    assert sums.max() - sums.min() < greedy.max() - greedy.min()


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def components(sets, percent=80):
    holders = defaultdict(list)
    for i, own in sets.items():
        for s in own:
            holders[s].append(i)
    shared = Counter((a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in sets}


def test_near_duplicates_by_brute_force(spark, texts):
    sets = {i: shingles(t, 4) for i, t in texts.items()}
    want = components(sets)
    for r in result(spark, "op7_near_dedup"):
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_a_large_group_of_like_documents(spark, monkeypatch):
    """Near copies with 0 to 12 edits, so that some chain together and some link to nothing."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(120)]
    docs = {}
    for i in range(250):
        words = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 13))):
            words[at] = f"x{rng.integers(0, 40)}"
        docs[i * 3 + 1] = " ".join(words)
    want = components({i: shingles(t, 5) for i, t in docs.items()})
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for paired in (1, 64):
        monkeypatch.setattr(near_dedup, "PAIRED", paired)
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df).collect()}
        assert got == want
    assert len(set(want.values())) > 20


@pytest.mark.parametrize("paired", [1, 64])
def test_like_documents_of_many_lengths_and_repeated_ids(spark, monkeypatch, paired):
    """Pieces of one text whose lengths differ by up to a third; an id of several texts links what any of them links."""
    rng = np.random.default_rng(5)
    base, rows = [f"w{k}" for k in range(150)], []
    for i in range(200):
        words = base[: int(rng.integers(110, 150))]
        for at in rng.integers(0, len(words), int(rng.integers(0, 9))):
            words[at] = f"x{rng.integers(0, 30)}"
        rows.append((int(rng.integers(0, 190)), " ".join(words)))
    distinct = sorted(set(rows))
    link = components({k: shingles(t, 5) for k, (_, t) in enumerate(distinct)})
    # texts of one id are one node
    names = {k: {k} for k in range(len(distinct))}
    for x, y in [*link.items(), *((a, b) for a in names for b in names if a < b and distinct[a][0] == distinct[b][0])]:
        if names[x] is not names[y]:
            names[x] |= names[y]
            for k in names[y]:
                names[k] = names[x]
    want = {distinct[k][0]: min(distinct[m][0] for m in group) for k, group in names.items()}
    monkeypatch.setattr(near_dedup, "PAIRED", paired)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) > 10


def test_template_pages_below_the_limit_meet_no_square(spark, monkeypatch):
    """2,000 pages that share most of their words, of resemblance below 0.8, and two that are linked."""
    seen = []
    meetings = near_dedup._meetings

    def watched(first, percent):
        one, two = (settle(x, "side") for x in meetings(first, percent))
        seen.append((one, two))
        return one, two

    monkeypatch.setattr(near_dedup, "_meetings", watched)
    base = [f"t{k}" for k in range(100)]
    docs = [(i, " ".join([f"own{i}a", *base[:50], *(f"own{i}b{k}" for k in range(4)), *base[50:], f"own{i}c", f"own{i}d", f"own{i}e"])) for i in range(2000)]
    docs.append((5000, docs[7][1] + " end"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    # few bands' values agree at this resemblance, so narrow bands bring all pages together
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, 5, 80, permutations=24, rows=1).collect()}
    assert got == {i: i for i in range(2000)} | {5000: 7}
    on = ["shingle", "block", "other"]
    assert seen
    for one, two in seen:
        pairs = one.groupBy(on).count().join(two.groupBy(on).agg(F.count("*").alias("m")), on)
        joined = pairs.agg(F.sum(F.col("count") * F.col("m"))).first()[0] or 0
        assert joined < 50 * 2000
