"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from noticegrade.llm import decontaminate, extract, fingerprints, licences, lines, near_dedup, pieces, quality, sharding, warc

CLASHES = "score double, predicted int, marks string, component_id long, kept string, n_lines long, n_exact int, near string, exact string, ids string, item string, place string, at string, line string, bands string, size string, shard string, slot string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
PAGES = f"page_id long, url string, html string, {CLASHES}"
LONG = "A very long story, told twice by 7 people. " * 4000 + "The end of a longer line\nThe end of a longer line which is longer\n" * 500


def document(doc_id, text):
    return (doc_id, text, "en", "s", len(text or ""), 0.5, 1, "m", 9, "k", 1, 2, "n", "e", "i", "t", "p", "a", "l", "b", "z", "h", "o")


TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, LONG), (7, LONG), (8, LONG + "x"),
    (None, "MIT License and the GNU General Public License"), (None, None), (9, "MIT License"), (9, "another text of nine"),
    (10, "ünïcödé 日本語 🙂 \x00 words"), (11, "benchmark words that nobody else would ever write down in a row here today"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([document(*t) for t in TEXTS], DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i != 4), 0, "x") for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] + [(None, 1, 0, "x"), (5, None, None, "x"), (6, 1, 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, TEXTS[-1][1]), (1, "Other words"), (2, None), (3, ""), (None, "told twice by 7 people"), (4, "one")]
    return spark.createDataFrame(rows, "item_id long, text string")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_quality(docs, none, labels):
    got = rows_of(quality.classify_quality(docs, labels))
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert rows_of(quality.classify_quality(none, labels)) == []
    empty = labels.limit(0)
    assert {r["score"] for r in rows_of(quality.classify_quality(docs, empty))} == {0.5}


def test_lines(docs, none):
    every = {r["doc_id"]: r["text"] for r in rows_of(lines.dedup_lines(docs)) if r["doc_id"] in (1, 2, 3, 4, 5)}
    assert every == {1: None, 2: "", 3: " ", 4: "one", 5: ""}
    got = rows_of(lines.dedup_lines(docs, 20))
    assert len(got) == len(TEXTS)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["text"] is None and by[1][0]["n_lines"] == 0 and by[2][0]["text"] == "" and by[2][0]["n_lines"] == 1
    assert by[3][0]["text"] == " \n\t " and [r["text"] for r in by[5]] == ["one", "one"]
    assert by[6][0]["text"].count("\n") == 3 and by[7][0]["n_exact"] == 1000  # its last line is empty
    assert by[7][0]["text"] == "" == by[8][0]["text"].rstrip("x") and by[6][0]["lang"] == "en" and by[6][0]["near"] == "n"
    assert rows_of(lines.dedup_lines(none)) == []


def test_near_duplicates(docs, none):
    got = rows_of(near_dedup.near_duplicates(docs))
    assert len(got) == len(TEXTS)
    of = {r["doc_id"]: r for r in got}
    assert of[5]["component_id"] == 4 and of[8]["component_id"] == 6 == of[7]["component_id"] and of[6]["kept"]
    assert of[1]["n_shingles"] == of[2]["n_shingles"] == of[3]["n_shingles"] == 0 and of[1]["component_id"] == 1
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]
    assert all(r["kept"] for r in got if r["doc_id"] is None)
    assert rows_of(near_dedup.near_duplicates(none)) == []


def test_decontaminate(docs, none, bench):
    marked = decontaminate.contamination(docs, bench)
    got = rows_of(marked.select("doc_id", "marks", decontaminate.n_hit().alias("hit"), decontaminate.contaminated().alias("bad")))
    assert len(got) == len(TEXTS)
    of = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert of[1]["marks"]["n_words"] == 0 and not of[1]["bad"] and of[11]["bad"] and of[11]["hit"] == 14
    assert of[6]["marks"]["items"] == ["null"] and of[6]["hit"] == 4000 * 5 and of[4]["marks"]["items"] == ["4"]
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and 11 not in [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert {r["marks"] for r in kept.select("marks").collect()} == {"m"}
    assert rows_of(decontaminate.contamination(none, bench)) == []
    assert not any(r["bad"] for r in rows_of(decontaminate.contamination(docs, bench.limit(0)).select(decontaminate.contaminated().alias("bad"))))


def test_pieces(docs, none):
    got = rows_of(pieces.tokenise(docs, parity_every=1))
    assert len(got) == len(TEXTS) and all(r["parity"] and r["round_trip"] for r in got)
    assert all(r["n_tokens"] == len(r["ids"]) and (r["n_tokens"] == 0) == (not r["text"]) for r in got)
    assert rows_of(pieces.tokenise(none)) == []


def test_fingerprints(docs, none):
    got = rows_of(fingerprints.fingerprints(docs))
    assert len(got) == len(TEXTS)
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r)
    assert of[1][0]["n_chars"] == 0 and of[1][0]["near_next"] == 1 and of[6][0]["near_next"] == 1
    assert of[4][0]["fingerprint"] == of[5][0]["fingerprint"] != of[9][0]["fingerprint"]
    assert rows_of(fingerprints.fingerprints(none)) == []
    alone = rows_of(fingerprints.fingerprints(docs.filter("doc_id = 4")))
    assert len(alone) == 1 and alone[0]["near_next"] == 1


def test_sharding(docs, none):
    got = rows_of(sharding.shard(docs, 3))
    assert len(got) == len(TEXTS) and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got)
    for k in range(3):
        own = sorted(r["slot"] for r in got if r["shard"] == k)
        assert own == list(range(len(own)))
    assert len({r["shard"] for r in got if r["text_crc32"] == 0}) == 1
    assert rows_of(sharding.shard(none)) == []


def test_licences(docs, none):
    got = rows_of(licences.scan_licences(docs))
    assert len(got) == len(TEXTS)
    by = {(r["doc_id"], r["n_words"]): r for r in got}
    r = by[(None, 8)]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (2, 0, 4, "gpl,mit") and r["labels"] == "gpl,mit"
    assert by[(1, 0)]["labels"] == "" and by[(1, 0)]["score"] == 0 and by[(9, 2)]["n_base"] == 1
    assert rows_of(licences.scan_licences(none)) == []


def page(page_id, url, html):
    return (page_id, url, html, *document(0, "")[5:])


@pytest.fixture(scope="module")
def pages(spark):
    long = "<article>" + "<p>A &amp; b&nbsp;<b>c</b>" * 20000
    rows = [(1, None, None), (2, "http://a/", ""), (3, "http://a/3", long), (3, "http://a/3", long), (4, "not a url\r\nX: y", "<p>Plain"), (None, "http://b", "text")]
    return spark.createDataFrame([page(*r) for r in rows], PAGES).cache()


def test_extract(pages):
    got = rows_of(extract.extract(pages))
    assert len(got) == 6
    of = {r["page_id"]: r["text"] for r in got}
    assert of[1] == of[2] == "" and of[3] == "\n".join(["A & b c"] * 20000) and of[4] == "Plain" and of[None] == "text"
    assert rows_of(extract.extract(pages.limit(0))) == []


def test_warc(spark, pages, tmp_path):
    warc.write_archives(pages, f"{tmp_path}/a")
    got = rows_of(warc.read_archives(spark, f"{tmp_path}/a", payload=True))
    assert len(got) == 6 and all(r["gap"] is None for r in got)
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert kinds == {(1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "response", None), (None, "response", None)}
    assert next(r["url"] for r in got if r["page_id"] == 4) == "not a url%0D%0AX: y"
    warc.write_archives(pages.limit(0), f"{tmp_path}/b")
    assert rows_of(warc.read_archives(spark, f"{tmp_path}/b")) == []


def test_pipeline_stages(spark, docs, none, labels, bench, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, none):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            if name != "tokens":
                assert out.columns == docs.columns, name
                assert [d for _, d in out.dtypes if d == "void"] == []
            out.write.parquet(f"{tmp_path}/{name}-{start is docs}")
            now = spark.read.parquet(f"{tmp_path}/{name}-{start is docs}")
        assert now.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and (now.count() > 0) == (start is docs)
        assert now.filter(~F.col("round_trip")).count() == 0
