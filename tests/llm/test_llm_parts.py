"""Parts of the text operators: damaged archives, deletion neighbourhoods, windows, rules, models."""

import gzip
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from noticegrade.llm import decontaminate, extract, licence_rules, lines, pieces, quality, warc


def record(block, kind="response", digest=None, length=None):
    digest = digest or warc.base32_sha1(block)
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{len(block)}>\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
    return (head + f"Content-Length: {len(block) if length is None else length}\r\n\r\n").encode() + block + b"\r\n\r\n"


BLOCKS = [b"one", b"two \r\n\r\n WARC/1.1\r\nX", b"", "drei ü".encode()]


def split(found):
    found = list(found)
    return [f.block for f in found if f.reason is None], [(f.offset, f.length, f.reason) for f in found if f.reason]


def test_whole_archives_have_no_gap():
    plain = [record(b) for b in BLOCKS]
    for data in (b"".join(plain), b"".join(map(gzip.compress, plain)), gzip.compress(b"".join(plain))):
        assert split(warc.salvage(data)) == (BLOCKS, [])
    assert split(warc.salvage(b"")) == ([], [])


@pytest.mark.parametrize(
    ("bad", "reason"),
    [
        (record(b"two", digest="A" * 32), "wrong digest"),
        (record(b"two", length=2), "wrong length"),
        (record(b"two", length=10**9), "wrong length"),
        (b"WARC/1.1\r\nno colon\r\n\r\nxx\r\n\r\n", "bad header"),
        (b"WARC/1.1\r\nWARC-Type: x\r\n\r\n\r\n\r\n", "no length"),
        (b"\x00\x01 rubbish \r\n", "no version line"),
    ],
)
def test_records_after_damage_are_recovered(bad, reason):
    good = [record(b) for b in BLOCKS]
    data = good[0] + good[1] + bad + good[2] + good[3]
    kept, gaps = split(warc.salvage(data))
    assert kept == BLOCKS and gaps == [(len(good[0] + good[1]), len(bad), reason)]


def test_members_after_a_damaged_one_are_recovered():
    members = [gzip.compress(record(b * 50)) for b in BLOCKS]
    broken = bytearray(members[1])
    broken[20:40] = b"\xff" * 20
    kept, gaps = split(warc.salvage(members[0] + bytes(broken) + members[2] + members[3]))
    assert kept == [BLOCKS[0] * 50, BLOCKS[2], BLOCKS[3] * 50]
    assert gaps[0][0] == len(members[0]) and sum(n for _, n, _ in gaps) == len(broken)
    # cut off in the middle: what came before the cut counts
    whole = gzip.compress(b"".join(record(b * 50) for b in BLOCKS))
    kept, gaps = split(warc.salvage(whole[:-12]))
    assert kept[0] == BLOCKS[0] * 50 and gaps[-1][2] == "member without an end"
    # rubbish, then plain records, then members
    data = b"rubbish" + record(b"plain") + members[0]
    assert split(warc.salvage(data)) == ([b"plain", BLOCKS[0] * 50], [(0, 7, "no member")])


@pytest.mark.parametrize("far", [4, 9000])
def test_a_damaged_member_gives_what_lies_before(far):
    draw = random.Random(4)
    blocks = [bytes(draw.choices(range(256), k=1000)) for _ in range(60)]
    data = bytearray(gzip.compress(b"".join(map(record, blocks))))
    data[-8 if far == 4 else -far] ^= 0xFF  # in the checksum, or in one of the last records
    kept, gaps = split(warc.salvage(bytes(data)))
    assert gaps == [(0, len(data), gaps[0][2])] and gaps[0][2].startswith("bad member")
    assert kept == blocks if far == 4 else blocks[:50] == kept[:50]


def test_damage_in_a_written_archive_costs_one_record(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"<p>page {i} é</p>" * 40) for i in range(200)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/a")
    data = b"".join(p.read_bytes() for p in sorted(tmp_path.glob("a/part-*")))
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 200
    assert sorted(f.headers["warc-record-id"] for f in warc.salvage(data)) == sorted(f"<urn:page:{i}>" for i, *_ in rows)
    second = data.index(b"\x1f\x8b\x08", 1)
    data = data[: second + 60] + bytes([data[second + 60] ^ 0xFF]) + data[second + 61 :]
    assert sum(f.reason is None for f in warc.salvage(data)) == 199


def test_archives_are_bounded_in_bytes(spark, tmp_path):
    rows = [(i, f"http://a/{i}", "".join(chr(97 + (i * j * j + j) % 26) for j in range(30 * (i % 9)))) for i in range(900)]
    rows.append((900, "http://a/large", "".join(chr(33 + hash((j, 7)) % 90) for j in range(30_000))))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/a", file_bytes=128 * 900)
    sizes = sorted(p.stat().st_size for p in tmp_path.glob("a/part-*"))
    assert len(sizes) > 2 and sizes[-2] <= 128 * 900 and sizes[-1] < 128 * 900 + 31_000
    got = warc.read_archives(spark, f"{tmp_path}/a", payload=True).collect()
    assert sorted((r["page_id"], r["payload"]) for r in got if r["record_type"] == "response") == sorted(
        (max(i for i, _, x in rows if x == text), text) for text in {x for *_, x in rows}
    )
    assert len(got) == 901 and all(r["gap"] is None for r in got)


def test_members_of_any_length_end_alike():
    for n in (0, 5, 1 << 24):
        assert gzip.decompress(warc._member_of("x" * n) + b"\0") == b"x" * n + b"\n"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize(("least", "alphabet", "lengths"), [(1, "abc", (0, 5)), (3, "ab", (0, 9)), (20, "xy z日", (18, 70))])
def test_lines_by_brute_force(spark, least, alphabet, lengths):
    draw = random.Random(5)
    base = ["".join(draw.choice(alphabet) for _ in range(draw.randint(*lengths))) for _ in range(50)]

    def changed(line):
        at, kind, c = draw.randint(0, len(line)), draw.random(), draw.choice(alphabet)
        if kind < 0.3:
            return line
        if kind < 0.5:
            return line[:at] + c + line[at:]
        if kind < 0.7:
            return line[:at] + line[at + 1 :]
        return line[:at] + c + line[at + 1 :] if kind < 0.9 else changed(line[:at] + c + c + line[at:])

    docs = [(i, "\n".join(changed(draw.choice(base)) for _ in range(draw.randint(0, 6)))) for i in range(120)]
    seen, want = [], {}
    for i, text in docs:
        kept, exact, near = [], 0, 0
        for line in text.split("\n"):
            if len(line) >= least and line in seen:
                exact += 1
            elif len(line) >= least and any(one_edit(line, s) for s in seen):
                near += 1
            else:
                kept.append(line)
            seen += [line] * (len(line) >= least)
        want[i] = ("\n".join(kept), exact, near)
    out = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), least).collect()
    assert {r["doc_id"]: (r["text"], r["n_exact"], r["n_near"]) for r in out} == want
    assert sum(w[2] for w in want.values()) > 20


def test_short_lines_go_if_they_repeat_exactly(spark):
    long = "a line of twenty characters or more"
    docs = [(1, f"Ietzte.\n\nx\n{long}"), (2, f"Ietzte.\n\nIetzte!\n{long}s"), (3, "x\nIetzte!\n ")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: (r["text"], r["n_exact"], r["n_near"]) for r in lines.dedup_lines(frame, 20, least_exact=1).collect()}
    assert out == {1: (docs[0][1], 0, 0), 2: ("\nIetzte!", 1, 1), 3: (" ", 2, 0)}
    stage = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["lines"](spark, frame, "").collect()}
    assert stage == {i: text for i, (text, _, _) in out.items()}


def test_chunks_of_a_large_benchmark_add_up(spark):
    draw = random.Random(2)
    words = [f"w{k}" for k in range(12)]
    say = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(i, say(draw.randint(1, 6))) for i in range(40)]
    docs = spark.createDataFrame([(i, say(60)) for i in range(50)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    runs = []
    for chunk in (1 << 20, 300):
        marked = decontaminate.contamination(docs, bench, 4, chunk_bytes=chunk)
        runs.append(sorted((r["doc_id"], tuple(r["marks"]["hit_from"]), tuple(r["marks"]["hit_to"]), tuple(r["marks"]["items"]), r["marks"]["longest"]) for r in marked.collect()))
    assert runs[0] == runs[1] and any(r[4] > 4 for r in runs[0])


def test_longest_match_and_its_place(spark):
    item = " ".join(f"t{k}" for k in range(30))
    text = "a b " + " ".join(item.split(" ")[3:22]) + " c " + " ".join(item.split(" ")[:14])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    marks = decontaminate.contamination(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).first()["marks"]
    assert (marks["longest"], marks["longest_at"], marks["longest_item"]) == (19, 2, "7")
    assert (marks["hit_from"], marks["hit_to"], marks["n_words"]) == ([2, 22], [21, 36], 36)


def test_rules_are_many_and_their_gate_misses_none():
    rules = licence_rules.rules()
    assert len(rules) > 300 and len({(r.keyword, r.label, r.priority, r.pattern) for r in rules}) == len(rules)
    gate = re.compile(licence_rules.gate().replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff"))
    for r in rules:
        # the shortest text of each rule: optional groups left out, first choices taken
        text = re.sub(r"\(\?:(?:[^()]|\([^()]*\))*\)\?", "", r.pattern)
        text = re.sub(r"\(\?:([^|()]*)\|[^()]*\)", r"\1", text).replace(" ?", " ").replace("[^ ]+", "x").replace("[cs]", "s")
        assert re.fullmatch(r.pattern, text) or "?" in r.pattern, r
        assert gate.search(f"... {text.upper()} ...") and (text.split(" ")[0] == r.keyword or r.pattern.startswith("(?:")), r


def test_unigram_models_are_rebuilt():
    def field(number, value):
        data = value if isinstance(value, bytes) else value.encode()
        return bytes([number << 3 | 2, len(data)]) + data

    def piece(text, score, kind):
        return field(1, field(1, text) + bytes([2 << 3 | 5]) + np.float32(score).tobytes() + bytes([3 << 3, kind]))

    data = piece("<unk>", 0, 2) + piece("▁ab", -1.0, 1) + piece("▁a", -2.0, 1) + piece("b", -2.5, 1) + piece("c", -3.0, 1)
    data += field(2, bytes([3 << 3, 1])) + field(3, bytes([3 << 3, 1, 4 << 3, 1]))
    model = pieces.read_model(data)
    assert model.kind == pieces.UNIGRAM and model.remove_extra_spaces and len(model.pieces) == 5
    assert pieces.build_tokenizer(model).encode("  ab   abc ").ids == [1, 1, 4]
    with pytest.raises(ValueError, match="not a SentencePiece model"):
        pieces.read_model(b"")


def test_prior_and_risk_on_a_known_mixture():
    rng = np.random.default_rng(1)
    pos, neg = rng.normal(2, 1, (3000, 3)), rng.normal(-2, 1, (3000, 3))
    unlabelled = np.concatenate([pos[:1050], neg[:450]])
    w = quality.fit_weights(pos[1500:], unlabelled, 0.7, steps=600)
    score = lambda x: quality._expanded(x) @ w
    assert (score(pos) > 0).mean() > 0.95 and (score(neg) < 0).mean() > 0.95
    prior = quality.estimate_prior(score(pos[1500:]), score(unlabelled))
    assert 0.62 < prior < 0.78


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<!DOCTYPE html><body><p>One line</p></body>", "One line"),
        ("<!doctype html PUBLIC '-//x'><?xml a?><!bad><p>One</p></>", "One"),
        ('<article><h2 class="social-structure">A</h2><p class="share-price">B</p></article>', "A\nB"),
        ('<article><section class="search-methods">A</section><p class="related-work">B <span class="ad-hoc">C</span></p></article>', "A\nB C"),
        ('<article><div class="notice-period">A</div><div class="notice">B</div><p class="advert">C</p></article>', "A"),
        ('<article>x <math><mi>y</mi></math> <object>z</object></article>', "x y z"),
        ("<main><p>Intro</p><article><p>Text</p></article><p>Outro</p><nav>N</nav></main><p>Else</p>", "Intro\nText\nOutro"),
        ("<header><h1>Site</h1></header><article><header><h1>Title</h1><p>by me</p></header><p>Text</p></article>", "Title\nText"),
        ('<article><div class="post-comments"><h3>Comments</h3>c</div><div id="related-posts">r</div>Text</article>', "Text"),
    ],
)
def test_what_is_text_of_a_page(spark, page, text):
    df = spark.createDataFrame([(1, "http://h/x", page)], "page_id long, url string, html string")
    assert [r["text"] for r in extract.extract(df).collect()] == [text]


def test_rows_that_share_an_id_are_no_bridge(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    rows = [(1, a, "p"), (2, a, "q"), (2, b, "r"), (3, "b c", "s"), (4, "t u", "x"), (4, "t u", "y"), (None, "n", "z"), (5, None, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = dict(corpus_pipeline.STAGES)["near"](spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:2]) for r in got) == [
        ("1", "a0"), ("2", "b0"), ("3", "b "), ("4", "t "), ("5", ""), ("None", "n")
    ]
