"""Periodic runs, spelling variants and SimHash groups against brute force; their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from noticegrade.llm import simhash as sh
from noticegrade.llm.periodic import Positions, find_runs, periodic_runs
from noticegrade.llm.spelling import near_in_list, near_words, spelling_variants, vocabulary
from oracle.compare import duck

SF = "/root/testdata/sf0.01"
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"


@pytest.fixture(scope="module")
def texts():
    return dict(duck(SF).execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall())


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


# --- op11


def slow_runs(w, least, exponent):
    """Every stretch by every period, the smallest period of equal stretches."""
    numbers = {x: k for k, x in enumerate(dict.fromkeys(w))}
    a, found = np.array([numbers[x] for x in w], np.int64), {}
    for q in range(1, len(w) // exponent + 1):
        same = np.concatenate([[0], a[:-q] == a[q:], [0]]).astype(np.int8)
        step = np.diff(same)
        for start, end in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            if end - start + q >= max(least, exponent * q):
                found.setdefault((start, end + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.sampled_from([(6, 4), (4, 2), (6, 3), (1, 2)]))
def test_runs_of_small_sequences(w, limits):
    assert find_runs(np.array(w, np.int64), *limits) == slow_runs(w, *limits)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=12), st.integers(2, 9), st.lists(st.integers(0, 5), max_size=12))
def test_runs_of_repeated_parts(part, times, tail):
    w = tail + part * times + tail
    assert find_runs(np.array(w, np.int64)) == slow_runs(w, 6, 4)


def test_ordered_sets_split(monkeypatch):
    import noticegrade.llm.periodic as periodic

    monkeypatch.setattr(periodic, "_BLOCK", 4)
    order = random.Random(3).sample(range(500), 500)
    own, have = Positions(order[0]), [order[0]]
    for x in order[1:]:
        assert own.add(x) == (max((y for y in have if y < x), default=None), min((y for y in have if y > x), default=None))
        have.append(x)
    assert list(own) == list(range(500)) and own.size == 500


def made_periodic(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_periods_equal_brute_force(spark, texts):
    got = {r["doc_id"]: r.asDict() for r in entry.queries()["op11_periods"](spark, SF).collect()}
    assert len(got) == len(texts)
    some = 0
    for doc_id, text in texts.items():
        w, r = made_periodic(doc_id, words_of(text)), got[doc_id]
        runs = slow_runs(w, 6, 4)
        some += bool(runs)
        dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
        collapsed = b" ".join(x for k, x in enumerate(w) if k not in dropped)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed).hexdigest()
    assert some > 20


def test_periodic_edges(spark):
    long = "la " * 30_000 + "énd of it"
    rows = [(1, None), (1, None), (2, ""), (3, " \n\t"), (4, "a b " * 4), (4, "A b a b a b a b"), (None, long), (5, "x" * 10**6)]
    docs = spark.createDataFrame([(i, t, "r", 7, "c") for i, t in rows], "doc_id long, text string, runs string, n_words int, collapsed string")
    got = [r.asDict(True) for r in periodic_runs(docs).collect()]
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_words"], [tuple(x.values()) for x in r["runs"]], r["collapsed"]))
    assert by[1] == [(0, [], "")] * 2 and by[2] == by[3] == [(0, [], "")]
    assert sorted(by[4]) == [(8, [], "A b a b a b a b"), (8, [(0, 8, 2)], "a b")]
    assert by[None] == [(30_003, [(0, 30_000, 1)], "la énd of it")] and by[5] == [(1, [], "x" * 10**6)]
    assert periodic_runs(docs.limit(0)).collect() == [] and periodic_runs(docs, keep=["doc_id"]).columns == ["doc_id", "n_words", "runs", "collapsed"]


# --- op12


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.sets(st.text("abé", min_size=0, max_size=6), max_size=25))
def test_sorted_list_scan(words):
    words = sorted(words)
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if edits(words[i], words[j]) == 1}
    got = list(near_in_list(words))
    assert {(i, j) for i, j, _ in got} == want and len(got) == len(want)
    for i, j, shared in got:
        a, b = words[i], words[j]
        assert shared == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


@pytest.mark.parametrize("block_words", [2, 5, 1000])
def test_near_words_in_blocks(spark, block_words):
    draw = random.Random(block_words)
    words = sorted({"".join(draw.choice("abc") for _ in range(draw.randint(1, 6))) for _ in range(260)} | {"\U0001f642aaaa", "\U0001f642aaa"})
    rows = spark.createDataFrame([(w, 1 + len(w)) for w in words], "word string, n long")
    got = [(r["word"], r["other"], r["other_n"]) for r in near_words(rows, block_words).collect()]
    want = {(a, b, 1 + len(b)) for a in words for b in words if abs(len(a) - len(b)) <= 1 and edits(a, b) == 1}
    assert set(got) == want and len(got) == len(want)


def test_spelling_equals_brute_force(spark, texts):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts = Counter()
    for doc_id, text in texts.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(lower)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            counts[word if h % 199 else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    # all words with a wildcard at each place, for replaced code points, and each word without one, for the others
    gaps, near = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            gaps[w[:k], w[k + 1 :]].add(w)
            if (shorter := w[:k] + w[k + 1 :]) in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    got = {r["word"]: r.asDict() for r in entry.queries()["op12_spelling"](spark, SF).collect()}
    assert got.keys() == words.keys() and sum(f is not None for f in form.values()) > 20
    for w, r in got.items():
        root = w
        while form[root]:
            root = form[root]
        want = {"word": w, "form": form[w], "root": root, "n": words[w], "n_near": len(near[w]), "form_n": form[w] and words[form[w]]}
        assert r == want


def test_forms_are_followed(spark):
    counts = [("abcdef", 5), ("abcdeg", 30), ("abcdhg", 200), ("abcihg", 1500), ("abjihg", 9000), ("abkihg", 9000), ("zzzzzz", 9)]
    rows = spark.createDataFrame([(w, n, "x") for w, n in counts], "word string, n long, root string")
    got = {r["word"]: r.asDict() for r in spelling_variants(rows).collect()}
    assert got["abcdef"] == {"word": "abcdef", "n": 5, "n_near": 1, "form": "abcdeg", "form_n": 30, "root": "abjihg"}
    assert got["abcihg"]["form"] == "abjihg" and got["abcihg"]["n_near"] == 3  # a tie: the smaller
    assert got["zzzzzz"] == {"word": "zzzzzz", "n": 9, "n_near": 0, "form": None, "form_n": None, "root": "zzzzzz"}
    assert spelling_variants(rows.limit(0)).collect() == []


def test_vocabulary_edges(spark):
    rows = [(1, None), (1, ""), (None, "ÉcoleÉ writers"), (2, "Writers writers WRITERS writer5 writers"), (2, "writers"), (3, "q" * 300_000 + " " + "\n\t")]
    docs = spark.createDataFrame([(i, t, "w", 3) for i, t in rows], "doc_id long, text string, word string, n int")
    assert {tuple(r) for r in vocabulary(docs, 6, 1).collect()} == {("writers", 6), ("ÉcoleÉ", 1), ("writer", 1), ("q" * 300_000, 1)}
    assert [tuple(r) for r in vocabulary(docs).collect()] == [("writers", 6)]
    assert vocabulary(docs.limit(0)).collect() == []
    damaged = {tuple(r) for r in vocabulary(docs, 6, 1, damage_every=1).collect()}
    h = zlib.crc32(b":writers")
    assert h % 1 == 0 and ("writers"[: h % 7] + "writers"[h % 7 + 1 :]) in {w for w, _ in damaged}


# --- op13


def slow_print(text):
    w = [x.lower() for x in words_of(text)]
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, bits=2):
    """Smallest key reachable, by a search over all pairs."""
    keys = sorted(prints)
    values = np.array([prints[k] for k in keys], np.uint64)
    component = {}
    for k, key in enumerate(keys):
        if key in component:
            continue
        component[key], open_ = key, [k]
        while open_:
            near = np.bitwise_count(values ^ values[open_.pop()]) <= bits
            for j in np.flatnonzero(near).tolist():
                if keys[j] not in component:
                    component[keys[j]] = key
                    open_.append(j)
    return component


def test_simhash_equals_brute_force(spark, texts):
    got = {r["doc_id"]: r.asDict() for r in entry.queries()["op13_simhash"](spark, SF).collect()}
    prints = {i: slow_print(t) for i, t in texts.items()}
    assert {i: f"{p:016x}" for i, p in prints.items()} == {i: r["fingerprint"] for i, r in got.items()}
    assert slow_components(prints) == {i: r["component_id"] for i, r in got.items()}


def test_every_close_pair_has_a_chain():
    """Pigeonring: whatever two bits differ, some start keeps all chains within their budgets."""
    masks = [m & (2**64 - 1) for m in sh._segments()]
    assert sum(masks) == 2**64 - 1
    for a in range(64):
        for b in range(64):
            x = 1 << a | 1 << b
            chains = [[sum(masks[(i + k) % 5] for k in range(n)) for n in range(1, 6)] for i in range(5)]
            assert any(all((x & m).bit_count() <= sh._budget(n) for n, m in enumerate(c, 1)) for c in chains)


@pytest.mark.parametrize("paired", [0, 3, 1000])
def test_links_keep_components(spark, paired):
    draw = random.Random(paired)
    prints = {draw.getrandbits(64) for _ in range(30)}
    for p in list(prints):  # chains and clouds around them
        for _ in range(12):
            for _ in range(draw.choice([1, 1, 2, 3])):
                p ^= 1 << draw.randrange(64)
            prints.add(p)
    signed = {int(np.uint64(p).astype(np.int64)): p for p in prints}
    rows = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    found = sh.links(rows, paired).collect()
    assert all((signed[r.a] ^ signed[r.b]).bit_count() <= 2 and r.a < r.b for r in found)
    got = {r["node"]: r["component"] for r in sh.components(sh.links(rows, paired)).collect()}
    assert {k: got.get(k, k) for k in signed} == slow_components(signed)


def test_simhash_edges(spark):
    long = "one two three four " * 40_000
    rows = [(1, None), (2, ""), (3, " \n"), (None, ""), (5, "One two"), (4, "one TWO"), (4, "unlike any other text"), (7, long), (6, long), (None, "nobody knows me")]
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, fingerprint string, component_id int")
    got = [r.asDict() for r in sh.simhash_duplicates(docs).collect()]
    assert len(got) == len(rows)
    zero = {(r["doc_id"], r["component_id"]) for r in got if r["fingerprint"] == 0}
    assert zero == {(1, 1), (2, 1), (3, 1), (None, 1)}
    assert {r["component_id"] for r in got if r["doc_id"] in (6, 7)} == {6}
    assert sorted(r["component_id"] for r in got if r["doc_id"] in (4, 5)) == [4, 4, 4]
    assert [r["component_id"] for r in got if r["doc_id"] is None and r["fingerprint"]] == [None]
    assert sh.simhash_duplicates(docs.limit(0)).collect() == []
