"""The array code of op1 and op4 against plain Python, byte by byte and word by word."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from noticegrade.llm import fingerprints, quality

from oracle.compare import duck

MADE = [
    "", " ", "\n\t ", "a", "ab", "abc", "é", "日本", "x" * 5000, "the the THE the. a b a b! [1] {2} #$% |x|", "no\x00control\x07s",
    "One. two, three; four: 'five' \"six\" - seven?", "\x0b\x0c\r", "12 34 !! ab", "w " * 30, "a b c d e f g h i j a k b",
]


@pytest.fixture(scope="module")
def texts():
    return MADE + [t or "" for (t,) in duck("/root/testdata/sf0.01").execute("SELECT text FROM documents").fetchall()]


def test_statistics_equal_plain_python(texts):
    def share(data, members):
        return math.sqrt(sum(map(data.count, members)) / max(len(data), 1))

    one = lambda s: [bytes([c]) for c in s.encode()]
    span = lambda *r: [bytes([c]) for a, b in r for c in range(a, b + 1)]
    classes = [
        span((65, 90)), span((97, 122)), span((48, 57)), span((9, 13), (32, 32)), one("\n"), one(".,;:?'\"-"), one("!"),
        one("|\t/\\_=+~"), one("#$%&*@^"), one("()[]{}<>"), span((0, 8), (11, 12), (14, 31)), span((128, 255)),
    ]

    def slow(text):
        data = text.encode()
        words = re.findall(rb"[^\x20\x09-\x0d]+", data)
        n = max(len(words), 1)
        plain, words = words, [w.lower() for w in words]  # words are compared without regard to A-Z or a-z
        counts = Counter(words)
        back = lambda gap: sum(a == b for a, b in zip(words[gap:], words, strict=False)) / n
        recent = sum(w in words[max(0, i - 10) : i] for i, w in enumerate(words)) / n
        return [share(data, c) for c in classes] + [
            math.log1p(len(words)) / 10, sum(map(len, words)) / n / 20, len(counts) / n, math.log1p(len(counts)) / 10,
            back(1), back(2), recent, max(counts.values(), default=0) / n, float(not words),
            sum(not re.search(rb"[A-Za-z\x80-\xff]", w) for w in words) / n,
            sum(b"A" <= w[:1] <= b"Z" for w in plain) / n, data.count(b".") / n,
        ]

    got = quality.statistics(pa.array(texts, pa.string()))
    assert got.shape == (len(texts), len(quality.STATISTICS))
    np.testing.assert_allclose(got, [slow(t) for t in texts], rtol=1e-12, atol=1e-12)


def _slow_digest(text, table):
    data = text.encode()
    counts = [0] * 1024
    closed = data + b"\xff\xff"
    for i in range(len(data)):
        counts[table[closed[i]] ^ table[256 + closed[i + 1]] ^ table[512 + closed[i + 2]]] += 1
    low, mid, high = (sorted(counts)[k] for k in (255, 511, 767))
    ratio = lambda x: f"{x * 15 // high if high else 0:x}"
    quartiles = [sum(c > q for q in (low, mid, high)) for c in counts]
    bits = "".join(f"{q:02b}" for q in quartiles)
    length = min(255, round(8 * math.log2(1 + len(data))))
    return f"{length:02x}{ratio(low)}{ratio(mid)}{int(bits, 2):0512x}", (length, int(ratio(low), 16), int(ratio(mid), 16)), quartiles


def test_digests_and_likeness_equal_plain_python(texts):
    table = [int(x) for x in fingerprints._TABLES.reshape(-1)]
    assert len(set(table)) > 500 and max(table) < 1024
    slow = [_slow_digest(t, table) for t in texts]
    assert [fingerprints.fingerprint(t) for t in texts] == [s[0] for s in slow]
    for (a, heads, codes), (b, other_heads, other_codes) in zip(slow, slow[1:], strict=False):
        apart = sum(abs(x - y) for x, y in zip(heads, other_heads, strict=True))
        apart += sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(codes, other_codes, strict=True))
        assert fingerprints.likeness(a, b) == 1 - apart / (6 * 1024 + 255 + 30)


def test_blocks_of_a_long_text_count_alike(monkeypatch):
    text = "".join(chr(97 + i * i % 23) for i in range(10_000))
    whole = fingerprints.fingerprint(text)
    monkeypatch.setattr(fingerprints, "_BLOCK", 777)
    assert fingerprints.fingerprint(text) == whole
