"""Spelling variants of a corpus' vocabulary: words one edit apart, by a scan of sorted lists.

``vocabulary`` counts the words. Two words are near if one inserted, deleted or replaced code
point makes one of the other; a word's form is its near word that is far more frequent.

A word is held against a sorted list by dynamic programming: row k of the edit matrix belongs
to the first k code points of the list's word, so the next word of the list, which shares its
longest common prefix (LCP) with the one before, goes on from the row at that depth. Rows are
banded to one edit on either side. Where a row has no cell of one edit or less, no word that
goes on from that prefix can be near, and the scan skips to the next word whose LCP is shorter.

One edit lies in the first or in the second half of a word, and the other half is the same in
both. So the vocabulary is dealt to blocks of words that agree in a half (and in the length of
the shorter word); a block's list holds what is left between the shared parts. Blocks that are
still large are halved again in the same way, each word going to two smaller blocks, until none
is. No pair is lost, no list grows with the vocabulary, and a common prefix is no hot spot.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrade.functions.storage import settle

LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: Blocks with more words are halved again; it doesn't change results.
BLOCK_WORDS = 32
#: Words that a task counts before it passes the counts on.
_HELD = 200_000

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _counter(least_chars: int, damage_every: int):
    runs = re.compile("[A-Za-z\u00c0-\u00ff]{%d,}" % least_chars)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                begin = zlib.crc32(key.encode())
                for run, n in Counter(runs.findall(text)).items():
                    word = run.lower() if run.isascii() else run.translate(_LOWER)
                    if damage_every:
                        h = zlib.crc32(word.encode(), begin)
                        if h % damage_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= least_chars:
                        held[word] += n
            if len(held) > _HELD:
                yield _counts(held)
                held.clear()
        yield _counts(held)

    return count


def _counts(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, damage_every: int = 0) -> DataFrame:
    """(word, n): the words of all texts with ``least_chars`` code points and ``least_count`` occurrences at least.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z as a-z. With
    ``damage_every`` d, made errors are put in first: where d divides h, the CRC-32 of
    "<doc_id>:<word>", the word loses its code point h modulo its length in that document.

    Null, empty and blank texts have no words. A null doc_id is spelled as nothing. Rows that
    repeat are counted as often as they stand there. Other columns aren't looked at.
    """
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    read = docs.select(key.alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = read.mapInArrow(_counter(least_chars, damage_every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def near_in_list(words: list[str]) -> Iterator[tuple[int, int, int]]:
    """(i, j, length of their common prefix) of all words i < j of a sorted list that are one edit apart.

    The words are distinct. Rows of the edit matrix have the cells beside the diagonal; 2 stands for two or more edits.
    """
    lcp = [0]
    for a, b in zip(words[:-1], words[1:], strict=True):
        most = min(len(a), len(b))
        lcp.append(next((k for k in range(most) if a[k] != b[k]), most))
    count = len(words)
    for i in range(count - 1):
        a, size = words[i], len(words[i])
        # the rows of the word's own prefixes
        rows = [(2, 0, 1 if size else 2)] + [(1, 0, 1)] * (size - 1) + [(1, 0, 2)] * (size > 0)
        j, depth, shared = i + 1, lcp[i + 1], lcp[i + 1]
        while j < count:
            b = words[j]
            del rows[depth + 1 :]
            left, mid, right = rows[depth]
            for k in range(depth, len(b)):
                c = b[k]
                # cells k, k + 1 and k + 2 of row k + 1
                x = left if 0 < k <= size and a[k - 1] == c else left + 1
                x = min(x, mid + 1, 2)
                y = mid if k < size and a[k] == c else mid + 1
                y = min(y, right + 1, x + 1, 2) if k < size else 2
                z = min(right if a[k + 1] == c else right + 1, y + 1, 2) if k + 1 < size else 2
                left, mid, right = x, y, z
                rows.append((x, y, z))
                depth = k + 1
                if x + y + z == 6:
                    break
            alive = left + mid + right < 6
            if alive and abs(size - len(b)) <= 1 and (left, mid, right)[size - len(b) + 1] <= 1:
                yield i, j, shared
            j += 1
            # all that share a dead prefix are passed over
            while j < count and not alive and lcp[j] >= depth:
                j += 1
            if j < count:
                depth = min(depth, lcp[j])
                shared = min(shared, lcp[j])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of the blocks of a partition, which is sorted by block and middle."""
    names = ["word", "other", "other_n"]

    def pairs(block: list[tuple]) -> Iterator[tuple[str, str, int]]:
        _, size, low, high = block[0][:4]
        for i, j, shared in near_in_list([row[4] for row in block]):
            (one, n), (two, m) = block[i][5:], block[j][5:]
            # both one longer: their pair is of the next size; the edit's last place says which block has the pair
            if min(len(one), len(two)) == size and (low + shared < high or high == size):
                yield one, two, m
                yield two, one, n

    block: list[tuple] = []
    for batch in batches:
        found: list[tuple[str, str, int]] = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("block", "size", "low", "high", "middle", "word", "n")), strict=True):
            if block and block[0][:4] != row[:4]:
                found += pairs(block)
                block = []
            block.append(row)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=names)
    if found := list(pairs(block)) if block else []:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=names)


def _blocks(rows: DataFrame, block_words: int) -> tuple[DataFrame, DataFrame]:
    """(rows of blocks to scan, rows of blocks that are too large) of those with two words or more.

    ``rows`` says of each word which part, from ``low`` to ``high``, may have the edit; block
    names are hashes of the rest.
    """
    start, end = F.substring("word", F.lit(1), F.col("low")), F.expr("right(word, size - high)")
    rows = settle(rows.withColumn("block", F.xxhash64("size", "low", "high", start, F.lit("|"), end)), "blocks")
    sizes = rows.groupBy("block").agg(F.count("*").alias("words")).filter("words > 1")
    large = (F.col("words") > block_words) & (F.col("high") - F.col("low") > 1)
    dealt = settle(rows.join(sizes, "block").withColumn("large", large).drop("words"), "dealt")
    return dealt.filter("not large").drop("large"), dealt.filter("large").select("word", "n", "size", "low", "high")


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, other, other_n): every two different words of (word, n) that are one edit apart, from both sides."""
    n = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(n, n - 1)).alias("size"), F.lit(0).alias("low"))
    rows = rows.filter("size > 0").withColumn("high", F.col("size"))
    parts = []
    while True:
        half = F.col("low") + ((F.col("high") - F.col("low")) / 2).cast("int")
        two = F.array(F.struct("low", half.alias("high")), F.struct(half.alias("low"), "high"))
        rows = rows.select("word", "n", "size", F.explode(two).alias("part")).select("word", "n", "size", "part.*")
        small, rows = _blocks(rows.filter("low < high"), block_words)
        parts.append(small)
        if rows.isEmpty():
            break
    lists = parts[0]
    for part in parts[1:]:
        lists = lists.unionByName(part)
    middle = F.expr("substring(word, low + 1, length(word) - low - (size - high))")
    lists = lists.withColumn("middle", middle).repartition("block").sortWithinPartitions("block", "size", "low", "high", "middle")
    near = lists.mapInArrow(_scan, "word string, other string, other_n long")
    # blocks are named by hashes: two that share a name would meet
    return near.filter(F.levenshtein("word", "other", 1) == 1)


def _roots(forms: DataFrame, words: DataFrame, ratio: int) -> DataFrame:
    """(word, root) of the words that have a form. Counts grow ``ratio`` times a step, which bounds the steps."""
    most, least = words.agg(F.max("n"), F.min("n")).first()
    steps = math.log(most / least, ratio) + 1 if most else 1
    now = settle(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        after = now.select(F.col("word").alias("root"), F.col("root").alias("after"))
        now = settle(now.join(after, "root", "left").select("word", F.coalesce("after", "root").alias("root")), "roots")
    return now


def spelling_variants(words: DataFrame, ratio: int = RATIO, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root): one row for each row of ``words`` (word, n).

    Words are near if they differ by exactly one inserted, deleted or replaced code point.
    ``n_near`` counts a word's near words, ``form`` is the one of largest n (ties: smallest in the
    order of code points) if that is ``ratio`` (2 or more) times the word's own n at least, else null;
    ``root`` is reached by following forms to the last one, the word itself if it has none.

    Words are distinct and not null, as ``vocabulary`` gives them, and n is positive; an empty
    table gives an empty one. Other columns aren't looked at.
    """
    if ratio < 2:
        raise ValueError("a form is twice as frequent at least")
    words = settle(words.select("word", "n"), "words")
    near = near_words(words, block_words).groupBy("word")
    near = near.agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    enough = -F.col("best.n") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"),
    )
    found = settle(found, "forms")
    roots = _roots(found.filter("form is not null"), words, ratio)
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
