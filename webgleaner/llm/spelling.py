"""Spelling variants: words of a corpus that differ by one edit from a much more frequent word.

Words one edit apart agree in the first or the last half of their letters, so words are brought together by those halves. In each such block
the words stand sorted; the longest common prefixes (LCP) of neighbours tell how many rows of the edit matrix the next word shares with the last
one. Every word of the block is matched against the sorted list in one scan: only the rows behind the LCP are computed, three cells wide, and
where a row holds no value below two, all words with that prefix are skipped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, give_back, lookup, prepared, stage

by_value(__name__)

# Words: runs of these letters, A-Z lower-cased before.
LETTERS = "a-zÀ-ÿ"
LEAST_LETTERS = 7
LEAST_COUNT = 2
TYPO_MODULUS = 31  # one in so many occurrences loses a letter
FORM_FACTOR = 10  # so much more frequent is a form than its variants
HELD_WORDS = 200_000  # words counted in a task before it passes them on
BLOCK_WORDS = 2_000  # larger blocks are divided further
SCAN_WORDS = 20_000  # words of whole blocks scanned together

# --- vocabulary -------------------------------------------------------------------------------------------------------


def typed_words(doc_id: int | None, text: str | None, least: int = LEAST_LETTERS, modulus: int = TYPO_MODULUS) -> Counter:
    """Words of a text with their counts; runs whose hash with the id is divisible by ``modulus`` lose the letter the hash names.

    A null text has no words; a null id is hashed as no text.
    """
    found: Counter = Counter()
    lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    start = zlib.crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
    for run, n in Counter(re.findall(f"[{LETTERS}]{{{least},}}", lowered)).items():
        h = zlib.crc32(run.encode(), start)
        if h % modulus == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        found[run] += n
    return found


def word_rows(least: int, modulus: int, schema: pa.Schema):
    """Partition function: ``word, n`` from ``doc_id, text``; a word may come several times."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for word, n in typed_words(doc_id, text, least, modulus).items():
                    held[word] += n
                if len(held) >= HELD_WORDS:
                    yield rows()
                    held = Counter()
        yield rows()
        give_back()

    return run


def vocabulary(docs: DataFrame, least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, modulus: int = TYPO_MODULUS) -> DataFrame:
    """``word, n`` of every word of at least ``least`` letters that occurs ``least_count`` times in ``docs`` (``doc_id, text``)."""
    prepared(docs.sparkSession)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = rows.mapInArrow(word_rows(least, modulus, schema), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- blocks -----------------------------------------------------------------------------------------------------------


def half(letters: int) -> int:
    """Letters at one end that two words share if they are one edit apart and the longer has ``letters`` of them."""
    return letters // 2


def _divided(rows: DataFrame) -> DataFrame:
    """Rows (``key, word, n, lo, hi``) by the next halves of what ``key`` leaves open, ``word[lo:hi]``.

    A word may be the longer or the shorter one of its pair, so it goes by the half of its own length and by that of the next one.
    """
    length = F.col("hi") - F.col("lo")
    sizes = F.array_distinct(F.array(F.floor(length / 2), F.floor((length + 1) / 2)).cast("array<int>"))
    by_size = rows.withColumn("k", F.explode(sizes))
    ends = F.explode(F.array(F.lit("p"), F.lit("s")))
    first = F.when(F.col("end") == "p", F.col("lo")).otherwise(F.col("hi") - F.col("k"))
    return by_size.withColumn("end", ends).select(
        F.concat("key", "end", F.col("k").cast("string"), F.lit(":"), F.substring("word", first + 1, F.col("k")), F.lit("|")).alias("key"),
        "word",
        "n",
        F.when(F.col("end") == "p", F.col("lo") + F.col("k")).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("end") == "p", F.col("hi")).otherwise(F.col("hi") - F.col("k")).alias("hi"),
    )


def blocks(words: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """``key, word, n``: words one edit apart share a key. Blocks of more than ``most`` words are divided by half of the letters left.

    Every division at least halves the open letters, so there are as many rounds as their number has binary digits, and none for small blocks.
    """
    start = words.select(F.lit("").alias("key"), "word", "n", F.lit(0).alias("lo"), F.char_length("word").alias("hi"))
    todo, done = stage(_divided(start), "spelling-blocks"), []
    while True:
        # Blocks that leave one letter open hold at most one word per letter of the alphabet.
        hot = todo.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("hi") - F.col("lo")).alias("_open"))
        hot = stage(hot.where((F.col("_n") > most) & (F.col("_open") > 1)).select("key"), "spelling-hot")
        if hot.isEmpty():
            done.append(todo)
            break
        hot = lookup(hot)
        done.append(todo.join(hot, "key", "left_anti"))
        todo = stage(_divided(todo.join(hot, "key")), "spelling-blocks")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("key", "word", "n")


def meets_here(key: str, a: str, b: str) -> bool:
    """Whether the block of ``key`` is the one of its blocks that stands for the pair: the first end they agree at, in every division."""
    while key:
        size = int(key[1 : key.index(":")])
        if size != half(max(len(a), len(b))):
            return False
        if key[0] == "p":
            a, b = a[size:], b[size:]
        else:
            if a[:size] == b[:size]:
                return False
            a, b = a[: len(a) - size], b[: len(b) - size]
        key = key[key.index("|") + 1 :]
    return True


# --- scan of the sorted list ------------------------------------------------------------------------------------------


class SortedList:
    """Words of whole blocks, sorted in each: the nodes are the letters behind the common prefix with the word before, in order."""

    def __init__(self, words: list[str], first_of_block: np.ndarray):
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        # Two zeros around each word: no letter equals them.
        self.letters = np.frombuffer(("\0\0" + "\0\0".join(words) + "\0\0").encode("utf-32-le"), dtype=np.uint32)
        self.at = np.cumsum(self.size + 2) - self.size
        self.lcp = np.zeros(len(words), dtype=np.int64)
        for i in np.flatnonzero(~first_of_block).tolist():
            a, b, n = words[i - 1], words[i], 0
            for x, y in zip(a, b):
                if x != y:
                    break
                n += 1
            self.lcp[i] = n
        own = self.size - self.lcp
        self.node = np.cumsum(own) - own
        self.word = np.repeat(np.arange(len(words)), own)
        self.depth = np.arange(int(own.sum())) - self.node[self.word] + self.lcp[self.word] + 1
        self.letter = self.letters[self.at[self.word] + self.depth - 1]
        # Blocks end where the next one starts.
        starts = np.append(np.flatnonzero(first_of_block), len(words))
        block = np.cumsum(first_of_block) - 1
        nodes = np.append(self.node, len(self.word))
        self.begin, self.end = nodes[starts[block]], nodes[starts[block + 1]]
        self.skip = nodes[self._next_word(self.word, self.depth)]

    def _next_word(self, word: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """For each node the next word that does not start with the node's prefix."""
        lcp = np.append(self.lcp, -1)
        smaller = np.empty(len(lcp), dtype=np.int64)
        waiting: list[int] = []
        values = lcp.tolist()
        for i, value in enumerate(values):
            while waiting and values[waiting[-1]] > value:
                smaller[waiting.pop()] = i
            waiting.append(i)
        smaller[waiting] = len(lcp) - 1
        out = word + 1
        todo = np.flatnonzero(lcp[out] >= depth)
        while len(todo):
            out[todo] = smaller[out[todo]]
            todo = todo[lcp[out[todo]] >= depth[todo]]
        return out

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (word, word of its block) that are exactly one edit apart, both ways."""
        query = np.arange(len(self.size))
        base = np.cumsum(self.size + 2) - (self.size + 2)
        rows = np.full((int((self.size + 2).sum()), 3), 2, dtype=np.int8)
        rows[base] = (2, 0, 1)  # the row of the empty prefix: cells of -1, 0 and 1 letters
        node, found_a, found_b = self.begin.copy(), [], []
        while len(query):
            depth, letter = self.depth[node], self.letter[node]
            deep = depth > self.size[query] + 1
            place = base[query] + np.minimum(depth, self.size[query] + 1)
            before = rows[place - 1]
            own = self.at[query] + np.minimum(depth, self.size[query] + 1)
            c0 = np.minimum(before[:, 0] + (letter != self.letters[own - 2]), before[:, 1] + 1)
            c1 = np.minimum(np.minimum(before[:, 1] + (letter != self.letters[own - 1]), before[:, 2] + 1), c0 + 1)
            c2 = np.minimum(before[:, 2] + (letter != self.letters[own]), c1 + 1)
            row = np.minimum(np.stack([c0, c1, c2], axis=1), 2).astype(np.int8)
            live = (row.min(axis=1) < 2) & ~deep
            rows[place[live]] = row[live]
            cell = self.size[query] - depth + 1
            last = np.flatnonzero(live & (depth == self.size[self.word[node]]) & (cell >= 0) & (cell <= 2))
            hit = last[row[last, cell[last]] == 1]
            found_a.append(query[hit])
            found_b.append(self.word[node[hit]])
            node = np.where(live, node + 1, self.skip[node])
            going = node < self.end[query]
            query, node = query[going], node[going]
        return np.concatenate(found_a or [query]), np.concatenate(found_b or [query])


def near_rows(schema: pa.Schema):
    """Partition function: near words found in each block, summed per word, from rows ``key, turned, word, n`` in order."""

    def scan(keys: list, turned: list, words: list, counts: np.ndarray) -> pa.RecordBatch:
        first = np.array([True, *(a != b for a, b in zip(keys, keys[1:]))])
        a, b = SortedList(turned, first).near()
        kept = [meets_here(keys[i], words[i], words[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        a, b = a[np.array(kept, dtype=bool)], b[np.array(kept, dtype=bool)]
        # The largest count first, then the smaller word.
        place = np.empty(len(words), dtype=np.int64)
        place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((place[b], -counts[b], a))
        a, b = a[order], b[order]
        start = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(start, len(a)))
        best = b[start]
        return pa.RecordBatch.from_pydict(
            {"word": [words[i] for i in a[start].tolist()], "n_near": sizes, "near": [words[i] for i in best.tolist()], "near_n": counts[best]}, schema=schema
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        for batch in batches:
            for column, name in zip(held, ("key", "turned", "word", "n"), strict=True):
                column.extend(batch[name].to_pylist())
            keys = held[0]
            if len(keys) >= SCAN_WORDS:
                cut = len(keys) - 1
                while cut and keys[cut - 1] == keys[cut]:
                    cut -= 1
                if cut:
                    yield scan(keys[:cut], held[1][:cut], held[2][:cut], np.array(held[3][:cut]))
                    held = tuple(column[cut:] for column in held)
        if held[0]:
            yield scan(*held[:3], np.array(held[3]))
        give_back()

    return run


def near_words(words: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """``word, n_near, near, near_n`` for each of ``words`` (``word, n``, distinct) with words one edit away: their number, the most frequent
    (ties: the smallest) and its count."""
    spark = prepared(words.sparkSession)
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # In blocks by the last letters the words are scanned from their ends.
    turned = F.when(F.startswith("key", F.lit("s")), F.reverse("word")).otherwise(F.col("word"))
    placed = blocks(words, most).select("key", turned.alias("turned"), "word", "n").repartition(parts, "key").sortWithinPartitions("key", "turned")
    found = placed.mapInArrow(near_rows(schema), "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")
    )


# --- forms ------------------------------------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form`` (no nulls, no cycles): forms followed to the last, twice as far each round."""
    now = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_ahead"))
        further = now.join(ahead, "root", "left").select("word", F.coalesce("_ahead", "root").alias("root"), F.col("_ahead").isNotNull().alias("_moved"))
        further = stage(further, "spelling-roots")
        now = further.select("word", "root")
        if further.where("_moved").isEmpty():
            return now


def spelling_groups(docs: DataFrame, factor: int = FORM_FACTOR, most: int = BLOCK_WORDS) -> DataFrame:
    """Words of ``docs`` (``doc_id, text``) with the more frequent word they may be a variant of.

    Returns ``word, form, root`` and long ``n, n_near, form_n``, a row per distinct word (see ``vocabulary``; typing errors are made on purpose in
    one of 31 occurrences, see ``typed_words``). ``form`` is the most frequent word one edit away, by ties the smallest, if it occurs ``factor``
    times as often; ``root`` follows forms to the last and is the word itself without one. Null and empty texts have no words; without documents
    there are no rows; repeated rows count as often as they stand there. Other columns are ignored.
    """
    words = stage(vocabulary(docs), "spelling-words")
    joined = words.join(near_words(words, most), "word", "left")
    chosen = F.col("near_n") >= factor * F.col("n")
    found = stage(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("near")).alias("form"),
            F.when(chosen, F.col("near_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    ends = roots(found.where(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
