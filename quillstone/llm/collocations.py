"""Phrase collocations: exact counts of frequent phrases, by Apriori levels over minimal perfect hashes.

A phrase of k words is a pair of numbers: the slot of its first k - 1 words and that of its last k - 1, each in the
table of the level below; a word's slot comes from the table of frequent words of its language. Only pairs of two
frequent parts are looked at (Apriori: a phrase is never more frequent than its parts). For each level:

1. tasks count pairs by buckets (many more buckets than pairs while the corpus is below 2^34 words), which are summed by range;
2. pairs in buckets with enough occurrences are candidates, each once;
3. a minimal perfect hash of the candidates goes to the tasks, which look pairs up (the stored key tells strangers
   apart), count slots with bincount, and send the arrays; the arrays are summed in a tree of two steps;
4. frequent slots number the phrases of the next level, in the same places of the text.

A table that goes to all tasks holds at most MOST entries (words: WORD_BYTES too); a level with more takes several
passes over its pairs. Texts are split into words twice; after that, tasks only see arrays of slots.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, slices, texts_of, written
from .perfect_hash import PerfectHash, mixed

#: Entries of a table that is sent to all tasks, at most, and bytes of words in one.
MOST, WORD_BYTES = 1 << 21, 32 << 20
#: Bits of a range of buckets or slots that is summed at once; bits of all buckets at most.
RANGE_BITS, MOST_BITS = 20, 36
#: Slots in one array of counts.
COUNTS = 1 << 14
#: Pairs that a task sorts at once, and distinct words it counts before it sends them on.
PAIRS, WORDS = 1 << 20, 250_000
_FOLD = bytes(32 if i == 9 else 10 if chr(i) in ".,;:!?" or 10 <= i <= 13 else ord(chr(i).lower()) if i < 128 else i for i in range(256))


def tokens(text: bytes) -> list[bytes]:
    r"""Words of a text in lower case (A-Z), with b"\n" between pieces and behind the last. b"" stands for nothing."""
    return (text.translate(_FOLD) + b"\n").replace(b"\n", b" \n ").split(b" ")


def _binary(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            c.pop(b"", None), c.pop(b"\n", None)
            words = [*c, None]
            yield _binary("lang, word, f", [pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array([*c.values(), sum(c.values())], pa.int64())])
        counts.clear()

    for whole in batches:
        for b in slices(whole, "text"):
            for lang, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                counts.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, counts.values())) > WORDS:
                yield from out()
    yield from out()


class WordTable:
    """A minimal perfect hash of (language, word); words whose 64-bit hash is not their own stand apart."""

    def __init__(self, langs: list[str], words: list[str], offset: int):
        self.offset = offset
        entries = [self.entry(a, w.encode()) for a, w in zip(langs, words, strict=True)]
        hashes = np.array([xxhash.xxh3_64_intdigest(e) for e in entries], np.uint64).view(np.int64)
        _, first, times = np.unique(hashes, return_index=True, return_counts=True)
        own = first[times == 1]
        self.table = PerfectHash(hashes[own])
        self.stored: list[bytes] = [b""] * len(own)
        for slot, k in zip(self.table.lookup(hashes[own]).tolist(), own.tolist(), strict=True):
            self.stored[slot] = entries[k]
        apart = sorted(set(range(len(entries))) - set(own.tolist()))
        self.apart = {entries[k]: len(own) + n for n, k in enumerate(apart)}

    @staticmethod
    def entry(lang: str, word: bytes) -> bytes:
        head = lang.encode()
        return len(head).to_bytes(4, "little") + head + word

    def slots(self, lang: str, words: list[bytes]) -> list[int]:
        """The slot of each word, -1 for strangers."""
        entries = [self.entry(lang, w) for w in words]
        led = self.table.lookup(np.array([xxhash.xxh3_64_intdigest(e) for e in entries], np.uint64).view(np.int64)).tolist()
        return [self.offset + s if s >= 0 and self.stored[s] == e else self.offset + self.apart[e] if e in self.apart else -1 for e, s in zip(entries, led, strict=True)]


def _squeezed(slots: np.ndarray) -> np.ndarray:
    """Of several -1 in a row, one; one at the end. Entries between two -1 that stand alone stay out too: no pair has them."""
    known = np.concatenate([[False], slots >= 0, [False]])
    paired = known[1:-1] & (known[:-2] | known[2:])
    slots = np.where(paired, slots, -1)
    keep = paired | np.concatenate([[False], paired[:-1]])
    return np.concatenate([slots[keep], np.array([-1], slots.dtype)])


def _encoder(shared, last: bool):
    """(lang, text, slots so far) -> the same with this table's words filled in; the last drops what has no pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[bytes, int]] = {}
        for whole in batches:
            for b in slices(whole, "text"):
                langs, texts, before = b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist()
                if sum(map(len, known.values())) > 2 * WORDS:
                    known.clear()
                docs = [tokens(t) for t in texts]
                for lang in set(langs):
                    mine = known.setdefault(lang, {b"\n": -1, b"": -2})
                    new = list(set().union(*(d for a, d in zip(langs, docs, strict=True) if a == lang)) - mine.keys())
                    mine.update(zip(new, shared.value.slots(lang, new), strict=True))
                out = []
                for lang, doc, done in zip(langs, docs, before, strict=True):
                    ids = np.fromiter(map(known[lang].__getitem__, doc), np.int32, len(doc))
                    ids = ids[ids != -2]
                    out.append(ids if done is None else np.maximum(ids, np.frombuffer(done, np.int32)))
                if last:
                    ids = _squeezed(np.concatenate([*out, np.array([-1], np.int32)]))
                    yield _binary("slots", [pa.array([ids.tobytes()], pa.binary())])
                else:
                    yield _binary("lang, text, slots", [b.column(0), b.column(1), pa.array([x.tobytes() for x in out], pa.binary())])

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Keys of neighbours that are both known, some PAIRS at once."""
    held, size = [], 0
    for b in batches:
        for raw in b.column(0).to_pylist():
            s = np.frombuffer(raw, np.int32).astype(np.int64)
            both = (s[:-1] >= 0) & (s[1:] >= 0)
            keys = (s[:-1][both] << 32) | s[1:][both]
            for at in range(0, len(keys), PAIRS):
                held.append(keys[at : at + PAIRS])
                size += len(held[-1])
                if size >= PAIRS:
                    yield np.concatenate(held)
                    held, size = [], 0
    if size:
        yield np.concatenate(held)


def _summed(df: DataFrame, schema: str, length: int, emit, *keys: str) -> DataFrame:
    """Sums arrays that share `keys`. Rows: the keys, places (uint32) and counts (int64) as binary; a range at a time is
    held, as `length` counts. `emit` makes a batch of the keys and the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(length, np.int64)
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for *key, places, counts in zip(*columns, strict=True):
                if at is not None and key != at:
                    yield from emit(at, total)
                    total[:] = 0
                at = key
                total[np.frombuffer(places, np.uint32)] += np.frombuffer(counts, np.int64)
        if at is not None:
            yield from emit(at, total)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _sparse(keys: list, total: np.ndarray) -> Iterator[pa.RecordBatch]:
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in keys], pa.array([some.astype(np.uint32).tobytes()]), pa.array([total[some].tobytes()])], [f"k{i}" for i in range(len(keys))] + ["places", "counts"])


def _hot_buckets(level: DataFrame, bits: int, least: int) -> DataFrame:
    """Buckets of pairs with `least` occurrences or more."""
    low = min(bits, RANGE_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys in _pairs(batches):
            buckets, times = np.unique(mixed(keys, 0) >> np.uint64(64 - bits), return_counts=True)
            high = (buckets >> np.uint64(low)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(high)) + 1
            places = (buckets & np.uint64((1 << low) - 1)).astype(np.uint32)
            yield _binary("k0, places, counts", [pa.array(high[np.concatenate([[0], cuts])]), pa.array([x.tobytes() for x in np.split(places, cuts)]), pa.array([x.tobytes() for x in np.split(times.astype(np.int64), cuts)])])

    def emit(keys: list, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield _binary("bucket", [pa.array((keys[0] << low) | np.flatnonzero(total >= least))])

    return _summed(level.mapInArrow(count, "k0 long, places binary, counts binary"), "bucket long", 1 << low, emit, "k0")


def _collected(df: DataFrame) -> np.ndarray:
    """A column of at most MOST numbers, sorted."""
    return np.sort(df.toArrow().column(0).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64))


def _parts(df: DataFrame, column: str) -> list[DataFrame]:
    """df in parts of MOST rows or less, by a hash of a column of distinct numbers."""
    rows = df.count()
    n = math.ceil(1.1 * rows / MOST)
    return [df] if n == 1 else [df.filter(F.pmod(F.xxhash64(column), F.lit(n)) == k) for k in range(n)]


def _candidates(level: DataFrame, buckets: np.ndarray, bits: int, least: int) -> DataFrame:
    """The distinct pairs of these buckets, without those that can't occur `least` times.

    Of n tasks, one at least has an n-th of a frequent pair's occurrences: a task sends the pairs that it has that often.
    """
    tasks = max(1, level.rdd.getNumPartitions())
    local = -(-least // tasks)
    shared = level.sparkSession.sparkContext.broadcast(buckets)

    shift = max(0, bits - RANGE_BITS)

    def sent(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Keys by the range of buckets they are in, as arrays."""
        part = (mixed(keys, 0) >> np.uint64(64 - bits)).astype(np.int64) >> (bits - shift)
        order = np.argsort(part, kind="stable")
        parts, first = np.unique(part[order], return_index=True)
        yield _binary("k0, keys", [pa.array(parts), pa.array([x.tobytes() for x in np.split(keys[order], first[1:])] if len(parts) else [], pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for keys in _pairs(batches):
            hot = shared.value
            b = (mixed(keys, 0) >> np.uint64(64 - bits)).astype(np.int64)
            at = np.minimum(np.searchsorted(hot, b), len(hot) - 1)
            own, n = np.unique(keys[hot[at] == b], return_counts=True)
            seen, back = np.unique(np.concatenate([seen, own]), return_inverse=True)
            times = np.bincount(back, np.concatenate([times, n]), len(seen)).astype(np.int64)
            if len(seen) > PAIRS:  # counts that are cut off here prove nothing: all go
                yield from sent(seen)
                seen, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield from sent(seen[times >= local])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, have = None, np.zeros(0, np.int64)
        for b in batches:
            for part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if part != at:
                    if len(have):
                        yield _binary("key", [pa.array(have)])
                    at, have = part, np.zeros(0, np.int64)
                have = np.union1d(have, np.frombuffer(raw, np.int64))
        if len(have):
            yield _binary("key", [pa.array(have)])

    # No more tasks than were counted, whatever the cluster does meanwhile. A pair is of one range: each comes out once.
    arrays = level.coalesce(tasks).mapInArrow(run, "k0 long, keys binary")
    return arrays.repartition("k0").sortWithinPartitions("k0").mapInArrow(merged, "key long")


def _counted(level: DataFrame, shared, offset: int, least: int) -> DataFrame:
    """slot, first, rest, a of the candidates that occur `least` times or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = shared.value
        total = np.zeros(len(table), np.int64)
        for keys in _pairs(batches):
            slots = table.lookup(keys)
            total += np.bincount(slots[slots >= 0], minlength=len(total))
        group = TaskContext.get().partitionId() // 32
        for at in range(0, len(total), COUNTS):
            part = total[at : at + COUNTS]
            if part.any():
                yield from _sparse([at, group], part)

    def emit(keys: list, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        places = np.flatnonzero(total >= least)
        key = shared.value.keys[keys[0] + places]
        yield _binary("slot, first, rest, a", [pa.array(offset + keys[0] + places), pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(total[places])])

    arrays = level.mapInArrow(count, "k0 long, k1 long, places binary, counts binary")
    groups = _summed(arrays, "k0 long, k1 long, places binary, counts binary", COUNTS, _sparse, "k0", "k1").drop("k1")
    return _summed(groups, "slot long, first long, rest long, a long", COUNTS, emit, "k0")


def _advanced(level: DataFrame, shared, frequent, offset: int, last: bool) -> DataFrame:
    """Arrays of this level's slots, in the places of the level below: slots, or slots below and slots so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, often = shared.value, frequent.value
        for b in batches:
            below = b.column(0).to_pylist()
            so_far = b.column(1).to_pylist() if b.num_columns > 1 else [None] * len(below)
            out = []
            for raw, done in zip(below, so_far, strict=True):
                s = np.frombuffer(raw, np.int32).astype(np.int64)
                both = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))
                slots = table.lookup((s[both] << 32) | s[both + 1])
                hit = (slots >= 0) & often[slots]
                mine = np.full(len(s), -1, np.int32)
                mine[both[hit]] = offset + slots[hit]
                mine = mine if done is None else np.maximum(mine, np.frombuffer(done, np.int32))
                out.append((_squeezed(mine) if last else mine).tobytes())
            if last:
                yield _binary("slots", [pa.array([x for x in out if len(x) > 4], pa.binary())])
            else:
                yield _binary("slots, next", [b.column(0), pa.array(out, pa.binary())])

    return level.mapInArrow(run, "slots binary" if last else "slots binary, next binary")


def _word_level(texts: DataFrame, frequent: DataFrame) -> tuple[DataFrame | None, DataFrame | None, list[DataFrame]]:
    """(arrays of word slots, slot and counts of each frequent word, tables to delete at the end)."""
    spark = texts.sparkSession
    level, slotted, spent, offset = texts.withColumn("slots", F.lit(None).cast("binary")), None, [], 0

    def of(rows: Iterator) -> Iterator[tuple[list, list]]:
        langs, words, size = [], [], 0
        for r in rows:
            if langs and (len(langs) >= MOST or size + len(r["word"]) > WORD_BYTES):
                yield langs, words
                langs, words, size = [], [], 0
            langs.append(r["lang"]), words.append(r["word"])
            size += len(r["word"])
        if langs:
            yield langs, words

    blocks = of(frequent.select("lang", "word").toLocalIterator())
    block = next(blocks, None)
    while block:
        after = next(blocks, None)
        table = WordTable(*block, offset)
        shared = spark.sparkContext.broadcast(table)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                langs, words = b.column(0).to_pylist(), b.column(1).to_pylist()
                slots = [shared.value.slots(a, [w.encode()])[0] for a, w in zip(langs, words, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(slots, pa.int64())], [*b.schema.names, "slot"]).filter(pa.array([s >= 0 for s in slots], pa.bool_()))

        mine = frequent.mapInArrow(find, "lang string, word string, f long, slot long")
        slotted = mine if slotted is None else slotted.union(mine)
        level = written(level.mapInArrow(_encoder(shared, after is None), "slots binary" if after is None else "lang string, text string, slots binary"), "phrase-words")
        spent.append(level)
        offset += len(block[0])
        block = after
    return (level if slotted is not None else None), slotted, spent


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, percent: int = 100, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` words.

    n counts all words of the language, a, l and r the occurrences, within pieces, of the phrase, of its first part and
    of the rest, at the cut of the lowest score; score is floor(1000 * a * n / (l * r)) in exact arithmetic. Ties of cuts:
    the shortest first part. A phrase is a candidate with a >= least, and is left out if a longer candidate holds it
    that has percent * a / 100 occurrences or more. Order: score, a, both falling, then the phrase by UTF-8 bytes.

    Null or empty text: no words. Null language: "und". Repeated rows count each time. Empty table, or no frequent
    phrase: no rows. Other columns are ignored. Less than 2^31 words or candidates of one length can be numbered; more
    raise an error. No language's rows meet in one task but for its `top` from each.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counts = texts.mapInArrow(_count_words, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    # The row without a word has the sum of the language.
    counts = written(counts.filter(F.col("word").isNull() | (F.col("f") >= least)), "phrase-counts")
    sums, frequent = counts.filter("word is null").select("lang", F.col("f").alias("n")), counts.filter("word is not null")
    level, words, spent = _word_level(texts, frequent)
    schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if level is None:
        return spark.createDataFrame([], schema)
    words_in_all = sums.agg(F.sum("n")).first()[0]
    phrases = [written(words.select("slot", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("heads"), F.array("f").alias("tails")), "phrase-level")]
    bits = min(MOST_BITS, max(16, words_in_all.bit_length() + 2))
    for size in range(2, longest + 1):
        hot = written(_hot_buckets(level, bits, least), "phrase-buckets")
        candidates = None
        for part in _parts(hot, "bucket"):
            if len(buckets := _collected(part)):
                mine = written(_candidates(level, buckets, bits, least), "phrase-candidates")
                spent.append(mine)
                candidates = mine if candidates is None else candidates.union(mine)
        discard(hot)
        if candidates is None:
            break
        parts, found, offset, above = _parts(candidates, "key"), None, 0, level
        for k, part in enumerate(parts):
            table = PerfectHash(_collected(part))
            if offset + len(table) >= 1 << 31:
                raise ValueError(f"{size}-word candidates can't be numbered: 2^31 or more")
            shared = spark.sparkContext.broadcast(table)
            mine = written(_counted(level, shared, offset, least), "phrase-slots")
            spent.append(mine)
            found = mine if found is None else found.union(mine)
            if size < longest:
                often = np.zeros(len(table), bool)
                often[_collected(mine.select("slot")) - offset] = True
                above = written(_advanced(above, shared, spark.sparkContext.broadcast(often), offset, k == len(parts) - 1), "phrase-arrays")
                spent.append(above)
            offset += len(table)
        level = above
        first, rest = phrases[-1].select([F.col(c).alias(f"x_{c}") for c in phrases[-1].columns]), phrases[-1].select([F.col(c).alias(f"y_{c}") for c in phrases[-1].columns])
        joined = found.join(first, F.col("first") == F.col("x_slot")).join(rest, F.col("rest") == F.col("y_slot"))
        joined = joined.select(
            "slot",
            F.col("x_lang").alias("lang"),
            F.concat_ws(" ", "x_phrase", "y_last").alias("phrase"),
            F.col("y_last").alias("last"),
            F.concat("x_heads", F.array("a")).alias("heads"),
            F.concat("y_tails", F.array("a")).alias("tails"),
            "first",
            "rest",
        )
        phrases.append(written(joined, "phrase-level"))
    out = None
    for k, rows in enumerate(phrases[1:], 2):
        if k < len(phrases):
            # What a phrase of one word more holds and is as frequent as: longer ones are never more frequent than that.
            longer = phrases[k]
            held = longer.select(F.explode(F.array(F.struct(F.col("first").alias("slot"), F.col("heads")[k - 1].alias("f")), F.struct(F.col("rest").alias("slot"), F.col("tails")[k - 1].alias("f")))).alias("h"), F.col("heads")[k].alias("a"))
            held = held.filter(F.col("a") * 100 >= F.col("h.f") * percent).select(F.col("h.slot").alias("slot"))
            rows = rows.join(held, "slot", "left_anti")
        exact = lambda c: c.cast("decimal(19,0)")
        cuts = []
        for j in range(1, k):
            l, r = F.col("heads")[j - 1], F.col("tails")[k - j - 1]  # noqa: E741
            cuts.append(F.struct(F.call_function("div", exact(1000 * F.col("heads")[k - 1]) * exact(F.col("n")), exact(l) * exact(r)).alias("score"), F.lit(j).alias("cut"), l.alias("l"), r.alias("r")))
        rows = rows.join(sums, "lang").select("lang", "phrase", F.col("heads")[k - 1].alias("a"), (F.array_min(F.array(*cuts)) if k > 2 else cuts[0]).alias("best"), "n")
        rows = rows.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
        out = rows if out is None else out.union(rows)
    if out is None:
        return spark.createDataFrame([], schema)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    result = written(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")), "phrase-result")
    for t in (*spent, *phrases, counts):
        discard(t)
    return result
