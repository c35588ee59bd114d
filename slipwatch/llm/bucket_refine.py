"""Repeated byte strings removed by bucket-pointer refinement of sampled suffixes.

Every 100-byte string is filed under the q-gram in it whose hash is smallest (leftmost of
ties), so equal strings are filed alike and one row stands for a run of neighbouring strings,
some 35 of them. The initial buckets are those q-grams, the suffixes at them are sorted by
bucket, and each round refines by what lies at other offsets:

1. In a sorted bucket, rows of one whole span (the run's bytes) are equal in all their
   strings: the first stays, the others are repeats. A bucket of one span needs no more.
2. Buckets of several spans are compared string by string in blocks of whole buckets.
3. A bucket of more than `limit` spans is refined first: strings with the q-gram in their left
   half share 66 bytes with it, those with it in their right half 66 others, so each half gets
   a bucket of its own, named by the old bucket and the new bytes; and so on, recursively, to
   100 bytes. Cut to a half, many rows are equal: as in step 1 the first goes on and the others
   are repeats. At the last depth a bucket holds equal strings only, so one row is left of it.

Nothing is collected, one bucket never fills a task, and a text is read three times.

Defined results. A null text is empty. Documents without an id come after all others; rows of
one id are ordered by a hash of the text; of rows equal in id and text the first by that order
is treated as stated and every other one as a copy, in which each 100-byte string starts
earlier. Texts of fewer than 100 bytes keep all. Other columns are not read, an empty table
gives no rows. Two different spans around the same q-gram are taken for equal if two 64-bit
hashes of them agree; strings are otherwise compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slipwatch.llm.common import saved

LENGTH, GRAM = 100, 32
LIMIT = 2000  # spans of a bucket that are compared in one task
BLOCK, LONGEST = 1 << 19, 1 << 12
ROWS = 1 << 16  # rows a task gives out at once
KEY = ["late", "id", "fp"]
MARKS = "late boolean, id long, fp long, start long, n int"

_rng = np.random.default_rng(100)
_BYTE = _rng.integers(1, 2**63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64(2 * BLOCK - 1)
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xCA5A826395121157)


def _scales() -> list[np.ndarray]:
    """Powers of the base and of its inverse for one block: a fixed size, whatever the texts."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(BLOCK + LONGEST, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps))
    return _powers


def _prefix(raw: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _scales()[0][: len(raw)])))


def _hashes(sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """Hashes of the bytes between places of a block."""
    down = _scales()[1]
    return _mix((sums[end] - sums[start]) * (down[start] if isinstance(start, np.ndarray) else down[: len(sums)][start]))


def runs(raw: np.ndarray, barred: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(start, strings, place of the q-gram, its hash, hash of the whole span) of the runs of one block.

    `barred` marks string starts that are left out.
    """
    sums = _prefix(raw)
    grams = len(raw) - gram + 1
    hashes = _hashes(sums, slice(0, grams), slice(gram, gram + grams))
    least = (hashes & ~_PLACE) | np.arange(grams, dtype=np.uint64)
    width, reach = length - gram + 1, 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    starts = np.flatnonzero(~barred[: len(least)])
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    place = (least[starts] & _PLACE).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    start, place = starts[head], place[head]
    n = np.diff(np.append(head, len(starts)))
    whole = _hashes(sums, start, start + n + length - 1) + ((n << 8) + (place - start)).astype(np.uint64) * np.uint64(_BASE)
    return start, n, place, hashes[place], _mix(whole)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and where each value starts (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and at[-1] > at[0] else np.zeros(int(at[-1]), np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _keyed(docs: DataFrame) -> DataFrame:
    """late (no id), id, fp and text as bytes: the order of documents and their join key."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").isNull().alias("late"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(text).alias("fp"),
        text.alias("text"),
    )


def _packed(start: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (start << 14) | (n << 7) | place


def _first_of_batch(h: np.ndarray, g: np.ndarray, keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows repeat a span that is earlier in the same batch."""
    gone = np.zeros(len(h), bool)
    code = h ^ (g << np.uint64(1))
    order = np.argsort(code, kind="stable")
    equal = code[order[1:]] == code[order[:-1]]
    some = order[np.concatenate((equal, [False])) | np.concatenate(([False], equal))]
    if len(some):
        some = some[np.lexsort((at[some], *(k[doc[some]] for k in reversed(keys)), g[some], h[some]))]
        a, b = some[1:], some[:-1]
        once = at[a] == at[b]  # one place given twice: rows equal in id and text
        for k in keys:
            once &= k[doc[a]] == k[doc[b]]
        gone[a[(h[a] == h[b]) & (g[a] == g[b]) & ~once]] = True
    return gone


def suffixes(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, g, late, id, fp, at, gone): a row for each run of strings filed under one q-gram.

    `gone` marks a span that is earlier in the same batch already, so that of a span that is
    everywhere one row a batch is compared with others.
    """

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts = _bytes(batch.column("text"))
            found = []
            for at in range(0, max(0, len(raw) - length + 1), BLOCK):
                block = raw[at : at + BLOCK + length - 1]
                first, last = np.searchsorted(starts, [at, at + len(block)], "left")
                ends = starts[first : last + 1] - at
                ends = ends[(ends > 0) & (ends < len(block) + length)]
                steps = np.zeros(len(block) + 1, np.int32)
                np.add.at(steps, np.clip(ends - length + 1, 0, len(block)), 1)
                np.add.at(steps, np.clip(ends, 0, len(block)), -1)
                start, n, place, h, g = runs(block, np.cumsum(steps[:-1]) > 0, length, gram)
                doc = np.searchsorted(starts, start + at, "right") - 1
                found.append((h, g, doc, _packed(start + at - starts[doc], n, place - start)))
            if not found:
                continue
            h, g, doc, places = (np.concatenate(x) for x in zip(*found, strict=True))
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in KEY]
            gone = _first_of_batch(h, g, keys, doc, places)
            for k in range(0, len(h), ROWS):
                part = slice(k, k + ROWS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[part].view(np.int64)), pa.array(g[part].view(np.int64))]
                    + [pa.array(x[doc[part]]) for x in keys]
                    + [pa.array(places[part]), pa.array(gone[part])],
                    ["h", "g", *KEY, "at", "gone"],
                )

    return keyed.mapInArrow(file, "h long, g long, late boolean, id long, fp long, at long, gone boolean")


def _sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket, span and place: repeats of a span, and the first of each span in buckets of several.

    Holds one row of what went before: the first of the last span, and whether it was given out.
    """
    before, told = None, False
    for batch in batches:
        done = batch.column("gone")
        if done.true_count:
            yield batch.filter(done).select(["h", *KEY, "at", "gone"])
            batch = batch.filter(pc.invert(done))
        if not batch.num_rows:
            continue
        if before is not None:
            batch = pa.Table.from_batches([before, batch]).combine_chunks().to_batches()[0]
        h, g, at = (batch.column(c).to_numpy() for c in ("h", "g", "at"))
        new_h = np.concatenate(([True], h[1:] != h[:-1]))
        new_g = new_h | np.concatenate(([True], g[1:] != g[:-1]))
        # One place given twice: rows equal in id and text.
        same = ~new_g & np.concatenate(([False], at[1:] == at[:-1]))
        for c in KEY:
            x = batch.column(c).to_numpy(zero_copy_only=False)
            same &= np.concatenate(([False], x[1:] == x[:-1]))
        firsts = np.flatnonzero(new_g)
        shares = ~new_h[firsts]  # not the first span of its bucket
        shares[:-1] |= ~new_h[firsts[1:]]
        if before is not None:
            kept = firsts[shares & ((firsts > 0) | (not told))]
        else:
            kept = firsts[shares]
        gone = np.flatnonzero(~new_g & ~same)
        rows = np.concatenate((kept, gone))
        if len(rows):
            out = batch.select(["h", *KEY, "at"]).take(pa.array(rows))
            yield out.append_column("gone", pa.array(np.arange(len(rows)) >= len(kept)))
        told = bool(shares[-1]) or (before is not None and firsts[-1] == 0 and told)
        before = batch.slice(int(firsts[-1]), 1)


def sorted_out(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, late, id, fp, start, n, s, gone) of the rows whose bucket has more than one place."""
    # Rows that are decided already go to any task.
    deal = F.when(F.col("gone"), F.xxhash64("fp", "at")).otherwise(F.col("h"))
    rows = suffixes(keyed, length, gram).repartition(deal).sortWithinPartitions("h", "g", *KEY, "at")
    found = rows.mapInArrow(_sort_out, "h long, late boolean, id long, fp long, at long, gone boolean")
    return found.select(
        "h", *KEY, F.shiftright("at", 14).alias("start"),
        F.shiftright("at", 7).bitwiseAND(127).cast("int").alias("n"), F.col("at").bitwiseAND(127).cast("int").alias("s"), "gone",
    )


def spans(keyed: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """`places` (h, KEY, start, n, s) with the bytes of their strings."""
    by_text = places.groupBy(*KEY).agg(F.collect_list(F.struct("h", "start", "n", "s")).alias("_x"))
    return (
        keyed.join(by_text, KEY)
        .dropDuplicates(KEY)  # copies of one row give their places once
        .select(*KEY, "text", F.explode("_x").alias("x"))
        .select(
            F.col("x.h").alias("key"), *KEY, "x.start", "x.n", "x.s",
            F.substring("text", F.col("x.start").cast("int") + 1, F.col("x.n") + (length - 1)).alias("bytes"),
        )
    )


def _repeats(table: pa.Table, length: int) -> pa.RecordBatch | None:
    """Of whole buckets (key, KEY, start, n, s, bytes): runs of strings that occur earlier in their bucket."""
    raw, starts = _bytes(table.column("bytes"))
    n = table.column("n").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = starts[row] + nth
    parts = [table.column(c).to_numpy(zero_copy_only=False) for c in (*KEY, "start", "key", "s")]
    late, ids, fp, start, key, s = (p[row] for p in parts)
    place, offset = start + nth, s - nth
    code = np.zeros(len(row), np.uint64)
    for base in range(0, len(raw), BLOCK):  # string hashes block by block
        own = np.flatnonzero((at >= base) & (at < base + BLOCK))
        if len(own):
            sums = _prefix(raw[base : base + BLOCK + length])
            code[own] = _hashes(sums, at[own] - base, at[own] - base + length)
    code = _mix(code + key.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + offset.astype(np.uint64) * np.uint64(_BASE))
    order = np.lexsort((place, fp, ids, late, code))
    equal = np.concatenate(([False], code[order[1:]] == code[order[:-1]]))
    pairs = np.flatnonzero(equal)
    steps = np.arange(length)
    for k in range(0, len(pairs), 1 << 15):  # byte by byte
        a, b = order[pairs[k : k + (1 << 15)]], order[pairs[k : k + (1 << 15)] - 1]
        alike = (raw[at[a][:, None] + steps] == raw[at[b][:, None] + steps]).all(1) & (key[a] == key[b]) & (offset[a] == offset[b])
        if not alike.all():
            raise ArithmeticError("two strings of one hash differ")
    gone = np.sort(order[equal])
    if not len(gone):
        return None
    head = np.flatnonzero(np.concatenate(([True], (gone[1:] != gone[:-1] + 1) | (row[gone[1:]] != row[gone[:-1]]))))
    size = np.diff(np.append(head, len(gone)))
    first = gone[head]
    return pa.RecordBatch.from_arrays(
        [pa.array(late[first]), pa.array(ids[first]), pa.array(fp[first]), pa.array(place[first]), pa.array(size.astype(np.int32))],
        [*KEY, "start", "n"],
    )


def compared(rows: DataFrame, length: int) -> DataFrame:
    """Marks of the repeats in buckets that fit a task, many buckets at a time."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = held.column("key").to_numpy()
            whole = int(np.append(-1, np.flatnonzero(key != key[-1]))[-1]) + 1  # the last bucket may go on
            if whole:
                found = _repeats(held.slice(0, whole).combine_chunks(), length)
                if found is not None:
                    yield found
                held = held.slice(whole)
        if held is not None:
            found = _repeats(held.combine_chunks(), length)
            if found is not None:
                yield found

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(meet, MARKS)


def refine(rows: DataFrame, length: int) -> DataFrame:
    """Rows of buckets lo <= s < hi dealt to the two halves; the new bucket is the old one and the bytes all its strings share."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.col("lo").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("hi").alias("b"))))
    top = F.least(F.col("s"), F.col("b") - 1)
    low = F.greatest(F.col("s") - F.col("n") + 1, F.col("a"))
    cut = rows.withColumn("_h", halves).select("*", "_h.a", "_h.b").withColumn("top", top).withColumn("low", low).filter("low <= top")
    skip = F.col("s") - F.col("top")
    count = F.col("top") - F.col("low") + 1
    own = F.substring("bytes", skip + 1, count + (length - 1))
    shared = F.substring("bytes", F.col("s") - F.col("a") + 1, F.lit(length + 1) - (F.col("b") - F.col("a")))
    return cut.select(
        F.xxhash64("key", "a", "b", shared).alias("key"), *KEY, (F.col("start") + skip).alias("start"), count.cast("int").alias("n"),
        F.col("top").alias("s"), own.alias("bytes"), F.col("a").alias("lo"), F.col("b").alias("hi"),
    )


ROW = ["key", "n", "s", "bytes"]  # rows that agree in these hold the same strings of a bucket


def firsts(rows: DataFrame) -> DataFrame:
    """Of equal rows of a bucket the first, found by a grouped minimum."""
    ends = [F.min("lo").alias("lo"), F.min("hi").alias("hi")]  # one bucket has one pair
    found = rows.groupBy(*ROW).agg(F.min(F.struct(*KEY, "start")).alias("_first"), *ends)
    return found.select("key", *[F.col(f"_first.{c}") for c in (*KEY, "start")], "n", "s", "bytes", "lo", "hi")


def equals(rows: DataFrame, first: DataFrame) -> DataFrame:
    """Marks of the rows that are not the first of their equals."""
    first = first.select(*ROW, F.struct(*KEY, "start").alias("_first"))
    return rows.join(first, ROW).filter(F.struct(*KEY, "start") > F.col("_first")).select(*KEY, "start", "n")


def solved(rows: DataFrame, length: int, gram: int, limit: int) -> DataFrame:
    """Marks of all repeats among `rows` of `spans`; large buckets are refined until they fit or hold equal strings."""
    todo = rows.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(length - gram + 1))
    marks = []
    todo = saved(todo, "buckets")
    while True:
        large = saved(todo.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select("key"), "large")
        if large.isEmpty():
            marks.append(saved(compared(todo, length), "marks"))
            break
        marks.append(saved(compared(todo.join(large, "key", "left_anti"), length), "marks"))
        halves = saved(refine(todo.join(large, "key", "left_semi").filter("hi - lo > 1"), length), "halves")
        todo = saved(firsts(halves), "buckets")
        marks.append(saved(equals(halves, todo), "marks"))
    out = marks[0]
    for m in marks[1:]:
        out = out.unionByName(m)
    return out


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Texts without the marked strings, and the spans that went."""
    for batch in batches:
        raw, at = _bytes(batch.column("text"))
        marks = batch.column("marks")
        marks = marks.combine_chunks() if isinstance(marks, pa.ChunkedArray) else marks
        sizes = np.diff(marks.offsets.to_numpy())
        flat = marks.flatten()
        begin = flat.field("start").to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int64)
        size = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else begin
        stop = begin + size + length - 1
        edge = np.cumsum(sizes) - sizes
        copy = batch.column("copy").to_numpy(zero_copy_only=False)
        kept, found = [], []
        for i in range(batch.num_rows):
            text = raw[at[i] : at[i + 1]]
            a, b = begin[edge[i] : edge[i] + sizes[i]], stop[edge[i] : edge[i] + sizes[i]]
            if copy[i] and len(text) >= length:
                a, b = np.zeros(1, np.int64), np.array([len(text)])
            if not len(a):
                kept.append(text.tobytes())
                found.append([])
                continue
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.concatenate(([True], a[1:] > b[:-1]))
            a, b = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
            stay = np.concatenate(([0], b)), np.concatenate((a, [len(text)]))
            kept.append(b"".join(text[x:y].tobytes() for x, y in zip(*stay, strict=True)))
            found.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(kept, pa.binary()), pa.array(found, span)], ["doc_id", "n_bytes", "kept", "spans"]
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, kept binary, spans): every row of `docs` (needs doc_id, text) without repeated strings.

    `spans` are the maximal removed runs of bytes, start and end (exclusive). Steps are written
    by `saved`; built inside `finished` they are removed with the result's last use.
    """
    if not 0 < gram <= length < LONGEST or length - gram >= 127:
        raise ValueError("a string holds 1 to 127 places of a q-gram")
    keyed = _keyed(docs)
    found = saved(sorted_out(keyed, length, gram), "suffixes")
    open_rows = spans(keyed, found.filter("not gone").select("h", *KEY, "start", "n", "s"), length)
    marks = found.filter("gone").select(*KEY, "start", "n").unionByName(solved(open_rows, length, gram, limit))
    by_text = marks.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    copies = Window.partitionBy(*KEY).orderBy(*KEY)
    joined = keyed.join(by_text, KEY, "left").withColumn("copy", F.row_number().over(copies) > 1)
    ready = joined.select(
        F.when(~F.col("late"), F.col("id")).alias("doc_id"), "text", "copy", F.coalesce("marks", F.array().cast("array<struct<start:bigint,n:int>>")).alias("marks")
    )
    return ready.mapInArrow(lambda b: _cut(b, length), "doc_id long, n_bytes long, kept binary, spans array<struct<start:bigint,end:bigint>>")
