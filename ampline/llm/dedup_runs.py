"""Exact removal of long repeats by a run-length index.

Every 200-byte window of a text holds an anchor: the least hash among its k-grams. Equal windows have equal anchors at
equal places, so only windows whose anchor occurs elsewhere can repeat. The windows of one anchor form a span of at
most 2 * length - k bytes. An anchor whose spans are all equal is decided by their number. All other spans of repeated
anchors are gathered by anchor, one copy of each kind (two where it occurs more than once), into batches; over a batch's concatenation a Burrows-Wheeler
transform is built and kept as runs with the suffix positions at the run ends. Match lengths with both neighbours in
suffix order stream from those samples: along the text a length falls by one until the next run end. Windows whose match
is at least the wanted length are marked.

A group of more kinds than a batch holds is split: the windows that begin from lo to hi bytes before the anchor have
the bytes from lo before it to length - hi after it in common, so they are dealt anew by that core, which grows with
each split until the groups fit (at the last split the core is the window itself, and its group has one kind).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampline.llm.common import release, small_batches, stage

LENGTH = 200
GRAM = 24
#: Distinct spans of one group that an index takes; larger groups are split by longer cores first.
GROUP = 1024
#: Bytes of spans that one index covers (a group is never cut by it).
BATCH = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Hashes:
    """Hashes of substrings of a byte array in constant time: prefix sums of b[i] * BASE^i modulo 2^64."""

    up = _powers(BASE, 1)
    down = _powers(INVERSE, 1)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Hashes.up) <= n:
            Hashes.up, Hashes.down = _powers(BASE, n + (n >> 1) + 2), _powers(INVERSE, n + (n >> 1) + 2)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * Hashes.up[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * Hashes.down[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - 1
        return _mix((self.sums[k:] - self.sums[: n + 1 - k]) * Hashes.down[: n + 1 - k])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x) - w + 1
    pad = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    pad[: len(x)] = x
    block = pad.reshape(-1, w)
    right = np.minimum.accumulate(block, 1).ravel()
    left = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[w - 1 : w - 1 + n])


#: Bytes hashed at a time: positions take 23 bits of a sort key.
PIECE = 1 << 22


def spans(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, span hash, start and end of each span of the texts data[bounds[i]:bounds[i + 1]] (at most 8 MiB).

    The last column is the text's number. Windows across a border of texts are dropped.
    """
    none = (np.empty(0, np.uint64), np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    if len(data) < length:
        return none
    h = Hashes(data)
    grams = h.grams(gram)
    key = grams & ~np.uint64((1 << 23) - 1) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(key, length - gram + 1) & np.uint64((1 << 23) - 1)).astype(np.int64)
    valid = np.ones(len(anchor), bool)
    for b in bounds[1:-1]:
        valid[max(0, b - length + 1) : b] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return none
    own = anchor[at]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
    start, end = at[new], np.append(at[new[1:] - 1], at[-1]) + length
    # where in the span its anchor lies is part of its identity
    whole = h.at(start, end) ^ (own[new] - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return grams[own[new]], whole, start, end, np.searchsorted(bounds, start, "right") - 1


def text_spans(raw: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Spans of one text of any size, piece by piece; pieces overlap so that no window is lost, and one that both hold
    is told once. A piece's border may cut a span in two, which only makes two spans of it."""
    data = np.frombuffer(raw, np.uint8)
    for i in range(0, max(1, len(data) - length + 1), PIECE):
        part = data[i : i + PIECE + length - 1]
        a, s, b, e, _ = spans(part, np.array([0, len(part)]), length, gram)
        yield a, s, b + i, e + i


PACK = 12  # bits for a span's length


def _anchor_rows(length: int, gram: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def put(rid, a, s, b, e):
            return pd.DataFrame({"anchor": a.view(np.int64), "span": s.view(np.int64), "rid": rid, "place": b << PACK | e - b})

        for pdf in batches:
            held, ids, size = [], [], 0
            for rid, raw in [*zip(pdf["rid"], pdf["raw"]), (None, None)]:
                if held and (raw is None or size + len(raw) > PIECE):
                    bounds = np.concatenate([[0], np.cumsum([len(x) for x in held])])
                    a, s, b, e, t = spans(np.frombuffer(b"".join(held), np.uint8), bounds, length, gram)
                    yield put(np.array(ids, np.int64)[t], a, s, b - bounds[t], e - bounds[t])
                    held, ids, size = [], [], 0
                if raw is None or len(raw) < length:
                    continue
                if len(raw) > PIECE:
                    for a, s, b, e in text_spans(raw, length, gram):
                        yield put(np.full(len(a), rid, np.int64), a, s, b, e)
                    continue
                held.append(raw)
                ids.append(rid)
                size += len(raw)

    return rows


class RunIndex:
    """Run-length Burrows-Wheeler index of a text of integer symbols, with suffix positions at both ends of each run."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        ranks = self._ranks(text)
        order = np.empty(n, np.int64)
        order[ranks[-1]] = np.arange(n)
        bwt = np.where(order == 0, -1, text[order - 1])  # nothing precedes position 0
        head = np.concatenate([[True], bwt[1:] != bwt[:-1]])
        self.heads = np.flatnonzero(head)  # first row of each run
        self.symbols = bwt[self.heads]
        tails = np.append(self.heads[1:], n) - 1
        self.first, self.last = order[self.heads], order[tails]
        self.n = n
        # match lengths at the run ends: with the suffix above a run's head, and with the one below its tail
        self.above = self._common(text, ranks, self.first, order[np.maximum(self.heads - 1, 0)])
        self.above[self.heads == 0] = 0
        self.below = self._common(text, ranks, self.last, order[np.minimum(tails + 1, n - 1)])
        self.below[tails == n - 1] = 0

    @staticmethod
    def _ranks(text: np.ndarray) -> list[np.ndarray]:
        """Ranks of suffixes by their first 7, 14, 28, ... symbols (of 9 bits), until all differ."""
        n = len(text)
        padded = np.concatenate([text.astype(np.int64), np.zeros(7, np.int64)])
        key = np.zeros(n, np.int64)
        for j in range(7):
            key = key << 9 | padded[j : j + n]
        ranks, step = [], 7
        while True:
            order = np.argsort(key)
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
            ranks.append(rank)
            if rank[order[-1]] == n - 1:
                return ranks
            if step >= 2 * n:  # not reached: suffixes differ in length
                raise AssertionError
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1 if step < n else 0
            key = rank * (n + 1) + after
            step *= 2

    @staticmethod
    def _common(text: np.ndarray, ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of common prefixes of suffixes a and b (which differ): by halving steps, then symbol by symbol."""
        n, a, b = len(ranks[0]), a.copy(), b.copy()
        total = np.zeros(len(a), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            step = 7 << level
            inside = (a < n) & (b < n)
            same = inside & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)])
            total[same] += step
            a[same] += step
            b[same] += step
        for _ in range(6):
            same = (a < n) & (b < n) & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])
            total[same] += 1
            a[same] += 1
            b[same] += 1
        return total

    def statistics(self, text: np.ndarray) -> np.ndarray:
        """For each position the longest match with a suffix that starts elsewhere, streamed from the run ends."""
        best = np.zeros(self.n, np.int64)
        place = np.arange(self.n)
        for sampled, length in ((self.first, self.above), (self.last, self.below)):
            until = np.zeros(self.n, np.int64)
            until[sampled] = sampled + length
            best = np.maximum(best, np.maximum.accumulate(until) - place)
        return best


def repeated_windows(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the parts that occur more than once in them: the part's number and the window's start in it."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + 1)
    text = np.zeros(ends[-1], np.int16)
    inner = np.ones(len(text), bool)
    inner[ends - 1] = False  # a border symbol that no part holds
    text[inner] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int16) + 1
    best = RunIndex(text).statistics(text)
    part = np.repeat(np.arange(len(parts)), sizes + 1)
    rest = ends[part] - 1 - np.arange(len(text))
    hit = np.flatnonzero((best >= length) & (rest >= length))
    return part[hit], hit - (ends - sizes - 1)[part[hit]]


def merged(owner: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the windows [start, start + length) of each owner; input sorted by owner and start."""
    if not len(owner):
        return owner, start, start
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + length)])
    at = np.flatnonzero(new)
    return owner[at], start[at], start[np.append(at[1:] - 1, len(start) - 1)] + length


MARKS = "anchor long, kind long, n int, rid long, start long, end long"


def _index_rows(length: int, batch: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, last = 0, None

        def told() -> pd.DataFrame:
            pdf = pd.concat(held, ignore_index=True)
            raws, n = pdf["raw"].tolist(), pdf["n"].to_numpy()
            # kinds that occur more than once stand there twice
            part, at = repeated_windows([*raws, *[raws[i] for i in np.flatnonzero(n > 1)[::-1]]], length)
            own = part < len(raws)
            owner, start, end = merged(part[own], at[own], length)
            base = pdf["start"].to_numpy()[owner]
            return pd.DataFrame({**{c: pdf[c].to_numpy()[owner] for c in ("anchor", "kind", "n", "rid")}, "start": base + start, "end": base + end})

        for pdf in batches:
            sizes = np.cumsum(pdf["raw"].str.len().to_numpy()) if len(pdf) else []
            anchors = pdf["anchor"].to_numpy()
            begin = 0
            for i in np.flatnonzero(np.concatenate([[len(pdf) > 0 and last is not None and anchors[0] != last], anchors[1:] != anchors[:-1]])) if len(pdf) else []:
                if size + (sizes[i - 1] if i else 0) - (sizes[begin - 1] if begin else 0) >= batch:
                    held.append(pdf.iloc[begin:i])
                    yield told()
                    held, size, begin = [], 0, i
            if len(pdf):
                held.append(pdf.iloc[begin:])
                size += sizes[-1] - (sizes[begin - 1] if begin else 0)
                last = anchors[-1]
        if held:
            yield told()

    return rows


PART = "anchor long, kind long, n int, rid long, start long, before int, raw binary"


def _split_rows(length: int, gram: int, width: int, first: bool):
    """Cuts the windows of a part into classes by how many bytes they have before the anchor, `width` of them in each.

    anchor becomes the hash of what all windows of the class share, kind that of the class's bytes in this part. before:
    bytes that the part's first window has before the anchor; in the first split it is looked for.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            sizes = pdf["raw"].str.len().to_numpy()
            begins = np.cumsum(sizes) - sizes
            h = Hashes(np.frombuffer(b"".join(pdf["raw"]), np.uint8))
            if first:
                own = np.repeat(np.arange(len(pdf)), sizes)
                grams = h.grams(gram).view(np.int64)
                hit = np.flatnonzero(grams == pdf["anchor"].to_numpy()[own[: len(grams)]])
                part, at = np.unique(own[hit], return_index=True)
                before = np.zeros(len(pdf), np.int64)
                before[part] = hit[at] - begins[part]  # the first place: an anchor is the leftmost of equal ones
            else:
                before = pdf["before"].to_numpy().astype(np.int64)
            least = before - (sizes - length)
            low, high = least // width, before // width
            row = np.repeat(np.arange(len(pdf)), high - low + 1)
            number = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
            most, fewest = np.minimum(before[row], (number + 1) * width - 1), np.maximum(least[row], number * width)
            start, end = before[row] - most, before[row] - fewest + length  # of the class, in the part
            core, stop = before[row] - number * width, before[row] - (number + 1) * width + 1 + length
            tag = number.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            place = begins[row]
            key, kind = h.at(place + core, place + stop) ^ tag, h.at(place + start, place + end) ^ most.view(np.uint64) * BASE
            raws = pdf["raw"].tolist()
            yield pd.DataFrame({
                "anchor": key.view(np.int64), "kind": kind.view(np.int64), "n": pdf["n"].to_numpy()[row], "rid": pdf["rid"].to_numpy()[row],
                "start": pdf["start"].to_numpy()[row] + start, "before": most.astype(np.int32), "raw": [raws[r][b:e] for r, b, e in zip(row.tolist(), start.tolist(), end.tolist())],
            })

    return rows


def long_repeats(df: DataFrame, text_col: str = "text", key_col: str = "doc_id", length: int = LENGTH, gram: int = GRAM, group: int = GROUP, batch: int = BATCH) -> DataFrame:
    """Byte ranges of each text that are covered by strings of length bytes which also start elsewhere in the table.

    Returns rid (a hash of key and text), start, end; ranges of a row may overlap. Null and short texts have none. Rows
    that repeat key and text are copies of each other and share their ranges. No task gets more than `group` kinds of
    one anchor: larger groups are split by longer and longer common cores, each split making at most four rows of a
    kind, and every group that comes of it goes through the index.
    """
    if not gram <= length < 1 << (PACK - 1):
        raise ValueError("length must be at least gram and under 2,048")
    small_batches(df.sparkSession)
    docs = keyed_bytes(df, text_col, key_col)
    start, size = F.shiftright("place", PACK), F.col("place").bitwiseAND((1 << PACK) - 1)
    whole = ["rid", start.alias("start"), (start + size).alias("end")]
    anchors = stage(docs.mapInPandas(_anchor_rows(length, gram), "anchor long, span long, rid long, place long"))
    # written before it is joined, so that the join sees both its sides' sizes and can split a frequent anchor
    shared = stage(anchors.groupBy("anchor").agg(F.count("*").alias("c"), (F.min("span") != F.max("span")).alias("mixed")).where("c > 1").drop("c"))
    again = stage(anchors.join(shared, "anchor"))
    release(anchors, shared)
    mixed = again.where("mixed").drop("mixed")
    kinds = stage(mixed.groupBy("anchor", F.col("span").alias("kind")).agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("n"), F.min(F.struct("rid", "place")).alias("one")))
    sizes = stage(kinds.groupBy("anchor").agg(F.count("*").alias("m")))
    ones = kinds.join(sizes, "anchor").select("anchor", "kind", "n", "m", "one.rid", "one.place")
    parts = stage(ones.join(docs, "rid").select("anchor", "kind", "n", "m", "rid", start.alias("start"), F.lit(0).alias("before"), F.substring("raw", start.cast("int") + 1, size.cast("int")).alias("raw")))
    release(sizes)

    def indexed(parts: DataFrame) -> DataFrame:
        return stage(parts.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(_index_rows(length, batch), MARKS))

    found = indexed(parts.where(F.col("m") <= group).select("anchor", "kind", "n", "rid", "start", "raw"))
    # what occurs more than once repeats in all its places: as the index says, or by its number in groups that are split
    repeated = found.where("n > 1").unionByName(parts.where((F.col("m") > group) & (F.col("n") > 1)).select("anchor", "kind", "n", "rid", "start", F.lit(0).alias("end")))
    copied = stage(mixed.withColumnRenamed("span", "kind").join(stage(repeated.select("anchor", "kind").distinct()), ["anchor", "kind"]).select(*whole))
    marks = [again.where("not mixed").select(*whole), copied, found.where("n = 1").select("rid", "start", "end")]
    hot, first = stage(parts.where(F.col("m") > group).select("anchor", "kind", "n", "rid", "start", "before", "raw")), True
    release(kinds, parts)
    for width in _widths(length - gram + 1):
        if not hot.limit(1).count():
            break
        rows = stage(hot.mapInPandas(_split_rows(length, gram, width, first), PART))
        release(hot)
        kinds = stage(rows.groupBy("anchor", "kind").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n"), F.min(F.struct("rid", "start", "before", "raw")).alias("one")))
        sizes = stage(kinds.groupBy("anchor").agg(F.count("*").alias("m")))
        sized = kinds.join(sizes, "anchor").select("anchor", "kind", "n", "m", "one.*")
        found = indexed(sized.where((F.col("m") > 1) & (F.col("m") <= group)).select("anchor", "kind", "n", "rid", "start", "raw"))
        twice = rows.join(kinds.where("n > 1").select("anchor", "kind"), ["anchor", "kind"]).select("rid", "start", (F.col("start") + F.octet_length("raw")).alias("end"))
        marks += [stage(twice), found.where("n = 1").select("rid", "start", "end")]
        hot, first = stage(sized.where(F.col("m") > group).drop("m")), False
        release(rows, kinds, sizes)
    out = marks[0]
    for m in marks[1:]:
        out = out.unionByName(m)
    return out


def _widths(places: int) -> list[int]:
    """How many places a class of windows has in each split: falling powers of 4, down to 1."""
    out = [1]
    while out[-1] * 4 < places:
        out.append(out[-1] * 4)
    return out[::-1]


def keyed_bytes(df: DataFrame, text_col: str, key_col: str) -> DataFrame:
    """rid and raw: a hash that names the row, and the text's UTF-8 bytes (null: none)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.xxhash64(F.col(key_col), F.col(text_col)).alias("rid"), text.cast("binary").alias("raw"))


def union(ranges: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for b, e in sorted(ranges):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


REMOVED_TYPE = "n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def remove_long_repeats(df: DataFrame, text_col: str = "text", key_col: str = "doc_id", length: int = LENGTH, keep_bytes: bool = True, **options) -> DataFrame:
    """Add n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256 to each row; columns so named are replaced.

    Empty tables give empty results; a null text has no bytes. keep_bytes=False leaves kept null, to save room.
    """
    marks = long_repeats(df, text_col, key_col, length, **options)
    per_row = stage(marks.groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("__ranges"))).withColumnRenamed("rid", "__rid")

    @F.pandas_udf(REMOVED_TYPE)
    def kept(raws: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, found in zip(raws, ranges):
            raw = bytes(raw)
            gone = union([(r["start"], r["end"]) for r in found]) if found is not None else []
            left = b"".join(raw[b:e] for b, e in zip([0, *(e for _, e in gone)], [*(b for b, _ in gone), len(raw)]))
            rows.append((len(raw), len(raw) - len(left), len(gone), left if keep_bytes else None, hashlib.sha256(left).hexdigest()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    names = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    own = df.withColumn("__rid", F.xxhash64(F.col(key_col), F.col(text_col)))
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return own.join(per_row, "__rid", "left").withColumn("__kept", kept(raw, F.col("__ranges"))).withColumns({n: F.col("__kept")[n] for n in names}).drop("__rid", "__ranges", "__kept")
