"""SimHash near-duplicates through a segment-popcount embedding and a grid range-join.

A 64-bit fingerprint maps to the vector of bit counts of its 32 two-bit segments. The Manhattan distance of two
vectors is at most the Hamming distance of the fingerprints. Over the two halves of the vector a distance of at most 4
leaves at most 2 in one half, and integer vectors that are 2 apart have a grid point within 1 of both: each
fingerprint is placed in the grid cells within `reach` of its half vectors, and fingerprints that meet in a cell are
verified exactly. Likewise a distance of at most 8 leaves at most 2 in one of three parts of the vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampline.llm.common import UPPER, components, cut, release, small_batches, stage

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Fingerprints of a cell compared with each other at once; a larger cell is worked off in blocks of this size.
BLOCK = 2048
#: Pairs of a block after which those of one class by now are left out.
PAIRS = 1 << 12

LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
#: ASCII white space, as bytes.split() takes it: blank and 9 to 13.


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the shingles of size words; 0 without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words)
    if n <= size:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        begins = [0, *(ends[: n - size]).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[b:e], seed) for b, e in zip(begins, (ends[size - 1 :] - 1).tolist())]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        # byte-sliced counting: 255 rows fit into 8 bits
        bits = np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):
            ones += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def add_fingerprints(df: DataFrame, text_col: str = "text", out: str = "fp", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Add a bigint column with each whole text's fingerprint (null: zero). A column named out is replaced; repeated rows
    get equal fingerprints; a text of any length is read whole."""
    small_batches(df.sparkSession)

    @F.pandas_udf("long")
    def printed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, size, seed) for t in texts], np.uint64).view(np.int64))

    return df.withColumn(out, printed(F.col(text_col)))


def embed(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, packed two bits each, of uint64 fingerprints."""
    m = np.uint64(0x5555555555555555)
    return (fps & m) + (fps >> np.uint64(1) & m)


def half_cells(fps: np.ndarray, reach: int, parts: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and cells: for each half vector (or other part) all grid points within `reach` (0 or 1)."""
    packed = embed(fps)
    rows, cells = [], []
    everyone = np.arange(len(fps))
    bounds = [-(-32 * part // parts) for part in range(parts + 1)]  # segments
    for part, (begin, end) in enumerate(zip(bounds, bounds[1:])):
        own = packed >> np.uint64(2 * begin) & np.uint64((1 << 2 * (end - begin)) - 1)
        tag = np.uint64(part << 32)
        rows.append(everyone)
        cells.append(own | tag)
        for s in range(end - begin) if reach else ():
            level = own >> np.uint64(2 * s) & np.uint64(3)
            one = np.uint64(1 << (2 * s))
            for at, moved in ((level < 2, own + one), (level > 0, own - one)):
                rows.append(everyone[at])
                cells.append(moved[at] | tag)
    return np.concatenate(rows), np.concatenate(cells)


def _cell_rows(reach: int, parts: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = pdf["fp"].to_numpy()
            row, cell = half_cells(fps.view(np.uint64), reach, parts)
            yield pd.DataFrame({"cell": cell.view(np.int64), "fp": fps[row]})

    return rows


def cell_links(fps: np.ndarray, distance: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Links that join every pair of the cell's fingerprints within the distance into one class: at most one per fingerprint
    and merge, not all pairs. Compares block by block."""
    n = len(fps)
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left, right = [], []
    u = fps.view(np.uint64)
    for i in range(0, n, block):
        for j in range(i, n, block):
            near = np.bitwise_count(u[i : i + block, None] ^ u[None, j : j + block]) <= distance
            a, b = np.nonzero(np.triu(near, 1) if i == j else near)
            for k in range(0, len(a), PAIRS):
                s, t = a[k : k + PAIRS] + i, b[k : k + PAIRS] + j
                while (root != root[root]).any():
                    root = root[root]
                new = root[s] != root[t]
                for x, y in zip(s[new].tolist(), t[new].tolist()):
                    p, q = find(x), find(y)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        left.append(x)
                        right.append(y)
    return fps[left], fps[right]


def _link_rows(distance: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest_cell, rest = None, np.empty(0, np.int64)
        for pdf in batches:
            cells = np.concatenate([np.full(len(rest), rest_cell if rest_cell is not None else 0, np.int64), pdf["cell"].to_numpy()])
            fps = np.concatenate([rest, pdf["fp"].to_numpy()])
            if not len(cells):
                continue
            starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            # the last cell may go on in the next batch
            rest_cell, rest = cells[starts[-1]], fps[starts[-1] :]
            yield _links(fps[: starts[-1]], np.append(starts[:-1], starts[-1]), distance)
        yield _links(rest, np.array([0, len(rest)]), distance)

    return rows


def _links(fps: np.ndarray, bounds: np.ndarray, distance: int) -> pd.DataFrame:
    """Links within each run of rows between bounds. Rows side by side, two apart and so on are compared by array
    arithmetic up to runs of 8, so all their links are told, 28 at most; longer runs by blocks, a link for each merge."""
    sizes = np.diff(bounds)
    a, b = [], []
    run = np.repeat(np.arange(len(sizes)), sizes)
    short = sizes[run] <= 8
    for step in range(1, 8):
        if len(fps) <= step:
            break
        ok = (run[step:] == run[:-step]) & short[step:]
        x, y = fps[:-step][ok], fps[step:][ok]
        near = np.bitwise_count((x ^ y).view(np.uint64)) <= distance
        a.append(x[near])
        b.append(y[near])
    for k in np.flatnonzero(sizes > 8):
        x, y = cell_links(np.unique(fps[bounds[k] : bounds[k + 1]]), distance)
        a.append(x)
        b.append(y)
    if not a:
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    x, y = np.concatenate(a), np.concatenate(b)
    return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()


def near_links(distinct: DataFrame, col: str = "fp", distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) of distinct fingerprints: enough of those within the distance (at most 8) to join all their classes.

    Fingerprints that repeat in the table are compared like one; nulls must not be there; an empty table has no links.
    """
    if not 0 <= distance <= 8:
        raise ValueError("distance must be 0 to 8")
    small_batches(distinct.sparkSession, rows=1 << 15)
    cells = distinct.select(F.col(col).alias("fp")).mapInPandas(_cell_rows(1 if distance > 1 else 0, 2 if distance <= 5 else 3), "cell long, fp long")
    met = cells.repartition("cell").sortWithinPartitions("cell")
    return met.mapInPandas(_link_rows(distance), "a long, b long").distinct()


def near_rows(df: DataFrame, key_col: str, text_col: str = "text", size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b), a < b, of rows whose fingerprints are equal or within the distance: enough to join all their classes.

    key_col is bigint and unique. Equal fingerprints are one node, named by the least key. Written in the shared folder.
    """
    prints = stage(add_fingerprints(df.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")), "text", "fp", size).select("key", "fp"))
    nodes = stage(prints.groupBy("fp").agg(F.min("key").alias("least")))
    equal = prints.join(nodes, "fp").where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    near = near_links(nodes, "fp", distance)
    named = near.join(nodes.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    links = stage(equal.unionByName(named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))))
    release(prints, nodes)
    return links


def near_duplicates(df: DataFrame, text_col: str = "text", key_col: str = "doc_id", size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(key, fp, component_id) of each row: rows whose fingerprints link, directly or through others, share the least key.

    Texts without words have fingerprint zero and link like any other. Rows with equal fingerprints are one node, so
    copies need no pairs. Null keys get a component but never name one (a component of null keys alone has null).
    An empty table gives an empty result. Only key and text are read.
    """
    prints = cut(add_fingerprints(df.select(F.col(key_col).alias("__key"), F.col(text_col).alias("__text")), "__text", "fp", size).select("__key", "fp"))
    nodes = cut(prints.groupBy("fp").agg(F.min("__key").alias("least")))
    found = components(near_links(nodes, "fp", distance)).withColumnRenamed("node", "fp")
    named = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = cut(named.join(least, "component").select("fp", "component_id"))
    return prints.join(classes, "fp").select(F.col("__key").alias(key_col), "fp", "component_id")
