"""Exact n-gram Jaccard join by partitions of the universe.

A document's set holds its distinct word shingles as 64-bit hashes. Two sets link when their Jaccard similarity is at least
``MIN_PERCENT`` hundredths, so they differ in at most H tokens, where H follows from their sizes. Sizes form bands; the level of a pair
is the band of its larger set, and a set that can be the smaller one of a pair in the next band takes part in that level too. At a
level with largest size U, H = floor((1 - t) / (1 + t) * 2U), and every token is hashed into one of H + 1 segments. By the pigeonhole
principle a linked pair agrees in a whole segment: its subset of the segment is the key of the index.

**Allocation.** A key that many sets share (an empty segment, a passage that fills one) costs a comparison per pair. Such a key is
dropped where every set that has it can pay for it with one-deletion neighbourhoods: with k keys dropped, k of the other segments must
find differences of up to one token, as then all segments together still admit more than H differences. The sets concerned are indexed
under each of their segments with any one token left out. A segment with a neighbour that is itself a dropped key finds equality only
and cannot pay. Keys of which one set cannot pay stay.

**Verification.** Sets under a common key are tied to the smallest one, which gives families without listing pairs. Families that a
shared passage made are first cut by short sketches, which keep every pair within the differences that a link allows, so that only
sets with a likely link send their tokens. Inside a family
and level all pairs are compared: the sets are dealt out to blocks of bounded size, every two blocks meet in one unit of work, and a
unit computes its intersection sizes as a matrix product and returns a spanning forest of its links, not the links. So a group of
thousands of near copies costs comparisons, but neither rows nor memory grow with its square.

Defined cases: with fewer words than a shingle the whole sequence is the one token; null, empty and blank texts have an empty set, link
with nothing and are their own component; equal sets are one class from the start; repeated rows share a class; a null id is never the
smallest unless the class has no other; an empty table gives no rows; long texts are hashed in slices; only id and text are read, so
further columns and clashing names do no harm.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizes import fits
from .common import checkpointed, split_join, table
from .simhash import components

SHINGLE = 3
MIN_PERCENT = 90
#: Largest size of a band, as a multiple of its smallest.
BAND = 1.4
#: A key with more rows than this is dropped where its sets can pay for it.
HOT_KEY = 64
#: Bounds of a block of sets.
BLOCK_SETS = 1024
BLOCK_TOKENS = 1 << 20
#: A sketch takes less than this share of the memory of its tokens.
SKETCH_SHARE = 16
#: Keys or sets (up to 32 bytes each) that are broadcast; beyond it they meet in a shuffle.
MAX_BROADCAST_ROWS = 100_000

_SLICE = 1 << 20
_COLUMNS = 2048
_MAX_CACHE = 1 << 18
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class _Hashes(dict):
    """Hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MAX_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(raw: bytes, known: dict) -> np.ndarray:
    raw, parts, at = raw.lower(), [], 0
    while at < len(raw):
        end = at + _SLICE
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = raw[at:end].split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def token_set(raw: bytes, known: dict, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct tokens of a UTF-8 text."""
    words = word_hashes(raw, known)
    if not len(words):
        return words
    n = min(size, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        total = _mix(total + words[i : len(words) - n + 1 + i] * _U(0x9E3779B97F4A7C15))
    return np.unique(total)


class Levels:
    """Bands of set sizes for a least similarity in hundredths."""

    def __init__(self, percent: int = MIN_PERCENT, band: float = BAND):
        self.percent, self.starts = percent, [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * band) + 1))

    def of(self, n: int) -> tuple[int, bool]:
        """The band of a size, and whether such a set can be the smaller one of a pair of the next band."""
        level = bisect_right(self.starts, n) - 1
        return level, 100 * n >= self.percent * self.starts[level + 1]

    def segments(self, level: int) -> int:
        largest = self.starts[level + 1] - 1
        return (100 - self.percent) * 2 * largest // (100 + self.percent) + 1


def _subsets(tokens: np.ndarray, level: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segment of each token, a weight of each token, and the sum of the weights per segment."""
    segment = (tokens % _U(m)).astype(np.int64)
    weight = _mix(tokens + _U(0x632BE59BD9B4E019))
    sums = np.zeros(m, np.uint64)
    np.add.at(sums, segment, weight)
    return segment, weight, sums


def _keys(sums: np.ndarray, segments: np.ndarray, level: int) -> np.ndarray:
    return _mix(sums + _mix(segments.astype(np.uint64) + _U((level + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))).view(np.int64)


def segment_keys(tokens: np.ndarray, level: int, m: int, filled: bool = False) -> np.ndarray:
    """One key per segment, or only those of segments with tokens where ``filled``."""
    segment, _, sums = _subsets(tokens, level, m)
    keys = _keys(sums, np.arange(m), level)
    return keys[np.bincount(segment, minlength=m) > 0] if filled else keys


def deletion_keys(tokens: np.ndarray, level: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments and keys of all subsets with one token left out."""
    segment, weight, sums = _subsets(tokens, level, m)
    return segment, _keys(sums[segment] - weight, segment, level)


def _prints(levels: Levels, size: int, filled: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            n, sid, level, reach, m, keys = [], [], [], [], [], []
            for x in batch.column(2).cast(pa.binary()):
                tokens = token_set(x.as_py() or b"", known, size)
                own, up = levels.of(len(tokens)) if len(tokens) else (0, False)
                n.append(len(tokens))
                sid.append(xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63))
                level.append(own)
                reach.append(up)
                m.append(levels.segments(own))
                keys.append(np.concatenate([segment_keys(tokens, at, levels.segments(at), filled) for at in ((own, own + 1) if up else (own,))]) if len(tokens) else np.zeros(0, np.int64))
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(level, pa.int32()), pa.array(reach), pa.array(m, pa.int32()),
                 pa.ListArray.from_arrays(offsets, flat)],
                ["doc_id", "th", "n", "sid", "level", "reach", "m", "keys"],
            )

    return run


def set_prints(docs: DataFrame, doc_id: str, text: str, levels: Levels, size: int, filled: bool = False) -> DataFrame:
    """``doc_id, th, n, sid, level, reach, m, keys`` per document: text hash, set size, hash of the set, band, keys of its one or two levels (of segments with tokens only where ``filled``)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))
    return rows.mapInArrow(_prints(levels, size, filled), "doc_id long, th long, n long, sid long, level int, reach boolean, m int, keys array<long>")


def texts_of(docs: DataFrame, members: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The columns of ``members`` (one row per set, with ``th`` and ``least_id`` of one of its documents) and a text of each."""
    few = F.broadcast(members) if fits(members, MAX_BROADCAST_ROWS) else members
    rows = docs.select(F.col(doc_id).cast("long").alias("own_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("own_th"), F.col(text).alias("text"))
    return rows.join(few, (F.col("own_th") == F.col("th")) & F.col("own_id").eqNullSafe(F.col("least_id"))).drop("own_id", "own_th", "th", "least_id")


def allocate(docs: DataFrame, prints: DataFrame, entries: DataFrame, keys: DataFrame, doc_id: str, text: str, levels: Levels, size: int, hot_key: int) -> tuple[DataFrame, DataFrame] | None:
    """Keys to drop, and the entries ``sid, key`` of the one-deletion neighbourhoods that pay for them; None where no key is dropped."""
    hot = checkpointed(keys.filter(F.col("n") > hot_key).select("key", "n"))
    if hot.isEmpty():
        return None
    held = checkpointed(split_join(entries, hot, ["key"]).select("sid", "at", "segments", "key").distinct())
    afford = held.groupBy("sid", "at").agg((2 * F.count(F.lit(1)) <= F.min("segments")).alias("pays"))
    first = checkpointed(held.join(afford, ["sid", "at"]).groupBy("key").agg(F.min("pays").alias("pays"), F.count(F.lit(1)).alias("n")).filter("pays").select("key", "n"))
    if first.isEmpty():
        return None
    payers = held.join(F.broadcast(first.select("key")) if fits(first, MAX_BROADCAST_ROWS) else first.select("key"), "key", "left_semi").select("sid", "at").distinct()
    one = prints.groupBy("sid").agg(F.min(F.struct("th", "doc_id")).alias("d"))
    members = checkpointed(payers.groupBy("sid").agg(F.collect_set("at").alias("at")).join(one, "sid").select("sid", "at", F.col("d.th").alias("th"), F.col("d.doc_id").alias("least_id")))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            for x, sid, ats in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens = token_set(x.as_py() or b"", known, size)
                for at in ats:
                    m = levels.segments(at)
                    segment, near = deletion_keys(tokens, at, m)
                    rows = m + len(near)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(rows, sid)), pa.array(np.full(rows, at, np.int32)), pa.array(np.full(rows, m, np.int32)), pa.array(np.concatenate((np.arange(m), segment)).astype(np.int32)),
                         pa.array(np.arange(rows) < m), pa.array(np.concatenate((segment_keys(tokens, at, m), near)))],
                        ["sid", "at", "segments", "segment", "whole", "key"],
                    )

    around = checkpointed(texts_of(docs, members, doc_id, text).select("text", "sid", "at").mapInArrow(
        neighbours, "sid long, at int, segments int, segment int, whole boolean, key long").distinct())
    touched = around.join(F.broadcast(first.select("key")) if fits(first, MAX_BROADCAST_ROWS) else first.select("key"), "key", "left_semi")
    balance = touched.groupBy("sid", "at").agg(
        F.count_distinct(F.when(F.col("whole"), F.col("segment"))).alias("dropped"), (F.min("segments") - F.count_distinct("segment")).alias("paying")
    )
    kept = touched.filter("whole").join(balance.filter("dropped > paying"), ["sid", "at"], "left_semi").select("key").distinct()
    dropped = checkpointed(first.join(kept, "key", "left_anti").select("key"))
    return None if dropped.isEmpty() else (dropped, around.select("sid", "key"))


def common_keys(entries: DataFrame) -> DataFrame:
    """``key, least, n``: keys that two sets or more have, their smallest set and number of rows."""
    grouped = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("least"), F.max("sid").alias("most"))
    return checkpointed(grouped.filter("least < most").select("key", "least", "n"))


def ties_of(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """``a, b``: sets of a common key, tied to the smallest one."""
    met = entries.join(F.broadcast(keys.drop("n")), "key") if fits(keys, MAX_BROADCAST_ROWS) else split_join(entries, keys, ["key"])
    return met.filter("least < sid").select(F.col("least").alias("a"), F.col("sid").alias("b")).distinct()


def forest(sets: list[np.ndarray], first: np.ndarray, percent: int, within: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``sets``: those marked ``first`` against the others, or all of them where ``within``."""
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = df[column] > 1
    number = np.cumsum(df > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left, right = (np.arange(len(sets)),) * 2 if within else (np.flatnonzero(first), np.flatnonzero(~first))
    common = np.zeros((len(left), len(right)), np.float32)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + _COLUMNS, _COLUMNS))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            block = np.zeros((len(sets), _COLUMNS), np.float32)
            block[row[a:b], column[a:b] % _COLUMNS] = 1
            common += block[left] @ block[right].T
    common = common.astype(np.int64)
    return spanning(100 * common >= percent * (sizes[left][:, None] + sizes[right][None, :] - common), left, right, len(sets))


def sketch(tokens: np.ndarray, level_size: int, percent: int) -> np.ndarray:
    """The set size, then for each of a number of bits whether an odd number of tokens fall on it; ``level_size`` and ``percent`` set the number of bits.

    Two sets differ in at least as many tokens as their sketches differ in bits. The bits are four for each difference that a link
    allows, so sets with twice as many differences are mostly told apart.
    """
    bits = 64 * (1 + 4 * (100 - percent) * 2 * level_size // (100 + percent) // 64)
    odd = np.bincount((_mix(tokens + _U(0x94D049BB133111EB)) % _U(bits)).astype(np.int64), minlength=bits) & 1
    return np.concatenate((np.array([len(tokens)], np.int64), np.packbits(odd.astype(np.uint8)).view(np.int64))).view(np.uint64)


def sketch_forest(sketches: list[np.ndarray], first: np.ndarray, percent: int, within: bool) -> list[tuple[int, int]]:
    """As :func:`forest`, of the pairs that may be linked as far as sketches of one level tell: all that are linked, and some others."""
    sizes = np.array([s[0] for s in sketches], np.int64)
    packed = np.stack([s[1:] for s in sketches]).view(np.uint8)
    left, right = (np.arange(len(sketches)),) * 2 if within else (np.flatnonzero(first), np.flatnonzero(~first))
    differ = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, packed.shape[1], _COLUMNS // 8):
        sign = 1 - 2 * np.unpackbits(packed[:, at : at + _COLUMNS // 8], axis=1).astype(np.float32)
        differ += (sign.shape[1] - sign[left] @ sign[right].T) / 2
    most = (100 - percent) * (sizes[left][:, None] + sizes[right][None, :]) // (100 + percent)
    return spanning(differ <= most, left, right, len(sketches))


def spanning(linked: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the rows ``left`` and the columns ``right`` among ``n`` nodes."""
    whole = np.zeros((n, n), bool)
    whole[np.ix_(left, right)] = linked
    whole |= whole.T
    new, edges = np.ones(n, bool), []
    for start in range(n):
        stack = [start] if new[start] else []
        new[start] = False
        while stack:
            at = stack.pop()
            near = np.flatnonzero(whole[at] & new)
            new[near] = False
            edges += [(at, int(x)) for x in near]
            stack += near.tolist()
    return edges


def _verify(percent: int, tree=forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def links():
            ids = [h[0] for h in held]
            sets = [h[2] for h in held]
            edges = tree(sets, np.array([h[1] == unit[2] for h in held]), percent, unit[2] == unit[3]) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in edges], pa.int64()), pa.array([ids[b] for _, b in edges], pa.int64())], ["a", "b"])

        for batch in batches:
            roots, ats, lows, highs, blocks, sids = (batch.column(i).to_pylist() for i in range(6))
            lists = batch.column(6)
            for i in range(batch.num_rows):
                at = (roots[i], ats[i], lows[i], highs[i])
                if at != unit:
                    if held:
                        yield links()
                    unit, held = at, []
                held.append((sids[i], blocks[i], lists[i].values.to_numpy().view(np.uint64)))
        if held:
            yield links()

    return run


def verified_links(
    docs: DataFrame, prints: DataFrame, families: DataFrame, doc_id: str, text: str, size: int, percent: int, block_sets: int, block_tokens: int, levels: Levels | None = None
) -> DataFrame:
    """Links ``a, b`` between sets of one family that join all linked sets of it; ``families`` has ``sid, root``.

    Where ``levels`` are given, the sets are compared by sketches instead: the links join all linked sets, and some others.
    """
    one = prints.groupBy("sid").agg(F.min(F.struct("th", "doc_id")).alias("d"), F.first("n").alias("n"), F.first("level").alias("level"), F.first("reach").alias("reach"))
    members = checkpointed(families.join(one, "sid").select("sid", "root", "n", "level", "reach", F.col("d.th").alias("th"), F.col("d.doc_id").alias("least_id")))
    at = F.explode(F.when(F.col("reach"), F.array(F.col("level"), F.col("level") + 1)).otherwise(F.array("level"))).alias("at")
    sizes = members.select("root", "n", at).groupBy("root", "at").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("tokens")).filter("sets > 1").select(
        "root", "at", F.greatest(F.ceil(F.col("sets") / block_sets), F.ceil(F.col("tokens") / (block_tokens * (SKETCH_SHARE if levels else 1)))).cast("int").alias("blocks")
    )

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            sets = [token_set(x.as_py() or b"", known, size) for x in batch.column(0).cast(pa.binary())]
            if levels:
                sets = [sketch(s, levels.starts[level + 1] - 1, percent) for s, level in zip(sets, batch.column(3).to_pylist(), strict=True)]
            sets = [s.view(np.int64) for s in sets]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], ["sid", "root", "at", "blocks", "tokens"])

    # a set joins the levels of its family that hold another set as well
    placed = members.select("sid", "root", "th", "least_id", at).join(sizes, ["root", "at"])
    texts = texts_of(docs, placed.select("sid", "root", "at", "blocks", "th", "least_id"), doc_id, text).select("text", "sid", "root", "at", "blocks")
    sets = texts.mapInArrow(tokens, "sid long, root long, at int, blocks int, tokens array<long>").withColumn("block", F.pmod(F.xxhash64("sid"), "blocks").cast("int"))
    units = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "root", "at", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "sid", "tokens"
    )
    unit = ["root", "at", "low", "high"]
    return units.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_verify(percent, sketch_forest if levels else forest), "a long, b long").filter("a <> b").distinct()


def jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = MIN_PERCENT, hot_key: int = HOT_KEY, block_sets: int = BLOCK_SETS, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """``doc_id, n, component_id``: set size, and the smallest id that links lead to."""
    levels = Levels(percent)
    prints = checkpointed(set_prints(docs, doc_id, text, levels, size))
    own = F.col("pos") < F.col("m")
    entries = prints.filter("n > 0").select("sid", "level", "m", F.size("keys").alias("all"), F.posexplode("keys").alias("pos", "key")).select(
        "sid", F.when(own, F.col("level")).otherwise(F.col("level") + 1).alias("at"), F.when(own, F.col("m")).otherwise(F.col("all") - F.col("m")).alias("segments"), "key"
    )
    narrow = entries.select("sid", "key")
    frequent = common_keys(narrow)
    paid = allocate(docs, prints, entries, frequent, doc_id, text, levels, size, hot_key)
    if paid:
        dropped, around = paid
        around = around.join(dropped, "key", "left_anti")
        ties = ties_of(narrow, checkpointed(frequent.join(dropped, "key", "left_anti"))).unionByName(ties_of(around, common_keys(around)))
    else:
        ties = ties_of(narrow, frequent)
    families = components(ties).select(F.col("fp").alias("sid"), "root")
    close = verified_links(docs, prints, families, doc_id, text, size, percent, block_sets, block_tokens, levels)
    families = components(close).select(F.col("fp").alias("sid"), "root")
    links = verified_links(docs, prints, families, doc_id, text, size, percent, block_sets, block_tokens)
    roots = components(links)
    classes = prints.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    rooted = checkpointed(classes.join(roots.withColumnRenamed("fp", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")))
    component = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = split_join(prints.filter("n > 0").select("doc_id", F.col("n").alias("size"), "sid"), rooted.join(component, "root").select("sid", "component_id", "n"), ["sid"])
    alone = prints.filter("n = 0").select("doc_id", F.col("n").alias("size"), "sid", F.col("doc_id").alias("component_id"))
    return found.select("doc_id", "size", "sid", "component_id").unionByName(alone).select("doc_id", F.col("size").alias("n"), "component_id")


def op12_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """All documents."""
    return jaccard_components(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + {SHINGLE - 1}], ' ') AS sh
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {MIN_PERCENT} * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON r.other = w.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least ON least.doc_id = d.doc_id
"""
