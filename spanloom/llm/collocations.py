"""Phrase collocations by weighted acyclic automata.

Words stand in pieces between stop signs. Each task counts the n-grams of a shard of its texts, sorts them and builds count transducers
(:mod:`.automata`), one per language and range of the sorted n-grams. The transducers of a range meet in one task, which unites them and
sums their weights. Counts under ``MIN_COUNT`` then go: a part of a phrase is at least as frequent as the phrase, so every part of a
candidate stays. The parts that the cuts of candidates ask for are sent to their ranges, made an automaton too, and composed with the
counts. Scores are integer divisions of decimals.

Ranges are cut at n-grams of a sample (``SAMPLE_BYTES`` of text); the sample sets how even the ranges are, never what they hold. As a
range can begin within the phrases of one word, a word that stands in a third of all phrases is spread over many ranges. A part that
many candidates ask for (a thousandth of all requests) is answered by a broadcast row.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count again; ties are ranked by count, then
by the bytes of the phrase; an empty table gives no rows; long texts are read in slices; only language and text are read, so further
columns and clashing names do no harm.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automata import DEPTH, CountAutomaton
from .common import checkpointed, split_join, table

MIN_COUNT = 10
#: A phrase goes where a longer one that holds it is at least this frequent, in hundredths.
ABSORB_PERCENT = 50
TOP = 2000
SCALE = 1_000_000
UNKNOWN = "und"
#: Text of one range of n-grams, of the sample that cuts the ranges, and words of one shard.
RANGE_BYTES = 8 << 20
SAMPLE_BYTES = 8 << 20
SHARD_WORDS = 2 << 20
MAX_SAMPLE_ROWS = 200_000
SALTS = 32

_BITS = 21
_STRIDE = 16
_SLICE = 1 << 20
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 9 + b" ")
_TEXTS = "lang string, text string"


class _Numbers(dict):
    """Words by order of appearance; 0 is no word, 1 the end of a piece."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def word_slices(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, slice by slice; a line feed ends a piece, empty words count for nothing."""
    raw, at = raw.translate(_TABLE).replace(b"\n", b" \n "), 0
    while at < len(raw):
        end = raw.find(b" ", at + _SLICE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split(b" ")
        at = end
    yield [b"\n"]


def sorted_grams(ids: np.ndarray, rank: np.ndarray, context: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams within pieces as packed numbers, in order, and their counts; those that end within the first ``context`` words are left out. ``rank`` is 0 for the end of a piece."""
    r = rank[ids]
    keys, counts = [], []
    for n in range(1, DEPTH + 1):
        inside, packed = np.ones(max(0, len(r) - n + 1), bool), np.zeros(max(0, len(r) - n + 1), np.int64)
        for i in range(n):
            part = r[i : len(r) - n + 1 + i]
            inside &= part > 0
            packed |= part << (_BITS * (DEPTH - 1 - i))
        inside[: max(0, context - n + 1)] = False
        k, c = np.unique(packed[inside], return_counts=True)
        keys.append(k)
        counts.append(c)
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    return keys[order], counts[order]


def _place(words: list[bytes], bound: tuple[bytes, ...]) -> int:
    """The least packed n-gram over ``words`` that is not before ``bound``."""
    key = 0
    for i in range(DEPTH):
        shift = _BITS * (DEPTH - 1 - i)
        if i >= len(bound):
            break
        at = bisect_left(words, bound[i])
        key |= (at + 1) << shift
        if at == len(words) or words[at] != bound[i]:
            break
    return key


def _shards(bounds: list[tuple[bytes, tuple[bytes, ...]]], shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, size, context = _Numbers(), {}, 0, {}

        def flush():
            plain = list(numbers)
            order = sorted(range(2, len(plain)), key=plain.__getitem__)
            words = [plain[i] for i in order]
            rank = np.zeros(len(plain), np.int64)
            rank[order] = np.arange(1, len(order) + 1)
            out = []
            for lang, parts in held.items():
                keys, counts = sorted_grams(np.concatenate(parts), rank, context.get(lang, 0))
                first, last = bisect_left(bounds, (lang, ())), bisect_left(bounds, (lang + b"\0", ()))
                cuts = [0, *np.searchsorted(keys, [_place(words, b) for _, b in bounds[first:last]]).tolist(), len(keys)]
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if a < b:
                        grams = np.stack([(keys[a:b] >> (_BITS * (DEPTH - 1 - d)) & ((1 << _BITS) - 1)) - 1 for d in range(DEPTH)], axis=1)
                        out.append((first + i, lang, CountAutomaton.of(words, grams, counts[a:b]).to_bytes()))
            for i in range(0, len(out), 64):
                rows = out[i : i + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1].decode() for x in rows]), pa.array([x[2] for x in rows], pa.binary())], ["range", "lang", "counts"]
                )

        for batch in batches:
            for lang, x in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                for words in word_slices(x.as_py() or b""):
                    ids = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                    ids = ids[ids > 0]
                    held.setdefault(lang.encode(), []).append(ids)
                    size += len(ids)
                    if size >= shard_words or len(numbers) >= (1 << _BITS) - _SLICE:
                        # the last words before the cut begin n-grams that reach into the next slice of the text
                        plain = list(numbers)
                        tail = [plain[i] for i in np.concatenate(held[lang.encode()])[-(DEPTH - 1):].tolist()]
                        yield from flush()
                        numbers, size, context = _Numbers(), 0, {lang.encode(): len(tail)}
                        held = {lang.encode(): [np.array([numbers[w] for w in tail], np.int32)]}
        if size:
            yield from flush()

    return run


def cut_ranges(texts: DataFrame, range_bytes: int = RANGE_BYTES) -> list[tuple[bytes, tuple[bytes, ...]]]:
    """Sorted n-grams, each with its language, at which ranges of about ``range_bytes`` of text begin."""
    total = texts.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    ranges = max(total // range_bytes, 2 * texts.sparkSession.sparkContext.defaultParallelism)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, x in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = [w for part in word_slices(x.as_py() or b"") for w in part if w]
                rows = [b" ".join(words[a : a + DEPTH]).split(b" \n")[0] for a in range(0, len(words), _STRIDE) if words[a] != b"\n"]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array([r.decode() for r in rows], pa.string())], ["lang", "gram"])

    sample = texts.sample(min(1.0, SAMPLE_BYTES / max(total, 1)), 7).mapInArrow(pick, "lang string, gram string").distinct().limit(MAX_SAMPLE_ROWS).collect()
    grams = sorted((r["lang"].encode(), tuple(r["gram"].encode().split(b" "))) for r in sample)
    return sorted({grams[i * len(grams) // ranges] for i in range(1, ranges)}) if grams else []


def count_automata(texts: DataFrame, bounds: list, least: int = MIN_COUNT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``range, lang, total, counts``: the united automaton of each range, with weights of at least ``least``, and its number of words."""
    parts = texts.mapInArrow(_shards(bounds, shard_words), "range int, lang string, counts binary")

    def unite(table: pa.Table) -> pa.Table:
        own, rows = table.column("lang").to_pylist(), []
        for lang in sorted(set(own)):
            found = [CountAutomaton.from_bytes(x.as_py()) for x, k in zip(table.column("counts"), own, strict=True) if k == lang]
            united, total = CountAutomaton.union(found, least)
            rows.append((table.column("range")[0].as_py(), lang, total, united.to_bytes()))
        return pa.table({"range": pa.array([r[0] for r in rows], pa.int32()), "lang": pa.array([r[1] for r in rows]), "total": pa.array([r[2] for r in rows], pa.int64()), "counts": pa.array([r[3] for r in rows], pa.binary())})

    return parts.groupBy("range").applyInArrow(unite, "range int, lang string, total long, counts binary")


def phrases_of(counts: DataFrame) -> DataFrame:
    """``lang, phrase, words, a``: what the automata accept."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                automaton = CountAutomaton.from_bytes(x.as_py())
                grams, weights = automaton.expand()
                for i in range(0, len(grams), 1 << 16):
                    rows = grams[i : i + (1 << 16)]
                    spelled = [b" ".join(automaton.words[k] for k in r if k >= 0).decode() for r in rows.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(rows)), pa.array(spelled), pa.array((rows >= 0).sum(axis=1).astype(np.int32)), pa.array(weights[i : i + (1 << 16)])], ["lang", "phrase", "words", "a"]
                    )

    return counts.select("lang", "counts").mapInArrow(spell, "lang string, phrase string, words int, a long")


def look_up(requests: DataFrame, counts: DataFrame, bounds: list) -> DataFrame:
    """``lang, part, n, f`` for the distinct ``lang, part, n`` of ``requests``: composed with the automaton of the part's range."""

    @F.arrow_udf(T.IntegerType())
    def range_of(lang: pa.Array, part: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds, (k.encode(), tuple(p.encode().split(b" ")))) for k, p in zip(lang.to_pylist(), part.to_pylist(), strict=True)], pa.int32())

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        automata = dict(zip(held.column("lang").to_pylist(), held.column("counts"), strict=True)) if held.num_rows else {}
        by: dict[str, list] = {}
        for lang, part, n in zip(*(asked.column(c).to_pylist() for c in ("lang", "part", "n")), strict=True):
            by.setdefault(lang, []).append((tuple(part.encode().split(b" ")), part, n))
        out = []
        for lang, rows in by.items():
            rows.sort()
            words = sorted({w for r in rows for w in r[0]})
            number = {w: i for i, w in enumerate(words)}
            grams = np.array([[*(number[w] for w in r[0]), *[-1] * (DEPTH - len(r[0]))] for r in rows], np.int64)
            wanted = CountAutomaton.from_sorted(words, grams, np.ones(len(rows), np.int64))
            f = CountAutomaton.from_bytes(automata[lang].as_py()).compose(wanted).tolist() if lang in automata else [0] * len(rows)
            out += [(lang, r[1], r[2], x) for r, x in zip(rows, f, strict=True)]
        return pa.table({"lang": pa.array([x[0] for x in out], pa.string()), "part": pa.array([x[1] for x in out], pa.string()), "n": pa.array([x[2] for x in out], pa.int64()), "f": pa.array([x[3] for x in out], pa.int64())})

    routed = requests.withColumn("range", range_of("lang", "part"))
    return routed.groupBy("range").cogroup(counts.groupBy("range")).applyInArrow(answer, "lang string, part string, n long, f long")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = MIN_COUNT, percent: int = ABSORB_PERCENT, top: int = TOP, range_bytes: int = RANGE_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of two and three words of each language."""
    texts = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    bounds = cut_ranges(texts, range_bytes)
    counts = checkpointed(count_automata(texts, bounds, least, shard_words))
    candidates = checkpointed(phrases_of(counts).filter("words > 1"))
    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "*", F.array_join(F.slice(words, 1, F.col("k")), " ").alias("head"), F.array_join(F.slice(words, F.col("k") + 1, F.col("words")), " ").alias("tail")
    )
    requests = cuts.select("lang", F.explode(F.array("head", "tail")).alias("part")).groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"))
    known = checkpointed(look_up(requests, counts, bounds))
    met = split_join(cuts, known.select("lang", F.col("part").alias("head"), "n", F.col("f").alias("l")), ["lang", "head"])
    met = split_join(met, known.select("lang", F.col("part").alias("tail"), "n", F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(7)) * CAST(CAST(a AS DECIMAL(15)) * CAST(a AS DECIMAL(15)) AS DECIMAL(30))) div (CAST(l AS DECIMAL(15)) * CAST(r AS DECIMAL(15)))")
    best = met.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: F.array_join(F.slice(words, at, size), " "))))
    longer = candidates.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    listed = free.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    shortlist = listed.withColumn("place", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top).drop("place", "salt")
    ranked = shortlist.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = counts.groupBy("lang").agg(F.sum("total").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """All documents."""
    return collocations(table(spark, sf, "documents"))


OP11_SQL = f"""
WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents)),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS c FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND c >= {MIN_COUNT}),
cuts AS (SELECT lang, phrase, a, k, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)),
scored AS (SELECT cuts.lang, cuts.phrase, a, j, x.c AS l, y.c AS r, ({SCALE}::HUGEINT * a * a) // (x.c::HUGEINT * y.c) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_phrases AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM cand WHERE k = 3),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY lang, phrase),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {ABSORB_PERCENT} * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
