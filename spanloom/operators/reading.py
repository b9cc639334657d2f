"""The pass over a text in Python, inside Arrow batches.

Blocks, windows, lexicon hits, rule candidates and their places are those of the column expressions in :mod:`.parse`, :mod:`.match` and
:mod:`.candidates`. Those are interpreted element by element and copy a text for every pattern; here a text is read once. Python's
white space, digits and letters are the classes that :mod:`..functions.text` spells out for Java. Words are looked for in a copy whose ASCII letters are lower
case, as the patterns ignore the case of ASCII words only, so :func:`plain` says for which words this pass stands in.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..functions.wordtrie import longest_first
from .parse import ABBREVIATIONS, HEADING_MAX_WORDS

_BLOCK_BREAK = re.compile(r"\n\s*\n")
_NUMBERED = re.compile(r"(?:\d+(?:\.\d+)+\.?|\d+\.|[IVXLCDM]+\.)\s+\S")
_ITEM = re.compile(r"(?:[-*•]|\d+[.)]|[a-zA-Z][.)])\s+\S")
_SENTENCE_END = re.compile(r"[.!?…]\s++(?=[A-Z\"'(0-9]|\Z)")
_CHUNK_END = re.compile(r"(?<=[.!?])\s++(?=[A-Z])")
_SPLIT_BY_CHUNKS = re.compile(r"\A\s|\s\Z|[.!?]\s")
_SPACES = re.compile(r"\s+")
TOKENS_PER_WORD = 1.3
#: Vocabularies up to this size are looked for term by term, larger ones by an automaton.
FEW_TERMS = 32
#: Documents whose rows a worker holds at a time.
SLICE = 256


def plain(words: Iterable[str]) -> bool:
    """Whether the patterns of these words ignore the case of ASCII letters alone."""
    return all(w.isascii() for w in words)


def lower_ascii(text: str) -> str:
    """``text`` with its ASCII letters in lower case, so as long as before."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _is_word(char: str) -> bool:
    return char == "_" or char.isalnum()


def places(text: str, low: str, word: str, overlapping: bool = False) -> list[int]:
    """Where a lower-case word stands between word boundaries."""
    out, size, at = [], len(word), low.find(word)
    before, after, last = _is_word(word[0]), _is_word(word[-1]), len(text)
    while at >= 0:
        end = at + size
        if (at > 0 and ((c := text[at - 1]).isalnum() or c == "_")) != before and (end < last and ((c := text[end]).isalnum() or c == "_")) != after:
            out.append(at)
            at = low.find(word, at + 1 if overlapping else end)
        else:
            at = low.find(word, at + 1)
    return out


class Vocabulary:
    """Hits of lower-case terms as by :func:`.match.hit_array`: per batch the leftmost counts, of those the longest, and none overlap."""

    def __init__(self, terms: Sequence[str], batch_size: int):
        ordered = longest_first(terms)
        self.batches = {t: i // batch_size for i, t in enumerate(ordered)}
        self.automaton = None
        if len(ordered) > FEW_TERMS:
            self.automaton = ahocorasick.Automaton()
            for t in ordered:
                self.automaton.add_word(t, t)
            self.automaton.make_automaton()

    def spans(self, text: str, low: str) -> list[tuple[int, int, str]]:
        if self.automaton is None:
            found = [(a, -len(t), t) for t in self.batches for a in places(text, low, t, overlapping=True)]
        else:
            found = [(at + 1 - len(t), -len(t), t) for at, t in self.automaton.iter(low) if self._stands(text, at + 1 - len(t), at + 1, t)]
        found.sort()
        free, out = {}, []
        for a, size, term in found:
            lane = self.batches[term]
            if a >= free.get(lane, 0):
                free[lane] = a - size
                out.append((a, a - size, term))
        return out if len(free) < 2 else sorted(set(out))

    @staticmethod
    def _stands(text: str, a: int, b: int, term: str) -> bool:
        return (a > 0 and _is_word(text[a - 1])) != _is_word(term[0]) and (b < len(text) and _is_word(text[b])) != _is_word(term[-1])


# ---- parsing ---------------------------------------------------------------------------------


#: Words of the abbreviations by their last two letters.
_BY_ENDING: dict[str, list[list[str]]] = {}
for _a in ABBREVIATIONS:
    _BY_ENDING.setdefault(_a[-2:], []).append(_a.split(" "))


def _after_abbreviation(text: str, at: int) -> bool:
    """Whether the sentence mark at ``at`` follows an abbreviation, with any number of dots, then spaces, between."""
    while at and text[at - 1].isspace():
        at -= 1
    while at and text[at - 1] == ".":
        at -= 1
    return any(_ends_with(text, at, a) for a in _BY_ENDING.get(text[max(at - 2, 0) : at].lower(), ()))


def _ends_with(text: str, at: int, words: list[str]) -> bool:
    for i, w in enumerate(reversed(words)):
        if i:
            back = at
            while back and text[back - 1].isspace():
                back -= 1
            if back == at:
                return False
            at = back
            while at and text[at - 1] == ".":
                at -= 1
        if at < len(w) or text[at - len(w) : at].lower() != w:
            return False
        at -= len(w)
        while at and text[at - 1] == ".":
            at -= 1
    return at == 0 or text[at - 1].isspace()


def sentence_spans(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in _SENTENCE_END.finditer(text):
        if not _after_abbreviation(text, m.start()):
            out.append((at, m.start() + 1))
            at = m.end()
    out.append((at, len(text)))
    return [s for i, s in enumerate(out) if i == 0 or s[0] < s[1]]


def _all_capitals(text: str) -> bool:
    kinds = [unicodedata.category(c) for c in text]
    return kinds.count("Lu") > 1 and not any(k in ("Ll", "Lt", "Lm", "Lo") for k in kinds)


def block_kind(text: str) -> str:
    if "\n" not in text and len(text.split(None, HEADING_MAX_WORDS)) <= HEADING_MAX_WORDS and (text[-1] not in ".!?" or _NUMBERED.match(text) or _all_capitals(text)):
        return "heading"
    return "list" if _ITEM.match(text) and all(_ITEM.match(x) for line in text.splitlines() if (x := line.strip())) else "paragraph"


def blocks_of(text: str) -> list[tuple[int, str, str]]:
    """(char_start, text, kind) of the blocks between blank lines."""
    out, at = [], 0
    for end, after in [*(m.span() for m in _BLOCK_BREAK.finditer(text)), (len(text), 0)]:
        raw = text[at:end]
        stripped = raw.strip()
        if stripped:
            out.append((at + len(raw) - len(raw.lstrip()), stripped, block_kind(stripped)))
        at = after
    return out


def _tokens(text: str) -> float:
    return len(text.split()) * TOKENS_PER_WORD


def segments_of(blocks: list[tuple[int, str, str]], budget: float) -> list[tuple[int, int, str, str, float]]:
    """(char_start, char_end, kind, text, tokens): blocks, or groups of their sentences where they are over the budget."""
    out = []
    for start, text, kind in blocks:
        tokens = _tokens(text)
        if tokens <= budget:
            out.append((start, start + len(text), kind, text, tokens))
            continue
        groups, total = [], 0.0
        for a, b in sentence_spans(text):
            x = _tokens(text[a:b])
            if groups and total + x <= budget:
                groups[-1][1], total = b, total + x
            else:
                groups.append([a, b])
                total = x
        out += [(start + a, start + b, kind, text[a:b], _tokens(text[a:b])) for a, b in groups]
    return out


def windows_of(segments: list, budget: float) -> list[tuple[int, int, int | None, int]]:
    """(first, stop, overlap, heading): segments of a window, the one it repeats of the window before, and its last heading or -1."""
    out, first, total, heading, shown = [], 0, 0.0, -1, -1
    for i, s in enumerate(segments):
        if i > first and (total + s[4] > budget or (s[2] == "heading" and total >= budget * 0.5)):
            out.append((first, i, shown))
            first, total = i, 0.0
        total += s[4]
        if s[2] == "heading":
            heading = i
        shown = heading
    if segments:
        out.append((first, len(segments), shown))
    done, before = [], None
    for a, b, h in out:
        repeated = None if before is None else next((j for j in range(before[1] - 1, before[0] - 1, -1) if segments[j][2] == "paragraph"), before[1] - 1)
        done.append((a, b, repeated, h))
        before = (a, b)
    return done


# ---- candidates ------------------------------------------------------------------------------


def find_quote(text: str, quote: str, start: int) -> tuple[int, int] | None:
    at = text.find(quote, start)
    if at >= 0:
        return at, at + len(quote)
    words = quote.split()
    if not words or not all(w in text for w in words):
        return None
    m = re.compile(r"\s+".join(map(re.escape, words))).search(text, start)
    return m and m.span()


def quote_key(quote: str) -> str:
    return _SPACES.sub(" ", quote).strip().lower()


def expanded(text: str, low: str, key: str) -> list[tuple[int, int]]:
    """Every place the words of a phrase stand, whatever case and spacing, without word boundaries."""
    words = key.split()
    if len(words) == 1 and text.isascii() and key.isascii():
        out, at = [], low.find(key)
        while at >= 0:
            out.append((at, at + len(key)))
            at = low.find(key, at + len(key))
        return out
    return [m.span() for m in re.finditer(r"\s+".join(map(re.escape, words)), text, re.I)] if words else []


def _holding(starts: list[int], ends: list[int], at: int) -> int | None:
    i = bisect_right(starts, at) - 1
    return i if i >= 0 and at < ends[i] else None


def in_context(text: str, blocks: list, found: list[tuple]) -> list[tuple]:
    """(sentence_id, sentence_text, paragraph_text) of accepted candidates."""
    sentences = [(start + a, start + b, k) for k, (start, body, kind) in enumerate(blocks) if kind != "heading" for a, b in sentence_spans(body)]
    starts, ends = [s[0] for s in sentences], [s[1] for s in sentences]
    b_starts, b_ends = [b[0] for b in blocks], [b[0] + len(b[1]) for b in blocks]
    out = []
    for c in found:
        s, quote = _holding(starts, ends, c[3]), c[2]
        if s is not None:
            out.append((f"s{s:04d}", text[starts[s] : ends[s]], blocks[sentences[s][2]][1]))
        else:
            b = _holding(b_starts, b_ends, c[3])
            out.append((None, quote, quote if b is None else blocks[b][1]))
    return out


def _first_in(at: list[int], a: int, b: int) -> int | None:
    i = bisect_left(at, a)
    return at[i] if i < len(at) and at[i] < b else None


# ---- the pass ---------------------------------------------------------------------------------

_CANDIDATE = "window_idx int, pos int, quote string, char_start int, char_end int, category string, reason string, lexicon_backed boolean"
_CONTEXT = "sentence_id string, sentence_text string, paragraph_text string"
_SPANS = "array<struct<char_start:int,char_end:int>>"
_WINDOW = "window_idx int, window_id string, char_start int, char_end int, heading_path string, overlap_char_end int"
_HINT = "term:string,hit_count:bigint,first_start:int,sample_offsets:array<struct<start:int,end:int>>,category:string,alternatives:array<string>,condition:string,doc_count:bigint,rank:int"
_SAID = ("window_idx", "pos", "quote", "category", "reason", "lexicon_backed")


def _struct(fields: str) -> str:
    return f"array<struct<{fields}>>".replace(" int", ":int").replace(" string", ":string").replace(" boolean", ":boolean").replace(f" {_SPANS}", f":{_SPANS}")


def read_texts(
    documents: DataFrame, *, window_tokens: int, rules: Sequence | None = None, replied: bool = False, expand: bool = True, context: bool = True, flagged_only: bool = False,
    windows: bool = False, window_texts: bool = False, detected: bool = False, terms: Sequence[str] | None = None, batch_size: int = 500, max_windows: int | None = None, slack: int = 200,
    entries: dict[str, tuple[str, list[str], str]] | None = None, hint_cap: int = 20, samples: int = 3,
) -> DataFrame:
    """One narrow row per document (doc_id, text): doc_id, n_windows, n_raw, n_dropped, n_failed, candidates, and what is asked for.

    Candidates are those of ``rules`` or, with ``replied``, of the column ``said`` (an array of a model's candidates; ``n_failed`` is a column, too). Only the first
    candidate of a phrase has its ``expanded`` occurrences. ``windows`` (with ``window_texts`` their texts as well), ``detected`` (window_idx, pos of all raw candidates)
    and the ``hits`` of ``terms`` are arrays. With ``entries`` (category, alternatives and condition of each term) windows have their ``hints``, as by :func:`.match.window_hints`.
    With ``flagged_only`` only documents come out that hold a flag word.
    """
    fields = ", ".join([_CANDIDATE, *([_CONTEXT] if context else []), *([f"expanded {_SPANS}"] if expand else [])])
    extra = [
        *([f"windows {_struct(_WINDOW + (', text string' if window_texts else '') + (f', hints:array<struct<{_HINT}>>' if entries is not None else ''))}"] if windows else []),
        *([f"hits {_struct('char_start int, char_end int, term string')}"] if terms is not None else []),
        *([f"detected {_struct('window_idx int, pos int')}"] if detected else []),
    ]
    said = ["n_failed", "said"] if replied else []
    kind = _parse_datatype_string(", ".join(["n_windows int, n_raw int, n_dropped int, n_failed int", f"candidates {_struct(fields)}", *extra]))
    schema = StructType([StructField("doc_id", documents.schema["doc_id"].dataType), *kind.fields])
    reader = _Reader(
        float(window_tokens), [(r.word.lower(), r.category, f"contains: {r.word}") for r in rules or ()], expand, context, flagged_only, windows, window_texts, detected, list(terms) if terms is not None else None,
        batch_size, max_windows, slack, entries, hint_cap, samples,
    )
    return documents.select("doc_id", "text", *said).mapInArrow(reader.run, schema)


_HINTS = {
    "term": pa.string(), "hit_count": pa.int64(), "first_start": pa.int32(), "sample_offsets": {"start": pa.int32(), "end": pa.int32()}, "category": pa.string(), "alternatives": pa.list_(pa.string()),
    "condition": pa.string(), "doc_count": pa.int64(), "rank": pa.int32(),
}


class _Reader:
    def __init__(self, budget, rules, expand, context, flagged_only, windows, window_texts, detected, terms, batch_size, max_windows, slack, entries, hint_cap, samples):
        self.budget, self.rules, self.expand, self.context, self.flagged_only = budget, rules, expand, context, flagged_only
        self.windows, self.window_texts, self.detected = windows, window_texts, detected
        self.terms, self.batch_size, self.max_windows, self.slack = terms, batch_size, max_windows, slack
        self.entries, self.hint_cap, self.samples = entries, hint_cap, samples

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = None if self.terms is None else Vocabulary(self.terms, self.batch_size)
        for batch in _slices(batches):
            failed, said = (batch.column(2), batch.column(3)) if batch.num_columns > 2 else (None, None)
            at, rows = [], []
            for i, text in enumerate(batch.column(1)):
                row = self._read(text.as_py(), vocabulary, None if said is None else said[i].as_py())
                if row is not None:
                    at.append(i)
                    rows.append((row[0], row[1], row[2], failed[i].as_py() or 0 if failed is not None else 0, *row[3:]))
            yield self._batch(batch.column(0).take(pa.array(at, pa.int32())), rows)

    def _read(self, text: str, vocabulary: Vocabulary | None, said: list[dict] | None):
        low = lower_ascii(text)
        at = [places(text, low, r[0]) for r in self.rules]
        if self.flagged_only and not any(at):
            return None
        blocks = blocks_of(text)
        segments = segments_of(blocks, self.budget)
        windows = windows_of(segments, self.budget)
        if self.max_windows is not None and len(windows) > self.max_windows:
            return None
        edges = [(segments[a if o is None else o][0], segments[b - 1][1]) for a, b, o, _ in windows]
        raw = []
        if any(at):
            for w, (a, _, o, _) in enumerate(windows):
                for pos, (found, (word, category, reason)) in enumerate(zip(at, self.rules)):
                    p = _first_in(found, segments[o][0], segments[o][1]) if o is not None else None
                    p = _first_in(found, segments[a][0], edges[w][1]) if p is None else p
                    if p is not None:
                        raw.append((w, pos, text[p : p + len(word)], category, reason, True))
        for c in said or ():
            raw.append(tuple(c[n] for n in _SAID))
        accepted = []
        for w, pos, quote, category, reason, backed in raw:
            span = find_quote(text, quote, edges[w][0]) if 0 <= w < len(edges) else None
            if span and span[0] < edges[w][1] + self.slack:
                accepted.append((w, pos, text[span[0] : span[1]], *span, category, reason, backed))
        out = [len(windows), len(raw), len(raw) - len(accepted)]
        rows = accepted
        if self.context and accepted:
            rows = [c + x for c, x in zip(rows, in_context(text, blocks, accepted))]
        if self.expand and accepted:
            seen, grown = set(), []
            for c in rows:
                key = quote_key(c[2])
                grown.append((*c, None if key in seen else expanded(text, low, key)))
                if key.isascii():  # other letters may have another lower case in the JVM, which groups by it
                    seen.add(key)
            rows = grown
        out.append(rows if accepted or not self.context else None)
        hits = vocabulary.spans(text, low) if vocabulary is not None else []
        if self.windows:
            hints = self._hints(hits, edges) if self.entries is not None else None
            out.append([
                (w, f"w{w:03d}", edges[w][0], edges[w][1], segments[h][3] if h >= 0 else "", segments[a][0] if o is None else segments[o][1],
                 *(["\n\n".join(([] if o is None else [segments[o][3]]) + [s[3] for s in segments[a:b]])] if self.window_texts else []),
                 *([] if hints is None else [hints[w]]))
                for w, (a, b, o, h) in enumerate(windows)
            ])
        if vocabulary is not None:
            out.append(hits)
        if self.detected:
            out.append([c[:2] for c in raw])
        return out

    def _hints(self, hits: list[tuple[int, int, str]], edges: list[tuple[int, int]]) -> list[list[tuple]]:
        """The hints of each window: its terms, the rarest of the document first."""
        counts, starts, out = Counter(h[2] for h in hits), [h[0] for h in hits], []
        for a, b in edges:
            spans: dict[str, list[tuple[int, int]]] = {}
            for start, end, term in hits[bisect_left(starts, a) : bisect_left(starts, b)]:
                spans.setdefault(term, []).append((start, end))
            order = sorted((counts[t], s[0][0], t) for t, s in spans.items())[: self.hint_cap]
            out.append([
                (t, len(spans[t]), first, sorted(spans[t])[: self.samples], category, alternatives and alternatives[: self.samples], condition, n, rank)
                for rank, (n, first, t) in enumerate(order, 1) for category, alternatives, condition in [self.entries[t]]
            ])
        return out

    def _batch(self, keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        i32, text = pa.int32(), pa.string()
        columns = list(zip(*rows)) if rows else [()] * (5 + self.windows + (self.terms is not None) + self.detected)
        candidate = {"window_idx": i32, "pos": i32, "quote": text, "char_start": i32, "char_end": i32, "category": text, "reason": text, "lexicon_backed": pa.bool_()}
        candidate |= dict.fromkeys(("sentence_id", "sentence_text", "paragraph_text"), text) if self.context else {}
        candidate |= {"expanded": {"char_start": i32, "char_end": i32}} if self.expand else {}
        kinds = [candidate]
        if self.windows:
            kinds.append({"window_idx": i32, "window_id": text, "char_start": i32, "char_end": i32, "heading_path": text, "overlap_char_end": i32} | ({"text": text} if self.window_texts else {}) | ({"hints": _HINTS} if self.entries is not None else {}))
        if self.terms is not None:
            kinds.append({"char_start": i32, "char_end": i32, "term": text})
        if self.detected:
            kinds.append({"window_idx": i32, "pos": i32})
        names = ["candidates", *(["windows"] if self.windows else []), *(["hits"] if self.terms is not None else []), *(["detected"] if self.detected else [])]
        counts = [pa.array(c, i32) for c in columns[:4]]
        lists = [_lists(c, k) for c, k in zip(columns[4:], kinds)]
        return pa.RecordBatch.from_arrays([keys, *counts, *lists], ["doc_id", "n_windows", "n_raw", "n_dropped", "n_failed", *names])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _lists(rows: Sequence[list[tuple] | None], kinds: dict) -> pa.Array:
    """Lists of tuples, or nulls, as an array of structs; a kind that is a dictionary stands for such lists in turn."""
    offsets, flat = [0], []
    missing = []
    for r in rows:
        missing.append(r is None)
        flat += r or ()
        offsets.append(len(flat))
    columns = list(zip(*flat)) if flat else [()] * len(kinds)
    values = [_lists(c, k) if isinstance(k, dict) else pa.array(c, k) for c, k in zip(columns, kinds.values())]
    structs = pa.StructArray.from_arrays(values, list(kinds))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs, mask=pa.array(missing, pa.bool_()))


# ---- terms in chunks ----------------------------------------------------------------------------


def chunk_spans(text: str) -> list[tuple[int, int]]:
    """The chunks of :func:`.parse.chunk_table`."""
    body = text.strip()
    lead, at, out = len(text) - len(text.lstrip()), 0, []
    for m in _CHUNK_END.finditer(body):
        out.append((lead + at, lead + m.start()))
        at = m.end()
    return [s for s in (*out, (lead + at, lead + len(body))) if s[0] < s[1]]


def terms_in_chunks(documents: DataFrame, terms: Sequence[str]) -> DataFrame:
    """doc_id, chunk_idx, chunk_id, term, char_start, char_end: every lower-case term on its own in the chunks of the documents (doc_id, text)."""
    words = list(terms)
    schema = StructType([StructField("doc_id", documents.schema["doc_id"].dataType), *_parse_datatype_string("chunk_idx int, chunk_id string, term string, char_start int, char_end int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            at, found = [], []
            for i, x in enumerate(batch.column(1)):
                hits = _chunk_hits(x.as_py(), words)
                at += [i] * len(hits)
                found += hits
            k, term, a, b = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), pa.array(k, pa.int32()), pa.array([f"c{n:03d}" for n in k], pa.string()), pa.array(term, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                ["doc_id", "chunk_idx", "chunk_id", "term", "char_start", "char_end"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def _chunk_hits(text: str | None, terms: list[str]) -> list[tuple[int, str, int, int]]:
    if text is None or not text.strip():
        return []
    low, spans, starts, out = lower_ascii(text), None, None, []
    for t in terms:
        if t not in low:
            continue
        if spans is None:
            spans = chunk_spans(text)
            starts = [s[0] for s in spans]
        if _SPLIT_BY_CHUNKS.search(t):  # could reach over the end of a chunk
            out += [(k, t, a + p, a + p + len(t)) for k, (a, b) in enumerate(spans) for p in places(text[a:b], low[a:b], t)]
        else:
            out += [(bisect_right(starts, p) - 1, t, p, p + len(t)) for p in places(text, low, t)]
    return out
