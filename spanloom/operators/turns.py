"""Investigation by a model: bounded turns over the candidates that are still open.

Every turn puts one prompt per open candidate to the model, reads one action from each reply, carries the searches out for all
candidates at once, and writes the state. Candidates that are decided leave; only open ones go into the next turn. After the last turn
what is still open gets a forced verdict. The state of a candidate is narrow (evidence, actions, note); its context is joined for the
prompt alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.responses import response_object
from ..functions.sizes import broadcast_if_small, cut_lineage
from .candidates import candidate_context, normalize_category
from .investigate import EVIDENCE, MAX_SNIPPET, MAX_TURNS, NO_EVIDENCE_SUFFIX, call_model, evidence_accumulate, evidence_lists, finalize_normalize, forced_finalize, live_evidence
from .retrieval import citation_shape, embed_queries, search_ladder, topk_by_doc

Complete = Callable[[list[str]], list[str]]
KEYS = ("doc_id", "cand_id")
REPAIR = "\nThat was not one JSON object. Send only the object."
ACTION = (
    "action string, query string, phrases array<string>, any_of array<string>, min_year int, verdict string, category string, secondary_category string, "
    "explanation string, rewrite string, confidence string, needs_human_review boolean, evidence_used array<int>"
)
TASK = (
    "Judge whether a marked phrase of a document is at fault, in up to {turns} turns. Send one JSON object a turn: "
    'action "corpus_search" with query, {live}or "finalize" with verdict (confirmed or rejected), category, explanation, rewrite and confidence.'
)
LIVE_ACTION = 'action "live_search" with phrases, any_of and min_year, '
NOTE_INVALID = "The last reply named no action that can be taken."
NOTE_NO_LIVE = "There is no live search in this run."
NOTE_PREMATURE = "A phrase cannot be confirmed before a source was looked for."
#: Keys of failed replies that are broadcast.
MAX_BROADCAST_FAILED = 100_000
#: Query texts with their few sources that are broadcast.
MAX_BROADCAST_QUERIES = 10_000


class Turns(NamedTuple):
    """``results``: one row per candidate. ``asked``: doc_id, cand_id, turn, action, and raw reply of every turn, and prompts where they were kept."""

    results: DataFrame
    asked: DataFrame


def ask_twice(prompts: DataFrame, complete: Complete, keys: Sequence[str], repair: str | None = REPAIR) -> DataFrame:
    """Columns of ``prompts`` (without the prompt), ``raw``, ``reply`` (its JSON object or null), and ``repaired``: replies without a JSON object are asked for once more.

    The second round gets the failed rows only, with ``repair`` behind their prompt. Both rounds are written before they are read.
    """

    def ask(asked: DataFrame) -> DataFrame:
        return cut_lineage(call_model(asked, complete).drop("prompt").withColumn("reply", response_object(F.col("raw"))))

    first = ask(prompts).withColumn("repaired", F.lit(False))
    failed = first.filter("reply IS NULL")
    if repair is None or failed.isEmpty():
        return first
    # The failed rows are few columns, so where they are few rows as well no prompt is dealt out to meet them.
    ids = broadcast_if_small(failed.select(*keys), MAX_BROADCAST_FAILED)
    second = ask(prompts.join(ids, list(keys), "left_semi").withColumn("prompt", F.concat("prompt", F.lit(repair)))).withColumn("repaired", F.lit(True))
    return first.filter("reply IS NOT NULL").unionByName(second)


def turn_prompt(live_available: bool, max_turns: int = MAX_TURNS) -> Column:
    """The prompt of a turn: task, phrase in its place, sources so far, what was done, and a note on the last reply."""
    task = TASK.format(turns=max_turns, live=LIVE_ACTION if live_available else "")
    instead = F.when(F.size("alternatives") > 0, F.concat(F.lit("\ninstead: "), F.array_join("alternatives", " / "))).otherwise("")
    sources = F.transform("evidence", lambda e: F.concat(
        F.lit("\nsource "), e["n"].cast("string"), F.lit(" ("), F.coalesce(e["metadata"]["title"], F.lit("")), F.lit(", "), F.coalesce(e["metadata"]["year"], F.lit("")), F.lit(", "),
        F.format_number(e["score"], 2), F.lit("): "), F.left(F.coalesce(e["text"], F.lit("")), F.lit(MAX_SNIPPET)),
    ))
    done = F.when(F.size("actions") > 0, F.concat(F.lit("\ndone: "), F.array_join("actions", ", "))).otherwise("")
    note = F.when(F.col("note") != "", F.concat(F.lit("\nnote: "), "note")).otherwise("")
    return F.concat(
        F.lit(task + "\nphrase: "), "quote", F.lit("\nsuspected: "), "category", F.lit(", because "), F.coalesce("reason", F.lit("")), F.lit("\nfound: "),
        F.col("occurrences_count").cast("string"), F.lit(" times"), instead, F.lit("\nin: "), "sentence_text", F.lit("\nwithin: "), "paragraph_text", F.array_join(sources, ""), done, note,
    )


def _step(answered: DataFrame, turn: int, max_turns: int, live_available: bool) -> DataFrame:
    """What the reply of each open candidate does: ``taken`` (its action), ``final``, ``capped`` and the note for the next turn."""
    out = answered.withColumn("said", F.from_json("reply", ACTION)).drop("reply")
    name = F.coalesce("said.action", F.lit(""))
    finalize, live = name == "finalize", name == "live_search"
    ungrounded = finalize & F.coalesce(F.col("said.verdict") == "confirmed", F.lit(False)) & (F.size("evidence") <= 0)
    bounced = ungrounded & ~F.array_contains("actions", "premature_finalize") if turn < max_turns else F.lit(False)
    taken = F.when(bounced, "premature_finalize").when(finalize, "finalize").when(name == "corpus_search", "corpus_search").when(live & F.lit(live_available), "live_search").otherwise("invalid")
    note = F.when(bounced, NOTE_PREMATURE).when(live & F.lit(not live_available), NOTE_NO_LIVE).when(taken == "invalid", NOTE_INVALID).otherwise("")
    return (
        out.withColumn("taken", taken).withColumn("final", finalize & ~bounced).withColumn("capped", ungrounded & ~bounced)
        .withColumn("note", note).withColumn("actions", F.concat("actions", F.array("taken"))).withColumn("turns", F.lit(turn))
    )


def _corpus_found(queries: DataFrame, vectors: DataFrame, k: int, dim: int) -> DataFrame:
    """``query, fresh``: sources for distinct query texts."""
    asked = embed_queries(queries, "query", dim=dim).withColumn("query_id", F.col("query"))
    found = topk_by_doc(asked.select("query_id", "embedding"), vectors, k)
    listed = evidence_lists(evidence_accumulate(
        found.select("query_id", F.lit(1).alias("turn"), "rank", F.col("id").cast("string").alias("id"), "score", "text", "metadata"), ["query_id"]), ["query_id"])
    return listed.select(F.col("query_id").alias("query"), F.col("evidence").cast(EVIDENCE).alias("fresh"))


def _gather(state: DataFrame, vectors: DataFrame, live: DataFrame | None, k: int, dim: int) -> DataFrame:
    """Carry out the searches of a turn; sources that a candidate does not have yet are added, numbered on."""
    taken = {r[0] for r in state.select("taken").distinct().collect()}
    parts = [state.filter("taken NOT IN ('corpus_search', 'live_search')").withColumn("fresh", F.array().cast(EVIDENCE))]
    if "corpus_search" in taken:
        asked = state.filter("taken = 'corpus_search'").withColumn("query", F.coalesce("said.query", F.lit("")))
        found = cut_lineage(_corpus_found(asked.select("query").distinct(), vectors, k, dim))
        parts.append(asked.join(broadcast_if_small(found, MAX_BROADCAST_QUERIES), "query", "left").drop("query"))
    if "live_search" in taken:
        none = F.array().cast("array<string>")
        wanted = state.filter("taken = 'live_search'").withColumn(
            "request", F.struct(F.coalesce("said.phrases", none).alias("phrases"), F.coalesce("said.any_of", none).alias("any_of"), F.col("said.min_year").alias("min_year"))
        ).withColumn("request_id", F.to_json("request"))
        cited = citation_shape(search_ladder(wanted.select("request_id", "request.*").dropDuplicates(["request_id"]), live, k=k))
        lists = live_evidence(cited, wanted.select(*KEYS, "request_id")).withColumnRenamed("evidence", "fresh")
        parts.append(wanted.drop("request", "request_id").join(lists, list(KEYS), "left"))
    united = reduce(DataFrame.unionByName, parts)
    known = F.transform("evidence", lambda e: e["id"])
    new = F.filter(F.coalesce("fresh", F.array().cast(EVIDENCE)), lambda e: ~F.array_contains(known, e["id"]))
    return united.withColumn("evidence", F.transform(F.concat("evidence", new), lambda e, i: e.withField("n", (i + 1).cast("int")))).drop("fresh")


def _decided(state: DataFrame, max_turns: int) -> DataFrame:
    """Verdict columns of candidates that were finalized or ran out of turns."""
    said = lambda c: F.when(F.col("final"), F.col(f"said.{c}"))
    out = state.withColumns({c: said(c) for c in ("verdict", "secondary_category", "explanation", "rewrite", "confidence", "needs_human_review", "evidence_used")})
    out = out.withColumn("category", F.when(F.col("final"), F.col("said.category")).otherwise(F.col("category")))
    out = finalize_normalize(out).withColumn("category", normalize_category(F.col("category")))
    capped = F.col("capped")
    out = out.withColumns({
        "confidence": F.when(capped, "low").otherwise(F.col("confidence")), "needs_human_review": capped | F.col("needs_human_review"),
        "explanation": F.when(capped, F.trim(F.concat("explanation", F.lit(" " + NO_EVIDENCE_SUFFIX)))).otherwise(F.col("explanation")), "finalized": F.col("final"),
    })
    forced = forced_finalize(out, max_turns)
    return forced.select(
        *KEYS, "quote", "verdict", "category", "secondary_category", "explanation", "rewrite", "confidence", "needs_human_review", "evidence",
        F.coalesce("evidence_used", F.array().cast("array<int>")).alias("evidence_used"), "turns", "actions", "forced", F.col("capped").alias("confidence_capped"),
    )


def investigate_turns(
    context: DataFrame, vectors: DataFrame, complete: Complete, *, live: DataFrame | None = None, max_turns: int = MAX_TURNS, k: int = 3, dim: int = 64,
    repair: str | None = REPAIR, keep_prompts: bool = False,
) -> Turns:
    """Investigate every candidate of ``context`` (the columns of :func:`.candidates.candidate_context`) with a model.

    ``complete`` takes a batch of prompts inside a task. ``live`` is a second corpus for live_search, which is refused without one.
    A confirmation without a source is sent back once; later it stays, with low confidence. An unreadable reply is asked for once more
    in its turn. A candidate without a final verdict after ``max_turns`` is confirmed with low confidence, for review.
    """
    context = cut_lineage(context)
    about = context.select(*KEYS, "quote", "category", "reason")
    state = about.select(*KEYS, F.array().cast(EVIDENCE).alias("evidence"), F.array().cast("array<string>").alias("actions"), F.lit("").alias("note"))
    done, asked, rest = [], [], None
    for turn in range(1, max_turns + 1):
        prompts = context.join(state, list(KEYS)).select(*KEYS, "evidence", "actions", "note", turn_prompt(live is not None, max_turns).alias("prompt"))
        told = prompts.withColumn("shown", F.col("prompt")) if keep_prompts else prompts
        moved = cut_lineage(_step(ask_twice(told, complete, KEYS, repair), turn, max_turns, live is not None))
        asked.append(moved.select(*KEYS, F.lit(turn).alias("turn"), F.col("taken").alias("action"), "raw", "repaired", *(["shown"] if keep_prompts else [])))
        columns = [*KEYS, "evidence", "actions", "note", "taken", "said", "final", "capped", "turns"]
        done.append(moved.filter("final").select(columns))
        rest = moved.filter("NOT final").select(columns)
        if rest.isEmpty():
            rest = None
            break
        rest = cut_lineage(_gather(rest, vectors, live, k, dim))
        state = rest.select(*KEYS, "evidence", "actions", "note")
    if rest is not None:
        done.append(rest.select(columns))
    decided = about.join(reduce(DataFrame.unionByName, done), list(KEYS))
    return Turns(_decided(decided, max_turns), reduce(DataFrame.unionByName, asked))


def investigate_with_model(candidates: DataFrame, hits: DataFrame, vectors: DataFrame, complete: Complete, **options) -> DataFrame:
    """As :func:`.investigate.investigate`, with the verdicts of a model: the columns of ``candidates`` and those of the results."""
    results = investigate_turns(candidate_context(candidates, hits), vectors, complete, **options).results
    out = candidates.drop("category").join(results.drop("quote"), list(KEYS))
    if "expanded" in out.columns:
        spread = (F.col("verdict") == "confirmed") & (F.size("expanded") > 0)
        out = out.withColumn("occurrences", F.when(spread, F.col("expanded")).otherwise(F.col("occurrences"))).drop("expanded")
    return out.withColumn("escalated", F.array_contains("actions", "live_search"))
