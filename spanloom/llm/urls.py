"""URL filter by a ratio of character language models, in DataFrame operations only.

Domain and path rules settle what they fit; the longest rule wins. The URLs they allow and block teach two character models of
variable order (Witten-Bell: each context mixes its own counts with the next shorter context, in proportion to how many different
characters followed it; unseen contexts fall through). Every URL is scored by the difference of its log-likelihoods under the two
models, divided by its length. A fifth of the settled URLs, by hash, is left out of the counts and calibrates the scores: two
normal distributions of one variance, with equal priors, give the probability of being allowed; 0.5 is the limit.

Counting and scoring work on different strings and on different grams: the corpus is reduced to the distinct strings, those to
grams of ``order + 1`` characters with their counts, and each distinct gram gets its log ratio once.

Rules read host and path; the models read the whole URL, scheme, query and fragment included.

Defined cases: null URLs and URLs without ``://`` have empty host and path and fit no rule; a null URL is scored as the empty string;
repeated URLs get the same verdict; without settled URLs of both kinds every ratio is 0 and the verdict is ``allow``; an empty table
gives no rows; only the id and URL columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizes import fits
from .common import checkpointed, split_join, table

# The rules of the query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
ORDER = 4
#: Characters that the shortest context spreads its remainder over.
ALPHABET = 256
CALIBRATION_FOLDS = 5
#: Grams with their ratio up to this number are broadcast (about 50 bytes each); beyond it they are salted.
MAX_BROADCAST_GRAMS = 200_000
SALTS = 16

_START, _END = "\u0002", "\u0003"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; both null when none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        domain, prefix = text[:at], text[at:]
        fit = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(prefix))
        rule, verdict = F.when(fit, text).otherwise(rule), F.when(fit, says).otherwise(verdict)
    return rule, verdict


def grams_of(text: Column, order: int = ORDER) -> Column:
    """One gram per character and one for the end: up to ``order`` characters before it, padded at the start."""
    padded = F.concat(F.lit(_START * order), text, F.lit(_END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, order + 1))


def gram_ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, ratio`` from ``gram, good, bad``: log P(last character | context) under the allowed model minus the blocked one."""
    shorter = None
    for k in range(1, order + 2):
        level = counts.groupBy(F.substring("gram", order + 2 - k, k).alias("g")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        level = level.select("*", F.substring("g", 1, k - 1).alias("context"), F.substring("g", 2, k - 1).alias("rest"))
        seen = level.groupBy(F.col("context").alias("of")).agg(
            *[F.sum(c).alias(f"{c}_n") for c in ("good", "bad")], *[F.count_if(F.col(c) > 0).alias(f"{c}_t") for c in ("good", "bad")]
        )
        level = level.join(seen, level["context"] == seen["of"])
        if shorter is None:
            level = level.withColumns({f"{c}_q": F.lit(1.0 / ALPHABET) for c in ("good", "bad")})
        else:
            level = level.join(shorter, level["rest"] == shorter["short"])
        p = {c: F.when(F.col(f"{c}_n") > 0, (F.col(c) + F.col(f"{c}_t") * F.col(f"{c}_q")) / (F.col(f"{c}_n") + F.col(f"{c}_t"))).otherwise(F.col(f"{c}_q")) for c in ("good", "bad")}
        shorter = level.select(F.col("g").alias("short"), *[p[c].alias(f"{c}_q") for c in ("good", "bad")])
    return shorter.select(F.col("short").alias("gram"), (F.log("good_q") - F.log("bad_q")).alias("ratio"))


def score_strings(strings: DataFrame, ratios: DataFrame, order: int = ORDER) -> DataFrame:
    """``s, score``: mean log ratio over the characters of each distinct string."""
    places = strings.select("s", F.explode(grams_of(F.col("s"), order)).alias("gram"))
    if fits(ratios, MAX_BROADCAST_GRAMS):
        joined = places.join(F.broadcast(ratios), "gram")
    else:
        # a frequent gram meets SALTS copies of its ratio
        salted = ratios.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = places.withColumn("salt", F.pmod(F.xxhash64("s"), F.lit(SALTS)).cast("int")).join(salted, ["gram", "salt"])
    return joined.groupBy("s").agg(F.round(F.sum("ratio") / F.count(F.lit(1)), 12).alias("score"))


def filter_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """``page_id, host, path, rule, score, p_allow, verdict`` for every row."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    parts = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(F.col(url), F.lit("")).alias("s"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    judged = parts.select("*", rule.alias("rule"), says.alias("says"))
    held = F.conv(F.substring(F.md5(F.col("s").cast("binary")), 1, 8), 16, 10).cast("long") % CALIBRATION_FOLDS == 0
    strings = checkpointed(judged.groupBy("s").agg(F.min("says").alias("says"), F.count(F.lit(1)).alias("n")).withColumn("held", held))
    counts = strings.select("says", "held", F.explode(grams_of(F.col("s"), order)).alias("gram")).groupBy("gram").agg(
        F.count_if((F.col("says") == "allow") & ~F.col("held")).alias("good"), F.count_if((F.col("says") == "block") & ~F.col("held")).alias("bad")
    )
    ratios = checkpointed(gram_ratios(checkpointed(counts), order))
    scores = checkpointed(score_strings(strings, ratios, order).join(strings, "s"))
    fit = {r["says"]: r for r in scores.filter("held AND says IS NOT NULL").groupBy("says").agg(
        F.count(F.lit(1)).alias("n_urls"), F.avg("score").alias("m"), F.var_pop("score").alias("v")).collect()}
    p_allow = F.when(F.col("score") >= 0, 1.0).otherwise(0.0)
    if len(fit) == 2:
        good, bad = fit["allow"], fit["block"]
        variance = max((good["n_urls"] * good["v"] + bad["n_urls"] * bad["v"]) / (good["n_urls"] + bad["n_urls"]), 1e-6)
        logit = ((F.col("score") - bad["m"]) ** 2 - (F.col("score") - good["m"]) ** 2) / (2 * variance)
        p_allow = 1 / (1 + F.exp(-logit))
    return split_join(judged, scores.select("s", "score", p_allow.alias("p_allow"), "n"), ["s"]).select(
        "page_id", "host", "path", "rule", "score", "p_allow",
        F.coalesce("says", F.when(F.col("p_allow") >= 0.5, "allow").otherwise("block")).alias("verdict"),
    )


def op5_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """All pages under the rules of the query."""
    return filter_urls(table(spark, sf, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _level(k: int) -> str:
    """SQL of one order of the models: probabilities of all grams of k characters."""
    shorter = f"JOIN p{k - 1} x ON substr(a.g, 2) = x.g" if k > 1 else f"CROSS JOIN (SELECT 1.0 / {ALPHABET} AS pg, 1.0 / {ALPHABET} AS pb) x"
    p = "CASE WHEN c.{0} > 0 THEN (a.{0} + c.t{0} * x.p{1}) / (c.{0} + c.t{0}) ELSE x.p{1} END AS p{1}"
    return f"""l{k} AS (SELECT right(gram, {k}) AS g, sum(good) AS good, sum(bad) AS bad FROM counts GROUP BY 1),
c{k} AS (SELECT left(g, {k - 1}) AS ctx, sum(good) AS good, sum(bad) AS bad, count(*) FILTER (good > 0) AS tgood, count(*) FILTER (bad > 0) AS tbad FROM l{k} GROUP BY 1),
p{k} AS (SELECT a.g, {p.format("good", "g")}, {p.format("bad", "b")} FROM l{k} a JOIN c{k} c ON left(a.g, {k - 1}) = c.ctx {shorter})"""


def _cases(column: str) -> str:
    whens = ""
    for says, text in sorted(RULES, key=lambda r: -len(r[1])):
        domain, prefix = text[: text.index("/")], text[text.index("/"):]
        whens += f" WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{prefix}') THEN '{text if column == 'rule' else says}'"
    return f"CASE{whens} END AS {column}"


def _op5_sql() -> str:
    return f"""
WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, coalesce(url, '') AS s FROM pages),
judged AS (SELECT *, {_cases("rule")}, {_cases("says")} FROM parts),
base AS (SELECT s, min(says) AS says FROM judged GROUP BY s),
strings AS (SELECT s, says, CAST('0x' || substr(md5(s), 1, 8) AS BIGINT) % {CALIBRATION_FOLDS} = 0 AS held FROM base),
grams AS (SELECT s, says, held, substr(repeat(chr(2), {ORDER}) || s || chr(3), i, {ORDER + 1}) AS gram FROM (SELECT *, unnest(range(1, length(s) + 2)) AS i FROM strings)),
counts AS (SELECT gram, count(*) FILTER (says = 'allow' AND NOT held) AS good, count(*) FILTER (says = 'block' AND NOT held) AS bad FROM grams GROUP BY gram),
{", ".join(_level(k) for k in range(1, ORDER + 2))},
scores AS (SELECT s, says, held, round(avg(ln(pg) - ln(pb)), 12) AS score FROM grams JOIN p{ORDER + 1} ON g = gram GROUP BY ALL),
fit AS (SELECT says, count(*) AS n, avg(score) AS m, var_pop(score) AS v FROM scores WHERE held AND says IS NOT NULL GROUP BY says),
two AS (SELECT a.m AS ma, b.m AS mb FROM fit a, fit b WHERE a.says = 'allow' AND b.says = 'block'),
verdicts AS (SELECT s, CASE WHEN ma IS NULL THEN score >= 0 ELSE (score - mb) ** 2 >= (score - ma) ** 2 END AS good FROM scores LEFT JOIN two ON true)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN good THEN 'allow' ELSE 'block' END) AS verdict FROM judged JOIN verdicts USING (s)
"""


OP5_SQL = _op5_sql()
