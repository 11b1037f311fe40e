"""Quality rules by weak supervision, with DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). The votes of all documents are reduced to a histogram of vote patterns
(at most 3 ** number of rules rows, whatever the corpus holds); expectation-maximisation over that histogram estimates how
often each rule is right when it votes, and every document gets the posterior probability of being good from one SQL expression.
Whether a rule abstains doesn't depend on the class in this model, so abstentions are evidence of nothing, in the fit as in the
posterior.

Cases: a null, empty or blank text has no words, gets zeros and fails the base rule. Long texts are handled whole: repeated
word triples are found by sorting the triples inside the row. Repeated rows are judged alike and all stay. An empty table
gives an empty result. Extra columns pass through ``filter_quality`` untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labframe.llm.common import materialize, words_col

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
RULES = ["symbols", "dup_lines", "repeats", "word_length", "upper_case"]


def text_stats(df: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """``df`` plus one struct column ``{prefix}stats`` of COUNTS, all within the row: no shuffle and no Python."""
    p = prefix
    t = F.coalesce(F.col(text), F.lit(""))
    step = df.withColumn(f"{p}w", words_col(text))
    n = F.size(f"{p}w")
    # A long per triple: its hash above its position, in as many low bits as the text's length needs. Sorting these longs
    # brings equal hashes together. The hashes only pick candidates; the words themselves decide below. The triples are not
    # kept as an array of their own, as each step copies the arrays that it passes on.
    w, o = F.col(f"{p}w"), F.col(f"{p}o")
    bits = F.ceil(F.log2(F.greatest(n, F.lit(2)) + 1)).cast("int")
    step = step.withColumn(f"{p}b", bits)
    bits = F.col(f"{p}b")
    packed = F.transform(
        F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.call_function("shiftleft", F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")),
    )
    step = step.withColumn(f"{p}o", F.sort_array(packed))
    equal_next = F.filter(
        F.when(n >= 4, F.sequence(F.lit(0), n - 4)).otherwise(F.array().cast("array<int>")),
        lambda i: F.call_function("shiftright", F.get(o, i).bitwiseXOR(F.get(o, i + 1)), bits) == 0,
    )
    step = step.withColumn(f"{p}e", equal_next)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    starts = F.transform(F.array_union(f"{p}e", F.transform(f"{p}e", lambda i: i + 1)), lambda k: F.get(o, k).bitwiseAND(mask).cast("int"))
    step = step.withColumn(f"{p}s", F.sort_array(F.transform(starts, lambda i: F.struct(
        F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i")))))
    # In sorted order equal triples are neighbours, so a triple is repeated if it equals the one before or after it.
    s = F.col(f"{p}s")

    def same(x: Column, y: Column) -> Column:
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    repeated = F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)))
    step = step.withColumn(f"{p}r", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    # Starts in ascending order: each covers three words, less those that the previous start covers already.
    covered = F.when(
        F.size(f"{p}r") > 0,
        F.aggregate(
            F.col(f"{p}r"),
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last")),
            lambda acc: acc["n"],
        ),
    ).otherwise(F.lit(0))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    step = step.withColumn(f"{p}l", lines)
    stats = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(f"{p}w", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        (F.size(f"{p}l") - F.size(F.array_distinct(f"{p}l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(f"{p}l").cast("long").alias("n_lines"),
        (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))).cast("long").alias("n_upper"),
    )
    return step.withColumn(f"{p}stats", stats).drop(*[f"{p}{x}" for x in "wbeosrl"])


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat_words * 100 > n_words * MAX_REPEAT_PERCENT)


def votes(stats: Column) -> list[Column]:
    """One column of -1, 0 or 1 per rule of RULES, from a struct of COUNTS. Ratios are compared by products, so no division."""

    def ratio(part: str, whole: str, good_to: float, bad_from: float) -> Column:
        a, b = stats[part], stats[whole]
        return F.when(b <= 0, 0).when(a >= b * bad_from, -1).when(a <= b * good_to, 1).otherwise(0)

    chars, n = stats["word_chars"], stats["n_words"]
    return [
        ratio("n_symbols", "n_words", 0.02, 0.2),
        ratio("n_dup_lines", "n_lines", 0.1, 0.35),
        ratio("n_repeat_words", "n_words", 0.1, 0.3),
        F.when(n <= 0, 0).when((chars >= n * 7.0) | (chars <= n * 3.0), -1).when((chars >= n * 4.2) & (chars <= n * 6.2), 1).otherwise(0),
        ratio("n_upper", "word_chars", 0.1, 0.4),
    ]


#: What a rule that votes is taken to say before anything is seen: P(vote | class), class 1 good, 0 bad.
START = {1: {1: 0.994, -1: 0.006}, 0: {1: 0.625, -1: 0.375}}
START_GOOD = 0.8


def fit_accuracies(patterns: dict[tuple[int, ...], int], rounds: int = 50, strength: float = 0.05) -> dict:
    """EM over a histogram of vote patterns (bounded by 3 ** rules). Rules are independent given the hidden class.

    Each rule has a table P(vote | class, it votes). Pseudo-counts of ``strength`` of all documents hold it near the start: a rule
    that rarely accuses a good document but sees only some kinds of bad ones. So classes can't swap, and a rule that never speaks
    keeps its start. Deterministic.
    """
    total = sum(patterns.values())
    k = len(next(iter(patterns))) if patterns else len(RULES)
    table = [{c: dict(START[c]) for c in (0, 1)} for _ in range(k)]
    prior, extra = START_GOOD, max(1.0, strength * total)
    for _ in range(rounds if total else 0):
        good_docs = 0.0
        counts = [{c: {v: extra * START[c][v] for v in (-1, 1)} for c in (0, 1)} for _ in range(k)]
        for votes_, m in sorted(patterns.items()):
            good = _posterior(votes_, table, prior)
            good_docs += m * good
            for j, v in enumerate(votes_):
                if v:
                    counts[j][1][v] += m * good
                    counts[j][0][v] += m * (1 - good)
        prior = (good_docs + START_GOOD * extra) / (total + extra)
        table = [{c: {v: x / sum(counts[j][c].values()) for v, x in counts[j][c].items()} for c in (0, 1)} for j in range(k)]
    return {"prior": prior, "table": table}


def _posterior(votes_: tuple[int, ...], table: list[dict], prior: float) -> float:
    log = math.log(prior / (1 - prior)) + sum(math.log(table[j][1][v] / table[j][0][v]) for j, v in enumerate(votes_) if v)
    return 1 / (1 + math.exp(-log)) if log > -700 else 0.0


def posterior(vote_cols: list[Column], model: dict) -> Column:
    """P(good | votes)."""
    log = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for v, t in zip(vote_cols, model["table"], strict=True):
        log = log + F.when(v == 1, math.log(t[1][1] / t[0][1])).when(v == -1, math.log(t[1][-1] / t[0][-1])).otherwise(0.0)
    return F.round(1 / (1 + F.exp(-log)), 9)


def histogram(stats: DataFrame, column: str) -> dict[tuple[int, ...], int]:
    """Vote patterns and their counts: at most 3 ** len(RULES) rows reach the driver."""
    cols = [v.alias(r) for v, r in zip(votes(F.col(column)), RULES, strict=True)]
    rows = stats.select(*cols).groupBy(*RULES).count().collect()
    return {tuple(int(r[x]) for x in RULES): r["count"] for r in rows}


def score_documents(docs: DataFrame, text: str = "text", keep_from: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """doc_id, COUNTS, one vote per rule, p_good, base_failed, kept. The counts are stored once and read twice."""
    stats = materialize(text_stats(docs.select(id_col, text), text).select(id_col, "_q_stats"), "quality")
    model = fit_accuracies(histogram(stats, "_q_stats"))
    v = votes(F.col("_q_stats"))
    failed = base_failed(F.col("_q_stats.n_words"), F.col("_q_stats.n_repeat_words"))
    p = posterior(v, model)
    return stats.select(
        id_col, *[F.col(f"_q_stats.{c}").alias(c) for c in COUNTS], *[x.cast("int").alias(f"vote_{r}") for x, r in zip(v, RULES, strict=True)],
        p.alias("p_good"), failed.alias("base_failed"), (~failed & (p >= keep_from)).alias("kept"),
    )


def filter_quality(docs: DataFrame, text: str = "text", keep_from: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. The verdict is computed in the row, so doc_id needn't be unique.
    Rows are stored with their counts, so texts are analysed once."""
    # The rows travel as one struct, so no column of theirs can clash.
    packed = docs.select(F.struct("*").alias("doc"), F.col(text).alias("body"))
    stored = materialize(text_stats(packed, "body").select("doc", "_q_stats"), "quality", compression="zstd")
    model = fit_accuracies(histogram(stored, "_q_stats"))
    s = F.col("_q_stats")
    keep = ~base_failed(s["n_words"], s["n_repeat_words"]) & (posterior(votes(s), model) >= keep_from)
    return stored.filter(keep).select("doc.*")
