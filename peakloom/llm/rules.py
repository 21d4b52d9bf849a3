"""Quality rules as weak supervision: each rule votes good, votes bad or abstains; expectation-maximisation over the
counts of vote patterns estimates how often each rule gives each vote in good and in bad text, and the share of good
text; the posterior probability of good text replaces the usual all-must-pass filter.

The two classes are told apart because rules overlap (several of them look at one kind of trouble from different sides,
five vote both ways) and the fit starts from rules that are better than chance. No rate is clamped: a rule that
turns out to vote alike in both classes weighs nothing, and a vote that good text often gets can be outweighed.

DataFrame functions only. A pass over the texts makes one row of figures a document; the fit sees nothing but the number
of documents of each vote pattern, at most 3 ** len(RULES) rows whatever the corpus holds.

Cases: a null or empty text has no words, so that its figures are 0 and the base rule rejects it. A null id
stays null. Repeated rows give repeated results. An empty table gives an empty result and the starting
parameters. Columns of the input other than the id and the text are not read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import BLANK_CLASS, BLANKS, WORD_CLASS, cut, stored, text_of

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Frequent function words of the corpus languages; a fixed list.
FUNCTION_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "be", "on", "by", "are", "this",
    "der", "die", "und", "den", "von", "das", "mit", "sich", "des", "ist", "im", "dem", "nicht", "ein", "eine",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "sur",
    "el", "los", "se", "del", "las", "por", "con", "no", "una", "su", "para", "al", "lo", "como",
)


def let(value: Column, body) -> Column:
    """body(value) with value computed once; inside a lambda a plain reference would be computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeated_words(windows: Column) -> Column:
    """Words in windows (hashes by start position) that occur twice or more: sort (hash, position), keep
    neighbours with equal hashes, then measure the union of the windows from left to right."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    same = let(
        pairs,
        lambda s: F.filter(
            s,
            lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]),
        ),
    )
    starts = F.sort_array(F.transform(same, lambda x: x["p"]))
    walk = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(walk["n"])


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """One row a document: the id, the columns in keep, and its figures (all long)."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.col(f"`{c}`") for c in keep if c != id_col], text_of(text_col).alias("__text"))
    trimmed = F.btrim("__text", F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_CLASS + "+"))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD_CLASS))
    base = base.withColumn("__words", words).withColumn("__lines", lines)
    n = F.size("__words")
    windows = F.transform(
        F.slice("__words", 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)),
    )
    base = base.withColumn("__windows", windows)
    long = lambda c, name: c.cast("long").alias(name)
    return base.select(
        "doc_id",
        *[F.col(f"`{c}`") for c in keep if c != id_col],
        long(n, "n_words"),
        long(F.length(F.array_join("__words", "")), "word_chars"),
        long(F.regexp_count("__text", F.lit("[#*$%&|<>]")), "n_symbols"),
        long(F.size("__lines") - F.size(F.array_distinct("__lines")), "n_dup_lines"),
        long(_repeated_words(F.col("__windows")), "n_repeat_words"),
        long(F.size("__lines"), "n_lines"),
        long(F.regexp_count("__text", F.lit("[A-Z][A-Z]+")), "n_capital_runs"),
        long(F.regexp_count("__text", F.lit("[.!?](?=[\\s]|$)")), "n_stops"),
        long(F.size(F.filter("__words", lambda w: F.lower(w).isin(*FUNCTION_WORDS))), "n_function_words"),
        long(F.regexp_count("__text", F.lit(r"\p{L}" + WORD_CLASS + "*+")), "n_letter_words"),
        long(F.regexp_count("__text", F.lit(f"(?<!{WORD_CLASS})" + r"\p{L}[\p{L}'’-]*+[.,;:!?]*+" + f"(?!{WORD_CLASS})")), "n_plain_words"),
    )


def _share(top: str, bottom: str) -> Column:
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def _either(good: Column | None, bad: Column) -> Column:
    """1 for good, -1 for bad, 0 for an abstention; where neither can be told (null) the rule abstains."""
    vote = F.when(bad, F.lit(-1))
    if good is not None:
        vote = vote.when(good, F.lit(1))
    return vote.otherwise(F.lit(0))


def votes() -> dict[str, Column]:
    """The vote of each rule over the columns of figures(). Rules about one kind of trouble only vote bad: a text without
    many symbols isn't thereby good."""
    length, symbols = _share("word_chars", "n_words"), _share("n_symbols", "n_words")
    capitals, stops = _share("n_capital_runs", "n_words"), _share("n_stops", "n_words")
    twice, repeated = _share("n_dup_lines", "n_lines"), _share("n_repeat_words", "n_words")
    function, letters, plain = (_share(c, "n_words") for c in ("n_function_words", "n_letter_words", "n_plain_words"))
    return {
        "word_length": _either((length >= 3) & (length <= 10), (length < 2) | (length > 14)),
        "symbols": _either(None, symbols > 0.1),
        "capitals": _either(None, capitals > 0.3),
        "lines_twice": _either(None, twice > 0.4),
        "words_repeated": _either(None, repeated > 0.3),
        "sentences": _either((stops >= 0.02) & (stops <= 0.3), (stops < 0.004) | (stops > 0.5)),
        "function_words": _either(function >= 0.1, function < 0.03),
        "letters": _either(letters >= 0.95, letters < 0.8),
        "plain_words": _either(plain >= 0.8, plain < 0.5),
    }


RULES = ("word_length", "symbols", "capitals", "lines_twice", "words_repeated", "sentences", "function_words", "letters", "plain_words")
VOTES = (-1, 0, 1)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: The share of good documents at which the fit starts.
PRIOR = 0.8
#: Times the rate over all text that a vote (bad, none, good) has in good and in bad text when the fit starts.
START_GOOD, START_BAD = (0.3, 1.0, 1.0), (3.0, 1.0, 0.5)
#: Documents that the start counts for in each estimate: so few that it decides only where the corpus says nothing.
PSEUDO = 2.0


@dataclass
class VoteModel:
    """prior: share of good documents. good, bad: for each rule the rates of its votes (bad, none, good) in such text."""

    prior: float = PRIOR
    good: dict[str, tuple[float, ...]] = field(default_factory=lambda: {k: _scaled(START_GOOD) for k in RULES})
    bad: dict[str, tuple[float, ...]] = field(default_factory=lambda: {k: _scaled(START_BAD) for k in RULES})

    def weights(self) -> tuple[float, dict[str, dict[int, float]]]:
        """Log odds of good: at the start, and what each vote of each rule adds."""
        return math.log(self.prior / (1 - self.prior)), {k: {v: math.log(a / b) for v, a, b in zip(VOTES, self.good[k], self.bad[k], strict=True)} for k in RULES}

    def log_odds(self, pattern: Iterable[int]) -> float:
        """Of good, for one pattern of votes."""
        start, each = self.weights()
        return start + sum(each[k][v] for k, v in zip(RULES, pattern, strict=True))

    def posterior(self) -> Column:
        """The probability of good over the columns of figures()."""
        start, each = self.weights()
        total = F.lit(start)
        for k, vote in votes().items():
            total = total + _weighed(vote, each[k])
        return 1 / (1 + F.exp(-total))


def _weighed(vote: Column, weights: dict[int, float]) -> Column:
    return let(vote, lambda v: F.when(v == -1, weights[-1]).when(v == 1, weights[1]).otherwise(weights[0]))


def _scaled(values: Iterable[float]) -> tuple[float, ...]:
    own = tuple(values)
    return tuple(v / sum(own) for v in own)


def fit_patterns(counts: dict[tuple[int, ...], int], prior: float = PRIOR, rounds: int = 500, tolerance: float = 1e-9) -> VoteModel:
    """Expectation-maximisation over counts of vote patterns, with two classes in each of which a rule gives each vote, or
    none, at a rate of its own. It starts from better than chance: the corpus rates, with bad votes rarer in good text
    and more common in bad text, good votes the other way round. Each estimate counts that start as PSEUDO documents
    more, so that no rate is 0."""
    n_docs = sum(counts.values())
    if not n_docs:
        return VoteModel(prior)
    share = {k: [sum(n for p, n in counts.items() if p[i] == v) / n_docs + 1e-6 for v in VOTES] for i, k in enumerate(RULES)}
    start_good = {k: _scaled(x * y for x, y in zip(share[k], START_GOOD, strict=True)) for k in RULES}
    start_bad = {k: _scaled(x * y for x, y in zip(share[k], START_BAD, strict=True)) for k in RULES}
    model = VoteModel(prior, start_good, start_bad)
    for _ in range(rounds):
        start, each = model.weights()
        good, in_good, in_all = 0.0, {k: dict.fromkeys(VOTES, 0.0) for k in RULES}, {k: dict.fromkeys(VOTES, 0) for k in RULES}
        for pattern, n in counts.items():
            odds = start + sum(each[k][v] for k, v in zip(RULES, pattern, strict=True))
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            good += n * p
            for k, v in zip(RULES, pattern, strict=True):
                in_good[k][v] += n * p
                in_all[k][v] += n
        new = VoteModel(
            (good + PSEUDO * prior) / (n_docs + PSEUDO),
            {k: _scaled(in_good[k][v] + PSEUDO * s for v, s in zip(VOTES, start_good[k], strict=True)) for k in RULES},
            {k: _scaled(max(0.0, in_all[k][v] - in_good[k][v]) + PSEUDO * s for v, s in zip(VOTES, start_bad[k], strict=True)) for k in RULES},
        )
        moved = abs(new.prior - model.prior)
        model = new
        if moved < tolerance:
            break
    return model


def fit(figured: DataFrame) -> VoteModel:
    """The model of a frame of figures. Comes to the driver: one row a vote pattern, 3 ** len(RULES) at most."""
    rows = figured.select(*[v.alias(k) for k, v in votes().items()]).groupBy(*RULES).count().collect()
    return fit_patterns({tuple(r[k] for k in RULES): r["count"] for r in sorted(rows)})


def judge(figured: DataFrame, model: VoteModel) -> DataFrame:
    """Adds base_failed, p_good (posterior) and kept to a frame of figures."""
    return figured.withColumns({"base_failed": base_failed(), "p_good": model.posterior()}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, the figures, base_failed, kept and p_good. The texts are read once."""
    figured = cut(figures(docs, id_col, text_col))
    return judge(figured, fit(figured))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with their columns as they were. Rows are written once with their figures,
    so texts are neither taken apart twice nor joined by an id that may repeat."""
    plain = [f"__c{i}" for i in range(len(docs.columns))]
    names = dict(zip(docs.columns, plain, strict=True))
    figured = stored(figures(docs.toDF(*plain), names[id_col], names[text_col], plain))
    out = judge(figured, fit(figured)).where("kept")
    return out.select(*[F.col("doc_id" if c == names[id_col] else c).alias(o) for o, c in zip(docs.columns, plain, strict=True)])
