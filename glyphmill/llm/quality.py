"""Quality rules combined by weak supervision, in DataFrame functions only.

Rules look at one text and vote good (+1), bad (-1) or abstain (0). Expectation-maximisation over the counts of
vote patterns (at most 3 ** len(votes()) rows for each label, whatever the input) estimates for every rule how often it votes
and how often its vote is right; the posterior probability of quality replaces "all rules must pass". A text is good, or
bad in one of several ways (shouted texts and toxic ones have little in common), so the bad class is a mixture. A bounded sample of
labels, where there are any, says which class is the bad one: the class of a labelled text isn't estimated. All other texts
have no label, and all of them count.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.storage import materialize

SYMBOLS = "#*$%&|<>"
#: Abusive English words, one more sign for the rule of abuse. What labels show is learned (toxic_words).
ABUSE = ("trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "scum", "loser", "moron", "whore")
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
POSTERIOR = 0.5
ROUNDS = 20
#: The fit of toxic words: labels of a class used at most, languages, words kept for each language, toxic texts that a word
#: needs, its least log-odds, and the sum of log-odds from which a text is toxic (no word reaches it alone in small tables).
LABELS, LANGUAGES, LEXICON, LEAST_TOXIC, ODDS, TOXIC = 20_000, 20, 200, 3, 3.5, 6.0
#: Letters that shouting consists of.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÀÇÑÓÍÁÚ"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _covered(positions: Column, width: int) -> Column:
    """Words covered by windows that start at the ascending positions."""
    return F.aggregate(
        positions,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("at")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["at"])).cast("long").alias("n"), p.alias("at")),
        lambda a: a["n"],
    )


def _tokens(text: Column) -> Column:
    """Lower-case words without punctuation, some of them empty."""
    return F.split(F.lower(text), r"[\x20\x09-\x0D.,;:!?\"'()\[\]{}<>|/\\*#$%&+=~`^_-]+")


def toxic_words(docs: DataFrame, labels: DataFrame | None) -> dict[str, dict[str, float]]:
    """Language -> word -> log-odds of the share of toxic labelled texts with the word against that of clean ones.

    At most about LABELS labels of either class are used, chosen by a hash of doc_id, so the fit doesn't grow with the
    tables. A language whose labels single out no word is missing.
    """
    if labels is None or not {"doc_id", "lang"} <= set(docs.columns):
        return {}
    n = {r["toxic"]: r["count"] for r in labels.filter("toxic in (0, 1)").groupBy("toxic").count().collect()}
    if len(n) < 2:
        return {}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.when(F.col("toxic") == 1, (LABELS << 20) // n[1]).otherwise((LABELS << 20) // n[0])
    some = F.broadcast(labels.filter("toxic in (0, 1)").filter(part).select("doc_id", F.col("toxic").cast("int").alias("toxic")))
    # The empty word stands for the text itself: its counts are those of the texts.
    words = F.array_distinct(F.concat(_tokens(F.col("text")), F.array(F.lit(""))))
    rows = docs.select("doc_id", "lang", "text").filter("lang is not null and text is not null").join(some, "doc_id").select("lang", "toxic", F.explode(words).alias("w"))
    counts = rows.groupBy("lang", "w").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).filter(F.col("pos") >= LEAST_TOXIC)
    counts = materialize(counts, "toxic")
    out = {}
    for r in counts.filter("w = ''").orderBy(F.desc("pos"), "lang").limit(LANGUAGES).collect():
        odds = F.log((F.col("pos") + 0.5) / (r["pos"] + 1)) - F.log((F.col("neg") + 0.5) / (r["neg"] + 1))
        own = counts.filter((F.col("lang") == r["lang"]) & (F.col("w") != "")).select("w", odds.alias("odds"), (odds * F.col("pos")).alias("rank")).filter(F.col("odds") >= ODDS)
        found = own.orderBy(F.desc("rank"), "w").limit(LEXICON).collect()
        if found:
            out[r["lang"]] = {x["w"]: x["odds"] for x in found}
    return out


def _learned(text: Column, lang: Column, words: dict[str, dict[str, float]]) -> Column:
    """Sum of the log-odds of a text's distinct toxic words; null where its language has no evidence."""
    if not words:
        return F.lit(None).cast("double")
    table = F.create_map(*[x for k, v in words.items() for x in (F.lit(k), F.create_map(*[F.lit(y) for pair in v.items() for y in pair]))])
    own = F.try_element_at(table, lang)
    return F.aggregate(F.array_intersect(_tokens(text), F.map_keys(own)), F.lit(0.0), lambda a, w: a + F.try_element_at(own, w))


def measure(docs: DataFrame, words: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what else the rules need in _q.

    words: toxic words by language, for the column lang of docs. A null text has no words; an empty table gives an empty table. Other columns of docs pass unchanged.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # Signs that are counted, cut out once: what follows looks at a short string.
    marks = F.regexp_replace(text, f"[^!{SYMBOLS}{CAPITALS}]+", "")
    df = docs.withColumns({"_words": _words(text), "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), "_marks": marks})
    df = df.withColumn("_n", F.size("_words"))
    # Each word is hashed once, a window from the hashes of its words. Distinct hashes prove distinct windows; of texts with an
    # equal pair only the windows with a hash of another are looked at word by word.
    df = df.withColumn("_ids", F.when(F.col("_n") > WINDOW, F.transform("_words", lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))
    begins = F.slice("_ids", F.lit(1), F.greatest(F.size("_ids") - WINDOW + 1, F.lit(0)))
    df = df.withColumn("_hash", F.transform(begins, lambda h, i: F.xxhash64(h, *[F.get("_ids", i + k) for k in range(1, WINDOW)])))
    df = df.withColumn("_same", F.size("_hash") > F.size(F.array_distinct("_hash")))
    df = df.withColumn("_order", F.when(F.col("_same"), F.sort_array(F.transform("_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("_met", F.filter("_order", lambda x, k: (x["h"] == F.get("_order", k - 1)["h"]) | (x["h"] == F.get("_order", k + 1)["h"])))
    windows = F.sort_array(F.transform("_met", lambda x: F.struct(F.concat_ws(" ", *[F.get("_words", x["i"] + k) for k in range(WINDOW)]).alias("w"), x["i"].alias("i"))))
    df = df.withColumn("_win", F.when(F.col("_same"), windows))
    repeats = F.sort_array(
        F.transform(
            F.filter(
                F.col("_win"),
                lambda x, k: (x["w"] == F.get("_win", k - 1)["w"]) | (x["w"] == F.get("_win", k + 1)["w"]),
            ),
            lambda x: x["i"],
        )
    )
    repeats = F.when(F.col("_same"), repeats)
    df = df.withColumn("_at", repeats)
    low = F.lower(text)
    # The pattern is slow: texts without any of the words needn't be searched.
    listed = reduce(or_, [F.contains(low, F.lit(w)) for w in ABUSE])
    abuse = F.when(listed, F.regexp_count(low, F.lit(r"\b(" + "|".join(ABUSE) + r")\b"))).otherwise(0)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    n_marks = lambda signs: F.length("_marks") - F.length(F.translate("_marks", signs, ""))
    df = df.select(
        *docs.columns,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        n_marks(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("_at"), WINDOW), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.struct(
            F.size("_lines").alias("lines"),
            abuse.alias("abuse"),
            _learned(text, lang, words or {}).alias("toxic"),
            F.coalesce(lang == "en", F.lit(False)).alias("listed"),
            n_marks("!").alias("bangs"),
            n_marks(CAPITALS).alias("upper"),
            F.regexp_count(text, F.lit(r"[\x20\n]\|[\x20\n]")).alias("bars"),
        ).alias("_q"),
    )
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    return df.withColumn("base_failed", failed)


def votes() -> dict[str, Column]:
    """Rule name -> +1, -1 or 0 from the measures. Between its two bounds a rule abstains.

    The abuse rule finds a text good only where its language has evidence: learned words, or the list for English.
    """
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")

    def rule(x: Column, good: float, bad: float) -> Column:
        return F.when(x <= good, 1).when(x >= bad, -1).otherwise(0).cast("int")

    mean = chars / n
    listed = (F.col("_q.abuse") >= 3) | (F.col("_q.abuse") / n >= 0.004)
    toxic, known = F.coalesce("_q.toxic", F.lit(0.0)), F.col("_q.toxic").isNotNull() | F.col("_q.listed")
    return {
        "symbols": rule(F.col("n_symbols") / n, 0.05, 0.3),
        "bars": rule(F.col("_q.bars") / n, 0.03, 0.15),
        "shouting": rule(F.col("_q.upper") / chars, 0.15, 0.5),
        "bangs": rule(F.col("_q.bangs") / n, 0.05, 0.4),
        "same_lines": rule(F.col("n_dup_lines") / F.greatest(F.col("_q.lines"), F.lit(1)), 0.1, 0.4),
        "repeats": rule(F.col("n_repeat_words") / n, 0.05, MAX_REPEAT_PERCENT / 100),
        "length": F.when(n < MIN_WORDS, -1).when(n >= 30, 1).otherwise(0).cast("int"),
        "word_length": F.when((mean < 2) | (mean > 14), -1).when((mean >= 3) & (mean <= 10), 1).otherwise(0).cast("int"),
        "abuse": F.when(listed | (toxic >= TOXIC), -1).when((F.col("_q.abuse") == 0) & (toxic == 0) & known, 1).otherwise(0).cast("int"),
    }


#: Start of the estimates: the share of good texts; the shares of votes of any rule among them; and for each way of being bad, which
#: begins with one rule, those of that rule and of the others.
PRIOR = 0.8
GOOD, OWN, OTHERS = {1: 0.9, 0: 0.08, -1: 0.02}, {1: 0.1, 0: 0.1, -1: 0.8}, {1: 0.8, 0: 0.12, -1: 0.08}
#: Votes added to each estimate, so that none reaches 0 or 1.
SMOOTHING = 1.0


class Model:
    """Estimates: prior, the shares of the classes (good texts and the ways of being bad), and shares, those of the votes of each class and rule."""

    def __init__(self, names: list[str]):
        self.names, self.classes = names, ["good", *names]
        self.prior = {c: PRIOR if c == "good" else (1 - PRIOR) / len(names) for c in self.classes}
        self.shares = {c: {n: dict(GOOD if c == "good" else OWN if c == n else OTHERS) for n in names} for c in self.classes}

    def weights(self) -> dict[str, Column]:
        """Class -> probability of the class and of the votes in it, from columns named as the rules."""
        out = {}
        for c in self.classes:
            # Shares as arrays, not as conditions: code that Spark generates for one round then serves the others.
            base = {n: math.log(self.prior[c]) if n == self.names[0] else 0.0 for n in self.names}
            logs = {n: ", ".join(f"{base[n] + math.log(self.shares[c][n][v])!r}D" for v in (-1, 0, 1)) for n in self.names}
            out[c] = F.expr("exp(" + " + ".join(f"get(array({x}), `{n}` + 1)" for n, x in logs.items()) + ")")
        return out

    def weighed(self, df: DataFrame) -> DataFrame:
        """df with the weights as columns _w_class and their sum _w."""
        return df.withColumns({f"_w_{c}": w for c, w in self.weights().items()}).withColumn("_w", sum((F.col(f"_w_{c}") for c in self.classes), F.lit(0.0)))

    def scored(self, df: DataFrame) -> DataFrame:
        """df with posterior, the probability of quality."""
        return self.weighed(df).withColumn("posterior", F.col("_w_good") / F.col("_w")).drop("_w", *[f"_w_{c}" for c in self.classes])

    def update(self, sums: dict[tuple[str, str, int], float]) -> None:
        """The estimates that make the expected counts likeliest, given that a vote is right at least as often as wrong.

        Where the counts would have a rule's bad votes commoner among good texts than in a bad class (or its good votes
        rarer), both get the common share, so that the vote doesn't tell them apart.
        """
        first = self.names[0]
        size = {c: sum(sums.get((c, first, v), 0.0) for v in (-1, 0, 1)) for c in self.classes}
        total = sum(size.values()) + SMOOTHING * len(size)
        self.prior = {c: (x + SMOOTHING) / total for c, x in size.items()}
        for n in self.names:
            for c in self.classes:
                self.shares[c][n] = {v: (sums.get((c, n, v), 0.0) + SMOOTHING) / (size[c] + 3 * SMOOTHING) for v in (-1, 0, 1)}
            good = dict(self.shares["good"][n])
            for c in self.names:
                mine = self.shares[c][n]
                for v, wrong in ((-1, good[-1] > mine[-1]), (1, good[1] < mine[1])):
                    if wrong:
                        mine[v] = good[v]
                mine[0] = max(1 - mine[-1] - mine[1], SMOOTHING / (size[c] + 3 * SMOOTHING))
                total = sum(mine.values())
                self.shares[c][n] = {v: x / total for v, x in mine.items()}


def fit(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> Model:
    """EM over (one column per rule, label, n). Each round is one aggregation to a row for each rule and vote.

    label: 1 good, 0 bad in a way that is estimated, null unknown. Labelled texts together weigh as much as the others do, so
    their say doesn't fade as tables grow. Ends once the share of good texts stays the same.
    """
    model = Model(names)
    total = patterns.agg(F.sum(F.when(F.col("label").isNull(), F.col("n"))), F.sum(F.when(F.col("label").isNotNull(), F.col("n")))).first()
    weight = max(1.0, (total[0] or 0) / total[1]) if total[1] else 1.0
    n = F.when(F.col("label").isNull(), F.col("n")).otherwise(F.col("n") * weight)
    ballots = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("vote")) for r in names])).alias("b")
    for _ in range(rounds):
        w = model.classes
        some = F.when(F.col("label").isNull(), F.col("_w")).when(F.col("label") == 1, F.col("_w_good")).otherwise(F.col("_w") - F.col("_w_good"))
        part = {c: F.when(F.col("label").isNull() | ((F.col("label") == 1) == F.lit(c == "good")), F.col("_n") * F.col(f"_w_{c}")).otherwise(0.0) for c in w}
        rows = model.weighed(patterns).withColumn("_n", n / some).select(*[x.alias(f"p_{c}") for c, x in part.items()], ballots)
        rows = rows.groupBy("b.rule", "b.vote").agg(*[F.sum(f"p_{c}").alias(f"p_{c}") for c in w]).collect()
        if not rows:
            return model
        before = model.prior["good"]
        model.update({(c, r["rule"], r["vote"]): r[f"p_{c}"] for r in rows for c in w})
        if abs(model.prior["good"] - before) < 1e-5:
            break
    return model


def _labelled(labels: DataFrame | None) -> DataFrame | None:
    """labeled, label of a bounded sample, at most about LABELS of either class: good unless of quality 0 or toxic."""
    if labels is None:
        return None
    good = F.when((F.min("quality") == 0) | (F.max("toxic") == 1), 0).when((F.min("quality") == 1) & F.coalesce(F.max("toxic") == 0, F.lit(True)), 1)
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("labeled")).agg(good.cast("int").alias("label")).filter("label is not null")
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, (LABELS << 20) // n.get(1, 1)).otherwise((LABELS << 20) // n.get(0, 1))
    return F.broadcast(known.filter(F.pmod(F.xxhash64("labeled"), F.lit(1 << 20)) < share))


def judge(docs: DataFrame, words: dict[str, dict[str, float]] | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Rows of docs with the measures, base_failed, posterior and kept. words: toxic words by language; labels need doc_id in docs.

    kept: not base_failed and the posterior is at least POSTERIOR. Null and empty texts have no words, so fail.
    Equal texts of a language get equal verdicts; rows are never merged. One pass over the texts, whose measures are written
    with what else is in docs.
    """
    names = list(votes())
    voted = materialize(measure(docs, words).withColumns(votes()).drop("_q", "text"), "measures")
    some = _labelled(labels) if "doc_id" in docs.columns else None
    if some is None:
        marked = voted.select(*names, F.lit(None).cast("int").alias("label"))
    else:
        marked = voted.select(*names, "doc_id").join(some, F.col("doc_id") == F.col("labeled"), "left").select(*names, "label")
    patterns = materialize(marked.groupBy(*names, "label").agg(F.count("*").alias("n")).coalesce(1), "votes")
    model = fit(patterns, names)
    out = model.scored(voted).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= POSTERIOR))
    return out.drop(*names)


def _judged(docs: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "text", "lang") if c in docs.columns]


def keep_good(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows of docs whose verdict is kept, with the columns of docs, whatever their names.

    Null and empty texts go, equal rows stay or go together, an empty table stays empty.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.select(*_judged(docs), F.struct(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own)]).alias("_row"))
    kept = judge(inner, toxic_words(docs, labels), labels).filter("kept")
    return kept.select(*[F.col(f"_row.{o}").alias(c) for c, o in zip(docs.columns, own)])


def op3(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The result rows of the quality query. labels: doc_id, quality, toxic; without them only the English list speaks of abuse."""
    out = judge(docs.select("doc_id", *[c for c in _judged(docs) if c != "doc_id"]), toxic_words(docs, labels), labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
