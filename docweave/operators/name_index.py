"""Which company names can match each other, without comparing all with all.

Names meet along their words. First, distinct words meet under keys of which two words share one if a rule lets the first stand for
the second: the word itself, the beginnings that a known word posts for abbreviations and those that a longer word probes, and what
is left of it without one or two letters, for typos. The keys are asymmetric: only known words post short beginnings, only words that were cut
off probe them. Then names walk along the words that stand for each other, as the scores align them: one word for one, two joined for one, one
for two joined. Where many known names go the same way, the walk goes on to their next words; a way that few share gives its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as n
from ..tables import Tables

#: Known names on one way up to which all of them are taken as candidates.
FEW = 20


def _without_letters(word: str, times: int) -> set[str]:
    found = {word}
    for _ in range(times):
        found |= {w[:i] + w[i + 1 :] for w in found for i in range(len(w))}
    return found


def _typo_keys(word: str) -> set[str]:
    return {"d:" + w for w in _without_letters(word, 2 if len(word) >= 8 else 1)} if len(word) >= 5 else set()


def probe_keys(word: str, cut: bool, joined: bool) -> list[str]:
    """Keys under which a known word that ``word`` can stand for is posted; ``joined``: one of the two words is put together from two."""
    keys = {"=" + word} | _typo_keys(word)
    if not joined:
        keys |= {"=" + word[:k] for k in range(4, len(word))}
        if cut or len(word) >= 3:
            keys.add(("a:" if len(word) >= 3 else "t:") + word)
    return sorted(keys)


def post_keys(word: str, joined: bool) -> list[str]:
    keys = {"=" + word} | _typo_keys(word)
    if not joined:
        keys |= {("a:" if k >= 3 else "t:") + word[:k] for k in range(1, len(word))}
    return sorted(keys)


def normal(surface: Column, suffixes: bool = False) -> Column:
    """A name's words as the scores compare them, in one string."""
    return F.pandas_udf(lambda s: s.map(lambda x: " ".join(n.company_words(x, suffixes)) if x is not None else ""), "string")(surface)


def _stand_for(words: DataFrame, known: DataFrame, joined: bool) -> DataFrame:
    """``word, cut, stands_for``: each of ``words`` (``word, cut``) with the ``known`` ones (``word``) that it can stand for."""
    probe = F.pandas_udf(lambda w, c: pd.Series([probe_keys(x, bool(y), joined) for x, y in zip(w, c, strict=True)]), "array<string>")
    post = F.pandas_udf(lambda w: w.map(lambda x: post_keys(x, joined)), "array<string>")
    asked = words.distinct().select("word", "cut", F.explode(probe("word", "cut")).alias("key"))
    posted = known.distinct().select(F.col("word").alias("stands_for"), F.explode(post("word")).alias("key"))
    rule = F.pandas_udf(lambda a, b, c: pd.Series([(m[1] if (m := n.match_word(x, y, bool(z))) else None) for x, y, z in zip(a, b, c, strict=True)], dtype="object"), "string")
    met = asked.join(posted, "key").select("word", "cut", "stands_for").distinct().withColumn("rule", rule("word", "stands_for", "cut"))
    return met.filter(F.col("rule").isin("", "typo") if joined else F.col("rule").isNotNull()).drop("rule")


def _steps(rows: DataFrame, words: str, at: str) -> DataFrame:
    """Rows with their ``unit`` of one word (``size`` 1) and, where there is one, of the next two joined (2), and the place after it."""
    one, two = F.try_element_at(words, F.col(at) + 1), F.concat(F.try_element_at(words, F.col(at) + 1), F.try_element_at(words, F.col(at) + 2))
    made = F.array(F.struct(one.alias("unit"), F.lit(1).alias("size")), F.struct(two.alias("unit"), F.lit(2).alias("size")))
    out = rows.select("*", F.explode(made).alias("step")).filter("step.unit is not null").select("*", "step.*").drop("step")
    return out.withColumn(at, F.col(at) + F.col("size"))


def candidates(mentions: DataFrame, known: DataFrame, tables: Tables, name: str) -> DataFrame:
    """``name, cut, known``: every pair of ``mentions`` (``name, cut``) and ``known`` (``known``) that ``names.match_company`` can match, and few others.
    Names are normal ones."""
    mentions = tables.save(mentions.filter("name != ''").distinct().withColumn("words", F.split("name", " ")), f"{name}-mentions")
    known = tables.save(known.filter("known != ''").distinct().withColumn("kwords", F.split("known", " ")), f"{name}-known")
    # Every word, and every two neighbours joined, of either side.
    of = lambda rows, words: rows.select("*", F.posexplode(words).alias("p", "word"), F.size(words).alias("n"), F.col(words).alias("w"))
    single = of(mentions, "words").select("word", (F.col("cut") & (F.col("p") == F.col("n") - 1)).alias("cut"), F.concat("word", F.try_element_at("w", F.col("p") + 2)).alias("two"), (F.col("cut") & (F.col("p") == F.col("n") - 2)).alias("two_cut"))
    posted = of(known, "kwords").select("word", F.concat("word", F.try_element_at("w", F.col("p") + 2)).alias("two"))
    pairs_of = lambda rows: rows.select(F.col("two").alias("word"), F.col("two_cut").alias("cut")).filter("word is not null")
    plain = _stand_for(single.select("word", "cut"), posted.select("word"), False).select("*", F.lit(1).alias("own_size"), F.lit(1).alias("known_size"))
    joined = _stand_for(pairs_of(single), posted.select("word"), True).select("*", F.lit(2).alias("own_size"), F.lit(1).alias("known_size"))
    split = _stand_for(single.select("word", "cut"), posted.select(F.col("two").alias("word")).filter("word is not null"), True).select("*", F.lit(1).alias("own_size"), F.lit(2).alias("known_size"))
    words = tables.save(plain.unionByName(joined).unionByName(split), f"{name}-words")

    found = mentions.filter((F.size("words") == 1) & F.length("name").between(2, 5)).join(
        known.filter(F.size("kwords") > 1).select("known", F.array_join(F.transform("kwords", lambda w: F.substring(w, 1, 1)), "").alias("name")), "name"
    )
    found = found.select("name", "cut", "known").unionByName(mentions.withColumn("all", F.replace("name", F.lit(" "))).join(known.withColumn("all", F.replace("known", F.lit(" "))), "all").select("name", "cut", "known"))
    found = [tables.save(found, f"{name}-whole")]
    ours, theirs, depth = mentions.withColumn("i", F.lit(0)), known.withColumn("j", F.lit(0)), 0
    ours, theirs = ours.withColumn("way", F.lit("")), theirs.withColumn("way", F.lit(""))
    while True:
        steps = _steps(ours, "words", "i").withColumn("word_cut", F.col("cut") & (F.col("i") == F.size("words")))
        rules = words.select(F.col("word").alias("unit"), F.col("cut").alias("word_cut"), "stands_for", F.col("own_size").alias("size"), "known_size")
        walked = steps.join(rules, ["unit", "word_cut", "size"])
        onward = F.concat("way", F.lit("/"), F.col("known_size").cast("string"), "stands_for")
        ours = tables.save(walked.select("name", "cut", "words", "i", onward.alias("way")).distinct(), f"{name}-ours{depth}")
        theirs = _steps(theirs, "kwords", "j").select("known", "kwords", "j", F.concat("way", F.lit("/"), F.col("size").cast("string"), "unit").alias("way"))
        theirs = tables.save(theirs.join(ours.select("way").distinct(), "way", "left_semi"), f"{name}-theirs{depth}")
        ways = tables.save(theirs.groupBy("way").agg(F.count("*").alias("n_known")), f"{name}-ways{depth}")
        here = ours.join(ways, "way")
        ended = F.col("i") == F.size("words")
        # Few go this way, or the mention ends here; a known name that ends here takes the mention's other words as too many.
        out = here.filter((F.col("n_known") <= FEW) | ended).join(theirs, "way").select("name", "cut", "known")
        out = out.unionByName(here.filter((F.col("n_known") > FEW) & ~ended).join(theirs.filter("j = size(kwords)"), "way").select("name", "cut", "known"))
        found.append(tables.save(out, f"{name}-pairs{depth}"))
        ours = here.filter((F.col("n_known") > FEW) & ~ended).drop("n_known")
        if ours.isEmpty():
            break
        theirs, depth = theirs.join(ways.filter(F.col("n_known") > FEW).select("way"), "way", "left_semi"), depth + 1
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.distinct()


def _company_scores(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for names, known, cuts in batches:
        rows = [n.match_company(m, c, bool(cut)) for m, c, cut in zip(names, known, cuts, strict=True)]
        yield pd.DataFrame({"score": [r[0] if r else None for r in rows], "method": ["+".join(sorted(r[1])) if r else None for r in rows]})


def company_scores(mentions: DataFrame, known: DataFrame, tables: Tables, name: str) -> DataFrame:
    """``name, cut, known, score, method`` of all pairs of normal names that match at all."""
    pairs = candidates(mentions, known, tables, name)
    scored = pairs.withColumn("m", F.pandas_udf(_company_scores, "score double, method string")("name", "known", "cut"))
    return scored.filter("m.score is not null").select("name", "cut", "known", "m.*")


def _domain_probes(domain: str) -> list[str]:
    label = "".join(c for c in domain.lower().split(".")[0] if c.isascii() and c.isalnum())
    return [f"{label[:k]}/{label[k : k + 2]}" for k in range(1, len(label) + 1)]


def _domain_posts(full: str) -> list[str]:
    """The first word with the first two letters of each word that may come next; alone, for a domain that ends there."""
    words = full.split()
    out = [words[0] + "/"]
    for word in words[1:]:
        if len(word) > 1:
            out.append(f"{words[0]}/{word[:2]}")
        if word not in n.LEGAL_SUFFIXES:
            break
    return sorted(set(out))


def domain_scores(domains: DataFrame, known: DataFrame) -> DataFrame:
    """``domain, full, score, method`` of all ``domains`` (``domain``) and ``known`` names (``full``: normal, with legal suffixes) that match."""
    keys = lambda f: F.pandas_udf(lambda s: s.map(f), "array<string>")
    asked = domains.distinct().select("domain", F.explode(keys(_domain_probes)("domain")).alias("key"))
    posted = known.filter("full != ''").distinct().select("full", F.explode(keys(_domain_posts)("full")).alias("key"))
    fits = F.pandas_udf(lambda d, c: pd.Series([n.match_domain(x, y) is not None for x, y in zip(d, c, strict=True)], dtype="bool"), "boolean")
    return asked.join(posted, "key").select("domain", "full").distinct().filter(fits("domain", "full")).withColumns({"score": F.lit(n.DOMAIN), "method": F.lit("email_domain")})
