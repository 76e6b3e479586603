"""One company for all spellings of its name: matches from an index, decisions in waves, names by votes, merges to a fixpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as n
from ..functions import text as t
from ..schema import COMPANY_RANK
from ..tables import Tables, ranked
from . import name_index as index

#: Roles whose spellings stand for themselves: they are matched only with equal names.
ANCHORS = ("owner", "folder")


def company_rank(role: Column) -> Column:
    out = F.lit(99)
    for name, rank in (COMPANY_RANK | {"owner": -1}).items():
        out = F.when(role == name, rank).otherwise(out)
    return out


Adjudicator = Callable[[DataFrame], DataFrame]


def spellings(mentions: DataFrame, tables: Tables, owner: str | None = None, generic: tuple[str, ...] = t.GENERIC_DOMAINS) -> DataFrame:
    """``place, surface, domain, truncated, anchor, plain, rank, n``: distinct spellings of companies, the most trusted role first, then the earliest."""
    rows = mentions.filter("etype = 'company'").select(
        "surface", F.col("attrs")["domain"].isNotNull().alias("domain"), F.coalesce(F.col("attrs")["truncated"] == "1", F.lit(False)).alias("truncated"), "role", "id"
    )
    if owner:
        rows = rows.unionByName(mentions.sparkSession.createDataFrame([(owner, False, False, "owner", -1)], rows.schema))
    rows = rows.withColumn("rank", company_rank(F.col("role"))).filter(~(F.col("domain") & t.is_generic_domain(F.col("surface"), generic)))
    distinct = rows.groupBy("surface", "domain", "truncated").agg(
        F.min(F.struct("rank", "id")).alias("first"), F.min_by("role", F.struct("rank", "id")).alias("role"), F.sum(F.when(F.col("id") >= 0, 1).otherwise(0)).alias("n")
    )
    out = ranked(distinct, tables, "spellings", F.col("first.rank"), F.col("first.id"), F.col("surface"), column="place")
    return out.select("place", "surface", "domain", "truncated", F.col("role").isin(*ANCHORS).alias("anchor"), (F.col("role") == "free_text").alias("plain"), F.col("first.rank").alias("rank"), "n", "role")


def _edges(spelled: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """``kind, parent, score, method, leading`` of each kind of spelling, and the spellings that can name a company (``place, kind, ...``).

    Spellings of one kind are read alike, so only a kind's first can name a company; ``leading`` marks matches of a plain-text
    spelling without its first word.
    """
    firsts = tables.save(spelled.withColumn("at", F.struct("place", "anchor", "surface", "name", "full")).groupBy("kind", "domain", "cut", "plain").agg(F.min("at").alias("at")).select("kind", "domain", "cut", "plain", "at.*"), "company-kinds")
    names = firsts.filter("not domain").select("name", "cut")
    known = firsts.select(F.col("name").alias("known"))
    shorter = firsts.filter("plain and not domain").select("kind", index.normal(F.regexp_replace("surface", r"^\S+\s+", "")).alias("name"), F.lit(False).alias("cut"))
    shorter = tables.save(shorter.filter("name != ''"), "company-shorter")
    votes = firsts.filter("not domain").select("name", F.lit(False).alias("cut"))
    scores = tables.save(index.company_scores(names.unionByName(votes).unionByName(shorter.select("name", "cut")), known, tables, "company"), "company-scores")
    mail = index.domain_scores(firsts.filter("domain").select(F.lower("surface").alias("domain")), firsts.select("full"))
    mail = tables.save(mail, "company-domains")
    heads = firsts.select(F.col("name").alias("known"), "full", F.col("place").alias("parent"))
    by_name = firsts.filter("not domain").select("kind", "name", "cut").join(scores, ["name", "cut"]).join(heads, "known").select("kind", "parent", "score", "method", F.lit(False).alias("leading"))
    by_mail = firsts.filter("domain").select("kind", F.lower("surface").alias("domain")).join(mail, "domain").join(heads, "full").select("kind", "parent", "score", "method", F.lit(False).alias("leading"))
    by_rest = shorter.join(scores.filter(F.col("score") >= n.ACCEPT), ["name", "cut"]).join(heads, "known").select("kind", "parent", "score", "method", F.lit(True).alias("leading"))
    return tables.save(by_name.unionByName(by_mail).unionByName(by_rest), "company-edges"), firsts


def _decide(edges: DataFrame, firsts: DataFrame, tables: Tables, adjudicate: Adjudicator | None) -> tuple[DataFrame, DataFrame]:
    """Places of the spellings that name a company, and the unsure pairs ``place, parent`` that the adjudicator took as one.

    Spelling by spelling, one that matches no company so far becomes one. Here a wave decides every spelling whose answer is fixed by what
    is decided already: one that surely matches a company joins it; one before which nothing that it could match is
    open asks the adjudicator about its best unsure company, then tries its name without the first word, and else is a company. So
    waves are as many as the longest chain of open answers, and each reads only the edges of the spellings that are left.
    """
    own = edges.join(firsts.select("kind", "place", "anchor", "plain"), "kind").filter("parent < place").filter(~F.col("anchor") | (F.col("score") == 1.0)).filter(F.col("score") >= n.UNSURE)
    left = tables.save(own.drop("kind"), "wave-edges")
    heads = tables.save(firsts.select("place").join(left.select("place").distinct(), "place", "left_anti"), "wave-heads")
    decided, joined, step = heads.withColumn("head", F.lit(True)), None, 0
    while not left.isEmpty():
        known = left.join(decided.select(F.col("place").alias("parent"), "head"), "parent", "left")
        sure = (F.col("score") >= n.ACCEPT) & ~F.col("leading")
        seen = known.groupBy("place").agg(
            F.max(sure & F.coalesce("head", F.lit(False))).alias("sure"),
            F.max(F.col("head").isNull()).alias("open"),
            F.max(F.when(F.col("head") & ~F.col("leading"), F.struct("score", (-F.col("parent")).alias("last")))).alias("best"),
            F.max(F.col("leading") & F.coalesce("head", F.lit(False))).alias("rest"),
        )
        ready = tables.save(seen.filter("sure or not open"), f"wave-ready{step}")
        taken = ready.filter("sure").select("place")
        if adjudicate is not None:
            unsure = left.join(ready.filter("not sure and best is not null").select("place", (-F.col("best.last")).alias("parent")), ["place", "parent"]).filter(~F.col("leading")).select("place", "parent", "anchor", "score", "method")
            agreed = tables.save(adjudicate(unsure).select("place", "parent").distinct(), f"wave-agreed{step}")
            joined = agreed if joined is None else joined.unionByName(agreed)
            taken = taken.unionByName(agreed.select("place")).distinct()
        retried = ready.filter("not sure and rest and best is null").select("place")
        taken = tables.save(taken.unionByName(retried).distinct(), f"wave-taken{step}")
        now = ready.select("place").join(taken.withColumn("taken", F.lit(True)), "place", "left").select("place", F.col("taken").isNull().alias("head"))
        decided = decided.unionByName(tables.save(now, f"wave-decided{step}"))
        left, step = tables.save(left.join(ready.select("place"), "place", "left_anti"), f"wave-left{step}"), step + 1
    return decided.filter("head").select("place"), joined


def _joined(spelled: DataFrame, edges: DataFrame, heads: DataFrame, agreed: DataFrame | None) -> DataFrame:
    """``place, parent, score, method`` of the spellings that belong to another's company: the best of the companies before it, the most trusted of equal ones."""
    at = edges.join(heads.withColumnRenamed("place", "parent"), "parent").join(spelled.select("kind", "place", "anchor"), "kind").filter("parent < place").filter(~F.col("anchor") | (F.col("score") == 1.0))
    sure = at.filter((F.col("score") >= n.ACCEPT) & ~F.col("leading"))
    rest = at.filter("leading").withColumn("score", F.col("score") * 0.9).withColumn("method", F.concat(F.lit("leading_word+"), "method"))
    if agreed is not None:
        unsure = at.filter(~F.col("leading"))
        kinds = agreed.join(spelled.select("place", "kind"), "place").select("kind", "parent").distinct()
        sure = sure.unionByName(unsure.filter(F.col("score") < n.ACCEPT).join(kinds, ["kind", "parent"]).withColumn("method", F.concat(F.lit("adjudicated:"), "method")).select(sure.columns))
    unsure_only = at.filter((F.col("score") >= n.UNSURE) & ~F.col("leading")).select("place").distinct()
    best = lambda rows: rows.groupBy("place").agg(F.max_by(F.struct("parent", "score", "method"), F.struct("score", -F.col("parent"))).alias("b")).select("place", "b.*")
    return best(sure).unionByName(best(rest.join(unsure_only, "place", "left_anti")))


def companies(mentions: DataFrame, tables: Tables, owner: str | None = None, adjudicate: Adjudicator | None = None, generic: tuple[str, ...] = t.GENERIC_DOMAINS) -> tuple[DataFrame, DataFrame]:
    """``surface, domain, truncated, company, score, method`` of each spelling, and ``company, name, key, role, domain`` of each company.

    Spellings are ordered by trust. Each joins the company before it that it matches best, if the score is accepted; the best of those in the unsure band is
    shown to ``adjudicate``, which gives back the pairs that are one company. A spelling of free text that matches none is tried without its first word.
    What matches nothing is a company. Then companies are named by their spellings, and those whose names match become one, until no names match.
    Generic mail domains are no companies. Matches come from an index of names (``name_index``); no task holds all spellings.
    """
    spelled = spellings(mentions, tables, owner, generic)
    kind = F.struct("name", "domain", F.col("truncated").alias("cut"), "plain", F.when(F.col("domain"), F.lower("surface")).alias("mail"))
    spelled = spelled.withColumn("name", index.normal(F.col("surface"))).withColumn("full", index.normal(F.col("surface"), True)).withColumn("cut", F.col("truncated")).withColumn("kind", kind)
    spelled = tables.save(spelled, "company-spellings")
    edges, firsts = _edges(spelled, tables)
    heads, agreed = _decide(edges, firsts, tables, adjudicate)
    heads = tables.save(heads, "company-heads")
    links = tables.save(_joined(spelled, edges, heads, agreed), "company-links")
    rows = spelled.join(links, "place", "left").withColumn("company", F.coalesce("parent", "place"))
    rows = rows.withColumn("score", F.coalesce("score", F.lit(1.0))).withColumn("method", F.coalesce("method", F.when(F.col("anchor"), "exact").otherwise("new")))
    rows = tables.save(rows.drop("parent", "cut", "kind"), "company-rows")
    rows = merge_to_fixpoint(rows, tables.read("company-scores"), tables.read("company-domains"), tables)
    return rows.select("surface", "domain", "truncated", "company", "score", "method"), _named(rows, tables.read("company-scores"))


def merge_to_fixpoint(rows: DataFrame, scores: DataFrame, mail: DataFrame, tables: Tables) -> DataFrame:
    """``rows`` of spellings with their companies after merging: companies whose present names match either way become one, are named anew,
    and matched again, until no two names match. Two anchors never merge, nor do two domains. A group takes the company of its anchor, else of a
    name, else the one with most mentions; of several anchors the best match counts.

    After the first round only companies that have changed are matched, with all others. All scores are known from the index.
    """
    changed, step = None, 0
    while True:
        named = tables.save(_named(rows, scores).select("company", "name", "anchor", "only_domains", "n"), f"merge-names{step}")
        read = named.withColumn("norm", index.normal(F.col("name"))).withColumn("full", index.normal(F.col("name"), True)).withColumn("mail", F.lower("name"))
        read = tables.save(read, f"merge-read{step}")
        end = lambda side: read.select(*[F.col(c).alias(f"{side}_{c}") for c in ("company", "anchor", "only_domains", "n", "norm", "full", "mail")])  # noqa: E731, B023
        a, b = end("a"), end("b")
        by_name = scores.filter("not cut").filter(F.col("score") >= n.ACCEPT).select(F.col("name").alias("a_norm"), F.col("known").alias("b_norm"), "score", "method")
        by_name = a.filter("not a_only_domains").join(by_name, "a_norm").join(b.filter("not b_only_domains"), "b_norm")
        by_mail = a.filter("a_only_domains").join(mail.select(F.col("domain").alias("a_mail"), F.col("full").alias("b_full"), "score", "method"), "a_mail").join(b.filter("not b_only_domains"), "b_full")
        columns = [*a.columns, *b.columns, "score", "method"]
        pairs = by_name.select(columns).unionByName(by_mail.select(columns)).filter("a_company != b_company and not (a_anchor and b_anchor)")
        if changed is not None:
            pairs = pairs.join(changed.select(F.col("company").alias("a_company"), F.lit(True).alias("new_a")), "a_company", "left").join(changed.select(F.col("company").alias("b_company"), F.lit(True).alias("new_b")), "b_company", "left").filter("new_a or new_b").drop("new_a", "new_b")
        pairs = tables.save(pairs, f"merge-pairs{step}")
        if pairs.isEmpty():
            return rows
        # Free companies that match are one group; the group then belongs to the anchor that any of them matches best.
        free = pairs.filter("not a_anchor and not b_anchor").select(F.greatest("a_company", "b_company").alias("node"), F.least("a_company", "b_company").alias("parent"))
        groups = connected(free, tables, f"merge-groups{step}")
        held = pairs.filter("a_anchor or b_anchor").select(F.when(F.col("a_anchor"), F.col("b_company")).otherwise(F.col("a_company")).alias("node"), F.when(F.col("a_anchor"), F.col("a_company")).otherwise(F.col("b_company")).alias("to"), "score")
        held = held.join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
        by_anchor = held.groupBy("group").agg(F.max_by("to", F.struct("score", -F.col("to"))).alias("to"))
        members = groups.select("node", "group").unionByName(held.select("node", "group")).distinct().join(read.select(F.col("company").alias("node"), "only_domains", "n"), "node")
        by_size = members.groupBy("group").agg(F.max_by("node", F.struct(~F.col("only_domains"), "n", -F.col("node"))).alias("largest"))
        target = members.join(by_size, "group").join(by_anchor, "group", "left").select("node", F.coalesce("to", "largest").alias("target"))
        why = pairs.select(F.explode(F.array("a_company", "b_company")).alias("node"), "score", "method").groupBy("node").agg(F.max_by("method", "score").alias("merge_method"), F.max("score").alias("merge_score"))
        moved = tables.save(target.filter("node != target").join(why, "node").withColumnRenamed("node", "company"), f"merge-moved{step}")
        out = rows.join(moved, "company", "left")
        out = out.withColumns({
            "company": F.coalesce("target", "company"), "score": F.when(F.col("target").isNotNull(), F.least("score", "merge_score")).otherwise(F.col("score")),
            "method": F.when(F.col("target").isNotNull(), F.concat(F.lit("merged:"), "merge_method")).otherwise(F.col("method")),
        }).drop("target", "merge_score", "merge_method")
        rows = tables.save(out.select(rows.columns), f"merge-rows{step}")
        changed, step = moved.select(F.col("target").alias("company")).distinct(), step + 1


def connected(links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """``node, group`` of ``links`` (``node, parent``): the smallest node that a node hangs together with. Each round every node takes the smallest group next to it,
    then the group of that group."""
    both = tables.save(links.select("node", F.col("parent").alias("other")).unionByName(links.select(F.col("parent").alias("node"), F.col("node").alias("other"))).distinct(), f"{name}-links")
    found, step = both.select("node").distinct().withColumn("group", F.col("node")), 0
    while True:
        seen = both.join(found.withColumnRenamed("node", "other").withColumnRenamed("group", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        lower = tables.save(found.join(seen, "node").select("node", F.least("group", "near").alias("low"), "group"), f"{name}-low{step}")
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("lowest"))
        now = lower.join(jump, "low", "left").select("node", F.coalesce("lowest", "low").alias("group"), (F.coalesce("lowest", "low") != F.col("group")).alias("moved"))
        now, step = tables.save(now, f"{name}-{step}"), step + 1
        found = now.select("node", "group")
        if now.filter("moved").isEmpty():
            return found


def _named(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Each company's name: an anchor's as it is; else the spelling that its spellings, by their numbers, speak for most; a longer one never speaks for a shorter name.
    Domains and file names never name a company that has another spelling. Spellings speak by the index's scores, so only those that match meet."""
    good = rows.filter(~F.col("domain") & (F.col("role") != "filename") & (F.col("name") != ""))
    keyed = good.groupBy("company", "name").agg(F.sum("n").alias("n"), F.max_by("surface", F.struct("n", -F.col("place"))).alias("surface"))
    other = keyed.select("company", F.col("name").alias("spelling"), F.col("n").alias("votes"))
    longer = F.array_contains(F.split("method", r"\+"), "truncation") & (F.size(F.split("name", " ")) > F.size(F.split("known", " ")))
    speaks = scores.filter("not cut").select(F.col("name").alias("spelling"), F.col("known").alias("name"), F.when(longer, 0.0).otherwise(F.col("score")).alias("speaks"))
    voted = keyed.join(speaks, "name").join(other, ["company", "spelling"]).groupBy("company", "surface", "n").agg(F.round(F.sum(F.col("votes") * F.col("speaks")), 9).alias("support"))
    best = voted.groupBy("company").agg(F.max_by("surface", F.struct("support", "n", "surface")).alias("voted"))
    anchors = rows.filter("anchor").groupBy("company").agg(F.min_by("surface", "place").alias("anchored"), F.min_by("role", "place").alias("anchor_role"))
    any_ = rows.groupBy("company").agg(
        F.min_by("surface", "place").alias("first"), F.min(F.when(F.col("domain"), F.col("surface"))).alias("mail_domain"), F.min("domain").alias("only_domains"), F.sum("n").alias("n")
    )
    out = any_.join(best, "company", "left").join(anchors, "company", "left").withColumn("name", F.coalesce("anchored", "voted", "first"))
    role = F.when(F.col("anchor_role") == "owner", "owner").when(F.col("anchor_role") == "folder", "customer")
    key = F.when(F.col("only_domains"), F.concat(F.lit("domain:"), "name")).otherwise(t.company_key(F.col("name")))
    return out.select("company", "name", key.alias("key"), role.alias("role"), F.col("mail_domain").alias("domain"), F.col("anchored").isNotNull().alias("anchor"), "only_domains", "n")
