"""Entities from mentions: products by code, projects by job id, documents by number, people by name and e-mail."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..functions.titles import alike
from ..tables import Tables, partitions


def products(mentions: DataFrame) -> DataFrame:
    """``key, name, n``: a product for each code (or spelling without one), named by its most frequent
    description, the first of several; without any, by its code."""
    rows = mentions.filter("etype = 'product'").withColumn("key", F.coalesce(F.col("attrs")["code"], F.col("surface"))).withColumn("description", F.col("attrs")["description"])
    counted = rows.groupBy("key", "description").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    best = F.max_by("description", F.when(F.col("description").isNotNull(), F.struct("n", -F.col("first_id"))))
    named = counted.groupBy("key").agg(best.alias("description"), F.sum("n").alias("n"))
    return named.select("key", F.coalesce(F.concat_ws(" ", "description", "key"), F.col("key")).alias("name"), "n")


def projects(mentions: DataFrame) -> DataFrame:
    """``key, title, n_files`` of projects with a job id; what folders say goes first, then the earliest mention."""
    rows = mentions.filter("etype = 'project'").withColumn("key", F.col("attrs")["job_id"]).filter("key is not null")
    order = F.struct(F.col("role") != "folder", F.col("id"))
    title = F.min_by(F.col("attrs")["title"], F.when(F.col("attrs")["title"].isNotNull(), order))
    return rows.groupBy("key").agg(title.alias("title"), F.countDistinct("file_id").alias("n_files"))


def counterparties(facts: DataFrame, owner: int | None = None) -> DataFrame:
    """``document, company``: the first other party that a document's facts state, not the owner."""
    stated = facts.filter(F.col("rel").isin("ISSUED_TO", "ADDRESSED_TO", "DESCRIBES")).select(F.col("src").alias("document"), F.col("dst").alias("company"), "id")
    parties = facts.filter("rel = 'PARTY_TO'").select(F.col("dst").alias("document"), F.col("src").alias("company"), "id")
    every = stated.unionByName(parties)
    if owner is not None:
        every = every.filter(F.col("company") != owner)
    return every.groupBy("document").agg(F.min_by("company", "id").alias("company"))


def documents(mentions: DataFrame, parties: DataFrame) -> DataFrame:
    """``id, key, method`` for each document mention (``number``): its number; where several counterparties
    (``document``: a mention's id, ``company``) use one number, the number and the mention's own counterparty.

    A mention without a counterparty of such a number is ambiguous and gets no key.
    """
    rows = mentions.filter("etype = 'document'").withColumn("number", F.coalesce(F.col("attrs")["key"], F.col("surface")))
    rows = rows.join(parties.select(F.col("document").alias("id"), "company"), "id", "left")
    users = rows.filter("company is not null").groupBy("number").agg(F.countDistinct("company").alias("users"))
    rows = rows.join(users, "number", "left").withColumn("users", F.coalesce("users", F.lit(0)))
    reused = F.col("users") > 1
    key = F.when(~reused, F.col("number")).when(F.col("company").isNotNull(), F.concat_ws("@", "number", "company"))
    method = F.when(~reused, "doc_number").when(F.col("company").isNotNull(), "doc_number+counterparty").otherwise("ambiguous_number")
    return rows.select("id", key.alias("key"), method.alias("method"))


def merged_attributes(mentions: DataFrame, names: list[str], conflicting: tuple[str, ...] = ("total", "date", "job_title")) -> DataFrame:
    """``entity_id``, the first value of each attribute by mention id, and ``conflicts``: all values of those that differ. A type of
    ``other`` gives way to the first that says more."""
    vague = lambda n: (F.col("attrs")[n] == "other") if n == "doc_type" else F.lit(False)
    order = lambda n: F.when(F.col("attrs")[n].isNotNull(), F.struct(vague(n).alias("vague"), "id"))
    first = [F.min_by(F.col("attrs")[n], order(n)).alias(n) for n in names]
    values = [F.sort_array(F.collect_set(F.col("attrs")[n])).alias(f"all_{n}") for n in conflicting if n in names]
    merged = mentions.filter("entity_id is not null").groupBy("entity_id").agg(*first, *values)
    listed = [n for n in conflicting if n in names]
    pairs = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in listed]), F.array(*[F.col(f"all_{n}") for n in listed])), lambda _, v: F.size(v) > 1)
    return merged.withColumn("conflicts", pairs).drop(*[f"all_{n}" for n in listed])


def people(mentions: DataFrame, folders: DataFrame | None = None, owner: str | None = None) -> DataFrame:
    """``id, key, method`` for each person mention (``attrs``: email, organisation).

    A mention with an e-mail address belongs to that address; one with an organisation to (name, organisation), and
    to an address that the same name and organisation have. One with neither belongs to the only person of
    its name, else of its folded name, else, where it is an initial and a surname, of those. Of several such
    people it belongs to the only one at its file's ``folders`` organisation (``file_id, organisation``) or, if none is
    there, to the only one at the ``owner``. Otherwise it stays by itself.
    """
    rows = mentions.filter("etype = 'person'").select(
        "id", "file_id", t.person_key(F.col("surface")).alias("name"), t.person_key_folded(F.col("surface")).alias("folded"), t.person_initial_form(F.col("surface")).alias("initial"),
        F.lower(F.col("attrs")["email"]).alias("email"), t.company_key(F.col("attrs")["organisation"]).alias("org"),
    )
    by_org = rows.filter("org is not null and email is not null").groupBy("folded", "org").agg(F.min("email").alias("known"))
    rows = rows.join(by_org, ["folded", "org"], "left")
    keyed = F.coalesce("email", "known", F.when(F.col("org").isNotNull(), F.concat_ws("|", "folded", "org")))
    rows = rows.withColumn("own_key", keyed)
    sure = rows.filter("own_key is not null")
    # Only the mentions that have neither look for people, each among those of its name.
    seekers = rows.filter("own_key is null").select("id", "file_id", "name", "folded", F.when(F.col("name").rlike("^[a-z] [a-z]+$"), F.col("initial")).alias("initial"))
    here = F.lit(None).cast("string")
    if folders is not None:
        at = folders.groupBy("file_id").agg(F.min(t.company_key(F.col("organisation"))).alias("here"))
        seekers, here = seekers.join(at, "file_id", "left"), F.col("here")
    seekers = seekers.withColumn("here", here)
    owned = t.company_key(F.lit(owner).cast("string"))
    guess = single = F.lit(None).cast("string")
    level = F.lit(False)  # whether an earlier, better form of the name has found anyone
    for column in ("name", "folded", "initial"):
        at_owner = F.when(F.col("org") == owned, F.col("own_key"))
        found = sure.groupBy(column).agg(F.min("own_key").alias(f"any_{column}"), F.countDistinct("own_key").alias(f"n_{column}"), F.min(at_owner).alias(f"owner_{column}"), F.countDistinct(at_owner).alias(f"m_{column}"))
        local = sure.filter("org is not null").groupBy(column, F.col("org").alias("here")).agg(F.min("own_key").alias(f"local_{column}"), F.countDistinct("own_key").alias(f"l_{column}"))
        seekers = seekers.join(found, column, "left").join(local, [column, "here"], "left")
        near = F.when(F.col(f"l_{column}").isNotNull(), F.when(F.col(f"l_{column}") == 1, F.col(f"local_{column}"))).when(F.col(f"m_{column}") == 1, F.col(f"owner_{column}"))
        guess = F.when(level, guess).otherwise(F.when(F.col(f"n_{column}") == 1, F.col(f"any_{column}")).otherwise(near))
        single = F.when(level, single).otherwise(F.when(F.col(f"n_{column}") == 1, F.lit("unique_name")).otherwise(F.lit("name+context")))
        level = level | F.col(f"n_{column}").isNotNull()
    seekers = seekers.select("id", F.coalesce(guess, F.concat(F.col("name"), F.lit("|?"))).alias("key"), F.when(guess.isNotNull(), single).otherwise("new_unattributed").alias("method"))
    return sure.select("id", F.col("own_key").alias("key"), F.when(F.col("email").isNotNull(), "email").otherwise("name+organisation").alias("method")).unionByName(seekers)


#: Titles are the same project's from this ratio on, a fixed value.
SIMILAR_TITLE = 90


#: Letters of the titles that are held against others at a time.
LETTERS = 100_000


def _ratio() -> Column:
    """Of a title and a known one that differ by letters of only one of the two."""
    return 200.0 * F.least(F.length("title"), F.length("known")) / (F.length("title") + F.length("known"))


def _dealt(rows: DataFrame, column: str) -> DataFrame:
    """In so many partitions that each has about ``tables.ROWS`` letters, or one for each core."""
    return rows.repartition(partitions(rows.sparkSession, rows.agg(F.sum(F.length(column))).first()[0] or 0), column)


def _without_a_letter(column: str) -> Column:
    """Hashes of a text without each of its letters in turn."""
    text = F.col(column)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.xxhash64(F.concat(text.substr(F.lit(1), i - 1), text.substr(i + 1, F.length(text))))))


def _same_or_longer(titles: DataFrame, known: DataFrame) -> DataFrame:
    """``title, known, ratio`` of the known titles that are a title, or are it but for one letter more."""
    post = _dealt(known, "known").select("known", F.explode(F.concat(F.array(F.xxhash64("known")), _without_a_letter("known"))).alias("key"))
    met = titles.withColumn("key", F.xxhash64("title")).join(post, "key")
    more = F.length("known") - F.length("title")
    return met.filter((more >= 0) & (F.levenshtein("title", "known", 1) == more)).select("title", "known", _ratio().alias("ratio"))


def _shorter(titles: DataFrame, known: DataFrame) -> DataFrame:
    """``title, known, ratio`` of the known titles that are a title but for one letter fewer."""
    probe = _dealt(titles, "title").select("title", F.explode(_without_a_letter("title")).alias("key"))
    met = probe.join(known.withColumn("key", F.xxhash64("known")), "key")
    return met.filter((F.levenshtein("title", "known", 1) == 1) & (F.length("title") == F.length("known") + 1)).select("title", "known", _ratio().alias("ratio"))


def _title_blocks(rows: DataFrame, name: str) -> DataFrame:
    """``{name}, {name}_from, {name}_to``: titles in order, of lengths that are not far from each other, about ``LETTERS`` letters a row; dealt to so
    many partitions that each has a few rows, or one for each core."""
    sized = rows.select("title", F.length("title").alias("size"), F.floor(4 * F.log2(F.length("title"))).alias("band"))
    letters = sized.agg(F.sum("size")).first()[0] or 0
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-letters // (8 * LETTERS)))
    counted = sized.groupBy("band").agg(F.ceil(F.sum("size") / LETTERS).alias("n"))
    dealt = sized.join(F.broadcast(counted), "band").select("title", "size", "band", F.pmod(F.xxhash64("title"), "n").alias("block")).repartition(parts, "band", "block")
    ends = F.min("size").alias(f"{name}_from"), F.max("size").alias(f"{name}_to")
    return dealt.groupBy("band", "block").agg(F.sort_array(F.collect_list("title")).alias(name), *ends).drop("band", "block")


def title_pairs(titles: DataFrame, known: DataFrame, best: bool = False) -> DataFrame:
    """``title, known, ratio``: all pairs that are similar; with ``best`` only the most similar of each title and block of known ones.

    So many letters may differ that titles have no part in common by which few others could be found: of titles of sixty letters, pieces of four
    are what is sure to stay. Blocks of titles meet all blocks of known ones whose lengths allow it, and are compared as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, others in zip(batch["asked"], batch["others"], strict=True):
                asked, others = asked.as_py(), others.as_py()
                for i, j, ratio in alike(asked, others, SIMILAR_TITLE):
                    if best:
                        order = np.lexsort((j, ratio, i))
                        order = order[np.append(np.diff(i[order]) != 0, True)[: len(order)]]
                        i, j, ratio = i[order], j[order], ratio[order]
                    columns = [pa.array([asked[x] for x in i.tolist()], pa.string()), pa.array([others[x] for x in j.tolist()], pa.string()), pa.array(ratio)]
                    yield pa.RecordBatch.from_arrays(columns, names=["title", "known", "ratio"])

    blocks = lambda rows, name: _title_blocks(rows.select("title").filter("title != ''").distinct(), name)
    fits = lambda a, b: F.col(f"{a}_from") * SIMILAR_TITLE <= F.col(f"{b}_to") * (200 - SIMILAR_TITLE)
    met = blocks(titles, "asked").join(blocks(known, "others").hint("shuffle_replicate_nl"), fits("asked", "others") & fits("others", "asked"))
    return met.select("asked", "others").mapInArrow(run, "title string, known string, ratio double")


def _most_similar(pairs: DataFrame) -> DataFrame:
    best = F.max(F.struct("ratio", "known")).alias("best")
    return pairs.filter(F.col("ratio") >= SIMILAR_TITLE).groupBy("title").agg(best).select("title", "best.known", "best.ratio")


def similar_titles(titles: DataFrame, known: DataFrame, tables: Tables | None = None) -> DataFrame:
    """``title, known, ratio``: for each distinct title the most similar known one, of several the greatest, where the
    longest common subsequence makes up ``SIMILAR_TITLE`` percent of both.

    The most similar ones come first: a known title with one letter more is more like a title than any with one letter fewer, and that more than any
    that differs by two. Both are found by hashes in equi-joins. Only titles without either are compared with blocks of known ones; these
    have ``SIMILAR_TITLE / (100 - SIMILAR_TITLE)`` letters at least, fewer are not similar to anything two letters away.
    """
    tables = tables or Tables(titles.sparkSession)
    asked = tables.save(titles.select("title").filter("title != ''").distinct(), "titles-asked")
    have = tables.save(known.select(F.col("title").alias("known")).filter("known != ''").distinct(), "titles-known")
    found = tables.save(_most_similar(_same_or_longer(asked, have)), "titles-longer")
    asked = tables.save(asked.join(found, "title", "left_anti"), "titles-open")
    if asked.isEmpty():
        return found
    shorter = tables.save(_most_similar(_shorter(asked, have)), "titles-shorter")
    found, asked = found.unionByName(shorter), asked.join(shorter, "title", "left_anti").filter(F.length("title") * (100 - SIMILAR_TITLE) >= SIMILAR_TITLE)
    if asked.isEmpty():
        return found
    return found.unionByName(_most_similar(title_pairs(asked, have.withColumnRenamed("known", "title"), best=True)))


def title_only_projects(mentions: DataFrame, min_files: int = 2) -> DataFrame:
    """``title, customer, n_files``: titles without a job id that enough files of one customer use."""
    rows = mentions.filter("etype = 'project'").filter(F.col("attrs")["job_id"].isNull())
    keyed = rows.select(t.title_key(F.coalesce(F.col("attrs")["title"], F.col("surface"))).alias("title"), F.col("attrs")["customer"].alias("customer"), "file_id")
    return keyed.filter("title != ''").groupBy("title", "customer").agg(F.countDistinct("file_id").alias("n_files")).filter(F.col("n_files") >= min_files)


def first_fact_per_document(facts: DataFrame) -> DataFrame:
    """The first fact of each document mention."""
    return facts.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("id"))).filter("place = 1").drop("place")
