"""MinHash near-duplicates by a signature-coordinate inverted join.

Every distinct shingle set is posted under each (coordinate, value) of its signature.
Two sets at the similarity sought agree in most coordinates; sets that agree in at
least MATCHES of COORDINATES are compared in full. To find them, a set's MATCHES - 1 longest
lists are skipped and only the others, its prefix, are merged: a pair that agrees in MATCHES
coordinates meets in one of them. Agreements are then counted over the whole signatures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graphs import components
from .work import BROADCAST_ROWS, Workspace, join_groups, table

WORDS = 5
SIMILARITY = 75  # percent
#: A pair at 75 % agrees in 48 of 64 coordinates on average, in fewer than 30 less than once in a million times.
COORDINATES, MATCHES = 64, 30
#: Sets with one rare shingle that one task compares with the others that have it; more are spread over several.
SETS_A_PART = 2000

_RNG = np.random.default_rng(5)
_XOR = _RNG.integers(0, 1 << 63, COORDINATES, dtype="u8")[:, None]
_TIMES = (_RNG.integers(0, 1 << 63, COORDINATES, dtype="u8") | np.uint64(1))[:, None]
_PLACE = (_RNG.integers(0, 1 << 63, WORDS, dtype="u8") << np.uint64(1)) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's five-word shingles; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z alone, and the six white-space characters
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join([b"%d" % len(words), *words]))], "u8") if words else np.zeros(0, "u8")
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    n = len(words) - WORDS + 1
    out = np.zeros(n, "u8")
    for i in range(WORDS):
        out += hashes[i : i + n] * _PLACE[i]
        out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def signature(found: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions, its last bits replaced by the function's number."""
    least = np.full((COORDINATES, 1), np.iinfo("u8").max, "u8")
    for i in range(0, len(found), 4096):
        least = np.minimum(least, (((found[None, i : i + 4096] ^ _XOR) * _TIMES).min(1))[:, None])
    return ((least[:, 0] & np.uint64(~(COORDINATES - 1) & 0xFFFFFFFFFFFFFFFF)) | np.arange(COORDINATES, dtype="u8")).view("i8")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if SIMILARITY * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= SIMILARITY * (len(a) + len(b) - shared)


def sizes_fit(a: str, b: str) -> Column:
    """Whether sets of these sizes can be similar at all."""
    return SIMILARITY * F.greatest(a, b) <= 100 * F.least(a, b)


def sign(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``), ``n_shingles``, ``set_key`` (a 128-bit hash of the set) and ``coords``."""
    schema = T.StructType(
        [T.StructField("row", docs.schema), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("coords", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            sizes, keys, coords = [], [], []
            for text in rows.field("text").to_pylist():
                found = shingles(text)
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                coords.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([rows, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(coords, pa.list_(pa.int64()))], names=["row", "n_shingles", "set_key", "coords"])

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).mapInArrow(run, schema)


def classes_of(signed: DataFrame, ws: Workspace) -> DataFrame:
    """``cid, set_key, least, n_rows, n_shingles, coords``: distinct sets under numbers that take little room in shuffles."""
    found = signed.filter("n_shingles > 0").groupBy("set_key").agg(
        F.min(F.col("row.doc_id").cast("long")).alias("least"), F.count("*").alias("n_rows"), F.max("n_shingles").alias("n_shingles"), F.first("coords").alias("coords")
    )
    return ws.save(found.withColumn("cid", F.monotonically_increasing_id()), "classes")


def postings(classes: DataFrame, ws: Workspace) -> DataFrame:
    """``coord, cid, n_shingles, central``: the prefix of each set, its rarest coordinate values but for those
    skipped. A set is the more central the more of its values others have: what copies were made from."""
    posts = classes.select(F.explode("coords").alias("coord"), "cid")
    shared = ws.save(posts.groupBy("coord").agg(F.count("*").alias("n_posts")).filter("n_posts > 1"), "shared")
    met = join_groups(posts, shared, "coord", "n_posts").filter("n_posts is not null")
    own = Window.partitionBy("cid")
    ranked = met.withColumn("n", F.count("*").over(own)).withColumn("at", F.row_number().over(own.orderBy("n_posts", "coord")))
    prefix = ranked.filter(F.col("at") <= F.col("n") - (MATCHES - 1)).select("coord", "cid", "n")
    known = prefix.join(classes.select("cid", "n_shingles", "n_rows"), "cid")
    return ws.save(known.select("coord", "cid", "n_shingles", F.struct("n", "n_rows", -F.col("cid")).alias("central")), "postings")


def texts_of(cids: DataFrame, signed: DataFrame, classes: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """``cid, text``: one text of each set in ``cids`` (``cid``), a saved table."""
    keys = ws.save(classes.select("cid", "set_key").join(cids, "cid"), f"{name}-keys")
    few = keys.count() <= BROADCAST_ROWS
    texts = signed.select("set_key", F.col("row.text").alias("text")).join(F.broadcast(keys) if few else keys.hint("merge"), "set_key")
    return ws.save(texts.groupBy("cid").agg(F.first("text").alias("text")), f"{name}-texts")


def rarest_shingles(sets: DataFrame, signed: DataFrame, classes: DataFrame, ws: Workspace) -> DataFrame:
    """``shingle, cid, n_shingles, place, root, n_sets`` of ``sets`` (``cid, n_shingles, root``): each set's rarest
    quarter, with a shingle's place among the set's own, the rarest being the first, and the number of sets that have it.

    Similar sets share three quarters of either, so one at least of any order's first quarter and one more.
    Shingles of one set alone come first in the order and are left out.
    """
    texts = texts_of(sets.select("cid"), signed, classes, ws, "open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, text in zip(batch.column("cid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = shingles(text).view("i8")
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), cid, "i8"))], names=["shingle", "cid"])

    every = ws.save(texts.mapInArrow(run, "shingle long, cid long"), "open-shingles")
    shared = ws.save(every.groupBy("shingle").agg(F.count("*").alias("n_sets")).filter("n_sets > 1"), "open-shared")
    met = join_groups(every, shared, "shingle", "n_sets").filter("n_sets is not null")
    own = Window.partitionBy("cid")
    ranked = met.withColumn("common", F.count("*").over(own)).withColumn("at", F.row_number().over(own.orderBy("n_sets", "shingle"))).join(sets, "cid")
    length = F.col("n_shingles") - F.ceil(F.col("n_shingles") * SIMILARITY / 100) + 1
    place = F.col("at") + F.col("n_shingles") - F.col("common")
    prefix = ranked.filter(place <= length)
    out = ws.save(prefix.select("shingle", "cid", "n_shingles", place.alias("place"), "root", "n_sets"), "rare")
    ws.drop("open-shingles", "open-shared", "open-texts")
    return out


def confirm(pairs: DataFrame, signed: DataFrame, classes: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """The pairs ``a, b`` whose signatures agree often enough and whose full sets are similar."""
    for end in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("cid").alias(end), F.col("coords").alias(f"coords_{end}")), end)
    pairs = ws.save(pairs.filter(F.size(F.array_intersect("coords_a", "coords_b")) >= MATCHES).select("a", "b"), f"{name}-agree")
    wanted = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    texts = texts_of(wanted, signed, classes, ws, name)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, "u8")  # rows of one a come together
        for batch in batches:
            keep = []
            for a, text_a, text_b in zip(*(batch.column(c) for c in ("a", "text_a", "text_b")), strict=True):
                if (a := a.as_py()) != last:
                    last, own = a, shingles(text_a.as_py())
                keep.append(similar(own, shingles(text_b.as_py())))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    for end in ("b", "a"):
        pairs = pairs.join(texts.select(F.col("cid").alias(end), F.col("text").alias(f"text_{end}")), end)
    return ws.save(pairs.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long"), f"{name}-links")


def find(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``row, n_shingles, component_id, kept, group_key``: every row of ``docs`` with the smallest doc_id that links reach.

    Rows with one shingle set are one class; links are sought between classes. The lists are
    merged twice: first each posting with its list's most central set alone, a star; then, in the lists that
    the links so found leave in several components, the pairs that cross two of them. Where a long
    passage makes such a list long, most of these agree in many coordinates and are not similar; so
    they must also share one of either set's rarest shingles, so many that similar sets of their
    sizes cannot differ in all of them.
    A pair that is never compared is in one component already, so components are those of all links.

    Rows without words, or with a null text, are linked with nothing. Rows without a doc_id link like
    others; a component of such rows alone has a null id. Rows of equal ids are judged by their own texts; equal rows
    are one class. Texts of any length are shingled whole. An empty table gives an empty result; all columns are carried in
    one struct, so none of their names can clash.
    """
    signed = ws.save(sign(docs), "signed")
    doc_id = F.col("row.doc_id").cast("long")
    classes = classes_of(signed, ws)
    posts = postings(classes, ws)
    ws.drop("shared")
    heads = posts.groupBy("coord").agg(F.max_by(F.struct(F.col("cid").alias("a"), F.col("n_shingles").alias("n_a")), "central").alias("head"), F.count("*").alias("n_posts"))
    heads = ws.save(heads.filter("n_posts > 1").select("coord", "head.*", "n_posts"), "heads")
    star = join_groups(posts, heads, "coord", "n_posts").filter("a != cid").filter(sizes_fit("n_a", "n_shingles"))
    star = ws.save(star.select("a", F.col("cid").alias("b")).distinct(), "star")
    links = confirm(star, signed, classes, ws, "star")
    linked = components(links, ws, "first")
    placed = posts.join(linked.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    placed = ws.save(placed, "placed")
    open_lists = placed.groupBy("coord").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n_posts")).filter("low != high")
    open_lists = ws.save(open_lists.select("coord", "n_posts"), "open")
    left = ws.save(join_groups(placed, open_lists, "coord", "n_posts").filter("n_posts is not null").select("coord", "cid", "n_shingles", "root"), "left")
    rare = rarest_shingles(left.select("cid", "n_shingles", "root").distinct(), signed, classes, ws)
    # A passage that very many sets share is one key: one side of such a key goes to several tasks, the other to each of them.
    parts = F.ceil(F.col("n_sets") / SETS_A_PART).cast("int")
    x = rare.withColumn("part", F.pmod(F.xxhash64("cid"), parts).cast("int")).drop("n_sets").toDF("shingle", "x", "n_x", "place_x", "root_x", "part")
    y = rare.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n_sets").toDF("shingle", "y", "n_y", "place_y", "root_y", "part_y")
    share = F.ceil((F.col("n_x") + F.col("n_y")) * SIMILARITY / (100 + SIMILARITY))  # what similar sets of these sizes have in common
    near = (F.col("place_x") <= F.col("n_x") - share + 1) & (F.col("place_y") <= F.col("n_y") - share + 1)
    crossing = x.join(y, (x["shingle"] == y["shingle"]) & (F.col("part") == F.col("part_y")) & (F.col("root_x") < F.col("root_y")) & sizes_fit("n_x", "n_y") & near)
    crossing = crossing.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    crossing = ws.save(crossing.join(star, ["a", "b"], "left_anti"), "crossing")
    ws.drop("star-texts", "heads", "postings", "placed")
    if not crossing.isEmpty():
        links = links.unionByName(confirm(crossing, signed, classes, ws, "crossing"))
        linked = components(links, ws, "second")
    roots = classes.select("cid", "set_key", "least", "n_rows").join(linked.withColumnRenamed("node", "cid"), "cid", "left")
    roots = ws.save(roots.filter("root is not null or n_rows > 1").withColumn("root", F.coalesce("root", "cid")), "roots")
    groups = ws.save(roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_sets"), F.min("set_key").alias("group_key")), "groups")
    members = ws.save(join_groups(roots, groups, "root", "n_sets").select("set_key", "n_rows", "component_id", "group_key"), "members")
    rows = signed.select("row", "n_shingles", "set_key")
    out = join_groups(rows.filter("set_key is not null"), members, "set_key", "n_rows")
    blank = rows.filter("set_key is null")  # linked with nothing; as one key they would meet in one task
    for column, kind in members.drop("set_key").dtypes:
        blank = blank.withColumn(column, F.lit(None).cast(kind))
    out = out.unionByName(blank)
    out = out.withColumn("component_id", F.when(F.col("group_key").isNotNull(), F.col("component_id")).otherwise(doc_id))
    kept = doc_id.eqNullSafe(F.col("component_id")).alias("kept")
    return out.select("row", "n_shingles", "component_id", kept, F.coalesce("group_key", "set_key").alias("group_key"))


def keep_one(docs: DataFrame, ws: Workspace) -> DataFrame:
    """The rows of ``docs`` but for near-duplicates: of each component the row with its smallest doc_id.

    Rows without words all stay. Where several rows of a component share that id, or none of its
    rows has one, one of them stays.
    """
    kept = find(docs, ws).filter("kept").select("row", "group_key")
    tied = kept.filter("group_key is not null").groupBy("group_key").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
    tied = ws.save(tied, "tied")
    if tied.isEmpty():
        return kept.select("row.*")
    marked = join_groups(kept, tied, "group_key", "n_rows")
    one = marked.filter("n_rows is not null").groupBy("group_key").agg(F.first("row").alias("row"))
    return marked.filter("n_rows is null").select("row").unionByName(one.select("row")).select("row.*")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), Workspace(spark, "near-dedup"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_shingles", "component_id", "kept")


ORACLE = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
    s AS (SELECT DISTINCT doc_id, sh FROM (
        SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
               ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS sh FROM w)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM i JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 75 * (na.n + nb.n - c)),
    g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, g.b FROM r JOIN g ON r.other = g.a),
    m AS (SELECT node, min(other) AS component_id FROM r GROUP BY node)
    SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
    FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id"""
