"""N-gram Jaccard join by T-occurrence search.

A document's set holds its distinct shingles of five words as 64-bit hashes, mixed from an XXH3 hash of each word; equal sets are one class, represented by its
smallest id. Two sets of sizes m and n can only reach the similarity if they share T = ceil(0.75 max(m, n)) shingles, so
under one order of all shingles the first n - T + 1 + s shingles of both share at least 1 + s (s: a twentieth of the
set). These leading shingles make the inverted lists; lists of one set are dropped.

1. Star: every set on a list is paired with the list's smallest id. Pairs are checked by DivideSkip search (below), and
   links join sets to components. Families of near copies collapse here with pairs in proportion to the lists' lengths.
2. Lists that still hold several components get other stars, by other orders of ids, while these join many sets.
3. Search: lists that then still hold several components are searched for pairs across components. Two given sets must share
   A = ceil(0.75 / 1.75 (m + n)) shingles, which is at least T, so only their first m - A + 1 + s and n - A + 1 + s
   shingles count. Each set may leave out part of s of its lists, the longest. A pair is a candidate if it occurs on
   1 + s lists less those left out, and if what follows its last shared leading shingle can still make up A.
   Each set also has a map of 512 bits, the parities of its shingles by hash. Each bit in which two maps differ is due
   to a shingle of one set alone, so sets with more than m + n - 2 A such bits can't link and are never paired.
4. Candidates are checked as in 1, and components are final.

DivideSkip: the lists that a group of sets has for a query's shingles are divided. The short ones are merged by a heap, which
counts each set; sets that could still reach their own T are looked up in the longest lists by binary search. Who reaches T
is linked; nothing is counted again. Across the cluster the same division holds: the leading parts are the short lists, of
which a pair must share 1 + s, and the frequent shingles behind them are the long lists, which are only probed.

The order puts frequent shingles last, by the power of two of their count, then by hash. Counts come from one document in
`SHARE`, at any size of the corpus, and the most frequent `FREQUENT` of them are known to all tasks. They decide the order
alone: they change the lists' lengths and never the result.

Defined results: null texts and texts without words have no set, no links, and are their own component; texts of one to
four words have their whole sequence as one shingle; equal rows and copies share a class; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, mix64, stored, table, tidy

WIDTH, PERCENT = 5, 75
#: One document in SHARE is counted for the order; shingles of HITS such documents are frequent, FREQUENT of them at most.
SHARE, HITS, FREQUENT = 4, 4, 2_000_000
#: A set's share of shingles by which its leading part grows.
SPARE = 20
#: Stars end when a round joins fewer than one in FEW of the sets that are on open lists.
FEW = 20
#: Sets of a group that are searched at once; larger groups are split.
GROUP = 256
#: Below this many rows, ids are sent to all tasks; beyond it, tables are joined by key.
SMALL = 1_000_000
_PART = 1 << 18
#: Columns of a set's bitmap, 64 bits each.
MAP = tuple(f"k{i}" for i in range(8))

_BLANK = frozenset(b" \t\n\v\f\r")
_R = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH3 of each word, 64 bits."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def words_of(text: bytes) -> list[bytes]:
    """Words of a text, A-Z in lower case: bytes.split and bytes.lower know just these characters."""
    return text.lower().split()


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Words of about _PART bytes are held at once; only a long text's
    hashes, a number each, are held whole."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _PART):
            size += len(texts[end])
            end += 1
        if size > 2 * _PART:  # one long text: in parts that end at white space
            yield _distinct(np.concatenate([word_hashes(words_of(p)) for p in _parts(texts[at])]))
        else:
            group = [words_of(t) for t in texts[at:end]]
            hashes = word_hashes([w for ws in group for w in ws])
            cuts = np.cumsum([0, *map(len, group)])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield _distinct(hashes[a:b])
        at = end


def _parts(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = min(at + _PART, len(text))
        while end < len(text) and text[end] not in _BLANK:
            end += 1
        yield text[at:end]
        at = end


def _distinct(words: np.ndarray) -> np.ndarray:
    if not len(words):
        return words
    k = min(len(words), WIDTH)
    mixed = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        mixed = mix64(mixed * _R + words[j : j + len(mixed)])
    return np.unique(mixed)


def needed(n: int) -> int:
    return -(-n * PERCENT // 100)


def required(m: Column, n: Column) -> Column:
    """Shingles that sets of these sizes must share."""
    return F.ceil((m + n) * PERCENT / (100 + PERCENT))


def alike(m: Column, n: Column, left: str, right: str) -> Column:
    """Whether the bitmaps (columns left.*, right.*) leave room for a link between sets of sizes m and n."""
    differ = sum((F.bit_count(F.col(f"{left}.{k}").bitwiseXOR(F.col(f"{right}.{k}"))) for k in MAP), F.lit(0))
    return differ <= m + n - 2 * required(m, n)


def bitmap(x: np.ndarray) -> np.ndarray:
    """The columns MAP of a set of shingle hashes."""
    odd = np.bincount((x >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def sets_of(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray] | None, whole: bool) -> DataFrame:
    """(doc_id, n, s1, s2, part, *MAP): each set's size, signature, leading (or, if whole, all) shingles and bitmap."""
    schema = "doc_id long, n long, s1 long, s2 long, part binary, " + ", ".join(f"{k} long" for k in MAP)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                n, s1, s2, out, maps = [], [], [], [], []
                for x in shingle_sets([t or b"" for t in part["text"].cast(pa.binary()).to_pylist()]):
                    n.append(len(x))
                    maps.append(bitmap(x))
                    s1.append(int(mix64(x).sum(dtype=np.uint64).astype(np.int64)))
                    s2.append(int(mix64(x + _R).sum(dtype=np.uint64).astype(np.int64)))
                    if not whole and len(x):
                        if frequent is not None and len(frequent[0]):
                            spot = np.minimum(np.searchsorted(frequent[0], x), len(frequent[0]) - 1)
                            level = np.where(frequent[0][spot] == x, frequent[1][spot], 0)
                            x = x[np.argsort(level, kind="stable")]
                        x = x[: len(x) - needed(len(x)) + 1 + len(x) // SPARE]
                    out.append(x.tobytes())
                columns = [part["doc_id"].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(np.array(c, np.int64)) for c in zip(*maps, strict=True)], names=["doc_id", "n", "s1", "s2", "part", *MAP])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(tidy(made), schema)


def exploded(sets: DataFrame) -> DataFrame:
    """(doc, at, token) for each shingle of the binary column part: its place there, its hash read as a signed number."""
    schema = "doc long, at int, token long"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                tokens = [np.frombuffer(p, dtype=np.int64) for p in part["part"].to_pylist()]
                sizes = [len(t) for t in tokens]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part["doc_id"].to_numpy(), sizes)), pa.array(np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in sizes)])), pa.array(np.concatenate([np.zeros(0, np.int64), *tokens]))], ["doc", "at", "token"])

    return sets.select("doc_id", "part").mapInArrow(tidy(made), schema)


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most FREQUENT shingles that several of the counted documents share, sorted, and their counts' powers of two."""
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SHARE)) == 0)
    counts = exploded(sets_of(some, None, True)).groupBy("token").count().where(F.col("count") >= HITS)
    rows = counts.orderBy(F.desc("count"), "token").limit(FREQUENT).toArrow()
    tokens = rows["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.log2(rows["count"].to_numpy()[order]).astype(np.int8)


def divide_skip(lists: list[np.ndarray], need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members (places in need) that are on at least need[member] of the lists, and on how many each is.

    lists: sorted arrays of distinct members. The longest, fewer than the least need, are set aside; more of them the
    larger the need is and the shorter they are. The others are merged by a heap, which counts each member. Those that
    could still reach their need are looked up in the long lists by binary search, and given up as soon as they can't.
    """
    none = np.zeros(0, np.int64)
    lists = sorted((x for x in lists if len(x)), key=len, reverse=True)
    least = int(need.min()) if len(need) else 0
    if least < 1 or len(lists) < least:
        return none, none
    aside = min(least - 1, int(least / (0.01 * np.log2(len(lists[0]) + 1) + 1)))
    found, times = [], []
    for member, run in itertools.groupby(heapq.merge(*(x.tolist() for x in lists[aside:]))):
        n = sum(1 for _ in run)
        if n >= least - aside:
            found.append(member)
            times.append(n)
    left, counts = np.array(found, np.int64), np.array(times, np.int64)
    for i, x in enumerate(lists[:aside]):
        fine = counts + (aside - i) >= need[left]
        left, counts = left[fine], counts[fine]
        if not len(left):
            break
        counts += x[np.minimum(np.searchsorted(x, left), len(x) - 1)] == left
    fine = counts >= need[left]
    return left[fine], counts[fine]


def search_group(query: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of the sets that reach the similarity with query: T-occurrence search over the inverted lists that the sets
    have for the query's shingles, with each set's own T by both sizes."""
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), sizes)
    spot = np.minimum(np.searchsorted(query, tokens), len(query) - 1)
    hit = query[spot] == tokens
    order = np.lexsort((owners[hit], spot[hit]))
    slots, who = spot[hit][order], owners[hit][order]
    lists = np.split(who, np.flatnonzero(np.diff(slots)) + 1) if len(who) else []
    return divide_skip(lists, -(-(len(query) + sizes) * PERCENT // (100 + PERCENT)))[0]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    schema = "a long, b long"
    rows = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("part").alias("other")), "b")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("of") / GROUP)).cast("long"))
    salts = rows.select(F.col("a").alias("qa"), F.col("salt").alias("qsalt")).distinct()
    queries = salts.join(sets.select(F.col("doc_id").alias("qa"), F.col("part").alias("query")), "qa").select("qa", "qsalt", "query")

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros(0, np.int64)
        if len(left) and len(right):
            query = np.frombuffer(right["query"][0].as_py(), dtype=np.uint64)
            found = search_group(query, [np.frombuffer(x, dtype=np.uint64) for x in left["other"].to_pylist()])
        return left.select(["a", "b"]).take(pa.array(found))

    return rows.select("a", "salt", "b", "other").groupBy("a", "salt").cogroup(queries.groupBy("qa", "qsalt")).applyInArrow(group, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node that links reach.

    Each round gives a node the smallest of itself and its neighbours as its parent, follows parents to their roots by
    pointer jumping, and puts roots in the place of nodes in all edges. Edges within a root go, so a star is done in one
    round and later rounds are small. Tables are written in each round, so lineage stays short, and old ones deleted.
    """
    left = stored(edges.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).where("x <> y").distinct(), "edges")
    final = stored(left.select(F.explode(F.array("x", "y")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("y").alias("x"), F.col("x").alias("y")))
        parents = stored(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("up")), "parents")
        while True:
            above = parents.select(F.col("node").alias("at"), F.col("up").alias("top"))
            jumped = stored(parents.join(above, F.col("up") == F.col("at")).select("node", F.col("top").alias("up"), (F.col("up") != F.col("top")).alias("moved")), "parents")
            discard(parents)
            parents = jumped
            if parents.where("moved").isEmpty():
                break
        root = parents.select("node", "up")
        moved = stored(final.join(root.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        ends = left.join(root.select(F.col("node").alias("x"), F.col("up").alias("p")), "x").join(root.select(F.col("node").alias("y"), F.col("up").alias("q")), "y")
        fewer = stored(ends.where("p <> q").select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct(), "edges")
        discard(left, final, parents)
        left, final = fewer, moved
    discard(left)
    return final


def fits(m: Column, n: Column) -> Column:
    return 100 * F.least(m, n) >= PERCENT * F.greatest(m, n)


def link(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, rep (smallest id with the same set) and component_id."""
    docs = docs.select("doc_id", "text")
    heads = stored(sets_of(docs, frequent_shingles(docs), False), "heads")
    reps = stored(heads.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first(F.struct(*MAP)).alias("map")), "classes")
    sizes = reps.select(F.col("rep").alias("doc"), F.col("n"), "map")
    reps = reps.drop("map")
    lead = heads.where("n > 0").select("doc_id", "n", "part").join(among(sizes), F.col("doc_id") == F.col("among"), "left_semi")
    # One shuffle serves the counts and the lists; rows are three numbers.
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    postings = exploded(lead).repartition(parts, "token")
    tops = postings.groupBy("token").agg(F.min("doc").alias("top"), F.max("doc").alias("last"), F.count("*").alias("c")).where("top <> last")
    lists = stored(postings.join(tops.select("token", "top", "c"), "token"), "lists")

    # 1. Star: each set with the smallest id that it shares most lists with, if those suffice for a link by themselves.
    # All other pairs are left to the next steps, which miss none.
    shared = lists.where("doc <> top").groupBy("doc", "top").agg(F.count("*").alias("times"))
    tested = stored(promising(shared, sizes), "pairs")
    links = stored(verified(sized(tested), sets_in(tested, docs)), "links")
    labels = components(links)
    still, turn = stored(across(lists, labels), "open"), 0
    discard(lists)

    # 2. More stars over the lists that still hold several components, each time by another order of ids, so that no one set
    # stays the leader of sets that are unlike it. A family that is all alike collapses before its members could be paired.
    while True:
        turn += 1
        leader = F.min_by(F.struct(F.col("doc").alias("top"), "component"), F.struct(F.xxhash64("doc", F.lit(turn)), "doc"))
        led = still.join(still.groupBy("token").agg(leader.alias("lead")), "token").where("component <> lead.component")
        shared = led.groupBy("doc", F.col("lead.top").alias("top")).agg(F.count("*").alias("times"))
        pairs = stored(promising(shared, sizes).join(tested, ["a", "b"], "left_anti"), "pairs")
        found = stored(verified(sized(pairs), sets_in(pairs, docs)), "links")
        tested = tested.unionByName(pairs)
        joined = found.select("b").distinct().count()
        if joined:
            links = links.unionByName(found)
            labels = components(links)
        # Families that are alike join by the round; once few sets do, the search meets few pairs that are links.
        if FEW * joined < still.select("doc").distinct().count():
            if joined:
                still = across(still.drop("component"), labels)
            break
        fewer = stored(across(still.drop("component"), labels), "open")
        discard(still)
        still = fewer

    # 3. Search across components.
    m, n = F.col("m"), F.col("n")
    still = stored(thinned(still.join(sizes, "doc")), "open")
    left = still.select("token", F.col("doc").alias("a"), F.col("at").alias("i"), F.col("n").alias("m"), F.col("component").alias("ca"), F.col("spared").alias("sa"), F.col("map").alias("p"))
    right = still.select("token", F.col("doc").alias("b"), F.col("at").alias("j"), "n", F.col("component").alias("cb"), F.col("spared").alias("sb"), F.col("map").alias("q"))
    spare = F.floor(F.least(m, n) / SPARE)
    leading = (F.col("i") <= m - required(m, n) + spare) & (F.col("j") <= n - required(m, n) + spare)
    found = left.join(right, "token").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits(m, n) & leading & alike(m, n, "p", "q"))
    counted = found.groupBy("a", "b", "m", "n").agg(F.count("*").alias("shared"), F.max("i").alias("i"), F.max("j").alias("j"), F.min(F.col("sa") + F.col("sb")).alias("spared"))
    most = F.col("shared") + F.col("spared") + F.least(m - 1 - F.col("i"), n - 1 - F.col("j"))
    crossing = counted.where((F.col("shared") >= 1 + spare - F.col("spared")) & (most >= required(m, n))).select("a", "b")
    either = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crossing = stored(crossing.join(either, ["a", "b"], "left_anti"), "pairs")
    second = stored(verified(sized(crossing), sets_in(crossing, docs)), "links")
    final = components(links.unionByName(second))

    whole = heads.select("doc_id", "n", "s1", "s2").join(reps, ["n", "s1", "s2"], "left")
    out = whole.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def promising(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b): for each doc of shared (doc, top, times) the top with most shared lists, if the pair can be a link."""
    pairs = shared.groupBy(F.col("doc").alias("b")).agg(F.max_by("top", F.struct("times", -F.col("top"))).alias("a"), F.max("times").alias("times"))
    m, n = F.col("m"), F.col("n")
    one = sizes.select(F.col("doc").alias("a"), F.col("n").alias("m"), F.col("map").alias("p"))
    two = sizes.select(F.col("doc").alias("b"), "n", F.col("map").alias("q"))
    enough = F.col("times") >= 1 + F.floor(F.least("m", "n") / SPARE)
    return pairs.join(one, "a").join(two, "b").where(fits(m, n) & alike(m, n, "p", "q") & enough).select("a", "b")


def across(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(token, doc, at, component, c): rows of the lists that hold several components."""
    labelled = lists.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    open_lists = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    return labelled.join(open_lists, "token").select("token", "doc", "at", "component", "c")


def sets_in(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, part): the whole sets of the documents of pairs."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "ids")
    picked = docs.join(among(ids), F.col("doc_id") == F.col("among"), "left_semi")
    return stored(sets_of(picked, None, True).select("doc_id", "part"), "sets")


def among(ids: DataFrame) -> DataFrame:
    """Ids (the column doc, as `among`) for a semi-join: sent to all tasks if they are few, joined by key otherwise."""
    ids = ids.select(F.col("doc").alias("among"))
    return F.broadcast(ids) if ids.count() <= SMALL else ids


def sized(pairs: DataFrame) -> DataFrame:
    """pairs with of: how many pairs their a has, by which large groups are split."""
    return pairs.join(pairs.groupBy("a").agg(F.count("*").alias("of")), "a")


def thinned(lists: DataFrame) -> DataFrame:
    """Rows of lists without those that their set leaves out: up to an eighth of its spare shingles' lists, the longest.

    A pair shares 1 + s lists at least, s from the smaller set. Two sets together leave out at most s / 2 of them.
    """
    longest = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("c"), "token"))
    ranked = lists.withColumns({"place": longest, "spared": F.floor(F.col("n") * 3 / (16 * SPARE))})
    return ranked.where(F.col("place") > F.col("spared")).drop("place")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 75 * (p.n + q.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id FROM w JOIN r ON r.x = w.doc_id LEFT JOIN n USING (doc_id) GROUP BY w.doc_id, n.n
"""
