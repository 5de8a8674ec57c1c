"""Operator 4: n-gram Jaccard join by T-occurrence search (DivideSkip).

Two documents link when their sets of word shingles have a Jaccard similarity of at least
``percent`` / 100. The result names each document's component of links.

1. Documents with equal sets become one class; all that follows works on classes.
2. Support filter. Order shingles by hash. Texts that link share at least ``need`` of the
   first ``n - least_overlap + ell`` shingles of either (``ell`` more than the plain prefix
   filter asks for), so a class with fewer such shingles on lists of two or more classes is
   linked with nothing. Only the classes that pass get their whole sets out of the texts;
   a Bloom filter of fixed size, sent to the scan, keeps the others' sets from being made.
   By whole sets, at least ``least_overlap`` shingles must then be shared.
3. Inverted lists of the prefixes of those classes. A class leaves aside its ``need - 1``
   longest lists; a partner must still stand on one of its others, the short lists.
4. Star links: each class is compared with one list head, that of most of its short lists.
   A list's head is the class with the fewest shingles of its own, so near copies meet at
   their original. This joins most of a group of near copies, in work linear in the postings.
5. Search: what is left to find are links between different components. They stand on lists
   that hold several components; a class on too few of those is done. Classes meet in the
   pots of their lists' heads: a list belongs to its head's pot, so that many lists make few
   pots. A class asks its short lists' pots, unless it is of a pot's largest component: of two
   components the smaller asks. Askers and members of a pot stand in blocks of at most about
   ``BLOCK`` classes; in a pair of blocks a query merges its short inverted lists by a heap, skipping
   what cannot reach T occurrences, and probes the long lists by binary search. A pair of blocks
   hands on a spanning forest of the components it joins.

No pairs of a list are made: a class goes to a pot once, whatever lists they share, and a row
of it stands for a whole block of the other side.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm.common import read_table, stage, text_of
from stratum.llm.components import components
from stratum.llm.shingles import WORDS, set_key, shingle_sets

PERCENT = 80
#: Beyond the plain prefix filter, prefixes have 1 + n / share shingles: in the support
#: filter over all documents, and in the inverted lists of those that passed.
PREFIX_SHARE, LIST_SHARE = 20, 5
#: Classes of a pot that are indexed together, and about as many shingles at most.
BLOCK, BLOCK_SHINGLES = 256, 1 << 21
#: Heads a class is compared with before its search.
HEADS = 4
#: Bits of the Bloom filter, which is 8 MB whatever the corpus holds.
BLOOM_BITS = 1 << 26
#: DivideSkip's weight of the longest list when it chooses the number of long lists.
MU = 0.0085


def least_overlap(n, percent: int = PERCENT):
    """Shingles that a set of n shares with any partner at least (numbers or columns of longs)."""
    if isinstance(n, Column):
        return F.floor((n * percent + 99) / 100).cast("long")
    return (n * percent + 99) // 100


# ---------------------------------------------------------------- search within a block


class Block:
    """Inverted lists over some sets: shingle -> sorted member numbers."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        shingle = np.concatenate(sets) if sets else np.empty(0, dtype=np.int64)
        order = np.lexsort((member, shingle))
        self.shingle, self.member = shingle[order], member[order]

    def lists(self, query: np.ndarray) -> list[list[int]]:
        lo = np.searchsorted(self.shingle, query, "left")
        hi = np.searchsorted(self.shingle, query, "right")
        return [self.member[a:b].tolist() for a, b in zip(lo, hi, strict=True) if b > a]

    def search(self, query: np.ndarray, percent: int = PERCENT) -> Iterator[int]:
        """Members whose similarity to ``query`` is at least percent / 100 (DivideSkip)."""
        n = len(query)
        need = least_overlap(n, percent)
        lists = sorted(self.lists(query), key=len, reverse=True)
        if n == 0 or len(lists) < need:
            return
        n_long = min(need - 1, int(need / (MU * math.log(len(lists[0]) + 1) + 1)))
        long, short, least = lists[:n_long], lists[n_long:], need - n_long
        at = [0] * len(short)
        heap = [(values[0], k) for k, values in enumerate(short)]
        heapq.heapify(heap)
        while len(heap) >= least:
            member = heap[0][0]
            popped = []
            while heap and heap[0][0] == member:
                popped.append(heapq.heappop(heap)[1])
            if len(popped) >= least:
                shared = len(popped)
                for values in long:
                    i = bisect_left(values, member)
                    shared += i < len(values) and values[i] == member
                if 100 * shared >= percent * (n + len(self.sets[member]) - shared):
                    yield member
                goal = member + 1
            else:  # what stands on fewer lists than needed is skipped
                while heap and len(popped) < least - 1:
                    popped.append(heapq.heappop(heap)[1])
                goal = heap[0][0] if heap else None
            for k in popped:
                if goal is not None:
                    at[k] = bisect_left(short[k], goal, at[k])
                    if at[k] < len(short[k]):
                        heapq.heappush(heap, (short[k][at[k]], k))


# ---------------------------------------------------------------- sets out of texts


def _signatures(docs: DataFrame, id_col: str, text_col: str, words: int, row: Column) -> DataFrame:
    """``row, doc_id, n, key, code`` of every document; the last two null for a text without words."""
    ddl = f"row long, doc_id {docs.schema[id_col].dataType.simpleString()}, n long, key binary, code long"

    def run(batches):
        for batch in batches:
            sizes, keys = [], []
            for s in shingle_sets((v.as_py() for v in batch.column(2)), words):
                sizes.append(len(s))
                keys.append(set_key(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array([_code(k) if k else None for k in keys], pa.int64())],
                names=["row", "doc_id", "n", "key", "code"])

    return docs.select(row.cast("long").alias("row"), docs[id_col].alias("doc_id"),
                       text_of(docs, text_col).cast("binary").alias("body")).mapInArrow(run, ddl)


def _code(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _sets_of(docs: DataFrame, text_col: str, words: int, wanted=None, prefix: bool = False,
             percent: int = PERCENT) -> DataFrame:
    """``code, key, n, hashes`` once per batch for each set; a prefix only, or wanted codes only."""

    def run(batches):
        bits = np.frombuffer(wanted.value, dtype=np.uint64) if wanted else None
        for batch in batches:
            seen: set[bytes] = set()
            codes, keys, sizes, arrays = [], [], [], []
            for s in shingle_sets((v.as_py() for v in batch.column(0)), words):
                key = set_key(s)
                if not len(s) or key in seen or bits is not None and not _in_bloom(bits, _code(key)):
                    continue
                seen.add(key)
                n = len(s)
                codes.append(_code(key))
                keys.append(key)
                sizes.append(n)
                arrays.append(s[:n - least_overlap(n, percent) + _ell(n, PREFIX_SHARE)] if prefix else s)
            offsets = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
            values = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                names=["code", "key", "n", "hashes"])

    return docs.select(text_of(docs, text_col).cast("binary").alias("body")).mapInArrow(
        run, "code long, key binary, n long, hashes array<long>")


_BLOOM_SHIFTS = (0, 27)


def _in_bloom(bits: np.ndarray, code: int) -> bool:
    places = [(code >> s) & (BLOOM_BITS - 1) for s in _BLOOM_SHIFTS]
    return all(int(bits[p >> 6]) >> (p & 63) & 1 for p in places)


def _bloom(codes: DataFrame):
    """The codes' Bloom filter as a broadcast: at most ``BLOOM_BITS`` bits, merged on the executors."""
    place = F.explode(F.array(*[F.shiftright("code", s).bitwiseAND(F.lit(BLOOM_BITS - 1)) for s in _BLOOM_SHIFTS]))
    words = (codes.select(place.alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas())
    bits = np.zeros(BLOOM_BITS >> 6, dtype=np.int64)
    bits[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64)
    return codes.sparkSession.sparkContext.broadcast(bits.tobytes())


# ---------------------------------------------------------------- the join


def _ell(n, share: int):
    """What a prefix has beyond the plain prefix filter's: 1 + n / share."""
    return (F.floor(n / share) if isinstance(n, Column) else n // share) + 1


def _least_shared(n: Column, percent: int, share: int) -> Column:
    """Prefix shingles that a set of n shares with any partner's prefix at least.

    The shared shingles that come first stand in both prefixes: of a set's own at least its
    ell; of a smaller partner's, which has percent of n at least, as its overlap exceeds its
    own least one by what it is smaller, n / share (rounded down; percent / 100 >= 1 / share)."""
    return F.greatest(_ell(least_overlap(n, percent), share), F.floor(n / share))


def _unshared(posts: DataFrame, owner: str) -> DataFrame:
    """``owner, alone``: how many of an owner's postings stand on a list of its own.

    A list is one aggregate of its smallest and largest owner, so nothing is joined back."""
    return (posts.groupBy("h").agg(F.min(owner).alias(owner), F.max(owner).alias("hi")).where(f"{owner} = hi")
            .groupBy(owner).agg(F.count(F.lit(1)).alias("alone")))


def _candidates(docs: DataFrame, rows: DataFrame, text_col: str, words: int, percent: int) -> DataFrame:
    """Step 2: whole sets of the classes that may have a partner: ``cid, n, key, hashes``.

    ``alone`` counts the shingles that no other of them has. An overlap is at most the others,
    and must be percent / (100 + percent) of both sizes: so ``most`` is the largest partner's size."""
    first = _sets_of(docs, text_col, words, prefix=True, percent=percent)
    alone = _unshared(first.select("code", F.explode("hashes").alias("h")), "code")
    n = F.col("n")
    classes = rows.where("code is not null").groupBy("code").agg(F.max("n").alias("n"))
    length = n - least_overlap(n, percent) + _ell(n, PREFIX_SHARE)
    passed = stage(classes.join(alone, "code", "left").where(
        length - F.coalesce("alone", F.lit(0)) >= _least_shared(n, percent, PREFIX_SHARE)).select("code"))
    sets = _sets_of(docs, text_col, words, wanted=_bloom(passed), percent=percent)
    once = sets.join(passed, "code", "left_semi").groupBy("code", "key").agg(
        F.first("n").alias("n"), F.first("hashes").alias("hashes"))
    once = stage(once.select(F.monotonically_increasing_id().alias("cid"), "key", "n", "hashes"))
    # now by whole sets: a partner has the least overlap of them
    lonely = stage(_unshared(once.select("cid", F.explode("hashes").alias("h")), "cid"))
    alone = F.coalesce("alone", F.lit(0))
    return (once.join(lonely, "cid", "left").where(n - alone >= least_overlap(n, percent))
            .select("cid", "key", "n", "hashes", alone.alias("alone"),
                    (F.floor((n - alone) * (100 + percent) / percent) - n).alias("most")))


def _lists(sets: DataFrame, percent: int) -> DataFrame:
    """Step 3: the inverted lists ``h, cid, n, most, alone, short`` of two or more classes; ``short``
    marks the class's short ones."""
    n = F.col("n")
    need = _least_shared(n, percent, LIST_SHARE)
    length = n - least_overlap(n, percent) + _ell(n, LIST_SHARE)
    posts = sets.select("cid", "n", "most", "alone", F.explode(F.slice("hashes", 1, length.cast("int"))).alias("h"))
    df = stage(posts.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    posts = posts.join(df, "h")
    own = Window.partitionBy("cid")  # of one document's prefix
    return stage(posts.withColumn("on", F.count(F.lit(1)).over(own))
                 .withColumn("place", F.row_number().over(own.orderBy(F.desc("df"), "h")))
                 .where(F.col("on") >= need).withColumn("short", F.col("place") >= need)
                 .select("h", "cid", "n", "most", "alone", "short"))


def _fits(a: dict[str, Column], b: dict[str, Column], percent: int) -> Column:
    """Whether sizes allow a link between sets of sizes ``lo`` to ``hi`` with a partner of at most ``most``."""
    return ((a["hi"] * 100 >= b["lo"] * percent) & (b["hi"] * 100 >= a["lo"] * percent)
            & (a["lo"] <= b["most"]) & (b["lo"] <= a["most"]))


def _one(n: str, most: str) -> dict[str, Column]:
    return {"lo": F.col(n), "hi": F.col(n), "most": F.col(most)}


def _heads(lists: DataFrame) -> DataFrame:
    """Each list's head: the class with the fewest shingles of its own, in a group of near copies the original."""
    central = F.struct((F.col("alone") / F.col("n")).alias("share"), "cid", "n", "most")
    return stage(lists.groupBy("h").agg(F.min(central).alias("head")))


def _star_links(lists: DataFrame, heads: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Step 4: links ``u, v`` between a class and the head of most of its short lists, or failing
    that one of the next heads."""
    votes = (lists.where("short").join(heads, "h")
             .where((F.col("head.cid") != F.col("cid")) & _fits(_one("n", "most"), _one("head.n", "head.most"), percent))
             .groupBy(F.col("cid").alias("u"), F.col("head.cid").alias("v")).agg(F.count(F.lit(1)).alias("c")))
    by_votes = Window.partitionBy("u").orderBy(F.desc("c"), "v")  # of one document's lists
    votes = stage(votes.withColumn("place", F.row_number().over(by_votes)).where(F.col("place") <= HEADS)
                  .select("u", "v", "place"))
    first = stage(_linked(votes.where("place = 1"), sets, percent))
    rest = votes.where("place > 1").join(first.select("u"), "u", "left_anti")
    return first.unionAll(_linked(rest, sets, percent))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` that link."""
    a = sets.select(F.col("cid").alias("u"), F.col("hashes").alias("a"))
    b = sets.select(F.col("cid").alias("v"), F.col("hashes").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return (pairs.join(a, "u").join(b, "v")
            .where(both * 100 >= (F.size("a") + F.size("b") - both) * percent).select("u", "v"))


def _pots(lists: DataFrame, heads: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """Which classes meet in which pots: ``pot, cid, n, most, asks, component, size``.

    A link between components stands on ``_least_shared`` lists of either class, all of which
    hold several components."""
    mixed = (lists.join(named, "cid").groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("top"))
             .where("low <> top"))
    mixed = stage(mixed.join(heads, "h").select("h", F.col("head.cid").alias("pot")))
    near = stage(lists.join(mixed, "h").groupBy("cid", "pot").agg(
        F.count(F.lit(1)).alias("on"), F.max("short").alias("asks"), F.max("n").alias("n"), F.max("most").alias("most")))
    enough = near.groupBy("cid").agg(F.sum("on").alias("on"), F.max("n").alias("n")).where(
        F.col("on") >= _least_shared(F.col("n"), percent, LIST_SHARE))
    return stage(near.drop("on").join(enough.select("cid"), "cid", "left_semi").join(named, "cid"))


def _search_links(lists: DataFrame, heads: DataFrame, sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Step 5: links ``u, v`` found by the classes' searches in other, larger components."""
    # a table of its own: a hot component's rows can then be split where they meet its size
    sizes = stage(comp.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    named = stage(comp.join(sizes, "component").select(F.col("node").alias("cid"), "component", "size"))
    near = _pots(lists, heads, named, percent)
    rank = F.struct("size", "component")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES))
    pots = stage(near.groupBy("pot").agg(
        F.min(rank).alias("low"), F.max(rank).alias("top"), F.min("n").alias("lo"), F.max("n").alias("hi"),
        F.max("most").alias("their_most"), blocks.alias("blocks")).where("low <> top"))
    theirs = {"lo": F.col("lo"), "hi": F.col("hi"), "most": F.col("their_most")}
    asks = stage(near.where("asks").join(pots, "pot")
                 .where((rank < F.col("top")) & _fits(_one("n", "most"), theirs, percent))  # some member may fit
                 .select("pot", "cid", "n", "component", "size"))
    sides = stage(asks.groupBy("pot").agg(blocks.alias("sides")))
    cuts = stage(pots.join(sides, "pot").select("pot", "blocks", "sides"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    whole = sets.select("cid", "hashes")
    members = (near.join(cuts, "pot").join(whole, "cid")
               .select("pot", F.pmod(F.xxhash64("cid"), F.col("blocks")).alias("block"), each("sides").alias("side"),
                       "cid", "component", "size", "hashes"))
    queries = (asks.join(cuts, "pot").join(whole, "cid")
               .select(F.col("pot").alias("asked"), each("blocks").alias("part"),
                       F.pmod(F.xxhash64("cid", F.lit(1)), F.col("sides")).alias("from"),
                       F.col("cid").alias("asker"), F.col("component").alias("own"), F.col("size").alias("own_size"),
                       F.col("hashes").alias("query")))

    def run(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        if len(asking) and len(held):
            index = Block([np.asarray(h, dtype=np.int64) for h in held["hashes"]])
            cids, ranks = held["cid"].tolist(), list(zip(held["size"].tolist(), held["component"].tolist(), strict=True))
            joined: dict[int, int] = {}

            def root(component: int) -> int:
                while component in joined:
                    component = joined[component]
                return component

            for cid, size, own, h in zip(asking["asker"].tolist(), asking["own_size"].tolist(), asking["own"].tolist(),
                                         asking["query"], strict=True):
                for hit in index.search(np.asarray(h, dtype=np.int64), percent):
                    if ranks[hit] > (size, own) and (a := root(own)) != (b := root(ranks[hit][1])):
                        joined[a] = b
                        found.append((cid, cids[hit]))
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return (queries.groupBy("asked", "part", "from").cogroup(members.groupBy("pot", "block", "side"))
            .applyInPandas(run, "u long, v long"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                     percent: int = PERCENT, row_col: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept`` and ``row``.

    ``component_id`` is the smallest id that links reach, the document's own included;
    ``kept`` marks one document of each component, the one with that id. ``row`` is
    ``row_col`` where given (it must be unique), else a generated number.

    Defined cases: null, empty and wordless texts have no shingles and only themselves; a
    text of fewer words than a shingle is one shingle; a null id comes after every other, so
    ``component_id`` is null only if no document of the component has an id; repeated rows
    are copies of each other; an empty table gives an empty result; further columns are
    ignored whatever their names.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = stage(_signatures(docs, id_col, text_col, words, row))
    head = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = rows.where("key is not null").groupBy("key").agg(F.min(head).alias("head"))
    sets = stage(_candidates(docs, rows, text_col, words, percent))
    lists = _lists(sets, percent)
    heads = _heads(lists)
    links = stage(_star_links(lists, heads, sets, percent))
    comp = components(links)
    alone = lists.select("cid").distinct().join(comp, F.col("cid") == F.col("node"), "left_anti")
    every = stage(comp.unionAll(alone.select(F.col("cid").alias("node"), F.col("cid").alias("component"))))
    more = stage(_search_links(lists, heads, sets, every, percent))
    if not more.isEmpty():
        comp = components(links.unionAll(more))
    of_class = sets.select("key", "cid").join(comp, F.col("cid") == F.col("node")).select("key", "component")
    named = stage(classes.join(of_class, "key", "left"))
    best = stage(named.where("component is not null").groupBy("component").agg(F.min("head").alias("best")))
    named = named.join(best, "component", "left").select("key", F.coalesce("best", "head").alias("head"))
    alone = F.col("key").isNull()
    return rows.join(named, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        (alone | (F.col("head.row") == F.col("row"))).alias("kept"), "row")


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return ngram_components(read_table(spark, sf_dir, "documents")).drop("row", "kept")


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g FROM (
        SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.c = e.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
