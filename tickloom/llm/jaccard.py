"""N-gram Jaccard join by a token-group matrix.

A document is its set of distinct five-word shingles.  Documents with equal
sets are one class and are linked by that alone; the join works on classes.

1. One pass writes (document, set size, set digest) and counts shingles into a
   sketch of fixed size.  Shingles that the sketch holds for very common come
   last in the global order of shingles, so that passages many unrelated
   documents share do not bring them together.
2. A set posts its shingles in the first 30 percent of the order's range (but at
   least its first n - ceil(0.8 n) + 1 ones, so that two linked sets always
   meet).  Of a linked set at most n - ceil(0.8 n) shingles are missing in its
   partner, so all but so many of its posted ones must be posted by another
   class too.  Nearly all documents fail that and are dropped, again and again
   as the droppings make more shingles lonely.
3. The remaining classes are partitioned into groups of similar ones, by the
   most shared of their posted shingles.  The token-group matrix (shingle,
   group) holds each group's union of posted shingles; two groups become a
   candidate only where their unions share as many as the least demanding
   member needs.  Groups that are candidates of one another are laid together
   in blocks of bounded size; candidates in other blocks visit.
4. A block is opened for a set only if the overlap of the set with the block's
   whole union reaches 0.8 of the set's size, an upper bound of every overlap
   with a member.  Opened members are compared exactly.
5. Links that connect something new go to the connected components.

Nothing is capped: blocks bound the memory of a task, and every pair of classes
that can link meets in exactly one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import arrays, idmap
from tickloom.llm.components import components
from tickloom.llm.wordhash import U64, hash_words, shingles, text_slices
from tickloom.session import cut_lineage

SHINGLE = 5
PERCENT = 80
SKETCH_BITS = 20
POSTED = 0.3  # share of the order's range that every set posts
ROUNDS = 2  # of dropping
GROUP = 8192  # classes of a block, about
GROUP_SHINGLES = 1 << 21  # shingles of a block, about


def _sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words, first = hash_words(data, offsets)
    for at, end in zip(first[:-1], first[1:]):
        found = np.sort(shingles(words[at:end], SHINGLE))
        yield found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def _digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed numbers."""
    value = xxhash.xxh3_128_intdigest(found.tobytes())
    low, high = value & ((1 << 64) - 1), value >> 64
    return low - (1 << 64) * (low >> 63), high - (1 << 64) * (high >> 63)


def _scan(docs: DataFrame) -> DataFrame:
    """A row (doc_id, n, c1, c2) per document and, beside them, the blocks of the shingle sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        seen: set[tuple[int, int]] = set()
        for rows, data, offsets in text_slices(batches, "text"):
            out: list[tuple] = []
            fresh = []
            for found in _sets(data, offsets):
                c = _digest(found) if len(found) else (0, 0)
                out.append((len(found), *c))
                if len(found) and c not in seen:  # copies count once
                    seen.add(c)
                    fresh.append(found)
            if fresh:
                cells = (np.concatenate(fresh) >> U64(64 - SKETCH_BITS)).astype(np.int64)
                np.add.at(sketch, cells, 1)
            yield batch_of(
                ids=rows.column(0), sets=[pa.array([r[k] for r in out], pa.int64()) for k in range(3)]
            )
        for block in arrays.pack({"sketch": sketch.astype(np.int32)}):
            yield batch_of(block=block)

    kind = docs.schema["doc_id"].dataType
    fields = [
        T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("c1", T.LongType()),
        T.StructField("c2", T.LongType()), T.StructField("name", T.StringType()), T.StructField("block", T.IntegerType()),
        T.StructField("dtype", T.StringType()), T.StructField("body", T.BinaryType()),
    ]
    id_type = T_arrow(kind)
    blank = [pa.string(), pa.int32(), pa.string(), pa.binary()]

    def batch_of(ids=None, sets=None, block=None) -> pa.RecordBatch:
        if block is None:
            cols = [ids, *sets, *[pa.nulls(len(ids), t) for t in blank]]
        else:
            n = block.num_rows
            cols = [pa.nulls(n, id_type), *[pa.nulls(n, pa.int64())] * 3, *block.columns]
        return pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields))


def T_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _levels(sketch: np.ndarray) -> np.ndarray:
    """How far above the usual load a cell is, in powers of two; 0 for nearly all cells."""
    usual = 4 * sketch.mean() + 16
    return np.floor(np.log2(np.maximum(sketch / usual, 1))).astype(np.uint8)


def _posted(docs: DataFrame, levels) -> DataFrame:
    """(token, c, n, need): the posted shingles of each class, and how many of them a partner must post too."""
    limit = U64(int(POSTED * (1 << 64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = levels.value
        seen: set[tuple[int, int]] = set()
        for _, data, offsets in text_slices(batches, "text"):
            tokens, classes, sizes, needs = [], [], [], []
            for found in _sets(data, offsets):
                n = len(found)
                if not n or (c := _digest(found)) in seen:
                    continue
                seen.add(c)
                level = common[(found >> U64(64 - SKETCH_BITS)).astype(np.int64)]
                ordered = found[np.argsort(level, kind="stable")] if level.any() else found
                within = int(np.searchsorted(ordered[: n - np.count_nonzero(level)], limit))
                missing = n - -(-PERCENT * n // 100)
                tokens.append(ordered[: max(within, missing + 1)])
                classes.append(c[0])
                sizes.append(n)
                needs.append(max(1, within - missing))
            if tokens:
                counts = [len(t) for t in tokens]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens).view(np.int64)),
                        pa.array(np.repeat(np.array(classes, dtype=np.int64), counts)),
                        pa.array(np.repeat(np.array(sizes, dtype=np.int32), counts)),
                        pa.array(np.repeat(np.array(needs, dtype=np.int32), counts)),
                    ],
                    ["token", "c", "n", "need"],
                )

    return docs.select("text").mapInArrow(run, "token long, c long, n int, need int")


def _shared(posted: DataFrame) -> DataFrame:
    """The posted shingles that two classes have, with their counts, of classes that share as many as they need.

    A class that several tasks post counts its shingles several times: that
    may keep it, but never drops it.
    """
    by_token, by_class = Window.partitionBy("token"), Window.partitionBy("c")
    met = posted.select(
        "token", "c", "n", "need", F.min("c").over(by_token).alias("lo"), F.max("c").over(by_token).alias("hi"),
        F.count(F.lit(1)).over(by_token).alias("cnt"),
    ).where("lo <> hi")
    return met.select("token", "c", "n", "need", "cnt", F.count(F.lit(1)).over(by_class).alias("have")).where("have >= need")


def _grouped(live: DataFrame) -> DataFrame:
    """``live`` with the group g of each class: by its most shared shingle, in parts of bounded size.

    The count of that shingle bounds how many classes can have it as their key,
    so the number of parts needs no second look.  ``low`` is the least of the
    shingles that are shared about as much; it is mostly the same in all groups
    of one family, which lie side by side by it.
    """
    by_class = Window.partitionBy("c")
    keyed = live.withColumn("key", F.max(F.struct("cnt", "token")).over(by_class))
    keyed = keyed.withColumn("low", F.min(F.when(F.col("cnt") * 2 >= F.col("key.cnt"), F.col("token"))).over(by_class))
    many = F.greatest(F.col("key.cnt") / GROUP, F.col("key.cnt") * F.col("n") / GROUP_SHINGLES, F.lit(1.0))
    keyed = keyed.withColumn("parts", F.pow(F.lit(2.0), F.ceil(F.log2(many))).cast("long"))
    part = F.pmod(F.xxhash64("c"), F.col("parts"))
    return keyed.select("token", "c", "n", "need", "low", F.xxhash64("key.token", "parts", part).alias("g"))


def _candidates(live: DataFrame) -> DataFrame:
    """(g, visitor): the pairs of groups whose unions of posted shingles allow a link."""
    needs = live.groupBy("g").agg(F.min("need").alias("need"))
    # dealt by shingle once: the union of a group and the meeting of groups both happen there
    matrix = live.repartition("token").groupBy("token", "g").agg(F.lit(True).alias("_"))
    other = matrix.select("token", F.col("g").alias("visitor"))
    shared = matrix.join(other, "token").where("g < visitor").groupBy("g", "visitor").agg(F.count(F.lit(1)).alias("shared"))
    both = shared.join(needs, "g").join(needs.select(F.col("g").alias("visitor"), F.col("need").alias("other")), "visitor")
    return both.where("shared >= greatest(need, other)").select("g", "visitor")


def _blocks(nodes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, g, block) and the visits (home, g): groups whose members are compared with another block's.

    Of two blocks the one with the smaller number is the home, so two classes
    meet once.
    """
    roots = components(pairs.select(F.col("g").alias("a"), F.col("visitor").alias("b")))
    sizes = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.min("low").alias("low"))
    rooted = sizes.join(roots.select(F.col("node").alias("g"), "root"), "g", "left").withColumn("root", F.coalesce("root", "g"))
    before = Window.partitionBy("root").orderBy("low", "g").rowsBetween(Window.unboundedPreceding, -1)
    number = F.greatest(
        F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / GROUP),
        F.floor(F.coalesce(F.sum("shingles").over(before), F.lit(0)) / GROUP_SHINGLES),
    )
    laid = cut_lineage(rooted.select("g", F.xxhash64("root", number).alias("block")))
    one = pairs.join(laid, "g").select("g", "visitor", "block")
    two = one.join(laid.select(F.col("g").alias("visitor"), F.col("block").alias("other")), "visitor").where("block <> other")
    visits = two.select(
        F.least("block", "other").alias("home"), F.when(F.col("block") < F.col("other"), F.col("visitor")).otherwise(F.col("g")).alias("g")
    )
    return nodes.join(laid, "g").select("c", "g", "block"), visits.distinct()


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, block, c, m, text) of the wanted (doc_id, c, m, g, block).

    A bit map of fixed size keeps the texts of other documents from being
    moved; the join decides.  Texts travel, not their shingles: compressed they
    are less than half as large.
    """
    return docs.where(idmap.may_be_in(docs, wanted)).join(wanted, "doc_id").select("g", "block", "c", "m", "text")


class _Lists:
    """Lists of members, one after another."""

    def __init__(self, members: np.ndarray, many: np.ndarray):
        self.members, self.many, self.start = members, many, np.cumsum(many) - many

    def of(self, at: np.ndarray) -> np.ndarray:
        """The members of some lists, one after another."""
        many = self.many[at]
        return self.members[np.repeat(self.start[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())]


class _OpenGroup:
    """A block's members with the union of their shingles.

    A shingle that more than half of the members hold is listed by the members
    that lack it, so copies of one text cost no more than their differences.
    """

    def __init__(self, members: list[tuple[dict, np.ndarray]]):
        size = len(members)
        self.c = [r["c"] for r, _ in members]
        self.m = np.array([r["m"] for r, _ in members], dtype=np.int64)
        self.sets = [found for _, found in members]
        self.n = np.array([len(found) for found in self.sets], dtype=np.int64)
        tokens = np.concatenate(self.sets)
        order = np.argsort(tokens, kind="stable")
        owner = np.repeat(np.arange(size), self.n)[order]
        tokens = tokens[order]
        start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        self.union = tokens[start]
        held = np.diff(np.concatenate([start, [len(tokens)]]))
        self.core = 2 * held > size
        self.holders = _Lists(owner[~np.repeat(self.core, held)], np.where(self.core, 0, held))
        lackers, everyone = [], np.ones(size, dtype=bool)
        for k in np.flatnonzero(self.core):
            lack = everyone.copy()
            lack[owner[start[k]: start[k] + held[k]]] = False
            lackers.append(np.flatnonzero(lack))
        many = np.zeros(len(start), dtype=np.int64)
        many[self.core] = [len(x) for x in lackers]
        self.lackers = _Lists(np.concatenate([owner[:0], *lackers]), many)
        self.lack = np.bincount(self.lackers.members, minlength=size)
        self.links = np.zeros(size, dtype=np.int64)
        self.part = list(range(size))

    def root(self, i: int) -> int:
        while self.part[i] != i:
            self.part[i] = self.part[self.part[i]]
            i = self.part[i]
        return i

    def linked(self, found: np.ndarray) -> np.ndarray:
        """Members that link with a set; none unless the bound by the union allows one."""
        at = np.searchsorted(self.union, found)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == found]
        if 100 * len(at) < PERCENT * len(found):
            return np.zeros(0, dtype=np.int64)
        lacked = self.core.copy()
        lacked[at] = False
        both = (
            np.count_nonzero(self.core[at])
            - self.lack
            + np.bincount(self.lackers.of(np.flatnonzero(lacked)), minlength=len(self.n))
            + np.bincount(self.holders.of(at[~self.core[at]]), minlength=len(self.n))
        )
        return np.flatnonzero(100 * both >= PERCENT * (self.n + len(found) - both))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links and link counts of (home, g, c, m, text), each block's own members first, equal classes together."""
    home: list[tuple[dict, np.ndarray]] = []
    group, opened, last = None, None, None
    out: list[tuple] = []

    def close() -> None:
        """Links among the members, once all are there."""
        nonlocal opened
        opened = _OpenGroup(home)
        for i, found in enumerate(opened.sets):
            for j in opened.linked(found):
                if j != i:
                    opened.links[i] += opened.m[j]
                    a, b = opened.root(i), opened.root(int(j))
                    if a != b:
                        opened.part[a] = b
                        out.append((opened.c[i], opened.c[j], 0))

    def counts() -> None:
        if opened is not None:
            out.extend((c, None, int(k)) for c, k in zip(opened.c, opened.links) if k)

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "links"])

    slices = ((rows.select(["home", "g", "c", "m"]).to_pylist(), _sets(data, offsets)) for rows, data, offsets in text_slices(batches, "text"))
    for row, found in (pair for rows, sets in slices for pair in zip(rows, sets)):
        if not len(found) or _digest(found)[0] != row["c"]:
            continue  # another row that carries the same id
        if row["g"] != group:
            if home and opened is None:
                close()
            counts()
            group, home, opened, last = row["g"], [], None, None
        if (row["home"], row["c"]) == last:
            continue  # a repeated row
        last = (row["home"], row["c"])
        if row["home"]:
            home.append((row, found))
            continue
        if opened is None:
            if not home:
                continue
            close()
        hits = opened.linked(found)
        if len(hits):
            opened.links[hits] += row["m"]
            out.append((row["c"], None, int(opened.m[hits].sum())))
            # one link to each part of the group says all about what is connected
            for j in {opened.root(int(j)): int(j) for j in hits}.values():
                out.append((row["c"], opened.c[j], 0))
        if len(out) > 10_000:
            yield batch()
    if home and opened is None:
        close()
    counts()
    if out:
        yield batch()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), one row for each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links, itself included;
    n_links counts the documents it links with directly, copies included.

    Nulls: a null text has no shingles.  A document without shingles is linked
    with nothing.  A row without doc_id takes part in nothing and has a null
    component_id.  Rows that repeat a doc_id are documents of their own; if
    equal they are linked copies.  An empty table gives no rows; other columns
    are not read.

    Two sets are taken for equal when 128 bits of their digests agree, and
    shingles when 64 bits do.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    scan = cut_lineage(_scan(docs))
    sets = scan.where("name IS NULL").select("doc_id", "n", "c1", "c2")
    sketch = arrays.collected(
        arrays.merged(scan.where("name IS NOT NULL").select("name", "block", "dtype", "body"), lambda name: "sum"),
        lambda name: 1 << SKETCH_BITS,
    ).get("sketch", np.zeros(1 << SKETCH_BITS, dtype=np.int32))
    levels = spark.sparkContext.broadcast(_levels(sketch))

    named = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m"))

    live = _posted(docs.where("doc_id IS NOT NULL"), levels)
    for _ in range(ROUNDS):
        live = _shared(live)
    live = cut_lineage(_grouped(live))
    nodes = live.groupBy("c").agg(*[F.first(x).alias(x) for x in ("n", "need", "low", "g")])
    pairs = cut_lineage(_candidates(live))
    placed, visits = _blocks(nodes, pairs)
    wanted = cut_lineage(
        classes.join(placed.withColumnRenamed("c", "c1"), "c1").select(
            F.col("rep").alias("doc_id"), F.col("c1").alias("c"), "m", "g", "block"
        )
    )
    whole = cut_lineage(_texts(docs, wanted))
    homes = whole.select(F.lit(True).alias("home"), F.col("block").alias("g"), "c", "m", "text")
    guests = visits.join(whole, "g").select(F.lit(False).alias("home"), F.col("home").alias("g"), "c", "m", "text")
    dealt = homes.union(guests).repartition("g").sortWithinPartitions("g", F.col("home").desc(), "c")
    found = cut_lineage(dealt.mapInArrow(_verify, "a long, b long, links long"))

    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("c1")).agg(F.sum("links").alias("links"))
    members = classes.join(roots.select(F.col("node").alias("c1"), "root"), "c1")
    least = members.groupBy("root").agg(F.min("rep").alias("component"))
    joined = members.join(least, "root").select("c1", "c2", "component")
    linked = cut_lineage(joined.join(counts, "c1", "left").select("c1", "c2", "component", F.coalesce("links", F.lit(0)).alias("links")))
    table = classes.join(linked, ["c1", "c2"], "left").select(
        "c1", "c2", F.coalesce("component", "rep").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"),
    )
    return sets.join(table, ["c1", "c2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")).alias("component_id"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("links")).otherwise(0).alias("n_links"),
    )
