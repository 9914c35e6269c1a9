"""N-gram Jaccard join: groups of documents linked by shared word shingles, exact.

Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of k-word shingles.
The result is each document's component under these links.

The document-by-n-gram incidence matrix is multiplied with its transpose in blocks, and only where
size-derived bounds leave a pair possible:

1. Documents of equal sets are one class; from here on rows of the matrix are classes.
2. N-grams get one global order, rare first, from counts over all documents.  Groups of documents send
   their n-grams' leading hash bits, sorted and difference-coded, to the hash range's owner and get the
   counts back.  (Any order is right, so hashes that share these bits only cost a little time.)  A pair
   that links must share one of the first n - ceil(percent * n / 100) + 1 n-grams of both, so only these
   columns take part in the product that finds candidates, and of them only those counted twice or more.
   Entries carry n and their place; a pair is discarded where 100 * smaller < percent * larger, or where
   the n-grams after the shared one can't reach the overlap its sizes ask for.
3. Entries outside a column's largest component (at first, any one class) meet one pivot of that
   component, another one each turn, as long as a good part of them links, and what links joins.  The
   candidates' overlaps are counted in blocks of a pivot and up to BLOCK_ROWS rows over all n-grams.
4. In columns that still hold several components, entries outside the column's largest component
   meet the entries of other components.  What remains is one component already, so no link
   between components is lost and a large group of near copies never makes all its pairs.

Sets are held by 64-bit hashes.  A null text or one without words is linked with nothing, a null
doc_id never gives its name to a component.  Repeated rows are rows of one class.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import components, textbytes as tb
from .packing import lean, pack, pack_sorted, unpack, unpack_sorted
from .routing import Route
from .shared import Workspace, column_of, fresh_name, once, partitions, quoted, written

#: Leading bits of an n-gram's hash by which it is counted.
COUNT_BITS = 40
#: Bits of the filter that tells which sets are fetched for counting; 2**26 bits are 8 MB.
FILTER_BITS = 26
#: Rows, and n-grams, in one block of the product.
BLOCK_ROWS, BLOCK_GRAMS = 128, 4 << 20
#: Turns of step 3 before step 4 at most; step 4 alone is exact, the turns make it small.
MOST_TURNS = 6
#: Step 3 ends when fewer than one in FEW of a turn's pairs link.
FEW = 4
#: Bytes of text in one group of documents.
GROUP_BYTES = 12 << 20


def class_of(grams: np.ndarray) -> int:
    """A hash of a whole set (sorted distinct n-grams)."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for g in tb.shingles(*tb.column_bytes(column), k):
        yield np.unique(g)


def _group_sets(docs: pa.Table, k: int) -> tuple[list[np.ndarray], list[int], np.ndarray, np.ndarray]:
    """(sets of the group's classes, the classes, row -> class, leading bits of all sets' n-grams)."""
    sets, names, of, known = [], [], [], {}
    for s in _sets(docs.column("text"), k):
        c = class_of(s)
        if c not in known:
            known[c] = len(sets)
            sets.append(s)
            names.append(c)
        of.append(known[c])
    return sets, names, np.array(of, np.int64), np.concatenate(sets or [np.zeros(0, np.uint64)]) >> np.uint64(64 - COUNT_BITS)


def _cuts(x: np.ndarray) -> list[tuple[int, int]]:
    if not len(x):
        return []
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return list(zip(first.tolist(), [*first[1:].tolist(), len(x)]))


def _part(bits: np.ndarray, parts: int) -> np.ndarray:
    return (bits * np.uint64(parts) >> np.uint64(COUNT_BITS)).astype(np.int64)


def _ask(k: int, route: Route):
    """A group's n-grams and how many of its classes hold each, to their owners."""
    def run(docs: pa.Table) -> pa.Table:
        own = np.sort(_group_sets(docs, k)[3])
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        bits, count = own[first], np.diff(np.append(first, len(own))).astype(np.uint32)
        return _counts(docs.column("g")[0].as_py(), bits, count, _part(bits, route.parts) // route.fan)
    return run


_COUNTS = "g int, part int, bits binary, counts binary"


def _counts(sender: int, bits: np.ndarray, count: np.ndarray, part: np.ndarray) -> pa.Table:
    rows = [(int(part[a]), pack_sorted(bits[a:b]), pack(count[a:b])) for a, b in _cuts(part)]
    return pa.table({"g": pa.array([sender] * len(rows), pa.int32()), "part": pa.array([r[0] for r in rows], pa.int32()),
                     "bits": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})


def _joined(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct hash bits, their counts, place of each row's).  Counts only order columns, so they may stop at 2**32 - 1."""
    bits = [unpack_sorted(r["bits"]) for r in rows]
    every, index = np.unique(np.concatenate(bits), return_inverse=True)
    total = np.bincount(index, weights=np.concatenate([unpack(r["counts"], np.uint32) for r in rows]), minlength=len(every))
    return every, np.minimum(total, 0xFFFFFFFF).astype(np.uint32), np.split(index, np.cumsum([len(b) for b in bits])[:-1])


def _told(rows: list[dict], total: np.ndarray, places: list[np.ndarray]) -> pa.Table:
    return pa.table({"g": pa.array([r["g"] for r in rows], pa.int32()), "part": pa.array([r["part"] for r in rows], pa.int32()),
                     "counts": pa.array([pack(total[i]) for i in places], pa.binary())})


def _answer(rows: pa.Table) -> pa.Table:
    """Whole counts of what each group asked for, in its order."""
    rows = rows.to_pylist()
    _, total, places = _joined(rows)
    return _told(rows, total, places)


def _gather(route: Route):
    """A node's questions to the owners."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        bits, total, _ = _joined(rows)
        return _counts(rows[0]["node"], bits, total, _part(bits, route.parts))
    return run


def _hand(rows: pa.Table, told: pa.Table) -> pa.Table:
    """A node's answers to its groups."""
    rows, told = rows.to_pylist(), sorted(told.to_pylist(), key=lambda r: r["part"])
    _, _, places = _joined(rows)
    return _told(rows, np.concatenate([unpack(r["counts"], np.uint32) for r in told]), places)


def _entries(k: int, percent: int):
    """Rows without gram: each document's class.  Rows with gram: entries of the columns that a link can't do without."""
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        names = ("doc_id", "text_key", "n", "class", "gram", "place")
        if not docs.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        sets, classes, of, bits = _group_sets(docs, k)
        told = sorted(told.to_pylist(), key=lambda r: r["part"])
        count = np.concatenate([unpack(r["counts"], np.uint32) for r in told] or [np.zeros(0, np.uint32)])
        # Most n-grams are counted once; the others are looked up behind a bitmap.
        known = np.sort(bits)
        known = known[np.flatnonzero(np.concatenate([[True], known[1:] != known[:-1]]))] if len(known) else known
        many = np.flatnonzero(count > 1)
        common, often = known[many], count[many]
        seen = np.zeros(1 << 22, bool)
        mask = np.uint64(len(seen) - 1)
        seen[(common & mask).astype(np.int64)] = True
        rank = np.ones(len(bits), np.uint32)
        maybe = np.flatnonzero(seen[(bits & mask).astype(np.int64)])
        if len(common) and len(maybe):
            at = np.minimum(np.searchsorted(common, bits[maybe]), len(common) - 1)
            hit = common[at] == bits[maybe]
            rank[maybe[hit]] = often[at[hit]]
        size = np.array([len(s) for s in sets], np.int64)
        classes = np.array(classes, np.int64)
        ends = np.cumsum(size)
        shared = np.diff(np.concatenate([[0], np.cumsum(rank > 1)])[np.concatenate([[0], ends])])
        prefix = size - (percent * size + 99) // 100 + 1
        grams, place, own = [], [], []
        # A prefix that n-grams counted once can fill has no shared column.
        for i in np.flatnonzero((size > 0) & (size - shared < prefix)).tolist():
            r = rank[ends[i] - size[i]:ends[i]]
            order = np.argsort(r, kind="stable")[:prefix[i]]
            at = np.flatnonzero(r[order] > 1)
            grams.append(sets[i][order[at]])
            place.append(at)
            own.append(np.full(len(at), i))
        own = np.concatenate(own or [np.zeros(0, np.int64)]).astype(np.int64)
        n, m = len(of), len(own)
        flat = lambda a, x: pa.array(np.concatenate([a, x]).astype(np.int64))
        return pa.table({
            "doc_id": pa.concat_arrays([docs.column("doc_id").combine_chunks(), pa.nulls(m, pa.int64())]),
            "text_key": pa.concat_arrays([docs.column("text_key").combine_chunks(), pa.nulls(m, pa.int64())]),
            "n": flat(size[of], size[own]), "class": flat(classes[of], classes[own]),
            "gram": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.concatenate(grams or [np.zeros(0, np.uint64)]).view(np.int64))]),
            "place": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.concatenate(place or [np.zeros(0, np.int64)]).astype(np.int64))])})
    return run


def incidence(docs: DataFrame, k: int, percent: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text_key, n_shingles, class) of every row, (gram, class, n, place) entries)."""
    text = F.col(quoted(column_of(docs, "text")))
    rows = docs.select(F.col(quoted(column_of(docs, "doc_id"))).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(partitions(docs.sparkSession), int(total // GROUP_BYTES) + 1)
    rows = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    route = Route(groups)
    asked = rows.groupBy("g").applyInArrow(lean(_ask(k, route)), _COUNTS)
    if route.fan > 1:
        asked = work.written(asked, "asked")
    up = route.up(asked, _gather(route), _COUNTS, work, "gathered")
    told = work.written(up.groupBy("part").applyInArrow(lean(_answer), "g int, part int, counts binary"), "counts")
    told = route.down(asked, told, _hand, "g int, part int, counts binary", work, "handed")
    both = work.written(rows.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(
        lean(_entries(k, percent)), "doc_id long, text_key long, n long, class long, gram long, place long"), "incidence")
    work.drop("counts")
    return (both.where("gram is null").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "class"),
            both.where("gram is not null").select("gram", "class", F.col("n").cast("int").alias("n"), F.col("place").cast("int").alias("place")))


def _possible(percent: int) -> Column:
    """Whether entries (n, place) and (m, spot) of one column may belong to a link."""
    need = F.ceil(percent * (F.col("n").cast("long") + F.col("m")) / F.lit(100 + percent))
    return ((100 * F.least("n", "m").cast("long") >= percent * F.greatest("n", "m").cast("long"))
            & (F.least(F.col("n") - F.col("place"), F.col("m") - F.col("spot")) >= need))


def links(sets: DataFrame, pairs: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """(a, b): the pairs (a, b, n) of classes that link, counted over their whole sets in blocks; n is the size of a.

    sets has (class, grams).  Pairs are dealt by their b: b is a block's pivot and meets up to about
    BLOCK_ROWS a's, or BLOCK_GRAMS n-grams, there, so a hot pivot has many blocks.
    """
    sizes = work.written(pairs.groupBy("b").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.col("n").cast("long")) / BLOCK_GRAMS)).alias("blocks")), "sizes")
    dealt = pairs.join(sizes, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("blocks")))
    pivots = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    routes = dealt.select(F.col("a").alias("class"), F.col("b").alias("pivot"), "salt").union(
        pivots.select(F.col("b").alias("class"), F.col("b").alias("pivot"), "salt"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pivot = pdf["pivot"].iloc[0]
        sets = [np.frombuffer(x, np.uint64) for x in pdf["grams"]]
        own = next((s for s, c in zip(sets, pdf["class"]) if c == pivot), None)
        if own is None:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        # One block of the product: the pivot's row with all rows of the block.
        size = np.array([len(s) for s in sets])
        ends = np.cumsum(size)
        hit = np.concatenate([[0], np.cumsum(np.isin(np.concatenate(sets), own))])
        overlap = hit[ends] - hit[ends - size]
        keep = (100 * overlap >= percent * (size + len(own) - overlap)) & (pdf["class"].to_numpy() != pivot)
        return pd.DataFrame({"a": pdf["class"].to_numpy()[keep], "b": np.full(keep.sum(), pivot)})
    return routes.join(sets, "class").groupBy("pivot", "salt").applyInPandas(lean(count), "a long, b long")


def sets_of(docs: DataFrame, members: DataFrame, k: int, work: Workspace) -> DataFrame:
    """(class, grams) of the classes of members, which has one document (class, doc_id) of each."""
    spark = docs.sparkSession
    # A bit for each wanted (class, document); a few others share one and are dropped by the join.
    bit = F.col("class").bitwiseXOR(F.coalesce("doc_id", F.lit(0))).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    with once(spark):
        maps = members.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)  # buckets and positions count from 1
    for r in maps:
        bits[(r[0] - 1) * 4096:r[0] * 4096] = np.frombuffer(r[1], np.uint8)
    return work.written(_sets_of(docs, members, bits, k), "sets")


def _sets_of(docs: DataFrame, wanted: DataFrame, bits: np.ndarray, k: int) -> DataFrame:
    """(class, grams) of every wanted class, once."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, mask = shared.value, (1 << FILTER_BITS) - 1
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            keep, own, grams = [], [], []
            for i, s in enumerate(_sets(batch.column(1), k)):
                c = class_of(s)
                at = (c ^ int(ids[i])) & mask
                if filled[at >> 3] >> (at & 7) & 1:
                    keep.append(i)
                    own.append(c)
                    grams.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(own, pa.int64()), pa.array(grams, pa.binary())],
                                             ["doc_id", "class", "grams"])
    rows = docs.select(F.col(quoted(column_of(docs, "doc_id"))).cast("long").alias("doc_id"), F.col(quoted(column_of(docs, "text"))).alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, class long, grams binary")
    same = wanted.select("class", F.col("doc_id").alias("named"))
    return rows.join(same, "class").where(F.col("doc_id").eqNullSafe(F.col("named"))).select("class", "grams").dropDuplicates(["class"])


def _first_mixed(entries: DataFrame, work: Workspace) -> DataFrame:
    """Entries of columns with two classes or more, each class a component of its own.

    A class of copies has an entry from each group that holds some, so a column's largest is one with many copies,
    which the columns of a large group of near copies then have in common.
    """
    one = work.written(entries.groupBy("gram", "class").agg(F.first("n").alias("n"), F.first("place").alias("place"), F.count("*").alias("rows")), "classes")
    columns = one.groupBy("gram").agg(F.max(F.struct("rows", "class")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    columns = work.written(columns.select("gram", F.col("most.class").alias("largest")), "columns")
    mixed = work.written(one.drop("rows").join(columns, "gram").withColumn("part", F.col("class")), "mixed")
    work.drop("classes", "columns")
    return mixed


def _mixed(live: DataFrame, whole: DataFrame, work: Workspace) -> DataFrame:
    """Entries of columns that hold several components, each with its component (part) and its column's largest.

    Joins on a column's n-gram read written tables on both sides, so that adaptive execution can split a hot column.
    """
    live = live.select("gram", "class", "n", "place")
    part = live.join(whole, live["class"] == whole["node"], "left").select(*live.columns, F.coalesce("component_id", "class").alias("part"))
    part = work.written(part, "parts")
    per_part = part.groupBy("gram", "part").agg(F.count("*").alias("rows"))
    columns = per_part.groupBy("gram").agg(F.max(F.struct("rows", "part")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    columns = work.written(columns.select("gram", F.col("most.part").alias("largest")), "columns")
    out = work.written(part.join(columns, "gram"), "mixed")
    work.drop("parts", "columns")
    return out


def _to_pivots(mixed: DataFrame, turn: int, percent: int, work: Workspace) -> DataFrame:
    """(a, b, n): each entry outside its column's largest component with one class of that component, another one each turn."""
    inside = mixed.where("part = largest")
    pivots = inside.groupBy("gram").agg(F.min(F.struct(F.xxhash64("class", F.lit(turn)).alias("h"), "class", "n", "place")).alias("p"))
    pivots = work.written(pivots.select("gram", F.col("p.class").alias("b"), F.col("p.n").alias("m"), F.col("p.place").alias("spot")), "pivots")
    met = mixed.where("part <> largest").join(pivots, "gram").where(_possible(percent))
    return met.select(F.col("class").alias("a"), "b", "n").distinct()


def _rest(mixed: DataFrame, percent: int) -> DataFrame:
    """(a, b, n): all pairs of a column's entries of different components; the largest component's never meet each other.

    A pair must pass the bounds, which are tight for documents that share a template and differ in n-grams of their
    own: those n-grams are rarer and come first, so the template's place tells how much of it is left to share.
    """
    few = mixed.where("part <> largest")
    other = mixed.select("gram", F.col("class").alias("b"), F.col("n").alias("m"), F.col("place").alias("spot"), F.col("part").alias("part_b"), F.col("largest").alias("largest_b"))
    # Pairs outside the largest component are met once, by order.
    once_each = (F.col("part_b") == F.col("largest_b")) | (F.col("class") < F.col("b"))
    rest = few.join(other, "gram").where((F.col("part") != F.col("part_b")) & once_each & _possible(percent))
    return rest.select(F.least("class", "b").alias("b"), F.greatest("class", "b").alias("a"),
                       F.when(F.col("class") > F.col("b"), F.col("n")).otherwise(F.col("m")).alias("n")).distinct()


def linked(entries: DataFrame, sets_for, percent: int, work: Workspace) -> DataFrame:
    """(node, component_id) of all classes that link with another.

    entries: (gram, class, n, place) of the columns that a link can't do without.  sets_for makes the (class, grams)
    table of the classes it is given.
    """
    live = _first_mixed(entries, work)
    sets = sets_for(live.select("class").distinct())
    whole, few = None, False
    for turn in range(MOST_TURNS + 1):
        if turn:
            live = _mixed(live, whole, work)  # columns of one component stay so and are done
        last = turn == MOST_TURNS or few
        pairs = work.written(_rest(live, percent) if last else _to_pivots(live, turn, percent, work), "pairs")
        new = work.written(links(sets, pairs, percent, work), "found")
        whole = work.written(components.connected(new) if whole is None else components.joined(whole, new), "whole")
        if last:
            return whole
        few = new.count() * FEW < pairs.count()


def placed(docs: DataFrame, k: int, percent: int, work: Workspace, find=incidence) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, component_id and part (a name of the component itself; null without shingles).

    find gives what `incidence` gives; its entries' columns decide which classes may meet.
    """
    own, entries = find(docs, k, percent, work)
    members = work.written(own.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id")), "members")
    whole = linked(entries, lambda classes: sets_of(docs, work.written(members.join(classes, "class"), "wanted"), k, work), percent, work)
    named = work.written(members.join(whole, members["class"] == whole["node"], "left").select(
        "class", "doc_id", F.coalesce("component_id", "class").alias("part")), "named")
    least = work.written(named.groupBy("part").agg(F.min("doc_id").alias("component_id")), "least")
    named = work.written(named.join(least, "part").select("class", "part", "component_id"), "parts")
    # Rows without shingles join nothing; each is dealt by its own id.
    mark = F.when(F.col("n_shingles") > 0, F.col("class")).otherwise(F.xxhash64("doc_id"))
    rows = own.withColumn("mark", mark).join(named.withColumnRenamed("class", "mark"), "mark", "left")
    some = F.col("n_shingles") > 0
    return rows.select("doc_id", "text_key", "n_shingles", F.when(some, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
                       F.when(some, F.col("part")).alias("part"))


def components_of(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row."""
    with Workspace(docs.sparkSession) as work:
        return written(placed(docs, k, percent, work).select("doc_id", "n_shingles", "component_id"), "components")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without those that another document of their component stands for.

    The row with the least id stands for its component; of several texts with that id the one with the least hash,
    of repeated rows one.  A row goes by its id and text, so another text of the same id is judged for itself.
    Rows without shingles or without an id stay.
    """
    with Workspace(docs.sparkSession) as work:
        found = work.written(placed(docs, k, percent, work).where("doc_id is not null"), "found")
        heads = found.where("doc_id = component_id and part is not null")
        kept = heads.groupBy("part").agg(F.min("text_key").alias("kept"), F.max("text_key").alias("other")).where("kept <> other")
        twice = heads.join(kept, "part").where("text_key <> kept")
        gone = written(found.where("doc_id <> component_id").select("doc_id", "text_key").union(twice.select("doc_id", "text_key")).distinct(), "gone")
        repeated = bool(found.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count())
    names, doc_id, text = docs.columns, F.col(quoted(column_of(docs, "doc_id"))), F.col(quoted(column_of(docs, "text")))
    if repeated:
        mark = fresh_name(docs, "_no_id")
        # Rows without an id are told apart by a number of their own, so that they stay.
        docs = docs.withColumn(mark, F.when(doc_id.isNull(), F.monotonically_increasing_id())).dropDuplicates([column_of(docs, "doc_id"), column_of(docs, "text"), mark])
    left = docs.select(F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)]).alias("row"), doc_id.cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"))
    return left.join(gone, ["doc_id", "text_key"], "left_anti").select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])
