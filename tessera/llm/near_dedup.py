"""Operator 8: near-duplicate detection by one-permutation MinHash with optimal densification.

A document's set is its distinct five-word shingles, as 64-bit hashes. One permutation deals the set into ``BINS`` bins;
an empty bin borrows from the first filled bin in an order of its own (optimal densification), so that two documents
borrow alike. Bins form bands (for 0.85, 64 of 10); equal bands share a bucket. Of a bucket only a star is emitted: every
member with the smallest id. Star edges are confirmed on the full sets, in ``TURNS`` of the buckets: few at first, and later
only edges between what is still apart, so that a large group of copies costs a few edges a row and not one a band.

What a star can't see, links between two of its outer members, is looked up exactly, in blocks inside tasks that emit links only:
in a bucket that is still in several components, its rows meet the whole of the main component there, and after ``PEELS``
rounds of this all its other rows meet each other. So no link that a bucket holds is lost, and no bucket is capped.

Documents with equal sets are first collapsed to one representative each, so that groups of exact copies, however
large, cost one row.

Defined cases: a null text counts as empty; a text without words has an empty set and is linked with nothing; fewer words
than five make one shingle of the whole sequence; rows are told apart by their place, so that a repeated or null doc_id is a
row like any other, and two rows of one doc_id are two documents; component_id is the smallest doc_id of the component, null where no row of it has one; exactly one row of
a component is kept, one with that doc_id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Memo, arrow_map, documents, not_in, perhaps_in, written
from tessera.llm.exact_dedup import stays, with_locator

WORDS, SIMILARITY, STAGE_SIMILARITY = 5, 85, 80
BINS, MISS = 640, 1e-3
#: Of 64 buckets, how many send their stars in each turn; rounds of main components before the rest of a bucket meets.
TURNS, PEELS = (4, 60), 1
#: Bounds of one side of a block, by rows and by elements of sets (a single longer set is a block of its own).
BLOCK_ROWS, BLOCK_ELEMENTS = 256, 1 << 18
_MUL = np.uint64(0x9E3779B97F4A7C15)


def rows_a_band(similarity: int) -> int:
    """The most bins a band for which a pair at the limit shares no bucket with probability ``MISS`` at most (at 0.85,
    (1 - 0.85 ** 10) ** 64 = 8e-7)."""
    for rows in (10, 8, 5, 4, 2, 1):
        if (1 - (similarity / 100) ** rows) ** (BINS // rows) <= MISS:
            return rows
    raise ValueError(f"{BINS} bins can't find pairs of {similarity} %")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, word_hash: dict) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([word_hash[w] for w in words], np.uint64)
    width = min(WORDS, len(h))
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        acc = acc * _MUL + h[k : len(h) - width + 1 + k]
    return np.unique(mix(acc))


def word_hashes() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def borrow_order() -> tuple[np.ndarray, np.ndarray]:
    """order[i, k]: the k-th bin that empty bin i tries; rank[i, j]: when it tries bin j."""
    order = np.random.default_rng(20240229).permuted(np.tile(np.arange(BINS, dtype=np.uint16), (BINS, 1)), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.tile(np.arange(BINS, dtype=np.uint16), (BINS, 1)), axis=1)
    return order, rank


def lenders(filled: np.ndarray, empty: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For every empty bin the first filled one in its order."""
    if len(filled) < 32:
        return filled[rank[np.ix_(empty, filled)].argmin(axis=1)]
    full, out, todo, k = np.zeros(BINS, bool), np.empty(len(empty), np.int64), np.arange(len(empty)), 0
    full[filled] = True
    while len(todo):
        tried = order[empty[todo], k]
        hit = full[tried]
        out[todo[hit]] = tried[hit]
        todo, k = todo[~hit], k + 1
    return out


def bands(s: np.ndarray, order: np.ndarray, rank: np.ndarray, rows_a_band: int = 10) -> np.ndarray:
    """The band hashes of a sorted set."""
    bins = ((s >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)  # ascending with s
    first = np.flatnonzero(np.diff(bins, prepend=-1))  # in a bin the smallest comes first
    filled = bins[first]
    sig = np.zeros(BINS, np.uint64)
    sig[filled] = s[first]
    if len(filled) < BINS:
        is_empty = np.ones(BINS, bool)
        is_empty[filled] = False
        empty = np.flatnonzero(is_empty)
        sig[empty] = sig[lenders(filled, empty, order, rank)]
    rows = sig.reshape(-1, rows_a_band)
    acc = np.arange(len(rows), dtype=np.uint64)
    for k in range(rows_a_band):
        acc = mix(acc * _MUL + rows[:, k])
    return acc.view(np.int64)


def signatures(docs: DataFrame, rows_a_band: int) -> DataFrame:
    """row (a number of its own), doc_id, locator, n_shingles, set_key and the bands of every row."""

    def make():
        hashes, tables, numbers = word_hashes(), borrow_order(), count(TaskContext.get().partitionId() << 33)

        def step(doc_id, text, locator):
            n, keys, out = [], [], []
            for t in text:
                s = shingles(t, hashes)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out.append(bands(s, *tables, rows_a_band) if len(s) else np.empty(0, np.int64))
            ends = np.cumsum([0] + [len(x) for x in out])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out) if out else [], pa.int64()))
            rows = [next(numbers) for _ in text]
            return {"row": pa.array(rows, pa.int64()), "doc_id": pa.array(doc_id, pa.int64()), "locator": pa.array(locator, pa.string()), "n_shingles": pa.array(n, pa.int64()), "set_key": pa.array(keys, pa.binary()), "bands": lists}

        return step

    return arrow_map(docs.select("doc_id", "text", "locator"), make, "row long, doc_id long, locator string, n_shingles long, set_key binary, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """id, n (the set's size), tally and s, the full set, of every row (id, text)."""

    def make():
        hashes = word_hashes()

        def step(id, text):
            sets = [shingles(t, hashes) for t in text]
            ends = np.cumsum([0] + [len(x) for x in sets])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((np.concatenate(sets) if sets else np.empty(0, np.uint64)).view(np.int64), pa.int64()))
            return {"id": pa.array(id, pa.int64()), "n": pa.array(np.diff(ends), pa.int64()), "tally": pa.array([tally(x) for x in sets], pa.list_(pa.int8())), "s": lists}

        return step

    return arrow_map(docs, make, "id long, n long, tally array<tinyint>, s array<long>")


def tally(s: np.ndarray) -> np.ndarray | None:
    """How many elements of a set begin with each byte; None where a count is beyond 127, as in sets of some 25,000."""
    counts = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256)
    return counts.astype(np.int8) if counts.max() < 128 else None


def hopeful(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (id, centre) that may be similar enough: two sets share at most the smaller of their counts at each first byte.
    No pair that is similar enough is left out."""
    left = sets.select("id", "n", "tally")
    right = sets.select(F.col("id").alias("centre"), F.col("n").alias("m"), F.col("tally").alias("other"))
    both = pairs.select("id", "centre").join(left, "id").join(right, "centre")
    most = F.expr("coalesce(aggregate(zip_with(tally, other, (x, y) -> least(x, y)), 0L, (sum, x) -> sum + x), least(n, m))")
    return both.withColumn("most", most).where(f"100 * most >= {similarity} * (n + m - most)").select("id", "centre")


def sets_of(sets: DataFrame, *asked: DataFrame) -> DataFrame:
    """id and s of the ids in ``asked``, tables, and few others: only these sets are shuffled by what joins them."""
    ids = asked[0].select("id")
    for more in asked[1:]:
        ids = ids.unionByName(more.select("id"))
    return perhaps_in(sets.select("id", "s"), ids, "id", sum(x.count() for x in asked))


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (id, centre) whose full sets are similar enough. Row by row in the JVM, so that memory is that of two sets."""
    pairs = written(hopeful(pairs, sets, similarity), "near-hopeful")
    full = sets_of(sets, pairs, pairs.select(F.col("centre").alias("id")))
    both = pairs.join(full, "id").join(full.select(F.col("id").alias("centre"), F.col("s").alias("t")), "centre")
    sizes = both.select("id", "centre", F.size("s").alias("n"), F.size("t").alias("m"), F.size(F.array_intersect("s", "t")).alias("i"))
    return sizes.where(f"100 * i >= {similarity} * (n + m - i)").select("id", "centre")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """The sizes of all intersections of two lists of sets, as products of indicator blocks of ``width`` elements."""
    out = np.zeros((len(left), len(right)), np.float64)
    sides = [np.concatenate(x) for x in (left, right)]
    common = np.intersect1d(*map(np.unique, sides))
    cells = []
    for rows, flat in zip((left, right), sides):
        row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        at = np.searchsorted(common, flat)
        hit = at < len(common)
        hit[hit] = common[at[hit]] == flat[hit]
        order = np.argsort(at[hit], kind="stable")
        cells.append((row[hit][order], at[hit][order], len(rows)))
    for first in range(0, len(common), width):
        blocks = []
        for row, at, n in cells:
            i, j = np.searchsorted(at, (first, first + width))
            block = np.zeros((n, width), np.float32)
            block[row[i:j], at[i:j] - first] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out


def blocks_linked(rows: DataFrame, similarity: int) -> DataFrame:
    """Links (id, centre) between the two sides of each block: ``rows`` are (part, i, j, side, id, root, s), a block those of
    one (part, i, j). Of several links from a row to one component, one is returned; pairs of one component are passed over."""

    def link(block: pa.Table) -> pa.Table:
        side = block.column("side").to_numpy()
        at = [np.flatnonzero(side == k) for k in (0, 1)]
        found = ([], [])
        if len(at[0]) and len(at[1]):
            flat = block.column("s").combine_chunks()
            flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
            sets = [[flat[i].values.to_numpy() for i in k.tolist()] for k in at]
            ids, roots = block.column("id").to_numpy(), block.column("root").to_numpy()
            sizes = [np.array([len(x) for x in k], np.float64) for k in sets]
            inter = overlaps(*sets)
            ok = 100 * inter >= similarity * (sizes[0][:, None] + sizes[1][None, :] - inter)
            x, y = np.nonzero(ok & (roots[at[0]][:, None] != roots[at[1]][None, :]))
            x, y = at[0][x], at[1][y]
            _, one = np.unique(np.stack([x, roots[y]]), axis=1, return_index=True)
            found = ids[x[one]], ids[y[one]]
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["id", "centre"])

    return rows.groupBy("part", "i", "j").applyInArrow(link, "id long, centre long")


def blocks_of(rows: str, elements: str) -> Column:
    """Into how many blocks so many rows with so many elements are dealt."""
    return F.greatest(F.ceil(F.col(rows) / F.lit(BLOCK_ROWS)), F.ceil(F.col(elements) / F.lit(BLOCK_ELEMENTS))).cast("int")


def beside_main(open_: DataFrame, roots: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links between the rows of buckets and the main components there. ``open_``: (band, id, root, main).

    A component's rows are dealt out once, however many buckets it has; the rows that meet it are those that share a bucket
    with it. Both sides lie in blocks of bounded size, so that a component with a third of all rows spreads over all tasks.
    """
    lengths = sets.select("id", "n")
    left = open_.where("root <> main").select(F.col("main").alias("part"), "id", "root").distinct().join(roots.select(F.col("root").alias("part")).distinct(), "part", "left_semi")
    left = written(left.join(lengths, "id").select("part", "id", "n", "root"), "near-beside")
    if left.isEmpty():
        return roots.select("id", F.col("root").alias("centre")).limit(0)
    right = roots.join(left.select(F.col("part").alias("root")).distinct(), "root", "left_semi").join(lengths, "id").select(F.col("root").alias("part"), "id", "n", "root")
    right = written(right, "near-main")
    sized = [x.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("elements")).select("part", blocks_of("rows", "elements").alias(b)) for x, b in ((left, "bi"), (right, "bj"))]
    count = written(sized[0].join(sized[1], "part"), "near-blocks")
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("bi")).cast("int"), F.pmod(F.xxhash64("id", F.lit(2)), F.col("bj")).cast("int")
    l_rows = left.join(count, "part").select("part", own[0].alias("i"), F.explode(F.sequence(F.lit(0), F.col("bj") - 1)).alias("j"), F.lit(0).alias("side"), "id", "root")
    r_rows = right.join(count, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("bi") - 1)).alias("i"), own[1].alias("j"), F.lit(1).alias("side"), "id", "root")
    return blocks_linked(l_rows.unionByName(r_rows).join(sets_of(sets, left, right), "id"), similarity)


def within_rest(rest: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links between the rows of each bucket that belong to different components. ``rest``: (band, id, root).

    Buckets with the same rows count once.
    """
    buckets = rest.join(sets.select("id", "n"), "id").groupBy("band").agg(F.bit_xor(F.xxhash64("id")).alias("same"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("elements"), F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
    once = written(buckets.groupBy("same", "rows", "elements").agg(F.min("band").alias("band")).select("band", blocks_of("rows", "elements").alias("b")), "near-rest-blocks")
    own = F.pmod(F.xxhash64("id"), F.col("b")).cast("int")
    rows = written(rest.join(once, "band").select(F.col("band").alias("part"), own.alias("own"), "b", "id", "root"), "near-rest-rows")
    # block i meets every block j from i on
    l_rows = rows.select("part", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("b") - 1)).alias("j"), F.lit(0).alias("side"), "id", "root")
    r_rows = rows.select("part", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "id", "root")
    return blocks_linked(l_rows.unionByName(r_rows).join(sets_of(sets, rows), "id"), similarity)


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, by hooking each tree to its smallest neighbour until no label changes.

    ``edges``: (u, v) with u > v, distinct, as a table. Each round is a table in the shared folder. A hub's edges are reduced by
    map-side minima, never gathered.
    """
    labels = written(
        edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root")),
        "near-labels",
    )
    while True:
        root_of = labels.select(F.col("node").alias("k"), F.col("root").alias("r"))
        # the smallest label across each edge, for both ends' roots as well, so that whole trees hook at once
        ends = edges.join(root_of, F.col("u") == F.col("k")).select("u", "v", F.col("r").alias("ru")).join(root_of, F.col("v") == F.col("k")).select("ru", F.col("r").alias("rv")).where("ru <> rv")
        hooks = written(ends.selectExpr("greatest(ru, rv) AS k", "least(ru, rv) AS r").groupBy("k").agg(F.min("r").alias("r")), "near-hooks")
        if hooks.isEmpty():
            return labels
        # follow hooks to their ends by pointer doubling, then relabel
        while True:
            jump = hooks.join(hooks.select(F.col("k").alias("r"), F.col("r").alias("r2")), "r", "left").select("k", F.coalesce("r2", "r").alias("r"), F.col("r2").isNotNull().alias("moved"))
            jump = written(jump, "near-jump")
            hooks = jump.select("k", "r")
            if jump.where("moved").isEmpty():
                break
        labels = written(labels.join(hooks, F.col("root") == F.col("k"), "left").select("node", F.coalesce("r", "root").alias("root")), "near-labels")


def rooted(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``pairs`` (id, centre) with the roots of both, u and v, where these differ."""
    if roots is None:
        return pairs.select("id", "centre", F.col("id").alias("u"), F.col("centre").alias("v")).where("u <> v")
    for end, root in (("id", "u"), ("centre", "v")):
        pairs = pairs.join(roots.select(F.col("id").alias(end), F.col("root").alias(root)), end, "left").withColumn(root, F.coalesce(root, end))
    return pairs.where("u <> v").select("id", "centre", "u", "v")


def merged(roots: DataFrame | None, new: DataFrame) -> DataFrame | None:
    """The components (id, root) after the links ``new`` (id, centre), of which only those between components count."""
    edges = written(rooted(new, roots).selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), "near-edges")
    if edges.isEmpty():
        return roots
    by_root = components(edges)
    if roots is None:
        return by_root.withColumnRenamed("node", "id")
    every = roots.unionByName(by_root.select(F.col("node").alias("id"), F.col("node").alias("root")).join(roots, "id", "left_anti"))
    return written(every.join(by_root.select(F.col("node").alias("root"), F.col("root").alias("r")), "root", "left").select("id", F.coalesce("r", "root").alias("root")), "near-roots")


def links(docs: DataFrame, reps: DataFrame, places: DataFrame, similarity: int) -> DataFrame:
    """Components (id, root) of the representatives that have links. ``reps``: id, bands; ``places``: the locators of ids."""
    # dealt by bucket once, for both uses, with ids alone; a document's buckets lie apart, so that copies of one text spread over all tasks
    rows = reps.select("id", F.explode("bands").alias("band")).repartition("band")
    stars = rows.groupBy("band").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")
    # only buckets of several members go on
    members = written(rows.join(stars.select("band", "centre"), "band"), "near-members")
    # the full sets of these; other texts stay where they are
    ids = written(members.select("id").distinct().join(places, "id"), "near-ids")
    texts = perhaps_in(docs.select("locator", "text"), ids, "locator", ids.count())
    sets = written(shingle_sets(texts.join(ids, "locator").select("id", "text")), "near-sets")
    roots = tried = None
    turn = F.pmod(F.xxhash64("band"), F.lit(sum(TURNS)))
    for k in range(len(TURNS)):
        part = members.where("id <> centre").where(turn.between(sum(TURNS[:k]), sum(TURNS[: k + 1]) - 1))
        pairs = rooted(part.select("id", "centre").distinct(), roots).select("id", "centre")  # what is in one component needs no edge
        pairs = written(pairs.join(tried, ["id", "centre"], "left_anti") if tried else pairs, "near-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        roots = merged(roots, confirmed(pairs, sets, similarity))
    # buckets that the stars left in several components
    open_ = members.select("band", "id", "centre")
    if roots is None:
        roots = open_.select("id", F.col("id").alias("root")).limit(0)
    for last in (False,) * PEELS + (True,):
        label = open_.join(roots, "id", "left").withColumn("linked", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "id"))
        label = label.join(roots.select(F.col("id").alias("centre"), F.col("root").alias("hub")), "centre", "left").withColumn("hub", F.coalesce("hub", "centre"))
        by_root = label.groupBy("band", "root").agg(F.count(F.lit(1)).alias("rows"), F.max("linked").alias("linked"), F.max(F.col("root") == F.col("hub")).alias("is_hub"))
        # the main one has most rows; where all have one, one that has links elsewhere, or else the centre, which met every other row
        by_rank = F.struct("rows", "linked", "is_hub", "root")
        main = by_root.groupBy("band").agg(F.max_by("root", by_rank).alias("main"), F.max_by(F.col("linked") | F.col("is_hub"), by_rank).alias("met"), F.min("root").alias("a"), F.max("root").alias("b"))
        open_ = written(label.drop("hub", "linked").join(main.where("a < b").select("band", "main", "met"), "band"), "near-open")
        rest = open_.where("root <> main OR NOT met").select("band", "id", "root", "centre")
        if rest.isEmpty():
            return roots
        new = beside_main(open_, roots, sets, similarity)
        roots = merged(roots, new.unionByName(within_rest(rest, sets, similarity)) if last else new)
        open_ = rest.drop("root")
    return roots


def near_dedup(docs: DataFrame, similarity: int = SIMILARITY, scanned: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text). ``scanned``: see with_locator."""
    located, place = with_locator(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scanned)
    return near_located(located.withColumnRenamed(place, "locator"), similarity).drop("locator")


def near_located(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The result of near_dedup and the rows' locators, for rows (doc_id, text, locator)."""
    sigs = written(signatures(docs, rows_a_band(similarity)), "near-signatures")
    groups = written(sigs.where("n_shingles > 0").groupBy("set_key").agg(F.min("row").alias("rep")), "near-groups")
    of = written(sigs.drop("bands").join(groups, "set_key", "left").select("row", "doc_id", "locator", "n_shingles", F.coalesce("rep", "row").alias("rep")), "near-reps")
    copies = of.where("row <> rep").select(F.col("row").alias("id"))
    reps = not_in(sigs.select(F.col("row").alias("id"), "bands"), copies, "id", copies.count())
    roots = links(docs, reps, sigs.select(F.col("row").alias("id"), "locator"), similarity)
    rows = of.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").select("row", "doc_id", "locator", "n_shingles", F.coalesce("root", "rep").alias("root"))
    rows = written(rows, "near-rows")
    # of components with several rows, the first: the smallest id, rows without one last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    firsts = written(rows.groupBy("root").agg(first.alias("k"), F.count(F.lit(1)).alias("size")).where("size > 1").select("root", "k"), "near-firsts")
    component = F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("k.doc_id"))
    kept = F.coalesce(F.col("row") == F.col("k.row"), F.lit(True))
    return rows.join(firsts, "root", "left").select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "locator")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), scanned=True)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group, with the columns of ``docs``."""
    return stays(docs, lambda rows: near_located(rows, STAGE_SIMILARITY))


#: Documents of one set count as one before sets meet, as equal sets do in the operator.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, i, i + 4), ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(h, '' ORDER BY h)) AS same FROM s GROUP BY doc_id),
reps AS (SELECT same, min(doc_id) AS rep, any_value(n) AS n FROM n GROUP BY same),
r AS (SELECT s.doc_id, s.h, reps.n FROM s JOIN reps ON s.doc_id = reps.rep),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) + any_value(b.n) AS total, count(*) AS i FROM r a JOIN r b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
linked AS (SELECT x, y FROM i WHERE 100 * i >= 85 * (total - i)),
e AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach(x, y) AS (SELECT rep, rep FROM reps UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
c AS (SELECT x AS rep, min(y) AS component_id FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN reps ON n.same = reps.same LEFT JOIN c ON reps.rep = c.rep
"""
