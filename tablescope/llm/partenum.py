"""Exact set-similarity join of word shingles by PartEnum signatures (operator 7).

Sizes are cut into bands; a pair with Jaccard similarity of at least t has both sizes in one band or
in neighbouring ones, and differs in at most k elements, k following from the band. The shingle
domain is hashed into parts, more than the k differences can spoil, and subsets of the parts become
signatures: a similar pair shares one. Candidates are verified on the whole sets, so only true links count.

The member of a signature that shares most signatures is its centre. All members of a centre form a family, which meets
in cells of bounded size: a cell counts what its sets share and leaves only links that join components. A family of
several blocks is first linked within its blocks, each with the centre; then members outside its largest component meet
each other and that component.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm import textnum as X
from tablescope.llm.graph import components
from tablescope.session import cut_lineage

#: Up to this many differences a part has three cells and any two of them make a signature.
ENUMERATE_UP_TO = 8
#: Up to so many candidate ids are sent to all executors (8 bytes each); beyond, the ids are joined.
BROADCAST_IDS = 1_000_000
#: Sets and elements of a block; a cell holds two blocks.
CELL_SETS, CELL_ELEMENTS = 4096, 1 << 21
#: An element that meets more often in a cell is counted by a product of columns.
HEAVY = 4096


@lru_cache
def bands(percent: int, largest: int) -> np.ndarray:
    """Rows (smallest size, largest size, k, parts, cells per part, spare parts) up to ``largest`` and one more."""
    rows, low, past = [], 1, False
    while not past:
        past = low > largest
        high = max(low, low * 100 // percent)
        k = (100 - percent) * 2 * high // (100 + percent)
        cells = 3 if 0 < k <= ENUMERATE_UP_TO else 1
        needed = k // 2 + 1 if cells == 3 else k + 1
        smallest = max(1, low * percent // 100)
        # a part is weak if one of its signatures can be empty; spare parts outnumber the usual weak ones
        weak = needed * (3 * math.exp(-2 * smallest / (3 * needed)) if cells == 3 else math.exp(-smallest / needed))
        spare = 0 if needed == 1 else math.ceil(weak + 4 * math.sqrt(weak))
        rows.append((low, high, k, needed + spare, cells, spare))
        low = high + 1
    return np.array(rows, np.int64)


def shingle_sets(b: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text one after another, sizes)."""
    h, doc = X.word_hashes(b, offsets)
    texts = len(offsets) - 1
    n = np.bincount(doc, minlength=texts)
    first = np.cumsum(n) - n
    count = np.where(n >= k, n - k + 1, 0)
    at = X.ragged(first, count)
    s = np.zeros(len(at), np.uint64)
    for j in range(k):
        s = X.mix(s, 1) + h[at + j] * X.U64(2 * j + 3)
    owner = np.repeat(np.arange(texts), count)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = []
        for d in short:
            x = np.zeros(1, np.uint64)
            for j in range(n[d]):
                x = X.mix(x, 2) + h[first[d] + j:first[d] + j + 1] * X.U64(2 * j + 3)
            extra.append(X.mix(x, int(n[d]) + 7))
        s, owner = np.concatenate([s, *extra]), np.concatenate([owner, short])
    s = X.mix(s, 3)
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[new], owner[new]
    return s, np.bincount(owner, minlength=texts)


def fingerprints(s: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One 63-bit number for each whole set; 0 for the empty one."""
    owner = np.repeat(np.arange(len(size)), size)
    f = X.mix(X.sum_by(owner, X.mix(s, 5), len(size)) + size.astype(np.uint64), 6) >> X.U64(1)
    return np.where(size > 0, f | X.U64(1), X.U64(0)).astype(np.int64)


def signatures(s: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set): each set signs for its own band and for the next."""
    table = bands(percent, max(1, int(size.max(initial=0))))
    band = np.searchsorted(table[:, 0], size, "right") - 1
    out_sig, out_owner = [], []
    for step in (0, 1):
        mine = band + step
        for cells in (1, 3):
            use = np.flatnonzero((size > 0) & (table[np.minimum(mine, len(table) - 1), 4] == cells) & (mine < len(table)))
            if not len(use):
                continue
            n, row = size[use], table[mine[use]]
            parts = row[:, 3]
            base = X.counts_to_offsets(parts)
            element = s[X.ragged((np.cumsum(size) - size)[use], n)]
            owner = np.repeat(np.arange(len(use)), n)
            place = X.mix(element, 11)
            part = (place % parts[owner].astype(np.uint64)).astype(np.int64) + base[owner]
            total = int(base[-1])
            value = X.mix(element, 12)
            if cells == 1:
                sums = X.sum_by(part, value, total)[:, None]
                empty = np.bincount(part, minlength=total)[:, None] == 0
            else:
                cell = part * 3 + (X.mix(element, 13) % X.U64(3)).astype(np.int64)
                c = X.sum_by(cell, value, total * 3).reshape(-1, 3)
                have = np.bincount(cell, minlength=total * 3).reshape(-1, 3)
                # subsets of two cells, the third may hold the one difference
                sums = np.stack([c[:, 0] + c[:, 1], c[:, 0] + c[:, 2], c[:, 1] + c[:, 2]], 1)
                empty = np.stack([have[:, 0] + have[:, 1], have[:, 0] + have[:, 2], have[:, 1] + have[:, 2]], 1) == 0
            part_owner = np.repeat(np.arange(len(use)), parts)
            number = np.arange(total) - base[part_owner]
            label = ((mine[use][part_owner].astype(np.uint64) << X.U64(40)) + number.astype(np.uint64)) * X.U64(4)
            weak = np.bincount(part_owner, empty.any(1), len(use)) > row[:, 5]
            for j in range(sums.shape[1]):
                keep = ~empty[:, j] | weak[part_owner]
                out_sig.append(X.mix(X.mix(sums[keep, j], 14) + X.mix(label[keep] + X.U64(j), 15), 16))
                out_owner.append(use[part_owner[keep]])
    if not out_sig:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_sig).view(np.int64), np.concatenate(out_owner)


def _features(k: int):
    def run(batches):
        for batch in batches:
            for start, end, b, offsets in X.chunks(batch.column(1)):
                s, size = shingle_sets(b, offsets, k)
                yield pa.record_batch([batch.column(0).slice(start, end - start), pa.array(size), pa.array(fingerprints(s, size))],
                                      ["id", "n", "v"])
        X.release()
    return run


def _signature_rows(k: int, percent: int):
    def run(batches):
        seen: set[int] = set()  # copies within a task sign once; forgetting some only repeats rows
        for batch in batches:
            for _, _, b, offsets in X.chunks(batch.column(1)):
                s, size = shingle_sets(b, offsets, k)
                v = fingerprints(s, size)
                fresh = np.zeros(len(v), bool)
                for i, x in enumerate(v.tolist()):
                    if x and x not in seen:
                        fresh[i] = True
                        seen.add(x)
                if len(seen) > 200_000:
                    seen.clear()
                s, v, size = s[np.repeat(fresh, size)], v[fresh], size[fresh]
                sig, owner = signatures(s, size, percent)
                yield pa.record_batch([pa.array(sig), pa.array(v[owner])], ["sig", "v"])
        seen.clear()
        X.release()
    return run


def _set_rows(k: int):
    def run(batches):
        for batch in batches:
            for _, _, b, offsets in X.chunks(batch.column(1)):
                s, size = shingle_sets(b, offsets, k)
                lists = pa.ListArray.from_arrays(pa.array(X.counts_to_offsets(size).astype(np.int32)), pa.array(s.view(np.int64)))
                yield pa.record_batch([pa.array(fingerprints(s, size)), lists], ["v", "s"])
        X.release()
    return run


def _spanning(row: np.ndarray, column: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which of the links (row, column) between nodes of these labels join what no chosen link has joined yet."""
    label, chosen, left = label.copy(), [], np.arange(len(row))
    while True:
        left = left[label[row[left]] != label[column[left]]]
        if not len(left):
            return np.concatenate(chosen) if chosen else left
        # every component takes one link that leaves it
        _, first = np.unique(np.concatenate([label[row[left]], label[column[left]]]), return_index=True)
        take = np.unique(left[first % len(left)])
        chosen.append(take)
        to: dict[int, int] = {}

        def root(x, to=to):
            while x in to:
                x = to[x]
            return x
        for x, y in zip(label[row[take]].tolist(), label[column[take]].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                to[max(x, y)] = min(x, y)
        values, at = np.unique(label, return_inverse=True)
        label = np.array([root(x) for x in values.tolist()])[at]


def _overlaps(owner: np.ndarray, element: np.ndarray, left: int, right: int) -> np.ndarray:
    """Sizes of the intersections of the first ``left`` sets with the ``right`` ones after them."""
    _, e = np.unique(element, return_inverse=True)
    side = owner >= left
    f, g = np.bincount(e[~side], minlength=e.max() + 1), np.bincount(e[side], minlength=e.max() + 1)
    out = np.zeros((left, right), np.float32)
    heavy = f * g > HEAVY
    columns = np.flatnonzero(heavy)
    for at in range(0, len(columns), 512):  # what many sets have: products of 0/1 columns
        slot = np.full(len(f), -1)
        slot[columns[at:at + 512]] = np.arange(len(columns[at:at + 512]))
        use = slot[e] >= 0
        m = np.zeros((left + right, 512), np.float32)
        m[owner[use], slot[e[use]]] = 1
        out += m[:left] @ m[left:].T
    rare = ~heavy & (f * g > 0)
    x, y = np.flatnonzero(rare[e] & ~side), np.flatnonzero(rare[e] & side)
    y = y[np.argsort(e[y], kind="stable")]
    start = np.cumsum(np.where(rare, g, 0)) - np.where(rare, g, 0)
    todo = np.concatenate([[0], np.cumsum(g[e[x]])])
    at = 0
    while at < len(x):  # what few have: one count for each meeting
        end = max(at + 1, int(np.searchsorted(todo, todo[at] + (1 << 22), "right")) - 1)
        part = x[at:end]
        n = g[e[part]]
        cell = np.repeat(owner[part] * right, n) + owner[y[X.ragged(start[e[part]], n)]] - left
        values, count = np.unique(cell, return_counts=True)
        out.ravel()[values] += count
        at = end
    return out


def _cell_links(percent: int):
    """Rows (a, kind, i, j, side, b, c, s) of a partition, cells one after another: links that join components of a cell."""
    def cell(rows: pa.Table) -> pa.RecordBatch | None:
        side = rows.column("side").to_numpy()
        b, c = rows.column("b").to_numpy(), rows.column("c").to_numpy()
        lists = rows.column("s").combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        element = lists.flatten().to_numpy()
        left = int((side == 0).sum())
        if side[-1] == 0:  # one block with itself
            at = np.concatenate([np.arange(left), np.arange(left)])
        else:
            at = np.argsort(side, kind="stable")
        right = len(at) - left
        if not left or not right or (c == c[0]).all():
            return None
        first = np.cumsum(n) - n
        owner, element = np.repeat(np.arange(len(at)), n[at]), element[X.ragged(first[at], n[at])]
        b, c, n = b[at], c[at], n[at]
        if left == 2 and side[-1] == 0:
            same = np.intersect1d(element[:n[0]], element[n[0]:n[0] + n[1]], assume_unique=True).size
            return pa.record_batch([pa.array(b[:1]), pa.array(b[1:2])], ["a", "b"]) if (100 + percent) * same >= percent * (n[0] + n[1]) else None
        same = _overlaps(owner, element, left, right)
        total = n[:left, None] + n[None, left:]
        linked = ((100 + percent) * same.astype(np.int64) >= percent * total) & (c[:left, None] != c[None, left:])
        row, column = np.nonzero(linked)
        column += left
        keep = _spanning(row, column, np.unique(c, return_inverse=True)[1])
        return pa.record_batch([pa.array(b[row[keep]]), pa.array(b[column[keep]])], ["a", "b"])

    def run(batches):
        held, keys = [], None
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(4)]
            new = np.ones(len(batch), bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
            starts = [*np.flatnonzero(new).tolist(), len(batch)]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                key = tuple(int(x[s]) for x in columns)
                if key != keys and held:
                    if (out := cell(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                keys = key
                held.append(batch.slice(s, e - s))
        if held and (out := cell(pa.Table.from_batches(held))) is not None:
            yield out
        held.clear()
        X.release()
    return run


CELL = ["a", "kind", "i", "j"]


def _blocks_of(m, e):
    """Blocks into which ``m`` sets of ``e`` elements are dealt."""
    return F.greatest(F.ceil(m / CELL_SETS), F.ceil(e / CELL_ELEMENTS)).cast("int")


def _cells(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the cells of ``rows(a, kind, i, j, side, b, c)``; the sets join them here."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = rows.join(sets.select(F.col("v").alias("b"), "s"), "b").select(*CELL, "side", "b", "c", "s")
    return full.repartition(n, *CELL).sortWithinPartitions(*CELL, "side").mapInArrow(_cell_links(percent), "a long, b long")


def _block_links(members: DataFrame, split: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside every block of ``members(a, v)``, the centre ``a`` being in each block of its family."""
    zero = F.lit(0)
    nb = F.coalesce("nb", F.lit(1))
    mine = F.pmod(F.xxhash64("v", F.lit(7)), nb).cast("int")
    blocks = F.when(F.col("v") == F.col("a"), F.sequence(zero, nb - 1)).otherwise(F.array(mine))
    rows = members.join(split, "a", "left").select("a", F.lit(2).alias("kind"), F.explode(blocks).alias("i"), zero.alias("j"), zero.alias("side"),
                                                   F.col("v").alias("b"), F.col("v").alias("c"))
    return _cells(rows, sets, percent)


def _family_links(members: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one centre that are in different components, enough of them to join what is linked.

    ``members(a, v, n)`` are the members of large families and the sizes of their sets. Those outside the family's largest
    component are compared with each other and with that component, block by block in cells of bounded size; a pair is
    never written.
    """
    rows = cut_lineage(members.join(label, "v").select("a", F.col("v").alias("b"), "c", "n"))
    each = rows.groupBy("a", "c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("e"))
    top = each.groupBy("a").agg(F.max(F.struct("m", "c", "e")).alias("top"), F.sum("m").alias("m"), F.sum("e").alias("e"))
    top = cut_lineage(top.where(F.col("m") > F.col("top.m")).select(
        "a", F.col("top.c").alias("main"), _blocks_of(F.col("m") - F.col("top.m"), F.col("e") - F.col("top.e")).alias("nf"),
        _blocks_of(F.col("top.m"), F.col("top.e")).alias("nm")))
    h = F.xxhash64("b", F.lit(7))
    rows = rows.join(top, "a").withColumn("odd", F.col("c") != F.col("main"))
    f, m = F.pmod(h, "nf").cast("int"), F.pmod(h, "nm").cast("int")
    zero, one = F.lit(0), F.lit(1)
    cells = F.when(F.col("odd"), F.concat(
        F.transform(F.sequence(zero, F.col("nf") - 1), lambda t: F.struct(zero.alias("kind"), F.least(f, t).alias("i"), F.greatest(f, t).alias("j"), F.when(f > t, one).otherwise(zero).alias("side"))),
        F.transform(F.sequence(zero, F.col("nm") - 1), lambda t: F.struct(one.alias("kind"), f.alias("i"), t.alias("j"), zero.alias("side"))))).otherwise(
        F.transform(F.sequence(zero, F.col("nf") - 1), lambda t: F.struct(one.alias("kind"), t.alias("i"), m.alias("j"), one.alias("side"))))
    return _cells(rows.select("a", "b", "c", F.inline(cells)), sets, percent)


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: (id, n_shingles, component_id, n_links).

    Rows link when ``100 * |A & B| >= percent * |A | B|`` on their sets of ``k``-word shingles (A-Z
    lower-cased; a text with fewer words is one shingle). ``component_id`` is the smallest id reachable by
    links; ``n_links`` counts the links verified from the row's set to *different* sets. Links inside a component
    that is already joined are not all verified, which keeps thousands of near copies linear. No partner, group or
    candidate is capped.

    Null or empty text and text without words: n_shingles 0, component_id the own id. Rows with equal sets
    are one vertex, so copies and repeated rows meet without being paired. Null ids never are a
    component's id unless all its ids are null. Other columns are ignored; an empty table gives no rows.
    Sets are told apart by 63-bit fingerprints.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    nodes = cut_lineage(source.mapInArrow(_features(k), "id long, n long, v long"))
    reps = nodes.where("v <> 0").groupBy("v").agg(F.min("id").alias("rep"))

    # one exchange of the signatures; a neighbour in the sorted partition tells whether another set shares one
    rows = source.mapInArrow(_signature_rows(k, percent), "sig long, v long")
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = rows.repartition(n, "sig").sortWithinPartitions("sig", "v")
    shared = cut_lineage(sorted_rows.mapInArrow(_shared, "sig long, v long"))

    candidates = cut_lineage(shared.select("v").distinct())
    wanted = candidates.join(reps, "v").select("rep")
    few = candidates.count() <= BROADCAST_IDS
    texts = source.join(F.broadcast(wanted) if few else wanted, F.col("id").eqNullSafe(F.col("rep")), "left_semi")
    sets = texts.mapInArrow(_set_rows(k), "v long, s array<long>").join(F.broadcast(candidates) if few else candidates, "v", "left_semi")
    if not nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        sets = sets.dropDuplicates(["v"])
    sets = cut_lineage(sets)

    # the centre of a signature is the member that shares most signatures: of a family of copies the one nearest to all
    sizes = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("m"))
    shares = shared.join(sizes, "sig").groupBy("v").agg(F.sum("m").alias("shares"))
    tops = shared.join(shares, "v").groupBy("sig").agg(F.max(F.struct("shares", "v"))["v"].alias("a"))
    members = shared.join(tops, "sig").select("a", "v").distinct()
    members = cut_lineage(members.join(sets.select("v", F.size("s").alias("n")), "v"))
    split = members.groupBy("a").agg(_blocks_of(F.count(F.lit(1)), F.sum("n")).alias("nb")).where("nb > 1")
    split = cut_lineage(split)  # families of more than one block
    edges = cut_lineage(_block_links(members, split, sets, percent))
    label = cut_lineage(candidates.join(components(edges), "v", "left").select("v", F.coalesce("c", "v").alias("c")))
    if not split.isEmpty():
        more = cut_lineage(_family_links(members.join(split.select("a"), "a", "left_semi"), label, sets, percent).distinct())
        if not more.isEmpty():
            edges = edges.union(more)
            label = cut_lineage(candidates.join(components(edges), "v", "left").select("v", F.coalesce("c", "v").alias("c")))

    ends = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = ends.groupBy(F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("n_links"))
    of_set = reps.join(label, "v", "left").select("v", "rep", F.coalesce("c", "v").alias("c"))
    least = of_set.groupBy("c").agg(F.min("rep").alias("component_id"))
    classes = of_set.join(least, "c").join(links, "v", "left").select("v", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return nodes.join(classes, "v", "left").select(
        F.col("id"), F.col("n").alias("n_shingles"),
        F.when(F.col("v") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def _shared(batches):
    """Rows of a partition sorted by (sig, v): keep those whose signature another set has too, once each."""
    held = None  # last row, and whether its signature is known to be shared
    for batch in batches:
        sig, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        known = False
        if held is not None:
            sig, v, known = np.concatenate([[held[0]], sig]), np.concatenate([[held[1]], v]), held[2]
        if not len(sig):
            continue
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (v[1:] != v[:-1])
        sig, v = sig[new], v[new]
        same = sig[1:] == sig[:-1]
        several = np.zeros(len(sig), bool)
        several[1:] |= same
        several[:-1] |= same
        if known:
            several[0] = True
        held = (sig[-1], v[-1], bool(several[-1]))
        out = np.flatnonzero(several[:-1])
        yield pa.record_batch([pa.array(sig[:-1][out]), pa.array(v[:-1][out])], ["sig", "v"])
    if held is not None and held[2]:
        yield pa.record_batch([pa.array(np.array([held[0]])), pa.array(np.array([held[1]]))], ["sig", "v"])
