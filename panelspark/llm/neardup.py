"""Near duplicates by a chosen-path set similarity join over minwise tokens.

Each text becomes the set of its distinct five-word shingles; texts with equal sets form a class with one
representative. For each of several independent trees a representative walks down from the root: at every node one or
two of its minwise tokens are selected by the node's own hash (so all texts of a node select alike), and it goes to
the child named by the token's value. Texts of high similarity share tokens and so end in shared nodes.

Links are found in rounds, so that the work stays linear for groups of many near copies. In the first one the texts
of a node are dealt to blocks, and each text proposes the most similar text of all its blocks; proposals are confirmed
on the full sets. Nodes that would still take more than MOST_WORK pairs propose again, each text outside its own
component, as long as that halves those pairs. The last round is exhaustive: in every node that still holds texts of several
components, each text outside the node's largest component is compared with all texts of the node. Texts whose sketches
are alike then meet with their full sets, in groups that are the same for all nodes that hold the same texts, and each
group gives a spanning forest of the links between its components. So no link is lost, texts that are together already
are never expanded into pairs, and near misses never become rows.

A node whose comparison in the last round takes more than MOST_WORK pairs branches further, by two tokens at every
level, as long as its children need less work than itself; there is no bound on the depth.

Recall: with one or two selections a node (1.4 on average) and depth 3, a pair at similarity 0.75 meets in a given
tree with probability 0.63. Below that every node selects two, so a pair whose nodes all stay wide still meets with
0.61 at depth 5 and 0.60 at any depth. All trees draw from one pool of 128 tokens; counting that, none of 12 trees
holds the pair with probability 0.00003 at depth 3, 0.00008 at 5 and 0.00012 at 7 (1 of 20,000 random pairs was missed
there). More similar pairs meet more surely. A pair that meets is passed over if its sketches call it less similar
than `least_estimate`; 0 compares the full sets of all pairs that meet.

Defined cases: null, empty and blank texts have no shingles and no links; very long texts are taken whole; fewer than
five words are one shingle of the whole sequence; of equally similar partners a text proposes the one of smallest
doc_id; rows that repeat a doc_id count as one document with all their texts; a null doc_id keeps its row with
component_id null and kept true; columns other than doc_id and text are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WHITE, broadcast_if_small, discard, mixed, parts, run_hashes, shingle_hashes, small_batches, stored, text_chunks, word_spans
from .components import connected_components, rooted

TOKENS = 128
TREES = 12
DEPTH = 3
SECOND_CHOICE = 0.4
BLOCK = 512
#: Cells of at most this many texts are compared together, a distance between rows at a time.
SMALL = 24
#: Pairs that a node may compare in the last round before it branches further.
MOST_WORK = 1 << 21
#: A sketch of 128 one-byte tokens has a standard error of 0.038 at 0.75; pairs below this estimate aren't confirmed.
LEAST_ESTIMATE = 0.60
BROADCAST_ROWS = 500_000
_SEEDS = mixed(np.arange(1, TOKENS + 1, dtype=np.uint64))
_XOR = (_SEEDS >> np.uint64(32)).astype(np.uint32)
_ODD = (_SEEDS & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)


def _sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    for first, raw, offsets in text_chunks(column):
        lowered = LOWER[raw]
        starts, ends, firsts = word_spans(lowered, offsets, WHITE)
        yield first, shingle_hashes(run_hashes(lowered, starts, ends), firsts)


def _minwise(sets: list[np.ndarray]) -> np.ndarray:
    """TOKENS minima for each non-empty set."""
    edges = np.concatenate(([0], np.cumsum([len(x) for x in sets])))[:-1]
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), TOKENS), dtype=np.uint32)
    for k in range(TOKENS):
        out[:, k] = np.minimum.reduceat((values ^ _XOR[k]) * _ODD[k], edges)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set (null for none) and the minwise tokens."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _sets(batch.column(1)):
                sizes = np.array([len(x) for x in sets], dtype=np.int64)
                prints, tokens = [None] * len(sets), [None] * len(sets)
                own = np.flatnonzero(sizes)
                if len(own):
                    full = [sets[k] for k in own]
                    minima = _minwise(full)
                    for k, values, row in zip(own.tolist(), full, minima):
                        high = int(np.bitwise_xor.reduce(mixed(values)))
                        low = int(np.add.reduce(mixed(values ^ np.uint64(0x5851F42D4C957F2D))))
                        prints[k] = high.to_bytes(8, "big") + low.to_bytes(8, "big") + len(values).to_bytes(4, "big")
                        tokens[k] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets)), pa.array(sizes), pa.array(prints, type=pa.binary()), pa.array(tokens, type=pa.binary())],
                    names=["doc_id", "n_shingles", "print", "tokens"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(signed, "doc_id long, n_shingles long, print binary, tokens binary")


def _branch(nodes: np.ndarray, rows: np.ndarray, tokens: np.ndarray, second: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of the nodes that hold the rows: one selected token each, and for a share `second` of nodes another."""
    choice = mixed(nodes ^ np.uint64(0x632BE59BD9B4E019))
    token = (choice >> np.uint64(8)) % np.uint64(TOKENS)
    step = (choice >> np.uint64(40)) % np.uint64(TOKENS - 1) + np.uint64(1)
    twice = (choice & np.uint64(0xFF)) < int(second * 256)
    out_nodes, out_rows = [], []
    for picked, at in ((token, slice(None)), ((token + step) % np.uint64(TOKENS), twice)):
        own_rows, own = rows[at], picked[at]
        values = tokens[own_rows, own.astype(np.int64)].astype(np.uint64)
        out_nodes.append(mixed(mixed(nodes[at] + own + np.uint64(1)) ^ values * np.uint64(0x9E3779B97F4A7C15)))
        out_rows.append(own_rows)
    return np.concatenate(out_nodes), np.concatenate(out_rows)


def _walk(source: DataFrame, depth: int, root: bool) -> DataFrame:
    """(parent, node, rep) after `depth` more levels; source has rep, tokens and, unless at the root, node."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                reps = part.column(0).to_numpy()
                tokens = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint32).reshape(-1, TOKENS)
                rows = np.arange(len(reps))
                if root:
                    nodes = np.repeat(mixed(np.arange(1, TREES + 1, dtype=np.uint64)), len(reps))
                    rows = np.tile(rows, TREES)
                    parents = np.zeros(len(reps), dtype=np.int64)
                else:
                    parents = part.column(2).to_numpy()
                    nodes = parents.view(np.uint64)
                for _ in range(depth):
                    nodes, rows = _branch(nodes, rows, tokens, SECOND_CHOICE if root else 1.0)
                yield pa.RecordBatch.from_arrays([pa.array(parents[rows]), pa.array(nodes.view(np.int64)), pa.array(reps[rows])], names=["parent", "node", "rep"])

    return source.select("rep", "tokens", *([] if root else ["node"])).mapInArrow(walked, "parent long, node long, rep long")


def leaves(reps: DataFrame) -> DataFrame:
    """(node, rep, n) of the nodes at DEPTH that hold n texts, two or more."""
    rows = stored(_walk(reps, DEPTH, True).select("node", "rep").distinct(), "leaf_rows")
    # Stored, so that Spark can split a node that holds a large share of the rows in the join.
    sizes = stored(rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    shared = stored(rows.join(sizes, "node").select("node", "rep", "n"), "leaves")
    discard(rows, sizes)
    return shared


def _summed(rows: DataFrame) -> DataFrame:
    """node, its largest component, the number of its texts (n) and of those outside that component (q), where q > 0."""
    own = rows.groupBy("node", "component").agg(F.count("*").alias("c"))
    own = own.groupBy("node").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("n"), F.count("*").alias("parts"))
    return own.filter("parts > 1").select("node", F.col("top.component").alias("largest"), "n", (F.col("n") - F.col("top.c")).alias("q"))


def open_nodes(shared: DataFrame, components: DataFrame | None) -> DataFrame:
    """(node, rep, component, largest, n, q) of all texts of the nodes that hold several components."""
    named = stored(_named(shared.select("node", "rep"), components), "named")
    sums = stored(_summed(named), "sums")
    rows = stored(named.join(sums, "node"), "open")
    discard(named, sums)
    return rows


def narrowed_nodes(rows: DataFrame, components: DataFrame | None, reps: DataFrame, tables: list[DataFrame], most_work: int = MOST_WORK) -> DataFrame:
    """The rows of open_nodes, but nodes of more than most_work pairs n * q are replaced by their children two levels down.

    This goes on as long as the children need less than 0.8 of their parent's pairs. The stored tables that the result
    reads are added to `tables`.
    """
    work = F.col("n") * F.col("q")
    found = []
    while True:
        tables.append(rows)
        wide = stored(rows.filter(work > most_work), "wide")
        tables.append(wide)
        found.append(rows.filter(work <= most_work))
        if wide.isEmpty():
            break
        # A text that reaches a child by two ways is there once; the children of two parents never meet.
        below = stored(_named(_walk(wide.join(reps, "rep"), 2, False).distinct(), components), "below")
        sums = stored(_summed(below).join(below.select("node", "parent").distinct(), "node"), "sums")
        needed = sums.groupBy("parent").agg(F.sum(work).alias("below"))
        above = wide.select(F.col("node").alias("parent"), work.alias("above")).distinct()
        narrowed = stored(above.join(needed, "parent", "left").filter(F.coalesce("below", F.lit(0)) < 0.8 * F.col("above")).select("parent"), "narrowed")
        tables.append(narrowed)
        found.append(wide.join(narrowed.withColumnRenamed("parent", "node"), "node", "left_anti").select(*rows.columns))
        kept = stored(sums.join(narrowed, "parent", "left_semi").drop("parent"), "kept")
        rows = stored(below.drop("parent").join(kept, "node").select(*rows.columns), "open")
        discard(below, sums, kept)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _named(rows: DataFrame, components: DataFrame | None) -> DataFrame:
    """rows with the component of each rep so far (itself where it has no link)."""
    if components is None:
        return rows.withColumn("component", F.col("rep"))
    return rows.join(components.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _bytes(tokens: np.ndarray) -> np.ndarray:
    """One byte of each token, from all of its bits: a minimum over many shingles is small, its own top byte mostly 0."""
    return (mixed(tokens.astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of the rows of a (one row or as many as b) with the rows of b, from one-byte tokens."""
    same = (a == b).view(np.uint64).sum(axis=1)  # eight counts of up to 16 in each sum
    return (((same * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.float32) / TOKENS - 1 / 256) / (1 - 1 / 256)


def _cells(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows and the number of each row's cell, some cells at a time; rows of a cell stand together and aren't parted."""
    waiting: list[pa.RecordBatch] = []
    for batch in _and_last(batches):
        if batch is not None and batch.num_rows:
            waiting.append(batch)
        if not waiting or (batch is not None and sum(x.num_rows for x in waiting) < 4 * BLOCK and sum(x.nbytes for x in waiting) < 16 << 20):
            continue
        rows = pa.concat_batches(waiting)
        at = np.stack([rows.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys])
        first = np.concatenate(([True], (at[:, 1:] != at[:, :-1]).any(axis=0)))
        end = rows.num_rows if batch is None else int(np.flatnonzero(first)[-1])
        waiting = [] if batch is None else [rows.slice(end)]
        if end:
            yield rows.slice(0, end), np.cumsum(first[:end]) - 1


def _and_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, then None."""
    yield from batches
    yield None


def _alike(cell: np.ndarray, sketch: np.ndarray, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray], asks: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Pairs of rows of one cell, of which one asks, that are allowed and whose sketches agree to `least`, and by how much.

    Rows of cells up to SMALL are paired a distance at a time, each pair once. In larger cells all pairs of a row that
    asks come together, with that row first; the last value says so.
    """
    sizes = np.bincount(cell)
    small = sizes[cell] <= SMALL
    for d in range(1, min(SMALL, int(sizes[cell[small]].max(initial=0)))):
        i = np.flatnonzero((cell[:-d] == cell[d:]) & small[:-d])
        i = i[(asks[i] | asks[i + d]) & (allowed(i, i + d) | allowed(i + d, i))]
        if len(i):
            agree = _agreement(sketch[i], sketch[i + d])
            likely = agree >= least
            if likely.any():
                yield i[likely], i[likely] + d, agree[likely], False
    starts = np.cumsum(sizes) - sizes
    for number in np.flatnonzero(sizes > SMALL).tolist():
        own = np.arange(starts[number], starts[number] + sizes[number])
        for k in own[asks[own]].tolist():
            others = own[allowed(np.full(len(own), k), own)]
            if len(others):
                agree = _agreement(sketch[k], sketch[others])
                likely = agree >= least
                if likely.any():
                    yield np.full(int(likely.sum()), k), others[likely], agree[likely], True


def _sketches(rows: pa.RecordBatch, column: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(column).to_pylist()), dtype=np.uint8).reshape(-1, TOKENS)


def _dealt(rows: DataFrame, *at: str) -> DataFrame:
    return rows.repartition(parts(rows.sparkSession), *at).sortWithinPartitions(*at)


def proposals(shared: DataFrame, components: DataFrame | None, sketches: DataFrame, salt: int, least: float = LEAST_ESTIMATE) -> DataFrame:
    """(a, b): for each text the most similar one outside its component among the texts of its blocks."""
    block = F.pmod(F.xxhash64("rep", "node", F.lit(salt)), F.ceil(F.col("n") / BLOCK)).cast("int")
    rows = _named(shared.select("node", block.alias("block"), "rep"), components).join(sketches, "rep")

    def proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cell in _cells(batches, [0, 1]):
            members, of = (rows.column(k).to_numpy() for k in (2, 3))
            best, partner = np.full(len(cell), -1, dtype=np.float32), np.full(len(cell), np.iinfo(np.int64).max)
            for i, j, agree, alone in _alike(cell, _sketches(rows, 4), lambda i, j: of[i] != of[j], np.ones(len(cell), dtype=bool), least):
                if alone:
                    best[i[0]] = agree.max()
                    partner[i[0]] = members[j[agree == best[i[0]]]].min()
                    continue
                for x, y in ((i, j), (j, i)):
                    order = np.lexsort((members[y], -agree, x))
                    order = order[np.concatenate(([True], x[order][1:] != x[order][:-1]))]
                    x, z, s = x[order], members[y[order]], agree[order]
                    better = (s > best[x]) | ((s == best[x]) & (z < partner[x]))
                    best[x[better]], partner[x[better]] = s[better], z[better]
            found = best >= 0
            yield pa.RecordBatch.from_arrays([pa.array(members[found]), pa.array(partner[found]), pa.array(best[found])], names=["rep", "partner", "agree"])

    each = _dealt(rows.select("node", "block", "rep", "component", "sketch"), "node", "block").mapInArrow(proposed, "rep long, partner long, agree float")
    best = each.groupBy("rep").agg(F.max(F.struct("agree", (-F.col("partner")).alias("other"))).alias("best"))
    return best.select(F.least("rep", -F.col("best.other")).alias("a"), F.greatest("rep", -F.col("best.other")).alias("b")).distinct()


def _full_sets(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """(doc_id, values) of the wanted documents, whose texts are read again: the sorted hashes of all their shingles."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(broadcast_if_small(wanted, wanted.count(), BROADCAST_ROWS), "doc_id", "left_semi")
    if repeated:
        texts = texts.distinct()

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _sets(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array([x.tobytes() for x in sets], type=pa.binary())], names=["doc_id", "values"])

    return stored(texts.mapInArrow(full, "doc_id long, values binary"), "sets")


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    keep.append(False)
                    continue
                joint = np.sort(np.concatenate((a, b)), kind="stable")
                both = int((joint[1:] == joint[:-1]).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, type=pa.bool_())) for k in (0, 1)], names=["a", "b"])

    left, right = (sets.select(F.col("doc_id").alias(k), F.col("values").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(checked, "a long, b long")


PLACE = ["node", "query_cell", "target_cell"]
MEMBERS = "cell long, rep long, component long, sketch binary"


def _groups(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row that each of n rows reaches over the pairs."""
    label = np.arange(n)
    if pairs:
        i, j = (np.concatenate(x) for x in zip(*pairs))
        nodes, roots = rooted(i, j)
        label[nodes] = roots
    return label


def likely_members(nodes: DataFrame, sketches: DataFrame, least: float = LEAST_ESTIMATE) -> DataFrame:
    """(cell, rep, component, sketch) of the texts of nodes that have a likely partner in another component.

    A node is compared in places of at most about BLOCK queries and BLOCK targets. Queries are the texts outside its
    largest component, targets all its texts. Texts of a place that hang together by likely pairs are a cell; equal
    cells of several places are one.
    """
    rows = nodes.withColumn("asks", F.col("component") != F.col("largest")).join(sketches, "rep")
    rows = rows.withColumn("tb", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("qb", F.ceil(F.col("q") / BLOCK).cast("int"))
    yes, no = F.lit(True), F.lit(False)

    def place(query, target, queries, targets):
        return F.struct(query.alias("query_cell"), target.alias("target_cell"), queries.alias("queries"), targets.alias("targets"))

    def part(salt: int, count: str):
        return F.pmod(F.xxhash64("rep", "node", F.lit(salt)), F.col(count)).cast("int")

    # A node of one block has each text once; in a wider one targets go to every block of queries and the other way round.
    as_target = F.transform(F.sequence(F.lit(0), F.col("qb") - 1), lambda k: place(k, part(1, "tb"), no, yes))
    as_query = F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), F.col("tb") - 1), lambda k: place(part(2, "qb"), k, yes, no))).otherwise(F.filter(as_target, lambda _: no))
    once = F.array(place(F.lit(0), F.lit(0), F.col("asks"), yes))
    placed = rows.withColumn("place", F.explode(F.when(F.col("tb") == 1, once).otherwise(F.concat(as_target, as_query)))).select("node", "place.*", "rep", "component", "sketch", "asks")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cell in _cells(batches, [0, 1, 2]):
            members, of, queries, targets, asks = (rows.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 6, 7, 8))

            def allowed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                """Whether row i asks for row j; two texts that ask meet once."""
                return queries[i] & targets[j] & (of[i] != of[j]) & (~asks[j] | (members[i] < members[j]))

            pairs = [(i, j) for i, j, *_ in _alike(cell, _sketches(rows, 5), allowed, queries, least)]
            if not pairs:
                continue
            group = _groups(len(cell), pairs)
            held = np.zeros(len(cell), dtype=bool)
            for x in pairs:
                held[x[0]] = held[x[1]] = True
            at = np.flatnonzero(held)
            # A text that is in a place as query and as target counts once.
            at = at[np.lexsort((members[at], group[at]))]
            first = np.concatenate(([True], (group[at][1:] != group[at][:-1]) | (members[at][1:] != members[at][:-1])))
            at = at[first]
            starts = np.flatnonzero(np.concatenate(([True], group[at][1:] != group[at][:-1])))
            sizes = np.diff(np.append(starts, len(at)))
            print_of = np.add.reduceat(mixed(members[at].astype(np.uint64)), starts) ^ mixed(np.bitwise_xor.reduceat(mixed(members[at].astype(np.uint64) + np.uint64(1)), starts))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(print_of, sizes).view(np.int64)), *(rows.column(k).take(pa.array(at)) for k in (3, 4, 5))], names=["cell", "rep", "component", "sketch"])

    return _dealt(placed.select(*PLACE, "rep", "component", "sketch", "queries", "targets", "asks"), *PLACE).mapInArrow(marked, MEMBERS).dropDuplicates(["cell", "rep"])


def cell_links(members: DataFrame, sets: DataFrame, percent: int, least: float = LEAST_ESTIMATE) -> DataFrame:
    """(a, b): links confirmed on the full sets, in each cell a spanning forest of the components that they join.

    In a cell each text outside the largest component is compared with all others whose sketches are alike, as long as
    they aren't connected yet.
    """
    rows = members.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select("cell", "rep", "component", "sketch", "values")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cell in _cells(batches, [0]):
            members, of = (rows.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in rows.column(4)]
            sizes = np.array([len(x) for x in sets], dtype=np.int64)
            starts = np.cumsum(sizes) - sizes
            every = np.concatenate(sets)
            # The component that has most rows of each cell doesn't ask.
            order = np.lexsort((of, cell))
            edges = np.flatnonzero(np.concatenate(([True], (cell[order][1:] != cell[order][:-1]) | (of[order][1:] != of[order][:-1]))))
            counts = np.diff(np.append(edges, len(order)))
            ranked = np.lexsort((-counts, cell[order][edges]))
            top_one = ranked[np.concatenate(([True], cell[order][edges][ranked][1:] != cell[order][edges][ranked][:-1]))]
            asks = of != of[order][edges][top_one][cell]
            root = {x: x for x in of.tolist()}

            def allowed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                return asks[i] & (of[i] != of[j]) & (~asks[j] | (members[i] < members[j]))

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            out = []
            for i, j, _, alone in _alike(cell, _sketches(rows, 3), allowed, asks, least):
                for k, others in [(int(i[0]), j)] if alone else zip(i.tolist(), j[:, None]):
                    others = others[100 * np.minimum(sizes[others], sizes[k]) >= percent * np.maximum(sizes[others], sizes[k])]
                    # The full sets of some partners at a time, until none is left that isn't connected yet.
                    while len(others):
                        here = top(int(of[k]))
                        others = others[[top(x) != here for x in of[others].tolist()]]
                        now = others[: max(1, int(np.searchsorted(np.cumsum(sizes[others]), 500_000)))]
                        others = others[len(now) :]
                        if not len(now):
                            continue
                        ends = np.cumsum(sizes[now])
                        theirs = every[np.repeat(starts[now] - (ends - sizes[now]), sizes[now]) + np.arange(ends[-1])]
                        own = sets[k]
                        both = np.add.reduceat(own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs, ends - sizes[now], dtype=np.int64)
                        for other in now[100 * both >= percent * (len(own) + sizes[now] - both)].tolist():
                            x, y = top(int(of[k])), top(int(of[other]))
                            if x != y:
                                root[max(x, y)] = min(x, y)
                                out.append((int(members[k]), int(members[other])))
            pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1, initial=np.iinfo(np.int64).max)), pa.array(pairs.max(axis=1, initial=np.iinfo(np.int64).min))], names=["a", "b"])

    return _dealt(rows, "cell").mapInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, least_estimate: float = LEAST_ESTIMATE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over confirmed links) and kept, for every row."""
    small_batches(docs.sparkSession)
    signed = stored(signatures(docs), "signed")
    known = signed.filter(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    firsts = known.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("tokens").alias("tokens"))
    firsts = stored(firsts, "firsts")
    reps = firsts.select("rep", "tokens")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            tokens = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, TOKENS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in _bytes(tokens)], type=pa.binary())], names=["rep", "sketch"])

    shared = leaves(reps)
    sketches = stored(reps.mapInArrow(short, "rep long, sketch binary"), "sketches")
    # A class of equal sets has its smallest doc_id as its rep; a repeated doc_id in several classes links them.
    copies = known.join(firsts.filter("copies > 1").select("print", "rep"), "print").filter("doc_id != rep")
    copies = stored(copies.select(F.col("doc_id").alias("node"), "rep"), "copies")
    repeated = not known.groupBy("doc_id").count().filter("count > 1").isEmpty()
    links = copies.limit(0).select(F.col("node").alias("a"), F.col("rep").alias("b"))
    if repeated:
        copies = stored(copies.distinct(), "copies")
        several = copies.groupBy("node").count().filter("count > 1").select("node").unionByName(firsts.select(F.col("rep").alias("node")))
        links = stored(copies.join(several, "node", "left_semi").select(F.col("node").alias("a"), F.col("rep").alias("b")), "links")
    sets = None
    tables = [firsts, shared, sketches]

    def with_sets(wanted: DataFrame) -> DataFrame:
        """The full sets of the wanted texts, which are read again unless they were before."""
        nonlocal sets
        wanted = wanted.distinct() if sets is None else wanted.distinct().join(sets.select("doc_id").distinct(), "doc_id", "left_anti")
        more = _full_sets(docs, stored(wanted, "wanted"), repeated)
        tables.append(more)
        sets = more if sets is None else sets.unionByName(more)
        return sets

    def joined(components: DataFrame | None, new: DataFrame) -> DataFrame:
        """The components with new links; those found so far stand for their links, each a star around its smallest text."""
        known_links = links if components is None else components.select(F.col("component").alias("a"), F.col("node").alias("b"))
        return stored(connected_components(known_links.unionByName(new)), "components")

    components, step, nodes, before = None, 0, shared, None
    while True:
        pairs = stored(proposals(nodes.select("node", "rep", "n"), components, sketches, step, least_estimate), f"pairs{step}")
        tables.append(pairs)
        new = stored(_confirmed(with_sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))), pairs, percent), f"links{step}")
        components, step = joined(components, new), step + 1
        rows = open_nodes(shared, components)
        tables.append(rows)
        nodes = rows.filter(F.col("n") * F.col("q") > MOST_WORK)
        work = nodes.agg(F.sum("q")).first()[0]  # q pairs for each of a node's texts
        if not work or (before is not None and 2 * work > before):
            break
        before = work
    rest = rows if not work else narrowed_nodes(rows, components, reps, tables)
    members = stored(likely_members(rest, sketches, least_estimate), "members")
    tables.append(members)
    if not members.isEmpty():
        components = joined(components, stored(cell_links(members, with_sets(members.select(F.col("rep").alias("doc_id"))), percent, least_estimate), "links"))
    of_copies = copies.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("node", F.coalesce("component", "rep").alias("component"))
    membership = components.unionByName(of_copies)
    if repeated:
        membership = membership.groupBy("node").agg(F.min("component").alias("component"))
    membership = stored(membership, "membership")
    discard(*tables)
    return (
        signed.select("doc_id", "n_shingles")
        .join(membership.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
    )
