"""Exact Jaccard self-join of documents over word shingles, in a metric space of sets.

Alone.  Most sets have more shingles that no other set has than a link allows; they are linked with nothing and go first.

Regions.  A pivot is the set signature of :mod:`docloom.llm.shingle_sets`; a document lies in the regions of its own
signatures, and the triangle inequality (measured from the empty set) says which size band's regions it must be
replicated into.  Documents of one region that differ are linked as candidates; what hangs together is a cluster, and
no link joins two clusters.

Within a cluster.  A small cluster is joined recursively in one task: document pivots, every other document goes to
the Voronoi region of its nearest pivot and, as a replica, to each region whose pivot is not farther than that by more
than twice the radius; regions shrink until all pairs are cheap.  A cluster too large for one task is joined
around one pivot, its sets' majority, in rings that the triangle inequality leaves, block by block.  Both ways are
exact; neither caps or drops anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.llm.shingle_sets import least_hashes, occurrences, profile_gaps, profiles, set_hashes, shingle_sets, signatures
from docloom.llm.textblocks import Words, blocks
from docloom.sources.tables import KeptTable, cut_lineage, joined_to_small

#: Sets of a region up to which its pairs are candidates.
PAIRS_ROWS = 12
#: Sets of a larger region that are compared by profile in one block.
BLOCK_ROWS = 2048
#: Documents of a cluster that one task joins.
CLUSTER_ROWS = 100
#: Documents of a region below which all its pairs are compared.
REGION_ROWS = 12


def _of_texts(rows: DataFrame, n: int, schema: str, made: Callable[[pa.RecordBatch, list[np.ndarray]], list]) -> DataFrame:
    """The columns that ``made`` gives for a block of rows (whose last column is the text) and their shingle sets."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column(batch.num_columns - 1)):
                columns = made(batch.slice(first, len(texts)), shingle_sets(Words(texts), n))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    return rows.mapInArrow(run, schema)


def set_sizes(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, n_shingles, set_hash`` of each row of ``doc_id, text``, from its whole text."""
    return _of_texts(docs, n, "doc_id long, n_shingles long, set_hash long", lambda batch, sets: [batch.column(0), np.array([len(s) for s in sets], np.int64), set_hashes(sets)])


def _distinct(sets: list[np.ndarray]) -> list[int]:
    return np.unique(set_hashes(sets), return_index=True)[1].tolist()


def _lonely(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``node``: sets (hashes) of ``doc_id, text`` with more shingles of their own than a link allows.

    Within a block of texts equal sets count once, and a shingle of many sets is one row.
    """

    def made(_: pa.RecordBatch, sets: list[np.ndarray]) -> list:
        return list(occurrences([sets[i] for i in _distinct(sets)], percent))

    seen = _of_texts(docs.where("doc_id is not null"), n, "shingle long, least long, most long, spare long", made)
    own = seen.groupBy("shingle").agg(F.min("least").alias("node"), F.max("most").alias("most"), F.max("spare").alias("spare")).where("node = most and spare >= 0")
    return own.groupBy("node", "spare").agg(F.count("*").alias("c")).where("c > spare").select("node")


def _stars(shapes: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b``: each set with pivots that have one of its smallest hashes, where their profiles allow a link."""
    of = shapes.select("node", "n", "profile", F.explode("least").alias("h"))
    pivots = of.groupBy("h").agg(F.min(F.struct("node", "n", "profile")).alias("pivot"), F.count("*").alias("c")).where("c > 1").drop("c")
    pairs = of.join(pivots, "h").where("node <> pivot.node").select(F.col("pivot.node").alias("a"), F.col("node").alias("b"), F.col("pivot").alias("of_a"), F.struct("n", "profile").alias("of_b"))
    return _near(pairs, percent).distinct()


def _near(pairs: DataFrame, percent: int) -> DataFrame:
    """The ``a, b`` of ``a, b, of_a, of_b`` whose profiles allow a link: by the triangle inequality sets differ at least as
    much as their numbers of shingles in each part of the hash range do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("of_a"), batch.column("of_b")
            size = a.field("n").to_numpy() + b.field("n").to_numpy()
            keep = (100 + percent) * profile_gaps(*(c.field("profile").to_pylist() for c in (a, b))) <= (100 - percent) * size
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long")


def _signatures_of(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """``sig, node, part, tag`` of rows ``node, part, text``: the signatures of each set and their tags."""

    def made(batch: pa.RecordBatch, sets: list[np.ndarray]) -> list:
        node, sigs, tags = signatures(sets, percent)
        many = [len(x) for x in sigs]
        part = np.repeat(batch.column(1).to_numpy(), many)
        return [np.concatenate([*sigs, np.empty(0, np.int64)]), np.repeat(node, many), part, np.concatenate([*tags, np.empty(0, np.int32)])]

    return _of_texts(rows, n, "sig long, node long, part long, tag int", made)


def clusters_of(held: DataFrame, n: int, percent: int, parts: int) -> DataFrame:
    """``node, component`` of the sets ``node, text`` that may be linked with another: no link joins two components.

    First every set is hung to pivots that it is likely near to.  Then the signatures of all sets are compared; only those
    that several of the parts so made have in common go on.
    """
    shapes = _of_texts(held.select("node", "text"), n, "node long, n long, profile binary, least array<long>", lambda batch, sets: [
        batch.column(0), np.array([len(s) for s in sets], np.int64), pa.array([p.tobytes() for p in profiles(sets)], pa.binary()), pa.array(list(least_hashes(sets)), pa.list_(pa.int64()))])
    shapes = cut_lineage(shapes)
    stars = cut_lineage(_stars(shapes, percent))
    part = components(stars).select("node", F.col("component").alias("part"))
    placed = cut_lineage(shapes.select("node").join(part, "node", "left").select("node", F.coalesce("part", "node").alias("part")))
    signed = _signatures_of(joined_to_small(held, placed, "node").select("node", "part", "text"), n, percent)
    shared = cut_lineage(signed.groupBy("sig").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("sig"))
    members = cut_lineage(joined_to_small(signed, shared, "sig").select("sig", "node", "tag"))
    edges = candidate_edges(members, parts, shapes.select("node", "n", "profile").join(placed, "node"), percent)
    return components(stars.unionByName(edges))


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sig", pa.int64()), ("tag", pa.int32())])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by signature: the pairs of sets in each small region; the rows (with b null) of large regions, and
    of the partition's first and last one, which may go on elsewhere."""
    held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]  # the last region so far
    first, spilled = True, None

    def rows(sig: np.ndarray, node: np.ndarray, tag: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(sig), pa.array(tag)], schema=_FOUND)

    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        sig, node, tag = (np.concatenate([x, y]) for x, y in zip(held, new, strict=True))
        if not len(sig):
            continue
        again = np.flatnonzero((sig[1:] == sig[:-1]) & (node[1:] == node[:-1])) + 1  # copies from other blocks
        sig, node, tag = np.delete(sig, again), np.delete(node, again), np.delete(tag, again)
        edge = np.append(np.flatnonzero(np.diff(sig, prepend=~sig[:1]) != 0), len(sig))
        size = np.diff(edge)
        whole = np.ones(len(size), bool)
        whole[-1] = False  # it may go on in the next batch
        large = size > PAIRS_ROWS
        if first or spilled == sig[0]:
            large[0] = True
            first = first and len(size) == 1
        out = np.flatnonzero(large & (whole | (size > PAIRS_ROWS)))
        if len(out):
            at = np.concatenate([np.arange(edge[i], edge[i + 1]) for i in out])
            yield rows(sig[at], node[at], tag[at])
        for m in range(2, PAIRS_ROWS + 1):
            at = edge[:-1][(size == m) & whole & ~large]
            if len(at):
                i, j = np.triu_indices(m, 1)
                a, b = node[(at[:, None] + i).ravel()], node[(at[:, None] + j).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32())], schema=_FOUND)
        if size[-1] > PAIRS_ROWS:
            # what comes of this region later joins the rows already given
            held, spilled = [x[:0] for x in (sig, node, tag)], sig[-1]
        else:
            held = [x[edge[-2] :] for x in (sig, node, tag)]
            spilled = spilled if spilled == sig[-1] else None
    if len(held[0]):
        yield rows(*held)


def candidate_edges(members: DataFrame, parts: int, shapes: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b`` that hang together all sets that may be linked, from rows ``sig, node, tag``.

    The rows are sorted over all partitions by signature and set, so that a signature of very many sets spreads over
    partitions.  The pairs of small regions are kept where profiles (of ``shapes``: node, n, profile, part) allow a link.
    A large region is passed over by sets that are in fewer large regions than any set linked with them shares regions
    with them; such links show in a small region.  The others are compared by profile in blocks; what their blocks hang
    together is linked across blocks.  Of regions with the same sets one is compared, and sets of one part never are.
    """
    found = cut_lineage(members.repartitionByRange(parts, "sig", "node").sortWithinPartitions("sig", "node").mapInArrow(_regions, "a long, b long, sig long, tag int"))
    one, two = (shapes.select(F.col("node").alias(x), F.struct("n", "profile", "part").alias(f"of_{x}")) for x in ("a", "b"))
    pairs = found.where("b is not null").select("a", "b").distinct().join(one, "a").join(two, "b").where("of_a.part <> of_b.part")
    close = _near(pairs.select("a", "b", "of_a", "of_b"), percent)
    rows = found.where("b is null").select("sig", F.col("a").alias("node"), "tag")
    often = rows.groupBy("node", "tag").agg(F.count("*").alias("c")).where(F.col("c") >= F.col("tag").bitwiseAND(F.lit(0xFFFF))).select("node", "tag")
    stay = rows.join(often, ["node", "tag"]).select("sig", "node").distinct()
    stay = cut_lineage(stay)
    alike = stay.groupBy("sig").agg(F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum")).where("c > 1")
    sizes = alike.groupBy("c", "sum").agg(F.min("sig").alias("sig")).select("sig", F.ceil(F.col("c") / BLOCK_ROWS).alias("m"))
    block = F.pmod(F.xxhash64("node"), F.col("m"))
    dealt = stay.join(sizes, "sig").select("sig", "node", "m", block.alias("block")).join(shapes, "node")
    held = cut_lineage(dealt.groupBy("sig", "block").applyInArrow(_close_in_block(percent), "a long, b long, sig long"))
    ends = held.where("b is null").select("sig", "a")
    least = ends.groupBy("sig").agg(F.min("a").alias("m"))
    across = ends.join(least, "sig").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return close.unionByName(held.where("b is not null").select("a", "b")).unionByName(across).distinct()


def _close_in_block(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Edges that hang together the parts of a block of which sets' profiles allow a link; where the region has several
    blocks, also one set (with b null) of each part that the block then has, for what may link it with other blocks."""

    def run(block: pa.Table) -> pa.Table:
        rows = block.sort_by("node")
        node, n = rows["node"].to_numpy(), rows["n"].to_numpy()
        given = rows["profile"].to_pylist()
        width = min(map(len, given))  # sets of a region are of one band, so their profiles hardly differ in length
        profile = np.stack([np.frombuffer(x, np.uint8).reshape(width, -1).sum(1, dtype=np.int32) for x in given])
        part, times = np.unique(rows["part"].to_numpy(), return_inverse=True, return_counts=True)[1:]
        edges: list[tuple[int, int | None]] = []
        for i in np.flatnonzero(part != times.argmax()):  # links within the largest part are not asked for
            other = np.flatnonzero(part != part[i])
            differ = np.abs(profile[other] - profile[i]).sum(1, dtype=np.int64)
            hit = other[(100 + percent) * differ <= (100 - percent) * (n[i] + n[other])]
            parts, at = np.unique(part[hit], return_index=True)
            edges += [(node[i], node[j]) for j in hit[at]]
            part[np.isin(part, parts)] = part[i]
        if rows["m"][0].as_py() > 1:
            edges += [(node[i], None) for i in np.unique(part, return_index=True)[1]]
        sig = rows["sig"][0].as_py()
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64()), "sig": pa.array([sig] * len(edges), pa.int64())})

    return run


def metric_links(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the index of its component's first set: an exact join by recursive Voronoi regions."""
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def distance(i: int, j: int) -> float:
        a, b = sets[i], sets[j]
        common = len(np.intersect1d(a, b, assume_unique=True))
        union = len(a) + len(b) - common
        if common and 100 * common >= percent * union:
            p, q = sorted((find(i), find(j)))
            parent[q] = p
        return 1 - common / union if union else 0.0

    def join(members: list[int]) -> None:
        if len(members) <= REGION_ROWS:
            for at, i in enumerate(members):
                for j in members[at + 1 :]:
                    if find(i) != find(j):
                        distance(i, j)
            return
        pivots = members[:: max(1, len(members) // 6)][:6]
        far = {i: [distance(p, i) for p in pivots] for i in members if i not in pivots}
        for a, p in enumerate(pivots):  # the pivots themselves
            for q in pivots[a + 1 :]:
                distance(p, q)
        radius = 1 - percent / 100 + 1e-9
        regions: list[list[int]] = [[] for _ in pivots]
        for i, d in far.items():
            home = min(range(len(pivots)), key=d.__getitem__)
            for at, x in enumerate(d):
                if at == home or x <= d[home] + 2 * radius:
                    regions[at].append(i)
        rest = list(far)
        if max(map(len, regions)) == len(rest):  # the windows take in everything: these pivots split nothing
            rings = sorted(rest, key=lambda i: far[i][0])  # but their distances still exclude
            for at, i in enumerate(rings):
                for j in rings[at + 1 :]:
                    if far[j][0] > far[i][0] + radius:
                        break
                    if find(i) != find(j) and all(abs(x - y) <= radius for x, y in zip(far[i], far[j], strict=True)):
                        distance(i, j)
            return
        for region in regions:
            if len({find(i) for i in region}) > 1:
                join(region)

    join(list(range(len(sets))))
    return [find(i) for i in range(len(sets))]


def _small_clusters(members: DataFrame, n: int, percent: int) -> DataFrame:
    """Links ``a, b`` that give the components within clusters of at most CLUSTER_ROWS sets, from ``cluster, node, text``."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("node")
        ids = rows["node"].to_pylist()
        sets = [s for _, texts in blocks(rows["text"]) for s in shingle_sets(Words(texts), n)]
        roots = metric_links(sets, percent)
        return pa.table({"a": pa.array([ids[r] for r in roots], pa.int64()), "b": pa.array(ids, pa.int64())})

    return members.groupBy("cluster").applyInArrow(run, "a long, b long")


def _per_set(rows: DataFrame, n: int, schema: str, made: Callable[[pa.RecordBatch, int, np.ndarray], list[tuple]]) -> DataFrame:
    """Rows that ``made`` gives for each row of ``cluster, node, text, ...`` (batch, index, shingle set)."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column("text")):
                out = [x for i, s in enumerate(shingle_sets(Words(texts), n), first) for x in made(batch, i, s)]
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], kinds)

    kinds = pa.schema([(f.split()[0], {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}[f.split()[1]]) for f in schema.split(", ")])
    return rows.mapInArrow(run, schema)


def _against(batch: pa.RecordBatch, i: int, s: np.ndarray, name: str) -> tuple[int, int]:
    """Sizes of the intersection and the union with the row's array ``name`` (null: empty)."""
    given = batch.column(name)[i]
    other = given.values.to_numpy().view(np.uint64) if given.is_valid else np.empty(0, np.uint64)
    common = len(np.intersect1d(s, other, assume_unique=True))
    return common, len(s) + len(other) - common


def _block_links(n_words: int, percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links between the sets of side 0 and all others of a unit, by counting common shingles."""

    def run(unit: pa.Table) -> pa.Table:
        rows = unit.sort_by([("side", "ascending"), ("node", "ascending")])
        ids, sides, main = (rows[c].to_numpy() for c in ("node", "side", "main"))
        sets = [s for _, texts in blocks(rows["text"]) for s in shingle_sets(Words(texts), n_words)]
        n = int((sides == 0).sum())
        if n == len(sets):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        size = np.array([len(s) for s in sets[n:]])
        every = np.concatenate(sets[n:])
        order = np.argsort(every, kind="stable")
        owner, every = np.repeat(np.arange(len(size)), size)[order], every[order]
        a, b = [], []
        for i in range(n):
            low, high = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
            held = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(held)[:-1]]), held) + np.arange(held.sum())
            common = np.bincount(owner[at], minlength=len(size))
            hit = np.flatnonzero((common > 0) & (100 * common >= percent * (len(sets[i]) + size - common)) & (ids[n:] != ids[i]))
            near = hit[main[n:][hit]]
            for j in [*near[:1], *hit[~main[n:][hit]]]:  # what the hub holds together needs one link
                a.append(ids[i])
                b.append(ids[n + j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _counted(batch: pa.RecordBatch, sets: list[np.ndarray]) -> list:
    """Cluster, shingle, and how many of a block's sets of that cluster have it."""
    cluster = np.repeat(batch.column(0).to_numpy(), [len(s) for s in sets])
    shingle = np.concatenate(sets).view(np.int64)
    order = np.lexsort((shingle, cluster))
    cluster, shingle = cluster[order], shingle[order]
    at = np.flatnonzero((np.diff(cluster, prepend=~cluster[:1]) != 0) | (np.diff(shingle, prepend=~shingle[:1]) != 0))
    return [cluster[at], shingle[at], np.diff(np.append(at, len(order)))]


def _large_clusters(members: DataFrame, n: int, percent: int) -> DataFrame:
    """Links ``a, b`` that give the components within clusters of any size, from ``cluster, node, text``.

    A cluster's pivot is the set of the shingles that most of its sets have.  The set nearest to it is the hub: sets
    linked with the hub are never compared with each other.  Each other set is compared with all in the rings around
    the pivot that the triangle inequality leaves; rings are dealt into blocks, and a unit of work is a block of such
    sets with a block of any.
    """
    tokens = _of_texts(members.select("cluster", "text"), n, "cluster long, t long, c long", _counted)
    rows = members.groupBy("cluster").agg(F.count("*").alias("rows"))
    often = tokens.groupBy("cluster", "t").agg(F.sum("c").alias("df")).join(rows, "cluster").where("2 * df > rows")
    pivot = often.groupBy("cluster").agg(F.collect_list("t").alias("p"))  # at most twice the mean size of the cluster's sets
    pivot = cut_lineage(pivot.select("cluster", F.array_sort("p").alias("p")))

    def far_from(batch: pa.RecordBatch, i: int, s: np.ndarray) -> list[tuple]:
        common, union = _against(batch, i, s, "p")
        return [(batch.column("cluster")[i].as_py(), batch.column("node")[i].as_py(), 1 - common / union)]

    far = cut_lineage(_per_set(members.join(pivot, "cluster", "left"), n, "cluster long, node long, far double", far_from))
    hub = far.groupBy("cluster").agg(F.min(F.struct("far", "node")).alias("h")).select("cluster", F.col("h.node").alias("hub"))
    own = members.join(hub, (members["cluster"] == hub["cluster"]) & (members["node"] == hub["hub"])).select(members["cluster"], "node", "text")
    hubs = cut_lineage(_per_set(own, n, "cluster long, hub long, p array<long>", lambda batch, i, s: [(batch.column("cluster")[i].as_py(), batch.column("node")[i].as_py(), s.view(np.int64).tolist())]))

    def of_hub(batch: pa.RecordBatch, i: int, s: np.ndarray) -> list[tuple]:
        common, union = _against(batch, i, s, "p")
        return [(*(batch.column(c)[i].as_py() for c in ("cluster", "node", "hub")), bool(common) and 100 * common >= percent * union)]

    main = _per_set(members.join(hubs, "cluster"), n, "cluster long, node long, hub long, main boolean", of_hub)
    ring = F.floor(F.col("far") / ((100 - percent) / 100 + 1e-9))
    placed = cut_lineage(far.join(main, ["cluster", "node"]).select("cluster", "node", ring.alias("ring"), "hub", "main"))
    links = placed.where("main and node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    rest = placed.where("not main")
    ys = placed.groupBy("cluster", "ring").agg(F.ceil(F.count("*") / CLUSTER_ROWS).alias("m"))
    xs = rest.groupBy("cluster", "ring").agg(F.ceil(F.count("*") / CLUSTER_ROWS).alias("m"))
    units = (
        xs.select("cluster", F.col("ring").alias("xr"), F.col("m").alias("xm")).join(ys.select("cluster", F.col("ring").alias("yr"), F.col("m").alias("ym")), "cluster").where("abs(xr - yr) <= 1")
        .withColumn("xb", F.explode(F.expr("sequence(0L, xm - 1)"))).withColumn("yb", F.explode(F.expr("sequence(0L, ym - 1)")))
    )
    units = cut_lineage(units)
    block = F.pmod(F.xxhash64("node"), F.col("m"))
    unit = ["cluster", "xr", "xb", "yr", "yb"]
    one = rest.join(xs, ["cluster", "ring"]).select("cluster", F.col("ring").alias("xr"), block.alias("xb"), "node", "main").join(units, ["cluster", "xr", "xb"]).select(*unit, "node", "main", F.lit(0).alias("side"))
    two = placed.join(ys, ["cluster", "ring"]).select("cluster", F.col("ring").alias("yr"), block.alias("yb"), "node", "main").join(units, ["cluster", "yr", "yb"]).select(*unit, "node", "main", F.lit(1).alias("side"))
    both = one.unionByName(two).join(members.select("node", "text"), "node")
    return links.unionByName(both.groupBy(*unit).applyInArrow(_block_links(n, percent), "a long, b long"))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, set_hash, component_id`` of every row of ``docs``.

    Documents whose sets of distinct ``n``-word shingles have ``100 * intersection >= percent * union`` are linked;
    ``component_id`` is the smallest id that links reach.  Words are runs of other than ASCII white space, A-Z
    lower-cased.  With fewer than ``n`` words the whole sequence is the one shingle.  A null or empty text, or one of
    white space only, has no shingle and is its own component.  Rows that repeat an id count as one document; a row
    without an id is linked with nothing and has no component.  An empty table gives an empty result.  Other columns
    are ignored.  Sets are told apart by a 64-bit hash of their 64-bit shingle hashes.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut_lineage(set_sizes(text, n))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), text.rdd.getNumPartitions())
    sets = signed.where("doc_id is not null and n_shingles > 0").select("doc_id", F.col("set_hash").alias("node"))
    # one document's text stands for each set that may be linked
    stands = cut_lineage(sets.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(_lonely(text, n, percent), "node", "left_anti"))
    repeats = _repeats(signed)
    first = joined_to_small(text, stands, "doc_id").select("node", "text")
    if repeats:  # of the rows of an id, one with the set that the id stands for
        same = _of_texts(first, n, "node long, own long, text string", lambda batch, made: [batch.column(0), set_hashes(made), batch.column(1)])
        first = same.where("node = own").dropDuplicates(["node"]).select("node", "text")
    open_ = KeptTable(first)
    cluster = cut_lineage(clusters_of(open_.rows, n, percent, parts))
    counts = cluster.groupBy("component").agg(F.count("*").alias("rows"))
    sized = cut_lineage(cluster.join(counts, "component").select("node", F.col("component").alias("cluster"), "rows"))
    held = joined_to_small(open_.rows, sized, "node")
    links = _small_clusters(held.where(F.col("rows") <= CLUSTER_ROWS).select("cluster", "node", "text"), n, percent).where("a <> b")
    if not sized.where(F.col("rows") > CLUSTER_ROWS).isEmpty():
        links = links.unionByName(_large_clusters(held.where(F.col("rows") > CLUSTER_ROWS).select("cluster", "node", "text"), n, percent))
    # a set's id is that of its smallest document; sets of one id, where rows repeat it, are linked by it
    ids = sets.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    joined = cut_lineage(components(links))
    open_.drop()
    of_set = ids.join(joined, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = of_set.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = of_set.join(least, "component").select(F.col("node").alias("set_hash"), "component_id")
    out = signed.join(named, "set_hash", "left")
    whole = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", "set_hash", whole.alias("component_id"))
    return _joined_by_id(out) if repeats else out


def _repeats(signed: DataFrame) -> bool:
    """Whether some id has several rows."""
    return not signed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()


def _joined_by_id(out: DataFrame) -> DataFrame:
    """Components that rows of one id have in common, made one."""
    out = cut_lineage(out)
    same = out.where("component_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("a"))
    edges = out.join(same, "doc_id").select("a", F.col("component_id").alias("b")).where("a <> b")
    moved = components(edges).select(F.col("node").alias("component_id"), F.col("component").alias("to"))
    return out.join(moved, "component_id", "left").select("doc_id", "n_shingles", "set_hash", F.coalesce("to", "component_id").alias("component_id"))
