"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles. TREES independent trees branch all sets by tokens that
minwise hashing selects: the root by one minhash, and a large node of mostly unlike sets by further
ones. A branching goes REPEATS ways at once, so it keeps a pair at the threshold with 1 - 0.2 **
REPEATS, and there are LEVELS of them before the shuffle and LEVELS after it at most. A large node of
like sets, which branching would not part, is compared whole: where it is too large for a task, as
all pairs of its blocks. Sets in a node are compared exhaustively, first by their signatures; the
likely pairs are then confirmed on full sets. A pair at the threshold is in one node of at least one
tree with a probability of 1 - (1 - 0.8) ** TREES if its first nodes are not branched, and of
1 - (1 - 0.8 * 0.96 ** 6) ** TREES, all but some 8 in a million, if all of them are to the full depth.

Sets that are equal are one class from the start. In each node only a maximum spanning forest of
the likely pairs is confirmed at first. Where a pair fails, a second round compares the likely pairs
between components: forests have the components of all likely pairs, so the full sets of such a
cluster are sent to one place if it is small; if it is not, all pairs of its blocks are compared by
signatures and the sets that have a likely pair elsewhere are sent for each pair of blocks. Only
links that join components return. So no link between components is lost, and neither a group
of copies nor one whose members are likely but not linked makes more rows than it has members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stainloom.llm.common import cut, join_counted, lean, stored, text_of

TREES = 12
COORDS = 128
#: Signature matches of a likely pair: five standard deviations below 0.8 * COORDS.
LIKELY = 80
#: Sets of a node that is not branched.
LEAF = 2048
#: Members of a cluster whose sets are compared in one place.
CLUSTER = LEAF
#: Levels at which a large node is branched, before it is shuffled and again after it.
LEVELS = 3
#: Ways, by coordinates of their own, that a node is branched at a level.
REPEATS = 2
#: Edges of a task, on average, where components are found.
EDGES = 4096
#: Edges of a graph that one task settles, 1 MB of them whatever the input is; a larger one takes rounds until it has no more.
SMALL = 1 << 16
#: Words of a task's cache of hashes; a memory bound, without effect on the results.
CACHE = 200_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str, k: int, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; of fewer words, of all of them as one.

    ``known`` holds the hashes of words between texts, as long as its owner keeps it.
    """
    import xxhash

    known = {} if known is None else known

    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    try:
        h = [known[w] for w in words]
    except KeyError:
        if len(known) > CACHE:
            known.clear()
        h = [known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words]
    h = np.array(h, np.uint64)
    k = min(k, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    return np.unique(_mix(s))


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(11)
    return (r.randint(0, 2**31, (COORDS, 1)).astype(np.uint32) << np.uint32(1)) | np.uint32(1), r.randint(0, 2**31, (COORDS, 1)).astype(np.uint32)


def minhashes(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, out = (s >> np.uint64(32)).astype(np.uint32), np.full(COORDS, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(out, (x[None, at : at + 4096] * a + b).min(axis=1), out=out)
    return out


def _features(k: int):
    def run(batches):
        import xxhash

        a, b = _coefficients()
        known: dict[bytes, int] = {}
        trees = np.arange(1, TREES + 1, dtype=np.uint64) << np.uint64(40)
        for batch in batches:
            n, fp, sig, keys = [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingle_set(t, k, known)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                m = minhashes(s, a, b)
                sig.append(((m * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes())
                keys.append(_mix(m[:TREES].astype(np.uint64) | trees).view(np.int64).tolist() if len(s) else [])
            cols = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "n", "fp", "sig", "keys"])

    return run


def _groups(batches, columns: int):
    """Arrays of the rows of each key, of batches that are sorted by key in column 0."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(columns - 1)]
        raw = b.column(columns - 1).cast(pa.binary())
        cols.append(np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, COORDS))
        if held:
            cols = [np.concatenate([x, y]) for x, y in zip(held[0], cols, strict=True)]
        edges = np.flatnonzero(np.diff(cols[0])) + 1
        at = [0, *edges.tolist()]
        for i, j in zip(at, at[1:], strict=False):
            if j - i > 1:
                yield [c[i:j] for c in cols]
        held = [[c[at[-1] :] for c in cols]]
    if held and len(held[0][0]) > 1:
        yield held[0]


def _small(sig: np.ndarray, key: int):
    """Row numbers of the nodes to compare below one node: small ones, and larger ones of like sets whole."""
    order = np.random.RandomState(key & 0x7FFFFFFF).permutation(np.flatnonzero((sig != sig[0]).any(axis=0)))
    todo = [(np.arange(len(sig)), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) > LEAF and depth < LEVELS and len(order) >= (depth + 1) * REPEATS:
            parts = []
            for at in order[depth * REPEATS : (depth + 1) * REPEATS]:
                c = sig[rows, at]
                by = np.argsort(c, kind="stable")
                parts += [rows[x] for x in np.split(by, np.flatnonzero(np.diff(c[by])) + 1)]
            if 2 * sum(len(x) ** 2 for x in parts) < len(rows) ** 2:
                todo += [(x, depth + 1) for x in parts]
                continue
        if len(rows) > 1:
            yield rows


def _likeness(sig: np.ndarray, n: np.ndarray, i: int) -> np.ndarray:
    """Matches of member i with all; -1 where sizes alone rule a link out."""
    like = (sig == sig[i]).sum(axis=1)
    like[(5 * np.minimum(n, n[i]) < 4 * np.maximum(n, n[i])) | (like < LIKELY)] = -1
    return like


def _forest(sig: np.ndarray, n: np.ndarray):
    """Edges of a maximum spanning forest of the likely pairs."""
    left = np.ones(len(n), bool)
    best, of = np.full(len(n), -1), np.zeros(len(n), int)
    i = 0
    for _ in range(len(n) - 1):
        left[i] = False
        like = _likeness(sig, n, i)
        more = left & (like > best)
        best[more], of[more] = like[more], i
        rest = np.flatnonzero(left)
        i = int(rest[np.argmax(best[rest])])
        if best[i] >= 0:
            yield of[i], i


def _edges(batches):
    """A forest of likely pairs of each small node."""
    out: list[tuple[int, int, int]] = []

    def flush():
        cols = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays(cols, ["key", "a", "b"])

    for key, ids, n, sig in _groups(batches, 4):
        for rows in _small(sig, int(key[0])):
            for i, j in _forest(sig[rows], n[rows]):
                x, y = int(ids[rows[i]]), int(ids[rows[j]])
                if x != y:
                    out.append((int(key[0]), min(x, y), max(x, y)))
            if len(out) > 20_000:
                yield flush()
                out = []
    if out:
        yield flush()


def _members(batches):
    """Of each pair of blocks the members that have a likely pair in another component."""
    for key, ids, n, c, s in _groups(batches, 5):
        if (c == c[0]).all():
            continue
        asked = np.zeros(len(ids), bool)
        for i in range(len(ids)):
            hit = (_likeness(s, n, i) >= 0) & (c != c[i])
            asked |= hit
            asked[i] |= hit.any()
        if asked.any():
            cols = [pa.array(x[asked]) for x in (key, ids, n, c)]
            cols.append(pa.array([x.tobytes() for x in s[asked]], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["leaf", "doc_id", "n", "comp", "sig"])


def _leaves(batches):
    """Rows of each leaf, of batches that are sorted by it in column 0."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _bridges(percent: int):
    """Links of each leaf that join two components; every likely pair across them is compared on full sets."""

    def run(batches):
        for rows in _leaves(batches):
            n, comp = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
            sig = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, COORDS)
            sets, found = [np.frombuffer(r[5], np.uint64) for r in rows], []
            for i in range(len(rows)):
                likely = np.flatnonzero(_likeness(sig[i:], n[i:], 0) >= 0) + i
                for j in likely[1:].tolist():
                    if comp[i] == comp[j]:
                        continue
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        found.append((rows[i][1], rows[j][1]))
                        comp[comp == comp[j]] = comp[i]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return run


def _sets(k: int):
    def run(batches):
        known: dict[bytes, int] = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, k, known).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "set"])

    return run


def _settled(batches):
    """(id, component) of the edges of a whole graph, but for rows of that id itself."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while x in up:
            up[x] = x = up.get(up[x], up[x])
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    ids = list(up)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], ["id", "component"])


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each end of a link (a, b) reaches, but for rows of that id itself.

    Alternating large and small stars, which need a logarithmic number of rounds; every step is an
    aggregate and a join, and nothing is gathered on the driver but a count. A graph of SMALL edges
    at most needs no rounds, whose many plans and tasks fill the driver's memory.
    """
    e = cut(links.select("a", "b").filter("a <> b").distinct())
    n, seen = e.count(), None
    for _ in range(max_rounds):
        if n <= SMALL:
            return e.coalesce(1).mapInArrow(_settled, "id long, component long")
        hot = max(1000, 2 * n // 1000)
        # Tasks of EDGES edges: more would leave more files than data on the executors' disks.
        few = lambda df, k=max(1, -(-n // EDGES)): df.coalesce(k)
        both = few(e)
        both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")).withColumn("m", F.least("m", "a"))
        # The hub of a large star is joined by broadcast, so its edges stay where they are.
        large = join_counted(both, low, "a", "c", hot).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = few(few(large).distinct())
        # Every edge now goes from its larger end to a smaller one.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
        small = join_counted(down, low, "a", "c", hot).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        e = cut(few(few(small.unionByName(low.select("a", F.col("m").alias("b")))).distinct()))
        n, total = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if (n, total) == seen:
            return e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
        seen = (n, total)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _block_pairs(group: Column, member: Column, size: Column, most: int) -> Column:
    """Keys of the pairs of blocks that a member of a group is in, for a group larger than ``most``.

    Blocks have half of ``most`` on average, and every two members of the group share a key.
    """
    k = F.ceil(2 * size / F.lit(most)).cast("long")
    block = F.pmod(F.xxhash64(F.lit("block"), member), k)
    others = F.filter(F.sequence(F.lit(0).cast("long"), k - 1), lambda j: j != block)
    return F.transform(others, lambda j: F.xxhash64(F.lit("pair"), group, F.least(block, j), F.greatest(block, j)))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have a similarity of ``percent`` or more.

    Ids are whole numbers. Returns for every row: doc_id, n_shingles, component_id (the smallest
    id of the component), kept (whether it is that one). Words are parted by ASCII white space and
    A-Z are lower-cased. Null texts and texts without words are linked with nothing. A null id has
    a null component and stays. Rows that repeat an id are one document: its links are those of the
    texts that equal another document's, and of the one with the smallest hash. Other columns are
    ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    feats = stored(rows.withColumn("th", F.xxhash64("t")).mapInArrow(lean(_features(shingle)), "doc_id long, th long, n long, fp binary, sig binary, keys array<long>"), "features")
    some = feats.filter("n > 0 and doc_id is not null")
    classes = some.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"))
    reps = cut(some.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct("n", "keys", "sig"), "th").alias("r")).select("doc_id", "r.n", "r.keys", "r.sig"))
    hot = max(LEAF, reps.count() // 1000)
    larges: list[DataFrame] = []

    def coordinate(level: int, way: int) -> Column:
        """A byte of the signature that no other level, way or tree branches by before the shuffle."""
        return F.substring("sig", F.lit(TREES + 1 + level * REPEATS + way) + F.col("tree") * (LEVELS * REPEATS), F.lit(1))

    def placed(of: DataFrame) -> DataFrame:
        """A row for each node of a set, where large nodes of unlike sets are branched."""
        out = of.select("*", F.posexplode("keys").alias("tree", "key")).drop("keys")
        for level, large in enumerate(larges):
            deeper = F.array(*[F.xxhash64("key", F.lit(way), coordinate(level, way)) for way in range(REPEATS)])
            out = out.join(F.broadcast(large), "key", "left").withColumn("key", F.explode(F.when(F.col("_hot"), deeper).otherwise(F.array("key")))).drop("_hot")
        return out

    for level in range(LEVELS):
        at = placed(reps)
        over = cut(at.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > hot))
        if over.isEmpty():
            break
        met = at.join(F.broadcast(over), "key").withColumn("_ways", F.array(*[F.struct(F.lit(way).alias("way"), coordinate(level, way).alias("c")) for way in range(REPEATS)]))
        parts = met.select("key", "m", F.explode("_ways").alias("_way")).groupBy("key", "m", "_way").count()
        unlike = parts.groupBy("key", "m").agg(F.sum(F.col("count") * F.col("count")).alias("pairs")).filter(2 * F.col("pairs") < F.col("m") * F.col("m"))
        large = cut(unlike.select("key", F.lit(True).alias("_hot")))
        if large.isEmpty():
            break
        larges.append(large)
    spread = placed(reps)
    over = cut(spread.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > hot))
    if not over.isEmpty():
        keys = F.when(F.col("m").isNull(), F.array("key")).otherwise(_block_pairs(F.col("key"), F.col("doc_id"), F.col("m"), hot))
        spread = spread.join(F.broadcast(over), "key", "left").withColumn("key", F.explode(keys))
    spread = spread.repartition("key").sortWithinPartitions("key").select("key", "doc_id", "n", "sig")
    found = stored(spread.mapInArrow(lean(_edges), "key long, a long, b long"), "edges")

    pairs = found.select("a", "b").distinct()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = rows.join(ends, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    sets = stored(texts.mapInArrow(lean(_sets(shingle)), "doc_id long, set binary"), "sets")
    x, y = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y"))
    met = pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")
    tried = cut(met.mapInArrow(lean(_confirm(percent)), "a long, b long, ok boolean"))
    links = tried.filter("ok").select("a", "b")
    parts = cut(components(links))
    failed = tried.filter("not ok").select("a", "b")
    if not failed.isEmpty():
        # All likely pairs of a node are within one component of its forest, and so within one cluster.
        clusters = cut(components(pairs))
        # The root of a component, its smallest id, is not among the ids of components().
        clusters = clusters.unionByName(clusters.select(F.col("component").alias("id"), "component")).distinct()
        of = clusters.select(F.col("id").alias("doc_id"), F.col("component").alias("cluster"))
        of = of.join(parts.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
        split = of.groupBy("cluster").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("cluster", "size")
        asked = cut(of.join(split, "cluster"))
        whole = asked.filter(F.col("size") <= CLUSTER).join(reps, "doc_id").select(F.col("cluster").alias("leaf"), "doc_id", "n", "comp", "sig")
        wide = asked.filter(F.col("size") > CLUSTER)
        if not wide.isEmpty():
            # All pairs of members of a larger cluster meet as members of two of its blocks.
            key = F.explode(_block_pairs(F.col("cluster"), F.col("doc_id"), F.col("size"), CLUSTER)).alias("key")
            again = wide.join(reps, "doc_id").select(key, "doc_id", "n", "comp", "sig")
            again = again.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_members), "leaf long, doc_id long, n long, comp long, sig binary")
            whole = whole.unionByName(stored(again, "members"))
        met = whole.join(sets, "doc_id").select("leaf", "doc_id", "n", "comp", "sig", "set")
        bridges = cut(met.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(lean(_bridges(percent)), "a long, b long"))
        if not bridges.isEmpty():
            parts = cut(components(links.unionByName(bridges)))
    # Classes to components, then every row by its set. Large classes are joined by broadcast.
    of = classes.join(parts, classes["rep"] == parts["id"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "c")
    met = join_counted(some.select("doc_id", "n", "fp"), of, "fp", "c", max(1000, hot)).select("doc_id", "n", "component_id")
    rest = feats.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = met.unionByName(rest)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
