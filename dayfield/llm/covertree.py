"""Operator 9: exact pairs over a cosine threshold by a cover tree and a dual traversal of its node pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import matrix, valid_vectors
from .common import components, unique_join, written

#: Rows of a node that its net is drawn from, and what keeps rounding of distances from pruning a true pair.
SAMPLE, SLACK = 2048, 1e-9
#: A node whose sample has fewer rows than this share near another row is not covered by fewer centres than rows.
LEAST_COVERED = 0.25


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; a scaling by the largest component first keeps squares in range."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances between unit vectors, all with all; from differences where they are small."""
    gap = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))
    for i, j in zip(*np.nonzero(gap < 1e-5), strict=True):
        gap[i, j] = np.sqrt(((x[i] - y[j]) ** 2).sum())
    return gap


def _nearest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest row of y, distance to it) for each row of x."""
    best = (x @ y.T).argmax(axis=1)
    return best, np.sqrt(((x - y[best]) ** 2).sum(axis=1))


def net(unit: np.ndarray, radius: float, first: np.ndarray | None = None) -> np.ndarray:
    """Centres (rows of the result) so that rows of ``unit`` within ``radius`` of a centre are covered; empty where that does not pay.

    A greedy pass makes every row that no centre covers one; centres that cover no row but themselves are left out, and if the
    others cover less than LEAST_COVERED of the rows, the next level is the rows themselves. ``first``, the centre of the node
    above, stays a centre, so that levels are nested."""
    limit = 1 - radius * radius / 2
    open_rows, counts, chosen = np.ones(len(unit), bool), [], []
    if first is not None:
        open_rows &= unit @ first < limit
    alone = 0
    while open_rows.any() and alone <= (1 - LEAST_COVERED) * len(unit):
        at = int(open_rows.argmax())
        near = (unit @ unit[at] >= limit) & open_rows
        near[at] = True
        open_rows &= ~near
        if near.sum() > 1:
            chosen.append(at)
            counts.append(int(near.sum()))
        alone += int(near.sum() == 1)
    before = 0 if first is None else int((unit @ first >= limit).sum())
    if before + sum(counts) < LEAST_COVERED * len(unit):
        return np.empty((0, unit.shape[1]))
    centres = unit[chosen]
    return centres if first is None else np.concatenate((first[None], centres))


def _unpack(cell) -> np.ndarray:
    return np.array(cell.as_py(), np.float64)


def _net_of(group: pa.Table) -> pa.Table:
    """The net of one node's sample at half its radius: (node, k, centre)."""
    (_, x), = matrix(group.column("vec"))
    centre = group.column("centre")[0]
    found = net(_unit(x[:SAMPLE]), group.column("radius")[0].as_py() / 2, _unpack(centre) if centre.is_valid else None)
    node = [group.column("node")[0].as_py()] * len(found)
    return pa.table({"node": pa.array(node, pa.string()), "k": pa.array(np.arange(len(found)), pa.int32()), "centre": pa.array(list(found), pa.list_(pa.float64()))})


def _hung(rows: pa.Table, nets: pa.Table) -> pa.Table:
    """Rows of one node on the centre that covers them; the others stay with the first centre (the node's own) and its radius in a node "r"."""
    if not rows.num_rows or not nets.num_rows:
        return rows.select(["class", "vec", "w"]).append_column("node", pa.array([], pa.string())).append_column("radius", pa.array([], pa.float64())).append_column("gap", pa.array([], pa.float64())).slice(0, 0)
    node, radius = nets.column("node")[0].as_py(), rows.column("radius")[0].as_py()
    ks, centres = nets.column("k").to_numpy(), np.array([_unpack(c) for c in nets.column("centre")])
    (_, x), = matrix(rows.column("vec"))
    unit = _unit(x)
    at, gap = _nearest(unit, centres)
    far = gap > radius / 2
    own = np.sqrt(((unit - centres[0]) ** 2).sum(axis=1))
    names = [f"{node}.r" if f else f"{node}.{k}" for f, k in zip(far.tolist(), ks[at].tolist(), strict=True)]
    out = rows.select(["class", "vec", "w"]).append_column("node", pa.array(names, pa.string()))
    out = out.append_column("radius", pa.array(np.where(far, radius, radius / 2)))
    return out.append_column("gap", pa.array(np.where(far, own, gap)))


#: Nodes with more rows are divided, where the next level would not be the rows themselves; children that stand in one row of a join.
NODE_ROWS, CHILDREN = 64, 64


def build(classes: DataFrame, reach: float, node_rows: int = NODE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes) of the cover tree over ``classes`` (class, vec, w).

    rows: class, vec, w, node (its leaf). nodes: node, parent, centre, radius (the most it may cover), cover (measured over all rows
    below it), n, open (has children). The root of each dimension has radius 2, which covers the sphere. Level by level, every
    node with more than ``node_rows`` rows draws centres at half its radius from a sample of its own rows, in a job grouped by
    node; all its rows are then hung on the nearest centre that covers them, and what none covers stays in a node of its own
    that is divided again. A node is not divided if all its rows link with each other anyway (cover at most reach / 2), or if the
    next level would be its rows themselves: then the rows are the level, each with covering radius 0."""
    rows = classes.select("class", "vec", "w", F.size("vec").cast("string").alias("node"), F.lit(2.0).alias("radius"), F.lit(2.0).alias("gap"))
    rows = written(rows, "level")
    centres = rows.select("node", F.lit(None).cast("array<double>").alias("centre")).distinct()
    done_rows, done_nodes = [], []
    while True:
        found = rows.groupBy("node").agg(F.max("radius").alias("radius"), F.max("gap").alias("cover"), F.count("*").alias("n"))
        nodes = written(found.join(centres, "node"), "nodes")
        big = nodes.where((F.col("n") > node_rows) & (F.col("cover") * 2 > reach - SLACK))
        drawn = rows.join(big.select("node", "centre", "n"), "node").where(F.pmod(F.xxhash64(F.lit(11), "class"), F.lit(1 << 30)) < F.col("n") ** -1 * (SAMPLE * 1.1 * (1 << 30)))
        nets = written(drawn.groupBy("node").applyInArrow(_net_of, "node string, k int, centre array<double>"), "nets")
        split = nets.groupBy("node").agg(F.count("*").alias("_k"))
        nodes = nodes.join(split, "node", "left").select("node", F.regexp_replace("node", r"\.?[^.]*$", "").alias("parent"), "centre", "radius", "cover", "n", F.col("_k").isNotNull().alias("open"))
        done_nodes.append(nodes)
        if not nets.limit(1).count():
            done_rows.append(rows.select("class", "vec", "w", "node"))
            break
        done_rows.append(written(rows.join(split, "node", "left_anti").select("class", "vec", "w", "node"), "leaves"))
        salts = nodes.where("open").select("node", F.ceil(F.col("n") / 8192).cast("int").alias("_salts"))
        dealt = rows.join(salts, "node").withColumn("_salt", F.pmod(F.xxhash64("class"), "_salts").cast("int"))
        copied = nets.join(salts.withColumnRenamed("_salts", "_of"), "node").withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
        kind = f"class long, vec {rows.schema['vec'].dataType.simpleString()}, w long, node string, radius double, gap double"
        hung = dealt.groupBy("node", "_salt").cogroup(copied.groupBy("node", "_to")).applyInArrow(_hung, kind)
        below = nets.select(F.concat_ws(".", "node", F.col("k").cast("string")).alias("node"), "centre")
        rest = nets.where("k = 0").select(F.concat_ws(".", "node", F.lit("r")).alias("node"), "centre")
        rows, centres = written(hung, "level"), below.union(rest)
    all_rows, all_nodes = done_rows[0], done_nodes[0]
    for more in done_rows[1:]:
        all_rows = all_rows.union(more)
    for more in done_nodes[1:]:
        all_nodes = all_nodes.union(more)
    return all_rows, written(all_nodes, "tree")


def _children(nodes: DataFrame) -> DataFrame:
    """(of, piece, below): the children of each open node in pieces of about CHILDREN, and each leaf as its own only child."""
    child = F.struct("node", "centre", "cover", "n", "open")
    own, parent = F.when(~F.col("open"), F.col("node")), F.when(F.col("parent") != "", F.col("parent"))
    each = nodes.select(F.explode(F.array_compact(F.array(own, parent))).alias("of"), child.alias("c"))
    counts = each.groupBy(F.col("of").alias("_of")).agg(F.ceil(F.count("*") / CHILDREN).cast("int").alias("_pieces"))
    dealt = each.join(counts, F.col("of") == F.col("_of")).withColumn("piece", F.pmod(F.xxhash64("c.node"), F.col("_pieces")).cast("int"))
    return dealt.groupBy("of", "piece").agg(F.sort_array(F.collect_list("c")).alias("below"))


def _listed(column: pa.Array, k: int) -> tuple[pa.StructArray, np.ndarray | None]:
    """The k-th list of children, and their centres as rows."""
    rows = column.slice(k, 1).flatten()
    return rows, rows.field("centre").flatten().to_numpy().reshape(len(rows), -1)


def _surviving(batches: Iterator[pa.RecordBatch], reach: float) -> Iterator[pa.RecordBatch]:
    """Pairs of children whose centres are no further apart than ``reach`` plus both covering radii."""
    for batch in batches:
        for k in range(batch.num_rows):
            (left, x), (right, y) = _listed(batch.column(2), k), _listed(batch.column(3), k)
            near = _apart(x, y) <= reach + SLACK + np.add.outer(left.field("cover").to_numpy(), right.field("cover").to_numpy())
            if batch.column(4)[k].as_py():
                near = np.triu(near)
            a, b = (pa.array(at) for at in np.nonzero(near))
            columns = [left.field("node").take(a), right.field("node").take(b), left.field("n").take(a), right.field("n").take(b), left.field("open").take(a), right.field("open").take(b)]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", "n_i", "n_j", "open_i", "open_j"])


def traverse(nodes: DataFrame, reach: float) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(i, j, n_i, n_j): the leaf pairs that may hold vectors within ``reach``, and (pairs tested, pairs kept) of each level.

    The dual traversal starts with each root and itself; both sides of a pair that survives go down one level together, a leaf
    stays what it is. Only a root that is a leaf has no centre; it has no partner but itself. Each level is one join of the surviving pairs with the
    children of both sides, piece by piece."""
    below = written(_children(nodes), "children")
    pairs = nodes.where("parent = ''").select(F.col("node").alias("i"), F.col("node").alias("j"), F.col("n").alias("n_i"), F.col("n").alias("n_j"), F.col("open").alias("open_i"), F.col("open").alias("open_j"))
    leaves, figures = [], []
    sizes = below.groupBy("of").agg(F.sum(F.size("below")).cast("long").alias("c"))
    while True:
        leaves.append(pairs.where("not open_i and not open_j").select("i", "j", "n_i", "n_j"))
        go = pairs.where("open_i or open_j").select("i", "j")
        count = go.join(sizes.select(F.col("of").alias("i"), F.col("c").alias("c_i")), "i").join(sizes.select(F.col("of").alias("j"), F.col("c").alias("c_j")), "j")
        tested = count.agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("c_i") * (F.col("c_i") + 1) / 2).otherwise(F.col("c_i") * F.col("c_j"))).cast("long")).first()[0]
        if not tested:
            break
        side = lambda node, piece, name: below.select(F.col("of").alias(node), F.col("piece").alias(piece), F.col("below").alias(name))
        both = go.join(side("i", "_p", "mine"), "i").join(side("j", "_q", "theirs"), "j").where("i <> j or _p <= _q").select("i", "j", "mine", "theirs", F.expr("i = j and _p = _q").alias("same"))
        pairs = written(both.mapInArrow(lambda b: _surviving(b, reach), "i string, j string, n_i long, n_j long, open_i boolean, open_j boolean"), "pairs")
        figures.append((tested, pairs.count()))
    out = leaves[0]
    for more in leaves[1:]:
        out = out.union(more)
    return out, figures


def _dealt(rows: pa.Table, partners: pa.Table, reach: float) -> pa.Table:
    """The rows of one leaf for each partner leaf whose ball they may reach: (pair, part, other_part, side, class, w, vec)."""
    out = []
    if rows.num_rows and partners.num_rows:
        (_, x), = matrix(rows.column("vec"))
        unit, part = _unit(x), rows.column("_part").to_numpy()
        for other, centre, cover, parts, own, first in zip(*(partners.column(c).to_pylist() for c in ("other", "centre", "cover", "parts", "node", "first")), strict=True):
            near = np.arange(len(unit)) if other == own or centre is None else np.flatnonzero(_apart(unit, np.array(centre)[None])[:, 0] <= reach + cover + SLACK)
            if not len(near):
                continue
            pair = f"{own}|{other}" if first else f"{other}|{own}"
            for q in range(parts):
                mine = near
                p = part[mine]
                low, high = (p, np.full(len(p), q)) if first else (np.full(len(p), q), p)
                side = np.full(len(p), -1 if first else 1)
                if other == own:
                    low, high, side = np.minimum(p, q), np.maximum(p, q), np.where(p == q, 0, np.where(p < q, -1, 1))
                taken = rows.select(["class", "w", "vec"]).take(pa.array(mine))
                out.append(pa.table({"pair": pa.array([pair] * len(p), pa.string()), "low": pa.array(low.astype(np.int32)), "high": pa.array(high.astype(np.int32)), "side": pa.array(side.astype(np.int32)), "class": taken.column("class"), "w": taken.column("w"), "vec": taken.column("vec")}))
    if not out:
        none = {"pair": pa.array([], pa.string()), "low": pa.array([], pa.int32()), "high": pa.array([], pa.int32()), "side": pa.array([], pa.int32())}
        return pa.table(none | {c: rows.column(c).slice(0, 0) if rows.num_columns else pa.array([]) for c in ("class", "w", "vec")})
    return pa.concat_tables(out)


def _linked_sets(linked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of each connected set of a two-sided link matrix that has a link."""
    rows_left, columns_left = linked.any(axis=1), linked.any(axis=0)
    while rows_left.any():
        rows, columns = [], []
        frontier = np.array([rows_left.argmax()])
        rows_left[frontier] = False
        while len(frontier):
            rows.append(frontier)
            reached = np.flatnonzero(linked[frontier].any(axis=0) & columns_left)
            columns_left[reached] = False
            columns.append(reached)
            frontier = np.flatnonzero(linked[:, reached].any(axis=1) & rows_left) if len(reached) else np.empty(0, np.int64)
            rows_left[frontier] = False
        yield np.concatenate(rows), np.concatenate(columns)


def _weighed(linked: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of the weights that each row links with."""
    out = np.zeros(len(linked), np.int64)
    some = np.flatnonzero(linked.any(axis=1))
    out[some] = linked[some].astype(np.float64) @ weight
    return out


def _block_pair(group: pa.Table, threshold: float) -> pa.Table:
    """Links between the two sides of one block pair: link counts (b null), and edges (n 0) that join each linked set to its least id."""
    ids, side, weight = (group.column(c).to_numpy() for c in ("class", "side", "w"))
    (_, x), = matrix(group.column("vec"))
    unit = _unit(x)
    left, right = np.flatnonzero(side <= 0), np.flatnonzero(side == 1)
    within = not len(right) and bool((side == 0).all())
    right = left if within else right
    linked = np.zeros((len(left), len(right)), bool)
    to = unit[right].T
    for at in range(0, len(left), 512):
        linked[at : at + 512] = unit[left[at : at + 512]] @ to >= threshold
    if within:
        np.fill_diagonal(linked, False)
    out_a, out_b, out_n = [], [], []
    for mine, count in ((left, _weighed(linked, weight[right])), (right, np.zeros(0) if within else _weighed(linked.T, weight[left]))):
        has = np.flatnonzero(count)
        out_a.append(ids[mine[has]])
        out_b.append(np.full(len(has), -1))
        out_n.append(count[has])
    for rows, columns in _linked_sets(linked) if linked.any() else ():
        members = np.unique(np.concatenate((ids[left[rows]], ids[right[columns]])))
        out_a.append(members[1:])
        out_b.append(np.full(len(members) - 1, members[0]))
        out_n.append(np.zeros(len(members) - 1))
    n = np.concatenate(out_n).astype(np.int64)
    return pa.table({"a": pa.array(np.concatenate(out_a).astype(np.int64)), "b": pa.array(np.concatenate(out_b).astype(np.int64), mask=n > 0), "n": pa.array(n)})


def links(classes: DataFrame, threshold: float, node_rows: int = NODE_ROWS, block: int = 4096) -> DataFrame:
    """(a, b, n) over ``classes`` (class, vec, w): n other vectors link with class a (b null), or a and b are connected (n 0)."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    rows, nodes = build(classes, reach, node_rows)
    pairs, _ = traverse(nodes, reach)
    sizes = nodes.select("node", "centre", "cover", "n")
    tight = sizes.where(F.col("cover") * 2 <= reach - SLACK).select("node")
    apart = pairs.join(tight.withColumnRenamed("node", "i"), "i", "left_anti").union(pairs.join(tight.withColumnRenamed("node", "i"), "i", "left_semi").where("i <> j"))
    sided = apart.select(F.col("i").alias("node"), F.col("j").alias("other"), F.col("n_j").alias("_n"), F.lit(True).alias("first")).union(apart.where("i <> j").select("j", "i", "n_i", F.lit(False)))
    ball = nodes.select(F.col("node").alias("other"), "centre", "cover")
    partners = sided.join(ball, "other").select("node", "other", "centre", "cover", "first", F.ceil(F.col("_n") / block).cast("int").alias("parts"))
    own = sizes.select("node", F.ceil(F.col("n") / block).cast("int").alias("_parts"))
    mine = rows.join(own, "node").withColumn("_part", F.pmod(F.xxhash64("class"), "_parts").cast("int"))
    there = partners.join(own.withColumnRenamed("_parts", "_own"), "node").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_own") - 1)))
    kind = f"pair string, low int, high int, side int, class long, w long, vec {classes.schema['vec'].dataType.simpleString()}"
    dealt = mine.groupBy("node", "_part").cogroup(there.select("node", F.col("_part").alias("_of"), "other", "centre", "cover", "first", "parts").groupBy("node", "_of")).applyInArrow(lambda r, p: _dealt(r, p, reach), kind)
    found = dealt.groupBy("pair", "low", "high").applyInArrow(lambda t: _block_pair(t, threshold), "a long, b long, n long")
    close = rows.join(tight, "node")
    least = close.groupBy("node").agg(F.min("class").alias("_least"), F.sum("w").alias("_w"))
    all_linked = close.select("node", "class", "w").join(least, "node").where("_w > w")
    within = all_linked.select(F.col("class").alias("a"), F.lit(None).cast("long").alias("b"), (F.col("_w") - F.col("w")).alias("n")).union(all_linked.where("class <> _least").select("class", "_least", F.lit(0).cast("long")))
    return written(found.union(within), "links")


def near_duplicates(rows: DataFrame, threshold: float = 0.9, node_rows: int = NODE_ROWS, block: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vec_id: vec_id, n_links, component_id, kept.

    Two vectors link if their cosine (double precision) is ``threshold`` or more. Equal vectors (by two 64-bit hashes) are one class
    with a weight. The cover tree (``build``) has as many levels and nodes as the rows need; ``traverse`` prunes node pairs by
    centre distance and measured covering radii; rows of a surviving leaf pair are dealt out, in blocks of ``block`` rows, only
    if they reach the other leaf's ball, and block pairs are compared by matrix products. A leaf whose rows all link is not
    compared with itself. Results are counts and one edge per linked vector, never all pairs.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of another
    length: n_links 0, component_id their own id, kept true. Rows that repeat an id are one vector, the first by hash. Rows with
    a null id come out as one row with n_links 0, a null component and kept false. Other columns are not read. An empty table
    gives no rows."""
    ids = rows.select(F.col(id_col).cast("long").alias("vec_id")).distinct()
    once = valid_vectors(rows, id_col, vec_col).groupBy("vec_id").agg(F.min_by("vec", F.xxhash64("vec")).alias("vec"))
    key = F.concat_ws("", F.hex(F.xxhash64("vec")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "vec")))
    keyed = written(once.select("vec_id", "vec", key.alias("key")), "vectors")
    classes = written(keyed.groupBy("key").agg(F.min("vec_id").alias("class"), F.min_by("vec", "vec_id").alias("vec"), F.count("*").alias("w")), "classes")
    found = links(classes.select("class", "vec", "w"), threshold, node_rows, block)
    labels = components(found.where("n = 0").select("a", "b")).select(F.col("id").alias("class"), "component")
    counts = found.where("n > 0").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("_links"))
    result = classes.select("key", "class", "w").join(counts, "class", "left").join(labels, "class", "left")
    result = written(result.select("key", F.col("w").alias("n"), (F.coalesce("_links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "class").alias("component")), "results")
    of_vectors = unique_join(keyed.select("key", "vec_id"), result, "key").select(F.col("vec_id").alias("_id"), "n_links", "component")
    out = ids.join(of_vectors, F.col("vec_id") == F.col("_id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
