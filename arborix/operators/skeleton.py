"""Skeletons of voxel sets: clean voxel graphs, thinning, spurs, and branches between junctions."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import drop, written
from .blocks import BLOCK, SIDES, by_blocks, over_blocks, with_block
from .components import connected_components
from .labels import joined, least, links_within, one_block, pieces
from .ranks import running
from .voxels import BITS, KEYS, OFFSETS6, OFFSETS26

# The deletion templates of the 12-subiteration thinning of Palagyi and Kuba (1999). The 26 neighbours are named a to z
# in z, y, x order. A template holds if all of `off` are background, all of `on` foreground, one of `some` (if any) foreground,
# no pair of `not_both` both foreground, and of the pair `one_of` exactly one foreground.
TEMPLATES = [
    {"off": "abcjklrst", "on": "p", "some": "defmnuvwghioqxyz"},
    {"off": "abcdefghi", "on": "v", "some": "rstjklmnuwopqxyz"},
    {"off": "abcjklrstdefghi", "on": "y", "some": "mnuwoqxz"},
    {"off": "abcke", "on": "pv", "not_both": ["dj", "lf"]},
    {"off": "abke", "on": "cvp", "not_both": ["jd"], "one_of": "lf"},
    {"off": "bcke", "on": "avp", "not_both": ["lf"], "one_of": "jd"},
    {"off": "abke", "on": "nvp", "not_both": ["jd"]},
    {"off": "bcke", "on": "mvp", "not_both": ["lf"]},
    {"off": "bke", "on": "anvp", "one_of": "jd"},
    {"off": "bke", "on": "cmvp", "one_of": "lf"},
    {"off": "abcjklrstdegh", "on": "qy"},
    {"off": "abcjklrstefhi", "on": "oy"},
    {"off": "abcjkrsdefghi", "on": "wy"},
    {"off": "abcdefghiklst", "on": "uy"},
]
# The twelve directions as quarter turns (axis, times), in order, that bring each to the templates' own.
DIRECTIONS = ["", "yyxxx", "xz", "xxx", "yyy", "xxxzy", "x", "yy", "xxxz", "yyx", "y", "xx"]

_NAMES = "abcdefghijklmnopqrstuvwxyz"
_PLACES = [o for o in itertools.product((-1, 0, 1), repeat=3) if o != (0, 0, 0)]  # z, y, x


def _turn(place: tuple[int, int, int], axis: str) -> tuple[int, int, int]:
    """Where a quarter turn takes the value that stands at a place (z, y, x); x turns rows against columns, z turns planes against rows."""
    z, y, x = place
    return {"x": (z, -x, y), "y": (x, y, -z), "z": (y, -z, x)}[axis]


def direction_places(direction: int) -> dict[str, tuple[int, int, int]]:
    """For each template name the neighbour (z, y, x) that it means in a direction."""
    at = {p: p for p in _PLACES}  # place in the turned cube -> place in the original
    for axis in DIRECTIONS[direction]:
        at = {_turn(p, axis): o for p, o in at.items()}
    return {name: at[p] for name, p in zip(_NAMES, _PLACES)}


def deletable(code, direction: int):
    """Whether neighbour codes, an array of integers, match a template in a direction; a voxel with one neighbour stays."""
    import numpy as np

    places = direction_places(direction)
    mask = {n: 1 << BITS[(x, y, z)] for n, (z, y, x) in places.items()}
    bits = lambda names: sum(mask[n] for n in names)
    hit = np.zeros(len(code), bool)
    for t in TEMPLATES:
        fixed = bits(t["off"]) | bits(t["on"])
        one = (code & fixed) == bits(t["on"])
        if t.get("some"):
            one &= (code & bits(t["some"])) != 0
        for pair in t.get("not_both", ()):
            one &= (code & bits(pair)) != bits(pair)
        if t.get("one_of"):
            one &= np.bitwise_count(code & bits(t["one_of"])) == 1
        hit |= one
    return hit & (np.bitwise_count(code) != 1)


def _thin_block(rounds: int):
    """Rounds of twelve passes on one block; a pass sees one voxel far, so the halo must be 13 voxels a round."""

    def run(array, low, high):
        import numpy as np

        here = np.pad(array != 0, 1)
        offsets = [(bit, np.array(o)) for o, bit in BITS.items()]
        for _ in range(rounds):
            at = np.argwhere(here)
            if not len(at):
                break
            faces = sum(here[tuple((at + np.array(o)).T)].astype(np.int8) for o in OFFSETS6)
            border = at[faces < 6]
            for k in range(len(DIRECTIONS)):
                code = np.zeros(len(border), np.int64)
                for bit, o in offsets:
                    code |= here[tuple((border + o).T)].astype(np.int64) << bit
                gone = deletable(code, k)
                here[tuple(border[gone].T)] = False
                border = border[~gone]
        return here[tuple(slice(lo + 1, hi + 1) for lo, hi in zip(low, high))].astype(float)

    return run


def thin(voxels: DataFrame, max_rounds: int = 200, at_once: int = 2, sides=SIDES) -> DataFrame:
    """Parallel thinning: in each round twelve passes delete border voxels that match a template, until a round deletes none.

    Border voxels, those with under six face neighbours, are fixed for the round. Blocks with a halo run some rounds at once, so a
    shuffle serves that many; the result is written after each. Only blocks that changed, or near which something did, run again.
    """
    reach = 13 * at_once
    near = [F.explode(F.sequence(F.col(f"b{c}") - -(-reach // side), F.col(f"b{c}") + -(-reach // side))).alias(f"b{c}") for c, side in zip("xyz", sides)]
    now = written(voxels.select(*KEYS).distinct(), "thin")
    ends = now.agg(*(F.min(c) for c in "xyz"), *(F.max(c) for c in "xyz")).first()
    dims = tuple(v + 1 for v in ends[3:]) if ends[0] is not None and min(ends[:3]) >= 0 else None  # nothing beyond these has voxels
    sizes = written(with_block(now, sides).groupBy(*BLOCK).agg(F.count("*").alias("n")), "thinblocks")
    active = None
    for _ in range(0, max_rounds, at_once):
        after = by_blocks(now, _thin_block(at_once), (reach,) * 3, dims, None, sides, active).select(*KEYS)
        if active is not None:
            after = after.unionByName(with_block(now, sides).join(active, BLOCK, "left_anti").select(*KEYS))
        after = written(after, "thin")
        drop(now)
        now = after
        left = written(with_block(now, sides).groupBy(*BLOCK).agg(F.count("*").alias("n")), "thinblocks")
        changed = written(sizes.join(left.withColumnRenamed("n", "m"), BLOCK, "left").where("m IS NULL OR m <> n").select(*BLOCK), "changed")
        if changed.isEmpty():
            return now
        sizes, active = left, changed
        for k, c in enumerate("xyz"):
            active = active.select(*(near[k] if x == f"b{c}" else x for x in BLOCK))
        active = written(active.distinct(), "active")
    raise RuntimeError("thinning did not settle")


#: Offsets to the neighbours of a larger linear index, in its order.
FORWARD = [o for o in OFFSETS26 if o > (0, 0, 0)]


def _touch(p, q) -> bool:
    return p != q and all(abs(a - b) <= 1 for a, b in zip(p, q))


def _rules(offset) -> list[tuple[int, int]]:
    """For a pair of neighbours that are `offset` apart: bits of the first one's neighbours (one) with which the two make a triangle that costs them their edge,
    each with the bits of those (any) that are next to all three, where the triangle is not maximal."""
    out = []
    for third in OFFSETS26:
        if not _touch(third, offset):
            continue
        a, b, c = sorted([(0, 0, 0), offset, third])
        sides = [(sum((i - j) ** 2 for i, j in zip(p, q)), p[2] == q[2], {p, q}) for p, q in ((a, b), (a, c), (b, c))]
        most = max(s[0] for s in sides)
        if most > min(s[0] for s in sides):
            gone = [s[2] for s in sides if s[0] == most]
        else:
            gone = [s[2] for s in sides if s[1]][:1]
        if {(0, 0, 0), offset} in gone:
            near = [w for w in OFFSETS26 if _touch(w, offset) and _touch(w, third)]
            out.append((1 << BITS[third], sum(1 << BITS[w] for w in near)))
    return out


_RULES = [_rules(o) for o in FORWARD]


def graph_within(full):
    """Places of a mask's voxels in the order of their linear indices, and the clean graph's edges u - v among them, by number, u < v, in the order of u and v, with
    their squared lengths. Which edges a voxel has to larger ones follows from its 26 neighbours, so what the mask lacks beyond its sides matters one voxel far."""
    import numpy as np

    places = np.argwhere(full)
    wide = np.pad(full, 1)
    name = np.full(wide.shape, -1)
    name[tuple((places + 1).T)] = np.arange(len(places))
    code = np.zeros(len(places), np.int64)
    for o, bit in BITS.items():
        code |= wide[tuple((places + 1 + np.array(o)).T)].astype(np.int64) << bit
    kept = np.zeros((len(places), len(FORWARD)), bool)
    for k, o in enumerate(FORWARD):
        here = (code >> BITS[o]) & 1 == 1
        for one, any_ in _RULES[k]:
            here &= ((code & one) == 0) | ((code & any_) != 0)
        kept[:, k] = here
    u, k = np.nonzero(kept)
    offsets = np.array(FORWARD)
    v = name[tuple((places[u] + 1 + offsets[k]).T)]
    return places, u, v, (offsets[k] ** 2).sum(1)


def _inside(places, low, high):
    import numpy as np

    return np.logical_and(places >= low, places < high).all(1)


def _index(places, origin, dims):
    """Linear indices in the volume."""
    import numpy as np

    x, y, z = (places + np.array(origin)).astype(np.int64).T
    return (x * dims[1] + y) * dims[2] + z


def _whole(voxels: DataFrame) -> DataFrame:
    return voxels.select(*KEYS).where("image_id IS NOT NULL")


def voxel_graph(voxels: DataFrame, dims, sides=SIDES) -> DataFrame:
    """(image_id, u, v, length2): neighbour pairs without the redundant sides of triangles.

    Of each maximal clique of three the longest sides go, or of three equal sides the first whose ends have the same z. Nodes are
    linear indices. A block has the edges from its own voxels to larger ones, for which it needs one voxel around it.
    """

    def run(full, low, high, origin):
        import numpy as np

        places, u, v, length2 = graph_within(full)
        own = _inside(places, low, high)[u]
        at = _index(places, origin, dims)
        return [at[u[own]], at[v[own]], length2[own].astype(np.int32)]

    return over_blocks(_whole(voxels), run, (1, 1, 1), "u long, v long, length2 int", dims, None, sides)


def graph_degrees(edges: DataFrame) -> DataFrame:
    return edges.select("image_id", F.explode(F.array("u", "v")).alias("node")).groupBy("image_id", "node").agg(F.count("*").alias("degree"))


def voxel_degrees(voxels: DataFrame, dims, sides=SIDES) -> DataFrame:
    """graph_degrees() of voxel_graph(), block by block."""

    def run(full, low, high, origin):
        import numpy as np

        places, u, v, _ = graph_within(full)
        n = np.bincount(u, minlength=len(places)) + np.bincount(v, minlength=len(places))
        own = _inside(places, low, high) & (n > 0)
        return [_index(places, origin, dims)[own], n[own]]

    return over_blocks(_whole(voxels), run, (2, 2, 2), "node long, degree long", dims, None, sides)


def _chained(n: int, u, v, degree):
    """For n edges u - v, in order, the first edge of the chain that each is in; edges that meet at nodes of degree two are of one chain."""
    import numpy as np

    nodes, edges = np.concatenate([u, v]), np.tile(np.arange(n), 2)
    inner = degree[nodes] == 2
    nodes, edges = nodes[inner], edges[inner]
    order = np.argsort(nodes, kind="stable")
    nodes, edges = nodes[order], edges[order]
    two = np.flatnonzero(nodes[1:] == nodes[:-1])
    return least(n, edges[two], edges[two + 1])


#: What a block says of a chain, or of the piece of it that the block has (kind 0; tip: its part of the mask has an end), of a node at which a piece meets one of another block (1),
#: and of how many edges a stretch of the order has (2).
_PARTS = "kind int, piece long, part long, n1 long, n2 long, n3 long, least long, a long, b long, tip boolean, node long, at long, sx int, sy int, sz int, n long"


def _parts(dims, sides):
    """An edge is named by the index of its smaller end and the number of its offset. Edges are numbered within stretches of their order that lie in one block each: a line along z, a plane, or all of a block,
    as far as the block reaches from side to side of the volume."""
    by_plane = dims[1] > sides[1] or dims[2] > sides[2]
    by_line = dims[2] > sides[2]

    def run(full, low, high, origin):
        import numpy as np

        places, u, v, length2 = graph_within(full)
        degree = np.bincount(u, minlength=len(places)) + np.bincount(v, minlength=len(places))
        inside = _inside(places, low, high)
        at = _index(places, origin, dims)
        # parts of the mask within the block, by their least index
        own = np.flatnonzero(inside)
        _, p, q = links_within(full[tuple(slice(a, b) for a, b in zip(low, high))], OFFSETS26)
        part = np.zeros(len(places), np.int64)
        part[own] = at[own][least(len(own), p, q)]
        eu, ev, square = u[inside[u]], v[inside[u]], length2[inside[u]]
        n = len(eu)
        offset = places[ev] - places[eu]
        k = ((offset[:, 0] + 1) * 3 + offset[:, 1] + 1) * 3 + offset[:, 2] + 1  # grows with the index of v
        edge = at[eu] * 27 + k
        piece = _chained(n, eu, ev, degree)
        place = places[eu] + np.array(origin)
        s = np.stack([place[:, i] if fine else place[:, i] // sides[i] for i, fine in enumerate((by_plane, by_line, False))])
        first = np.flatnonzero(np.r_[True, (s[:, 1:] != s[:, :-1]).any(0)]) if n else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, n])
        number = np.arange(n) - np.repeat(first, count)
        # by part of a chain
        heads, group = np.unique(piece, return_inverse=True)
        m = len(heads)
        total = [np.bincount(group[square == i], minlength=m) for i in (1, 2, 3)]
        big = np.iinfo(np.int64).max
        a, b, tip, low_u = np.full(m, big), np.full(m, -1), np.zeros(m, bool), np.full(m, big)
        np.minimum.at(low_u, group, at[eu])
        for node in (eu, ev):
            outer = degree[node] != 2
            np.minimum.at(a, group[outer], at[node[outer]])
            np.maximum.at(b, group[outer], at[node[outer]])
            tip[group[degree[node] == 1]] = True
        tip = np.isin(part[eu[heads]], part[eu[heads]][tip])
        # nodes of degree two whose other edge is another block's
        nodes, groups = np.concatenate([eu, ev]), np.tile(group, 2)
        once = (degree[nodes] == 2) & (np.bincount(nodes, minlength=len(places))[nodes] == 1)
        z = lambda size, value=0, kind=np.int64: np.full(size, value, kind)
        j, c = int(once.sum()), len(first)
        columns = [
            np.r_[z(m), z(j, 1), z(c, 2)].astype(np.int32), np.r_[edge[heads], edge[heads][groups[once]], z(c)], np.r_[part[eu[heads]], z(j + c)], *(np.r_[t, z(j + c)] for t in total), np.r_[low_u, z(j + c)],
            np.r_[a, z(j + c)], np.r_[b, z(j + c)], np.r_[tip, z(j + c, False, bool)], np.r_[z(m), at[nodes[once]], z(c)], np.r_[number[heads], z(j + c)],
            *(np.r_[t[heads], z(j), t[first]].astype(np.int32) for t in s), np.r_[z(m + j), count],
        ]
        return columns

    return run


def branches(voxels: DataFrame, dims, sides=SIDES) -> DataFrame:
    """(image_id, chain, u, v, n_edges, length): branches between junctions and ends of a skeleton, an order-free form of tracking.

    A branch is a chain of edges that meet at nodes of degree two. The smallest number of an edge in its chain names it, edges being numbered in the order of their images and nodes.
    Components without an end are left out. A closed chain has its smallest node at both ends. Chains are found block by block; only those that go on in another block are joined by rounds.
    """
    voxels = _whole(voxels)
    found = written(over_blocks(voxels, _parts(dims, sides), (3, 3, 3), _PARTS, dims, None, sides), "chainparts")
    stretch = ["image_id", "sx", "sy", "sz"]
    pieces_ = found.where("kind = 0").select("image_id", "piece", "part", "n1", "n2", "n3", "least", F.when(F.col("b") >= 0, F.col("a")).alias("a"), F.when(F.col("b") >= 0, F.col("b")).alias("b"), "tip", "at", "sx", "sy", "sz")
    if one_block(dims, sides):
        whole = pieces_.where("tip")
    else:
        met = written(joined(written(pieces(voxels, dims, OFFSETS26, sides=sides), "pieces"), OFFSETS26, sides), "met").withColumnRenamed("piece", "part")
        named = written(pieces_.join(met, ["image_id", "part"], "left").withColumn("component", F.coalesce("component", "part")), "named")
        ended = named.where("tip").select("image_id", "component").distinct()
        links = found.where("kind = 1").groupBy("image_id", "node").agg(F.min("piece").alias("u"), F.max("piece").alias("v"))
        chain = connected_components(links, ["image_id"]).select("image_id", F.col("node").alias("piece"), F.col("component").alias("chain"))
        one = named.join(ended, ["image_id", "component"], "left_semi").join(chain, ["image_id", "piece"], "left").withColumn("chain", F.coalesce("chain", "piece"))
        first = F.min_by(F.struct("at", "sx", "sy", "sz"), "piece").alias("first")
        whole = one.groupBy("image_id", "chain").agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "n3")), F.min("least").alias("least"), F.min("a").alias("a"), F.max("b").alias("b"), first)
        whole = whole.select("image_id", "chain", "n1", "n2", "n3", "least", "a", "b", "first.*")
    before = written(running(found.where("kind = 2").select(*stretch, "n"), stretch, "n", "_before"), "before")
    length = F.col("n1") + F.col("n2") * F.sqrt(F.lit(2.0)) + F.col("n3") * F.sqrt(F.lit(3.0))
    out = whole.join(before.drop("n"), stretch)
    return out.select("image_id", (F.col("_before") + F.col("at")).alias("chain"), F.coalesce("a", "least").alias("u"), F.coalesce("b", "least").alias("v"), (F.col("n1") + F.col("n2") + F.col("n3")).alias("n_edges"), length.alias("length"))


def prune_spurs(voxels: DataFrame, dims, cutoff: int = 9, parity: bool = False, sides=SIDES) -> DataFrame:
    """Voxels without spurs: chains of `cutoff` edges or fewer from an end to a junction lose their voxels, but not the junction's.

    parity keeps the end voxel and takes the junction's away instead. A block sees chains of one edge more from each of its voxels, which is all that it needs to know.
    """

    def run(full, low, high):
        import numpy as np

        places, u, v, _ = graph_within(full)
        degree = np.bincount(u, minlength=len(places)) + np.bincount(v, minlength=len(places))
        chain = _chained(len(u), u, v, degree)
        nodes, group = np.concatenate([u, v]), np.tile(chain, 2)
        size = np.bincount(chain, minlength=len(u))
        ends, forks = (np.zeros(len(u), np.int64) for _ in range(2))
        pairs = np.unique(np.stack([group, nodes]), axis=1)
        np.add.at(ends, pairs[0][degree[pairs[1]] == 1], 1)
        np.add.at(forks, pairs[0][degree[pairs[1]] > 2], 1)
        spur = (ends == 1) & (forks == 1) & (size <= cutoff)
        lost = spur[group] & (degree[nodes] != 1 if parity else degree[nodes] <= 2)
        left = full.copy()
        left[tuple(places[nodes[lost]].T)] = False
        return left[tuple(slice(a, b) for a, b in zip(low, high))]

    kept = by_blocks(_whole(voxels), run, (cutoff + 4,) * 3, dims, None, sides).select(*KEYS)
    return kept if set(voxels.columns) == set(KEYS) else voxels.join(kept, KEYS, "left_semi")
