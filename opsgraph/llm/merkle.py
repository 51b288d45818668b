"""A Merkle manifest of a table: a digest for each row, a tree for each group of rows, a tree over the groups' roots.

A fragment of a forest is a set of unresolved nodes, keyed by tree, level and index, with the number of
leaves of each tree known. Two fragments combine by union, and wherever all siblings of a run are there
(the last run of a level is known to be shorter) they are replaced by their parent, over and over; so
fragments are a commutative monoid, however the leaves are dealt out. Here each partition holds
consecutive leaves and leaves few nodes a level unresolved, and neighbouring partitions' fragments are
merged, FAN at a time, round by round, until each tree has its root. What was made on the way is kept as
rows, for with it each partition can prove its leaves without the others. No partition holds more than
about ROWS leaves, and nothing is brought to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgraph.llm.common import forget, saved, ship

ARITY = 2
#: Leaves in a partition; fragments merged at once.
ROWS, FAN = 50_000, 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

Nodes = dict[int, dict[int, str]]


def hashed(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(columns: dict[str, Column]) -> Column:
    """sha256 of a row: each value as `-` if null, else as its UTF-8 length, a colon and itself."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns.values()]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def level_sizes(n: int, arity: int = ARITY) -> list[int]:
    """Nodes of each level of a tree of n leaves."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // arity))
    return sizes


def resolve(nodes: Nodes, n: int, arity: int = ARITY) -> tuple[Nodes, Nodes]:
    """What of a fragment of one tree stays unresolved once all runs that are there have become parents, and the parents made."""
    sizes, left, made = level_sizes(n, arity), {}, {}
    for level, size in enumerate(sizes):
        here = nodes.get(level, {}) | made.get(level, {})
        runs: dict[int, list[int]] = {}
        for i in sorted(here):
            runs.setdefault(i // arity, []).append(i)
        for run, ids in runs.items():
            if size > 1 and len(ids) == min(arity, size - run * arity):
                made.setdefault(level + 1, {})[run] = hashed("".join(here[i] for i in ids))
            else:
                left.setdefault(level, {}).update((i, here[i]) for i in ids)
    return left, made


def _outside(start: int, count: int, n: int, own: Nodes, arity: int) -> Iterator[tuple[int, int]]:
    """The nodes beside the paths of leaves start .. start + count, and the root, as far as they are not their own."""
    sizes = level_sizes(n, arity)
    first, last = start, start + count - 1
    for level, size in enumerate(sizes):
        for run in {first // arity, last // arity}:
            yield from ((level, i) for i in range(run * arity, min(size, (run + 1) * arity)) if i not in own.get(level, ()))
        first, last = first // arity, last // arity


_SLICE = "part long, tree string, start long, n long, rows long"
_NODE = "kind string, part long, tree string, n long, level int, at long, digest string"
_PATH = "path array<struct<before:string, after:string>>"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")], dtype=object)


def _ranged(leaves: DataFrame, n: int) -> DataFrame:
    """leaves in partitions of consecutive ones of about ROWS, with part and pos, the place within; written."""
    order = [F.col(c).asc_nulls_first() for c in ("tree", "key", "leaf", "claim", "_deal")]
    dealt = leaves.withColumn("_deal", F.monotonically_increasing_id())  # equal rows are dealt out too
    sorted_ = dealt.repartitionByRange(max(1, -(-n // ROWS)), *order).sortWithinPartitions(*order).drop("_deal")
    at = F.monotonically_increasing_id()
    return saved(sorted_.select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("pos")), "leaves")


def _climbed(ranged: DataFrame, slices: DataFrame, arity: int) -> DataFrame:
    """Each partition's own fragment (kind node), and the nodes outside that proofs of its leaves need (want)."""

    def climb(own: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
        digests = dict(tuple(own.sort_values("pos").groupby("tree", sort=False)["leaf"]))
        out: list[tuple] = []
        for part, tree, start, n, rows in cuts[[f.split()[0] for f in _SLICE.split(", ")]].itertuples(index=False):
            nodes: Nodes = {0: dict(enumerate(digests[tree], start))}
            left, made = resolve(nodes, n, arity)
            out += [("node", part, tree, n, level, i, d) for level, at in left.items() for i, d in at.items()]
            out += [("want", part, tree, n, level, i, None) for level, i in _outside(start, rows, n, nodes | made, arity)]
        return _frame(out, _NODE)

    return ranged.select("part", "pos", "tree", "leaf").groupBy("part").cogroup(slices.groupBy("part")).applyInPandas(climb, _NODE)


def _tree_reduced(nodes: DataFrame, parts: int, arity: int) -> DataFrame:
    """All nodes that ever stood unresolved, from fragments merged by neighbours in rounds; each tree's root is among them."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for tree, own in frame.groupby("tree", sort=False):
            n, part, fragment = int(own["n"].iloc[0]), int(own["part"].iloc[0]), {}
            for level, at, digest in own[["level", "at", "digest"]].itertuples(index=False):
                fragment.setdefault(int(level), {})[int(at)] = digest
            left, made = resolve(fragment, n, arity)
            new = made.keys() | left.keys()
            out += [("node" if i in left.get(level, ()) else "made", part, tree, n, level, i, d) for level in new for i, d in (fragment.get(level, {}) | made.get(level, {})).items() if i in left.get(level, ()) or i in made.get(level, ())]
        return _frame(out, _NODE)

    spine, rest = nodes, nodes
    while parts > 1:
        # A tree's root has nothing to merge with; trees within one partition end here.
        rest = rest.where((F.col("kind") == "node") & (F.pow(F.lit(float(arity)), F.col("level")) < F.col("n")))
        merged = rest.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInPandas(merge, _NODE)
        rest = saved(merged, "fragments")
        spine, parts = spine.unionByName(rest), -(-parts // FAN)
    return spine.select("tree", "n", "level", "at", "digest").distinct()


def _manifest(leaves: DataFrame, arity: int, tree_of_trees: bool) -> DataFrame:
    """leaves (tree, key, leaf, claim) with the path from each to its tree's root and that root, or over the tree of trees, with what the proof comes to."""
    n = leaves.count()
    ranged = _ranged(leaves, n)
    counted = ranged.groupBy("part", "tree").agg(F.count("*").alias("rows"), F.min("pos").alias("pos"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    slices = saved(counted.select("part", "tree", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).cast("long").alias("start"), F.sum("rows").over(Window.partitionBy("tree")).cast("long").alias("n"), "rows"), "slices")
    parts = (slices.agg(F.max("part")).first()[0] or 0) + 1
    climbed = saved(_climbed(ranged, slices, arity), "climbed")
    spine = _tree_reduced(climbed.where("kind = 'node'"), parts, arity)
    roots = spine.join(spine.groupBy("tree").agg(F.max("level").alias("level")), ["tree", "level"]).select("tree", F.col("digest").alias("root"))
    wanted = climbed.where("kind = 'want'").select("part", "tree", "level", "at").join(spine.drop("n"), ["tree", "level", "at"])
    context = slices.select("part", "tree", "start", "n", F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("digest"))
    nodes = wanted.select("part", "tree", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("n"), "level", "at", "digest")
    key = leaves.schema["key"].dataType.simpleString()
    if not tree_of_trees:
        upper = context.select("part", "tree").withColumns({"path": F.array().cast("array<struct<before:string, after:string>>"), "root": F.lit(None).cast("string")})
        schema = f"tree string, key {key}, leaf string, root string, {_PATH}"
    else:
        subroots = roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("claim"))
        upper = _manifest(subroots, arity, False).select(F.col("key").alias("tree"), "path", "root").join(slices.select("part", "tree"), "tree").select("part", "tree", "path", "root")
        schema = f"tree string, key {key}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    blank = {"path": F.lit(None).cast("array<struct<before:string, after:string>>"), "root": F.lit(None).cast("string")}
    context = context.withColumns(blank).unionByName(nodes.withColumns(blank)).unionByName(upper.select("part", "tree", *(F.lit(None).alias(c) for c in ("start", "n", "level", "at", "digest")), "path", "root"))

    def prove(own: pa.Table, beside: pa.Table) -> pa.Table:
        known: dict[str, dict] = {}
        for x in beside.to_pylist():
            tree = known.setdefault(x["tree"], {"nodes": {}})
            if x["n"] is not None:
                tree |= {"start": x["start"], "n": x["n"]}
            elif x["level"] is not None:
                tree["nodes"].setdefault(x["level"], {})[x["at"]] = x["digest"]
            else:
                tree |= {"path": [(p["before"], p["after"]) for p in x["path"]], "root": x["root"]}
        rows = sorted(own.select(["pos", "tree", "key", "leaf", "claim"]).to_pylist(), key=lambda r: r["pos"])
        out, i = [], 0
        while i < len(rows):
            tree, first = rows[i]["tree"], i
            while i < len(rows) and rows[i]["tree"] == tree:
                i += 1
            x = known[tree]
            steps = _steps(dict(enumerate((r["leaf"] for r in rows[first:i]), x["start"])), x["nodes"], x["n"], arity)
            top = steps[-1]["root"]
            for at, r in enumerate(rows[first:i], x["start"]):
                path = []
                for level in steps[:-1]:
                    path.append(level[at])
                    at //= arity
                if not tree_of_trees:
                    out.append((tree, r["key"], r["leaf"], top, [{"before": a, "after": b} for a, b in path]))
                    continue
                path += x["path"]
                folded = r["claim"] or r["leaf"]
                for a, b in path:
                    folded = hashed(a + folded + b)
                out.append((tree, r["key"], r["leaf"], top, x["root"], hashed("".join(a + b for a, b in path)), folded, folded == x["root"]))
        kinds = own.schema.field("key").type
        names = [f.split()[0] for f in schema.split(", ") if not f.startswith("after")]
        types = [pa.string(), kinds, pa.string(), pa.string(), *([pa.string()] * 3 + [pa.bool_()] if tree_of_trees else [pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))])]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)], names=names)

    return saved(ranged.groupBy("part").cogroup(context.groupBy("part")).applyInArrow(prove, schema), "proofs")


def _steps(leaves: dict[int, str], outside: Nodes, n: int, arity: int) -> list[dict]:
    """Level by level, of each node on the leaves' paths, what stands before and after it in its run; last, the root."""
    _, made = resolve({0: leaves}, n, arity)
    on, out = sorted(leaves), []
    for level, size in enumerate(level_sizes(n, arity)):
        here = (leaves if level == 0 else {}) | made.get(level, {}) | outside.get(level, {})
        if size == 1:
            return [*out, {"root": here[0]}]
        beside = {}
        for i in on:
            run = range(i // arity * arity, min(size, (i // arity + 1) * arity))
            beside[i] = "".join(here[j] for j in run if j < i), "".join(here[j] for j in run if j > i)
        out.append(beside)
        on = sorted({i // arity for i in on})
    return out


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "lang", key: str = "doc_id", claim: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """Of each row: key, group's name, leaf, subroot (of its group's tree), root (of all), proof_sha256, folded_root and verified.

    Leaves of a group ascend by key (null first), rows of one key by leaf digest, so equal rows follow
    each other and have proofs of their own; groups ascend by name, null first. `arity` consecutive nodes
    become one, fewer at the end of a level, until one is left; a lone leaf is its subroot, a lone
    subroot the root. The proof of a row is its siblings' digests, level by level to the root, left to
    right; folded_root is what these and the row come to. claim replaces columns as the row is presented
    for verification; a null, absent or equal value leaves the leaf as it is. An empty table has no
    rows. Other columns are neither read nor returned.
    """
    ship(docs.sparkSession)
    own = {c: F.col(f"`{c}`") for c in columns}
    presented = leaf(own | (claim or {}))
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-"))  # "-" comes before "="
    told = docs.select(tree.alias("tree"), F.col(f"`{key}`").alias("key"), leaf(own).alias("leaf"), (presented if claim else F.lit(None).cast("string")).alias("claim"))
    leaves = saved(told.withColumn("claim", F.when(F.col("claim") != F.col("leaf"), F.col("claim"))), "digests")
    found = _manifest(leaves, arity, True)
    forget(leaves)
    name = F.when(F.col("tree") != "-", F.substring("tree", 2, 1 << 30))
    return found.select(F.col("key").alias(key), name.alias(group), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
