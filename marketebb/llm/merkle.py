"""Merkle manifest of a dataset: 16-ary hash trees, one for each source and one over them, stored in van Emde Boas layout.

The digest H is the lowercase hex SHA-256 of its inputs, one after the other; digests enter as hex text. A leaf is H of the
fields of a row. A tree is cut into aligned blocks, subtrees of at most ``HEIGHT`` levels above their leaves. A block keeps its
digests in one binary value in van Emde Boas order: the upper half of its levels first, then the lower subtrees from left to right,
each laid out likewise. ``address`` computes the place of a node from its level and number, by halving the height; construction
and the retrieval of siblings both go through it. The roots of blocks are the leaves of the next tier of blocks, until a tree has
one. So a task holds one block, of 16 ** HEIGHT leaves, whatever the size of a source; a source is spread over its blocks.

The paths of siblings come from the top: a block hands each of its leaves, which is the root of a block below, its siblings
within the block and those above.

Order: sources and doc_ids ascend, nulls first (texts bytewise). Rows of one source and doc_id are ordered by their leaf; equal rows
have equal leaves, so the tree does not depend on their order. Nulls in hashed columns are ``-``; a source of null is one like
others. Texts are hashed whole in the JVM, where they are read, and never shuffled. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketebb.llm.ranks import crc32_sql, ranked, same, with_runs
from marketebb.llm.shared import stage

FAN, HEIGHT, TAMPERED_EACH = 16, 2, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


# Layout of a block


def _over(n: np.ndarray | int, levels: int) -> np.ndarray | int:
    """Nodes of the level so far above n leaves."""
    return (n + (1 << 4 * levels) - 1) >> 4 * levels


def size(n: np.ndarray | int, height: int) -> np.ndarray | int:
    """Nodes of a subtree over n leaves."""
    return sum(_over(n, k) for k in range(height + 1))


def address(level: int, index: np.ndarray, height: int, n: np.ndarray | int) -> np.ndarray:
    """Places of the nodes ``index`` of a level (0: leaves) in a block of this height over n leaves."""
    if height == 0:
        return np.zeros_like(index)
    top = (height + 1) // 2
    low = height - top
    if level > low:
        return address(level - low - 1, index, top - 1, _over(n, low + 1))
    full, steps = FAN**low, 4 * (low - level)
    subtree = index >> steps
    own = np.minimum(n - subtree * full, full)
    return size(_over(n, low + 1), top - 1) + subtree * size(full, low) + address(level, index - (subtree << steps), low, own)


def construct(leaves: np.ndarray, height: int) -> np.ndarray:
    """Digests (rows of 32 bytes) of a block in its layout, from those of its leaves."""
    n = len(leaves)
    out = np.zeros((size(n, height), 32), np.uint8)
    out[address(0, np.arange(n), height, n)] = leaves
    for level in range(1, height + 1):
        below = hexes(out, level - 1, height, n)
        made = b"".join(hashlib.sha256("".join(below[i : i + FAN]).encode()).digest() for i in range(0, len(below), FAN))
        out[address(level, np.arange(_over(n, level)), height, n)] = np.frombuffer(made, np.uint8).reshape(-1, 32)
    return out


def hexes(nodes: np.ndarray, level: int, height: int, n: int) -> list[str]:
    """The digests of one level, fetched from their addresses."""
    row = nodes[address(level, np.arange(_over(n, level)), height, n)].tobytes().hex()
    return [row[i : i + 64] for i in range(0, len(row), 64)]


def levels_of(nodes: bytes, height: int, n: int) -> list[list[str]]:
    """Digests of the levels below the root of a block."""
    block = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
    return [hexes(block, level, height, n) for level in range(height)]


def path(levels: list[list[str]], leaf: int) -> list[tuple[int, list[str]]]:
    """For each level of a block above a leaf: the place in its run, and the run."""
    out = []
    for row in levels:
        begin = leaf & -FAN
        out.append((leaf - begin, row[begin : begin + FAN]))
        leaf >>= 4
    return out


# Blocks of all trees


def tree_height(total: Column) -> Column:
    """Levels above the leaves of a tree."""
    return reduce(lambda a, k: a + (total > F.lit(FAN**k)).cast("int"), range(15), F.lit(0))


PATH = "array<struct<pos:int,run:binary>>"


def blocks(rows: DataFrame, group: Sequence[str], carried: Sequence[str], height: int = HEIGHT) -> DataFrame:
    """One row for each block of (group, idx, total, digest): block, n, height, total (blocks of the tree), nodes, carried as lists."""
    rows = rows.withColumn("height", F.least(F.lit(height), tree_height(F.col("total"))))
    rows = rows.withColumn("block", F.expr("shiftright(idx, 4 * height)"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    lists = [f"{c} array<{kinds[c]}>" for c in carried]
    schema = ", ".join([*[f"{g} {kinds[g]}" for g in group], "block long", "height int", "n int", "total long", "nodes binary", *lists])

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx").combine_chunks()
        h, n = table["height"][0].as_py(), len(table)
        leaves = np.frombuffer(b"".join(table["digest"].to_pylist()), np.uint8).reshape(n, 32)
        columns = {g: table[g].slice(0, 1) for g in group}
        columns |= {
            "block": table["block"].slice(0, 1), "height": pa.array([h], pa.int32()), "n": pa.array([n], pa.int32()),
            "total": pa.array([(table["total"][0].as_py() + FAN**h - 1) // FAN**h], pa.int64()), "nodes": pa.array([construct(leaves, h).tobytes()], pa.binary()),
        }
        for c in carried:
            values = table[c].combine_chunks()
            values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
            columns[c] = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values)
        return pa.table(columns)

    keep = [*group, "block", "height", "idx", "total", "digest", *carried]
    return rows.select(*keep).groupBy(*group, "block").applyInArrow(lambda t: make(t), schema)


def tree(rows: DataFrame, group: Sequence[str], carried: Sequence[str], label: str, height: int = HEIGHT) -> list[DataFrame]:
    """The tiers of blocks of all trees, each a written table; tier 0 holds the carried columns."""
    tiers = [stage(blocks(rows, group, carried, height), label)]
    while (tiers[-1].agg(F.max("total")).first()[0] or 0) > 1:
        roots = tiers[-1].where("total > 1").select(*group, F.col("block").alias("idx"), "total", root_of("nodes").alias("digest"))
        tiers.append(stage(blocks(roots, group, [], height), label))
    return tiers


def root_of(nodes: str) -> Column:
    """The root lies first in the layout."""
    return F.substring(nodes, 1, 32)


def roots(tiers: Sequence[DataFrame], group: Sequence[str]) -> DataFrame:
    """(group, digest): the roots of all trees."""
    return reduce(DataFrame.unionByName, [t.where("total = 1").select(*group, root_of("nodes").alias("digest")) for t in tiers])


def _packed(levels: list[tuple[int, list[str]]]) -> list[dict]:
    return [{"pos": p, "run": bytes.fromhex("".join(run))} for p, run in levels]


def handed_down(tier: DataFrame, group: Sequence[str], extra: Sequence[str], ids: str | None = None) -> DataFrame:
    """From blocks with ``upper``: group, block (the leaf's number), upper, extra columns and the carried id of every leaf."""
    kinds = {f.name: f.dataType for f in tier.schema.fields}
    keep = [*group, *extra]
    schema = ", ".join([*[f"{c} {kinds[c].simpleString()}" for c in keep], "block long", f"upper {PATH}", *([f"{ids} {kinds[ids].elementType.simpleString()}"] if ids else [])])
    path_type = pa.list_(pa.struct([("pos", pa.int32()), ("run", pa.binary())]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1)
                n, h, first = row["n"][0].as_py(), row["height"][0].as_py(), row["block"][0].as_py()
                levels, above = levels_of(row["nodes"][0].as_py(), h, n), row["upper"][0].as_py()
                at = pa.array(np.zeros(n, np.int64))
                columns = [row[c].take(at) for c in keep]
                columns += [pa.array((first << 4 * h) + np.arange(n)), pa.array([_packed(path(levels, i)) + above for i in range(n)], path_type)]
                yield pa.RecordBatch.from_arrays(columns + ([row[ids].flatten()] if ids else []), [*keep, "block", "upper", *([ids] if ids else [])])

    return tier.select(*keep, "block", "height", "n", "nodes", "upper", *([ids] if ids else [])).mapInArrow(emit, schema)


def with_paths(tiers: Sequence[DataFrame], group: Sequence[str], above: DataFrame, extra: Sequence[str]) -> DataFrame:
    """Tier 0 with ``upper``, the siblings above each block, and the extra columns of ``above`` (group, upper, extra)."""
    names = {g: f"_g_{g}" for g in group}

    def met(tier: DataFrame, paths: DataFrame, *keys: str) -> DataFrame:
        paths = paths.select(*[F.col(k).alias(names.get(k, f"_k_{k}")) for k in keys], "upper", *extra)
        on = reduce(lambda a, k: a & same(F.col(k), F.col(names.get(k, f"_k_{k}"))), keys, F.lit(True))
        return tier.join(paths, on).drop(*[names.get(k, f"_k_{k}") for k in keys])

    paths = None
    for tier in reversed(tiers):
        ends = met(tier.where("total = 1").withColumn("_one", F.lit(0)), above.withColumn("_one", F.lit(0)), "_one", *group).drop("_one")
        now = ends if paths is None else ends.unionByName(met(tier.where("total > 1"), paths, *group, "block"))
        paths = None if tier is tiers[0] else handed_down(now, group, extra)
    return now


# The manifest of documents


def encoded(columns: Sequence[str]) -> Column:
    """The hashed fields in one text: ``-`` for null, else bytes, colon, value."""

    def field(c: Column) -> Column:
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))

    return F.concat(*[field((c if isinstance(c, Column) else F.col(c)).cast("string")) for c in columns])


def tampered(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % TAMPERED_EACH == 0


def leaves(docs: DataFrame) -> DataFrame:
    """source, doc_id, digest and, where the text is tampered with, the digest of the changed row (``changed``)."""
    changed = F.sha2(encoded([*FIELDS[:-1], F.translate("text", UPPER, LOWER)]), 256)
    return docs.select(
        "source", "doc_id", F.unhex(F.sha2(encoded(FIELDS), 256)).alias("digest"),
        F.when(tampered(F.col("doc_id")), F.unhex(changed)).alias("changed"),
    )


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    placed, runs = ranked(rows, group, order, label)
    return with_runs(placed, runs, group).withColumnRenamed("_total", "total").drop("_part", "_pos", "_first", "_n", "_start")


def verify(tier: DataFrame) -> DataFrame:
    """Every leaf of blocks with paths: its proof, and the root recomputed from the changed or untouched leaf."""
    id_type = tier.schema["doc_id"].dataType.elementType.simpleString()
    schema = f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1)
                n, h = row["n"][0].as_py(), row["height"][0].as_py()
                levels = [*levels_of(row["nodes"][0].as_py(), h, n)]
                own = levels[0] if h else [row["nodes"][0].as_py().hex()]
                above = []
                for step in row["upper"][0].as_py():
                    run = step["run"].hex()
                    above.append((step["pos"], [run[i : i + 64] for i in range(0, len(run), 64)]))
                subroot, root = row["subroot"][0].as_py().hex(), row["root"][0].as_py().hex()
                out = []
                for i, new in enumerate(row["changed"][0].as_py()):
                    steps = path(levels, i) + above
                    value = own[i] if new is None else new.hex()
                    siblings = []
                    for pos, run in steps:
                        before, after = "".join(run[:pos]), "".join(run[pos + 1 :])
                        siblings += (before, after)
                        value = sha(before, value, after)
                    out.append((own[i], subroot, root, sha(*siblings), value, value == root))
                yield pa.RecordBatch.from_arrays([row["doc_id"].flatten(), *map(pa.array, zip(*out, strict=True))], ["doc_id", *names])

    return tier.select("doc_id", "changed", "height", "n", "nodes", "upper", "subroot", "root").mapInArrow(emit, schema)


def manifest(docs: DataFrame, height: int = HEIGHT) -> tuple[list[DataFrame], list[DataFrame]]:
    """The stored manifest: tiers of the trees of sources, and tiers of the tree over the sources."""
    rows = numbered(leaves(docs), ["source"], ["doc_id", "digest"], "leaves")
    trees = tree(rows, ["source"], ["doc_id", "changed"], "blocks", height)
    top = numbered(roots(trees, ["source"]), [], ["source"], "subroots").withColumn("subroot", F.col("digest"))
    return trees, tree(top.withColumn("ids", F.struct("source", "subroot")).drop("source", "subroot"), [], ["ids"], "root-blocks", height)


def merkle(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document."""
    trees, top = manifest(docs, height)
    root = roots(top, []).withColumnRenamed("digest", "root")
    start = root.select("root", F.lit(None).cast(PATH).alias("none")).select("root", F.coalesce("none", F.array().cast(PATH)).alias("upper"))
    ends = handed_down(with_paths(top, [], start, ["root"]), [], ["root"], "ids").select("ids.source", "ids.subroot", "upper", "root")
    ends = stage(ends, "subroot-paths")
    return verify(with_paths(trees, ["source"], ends, ["subroot", "root"]))


def _sql(levels: int = 7, above: int = 4) -> str:
    """Comparison SQL for sources of place most 16 ** levels rows and 16 ** above sources."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
    change = f"translate(text, '{UPPER}', '{LOWER}')"
    row = " || ".join(part(c) for c in FIELDS)
    new = " || ".join([*[part(c) for c in FIELDS[:-1]], f"CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode({change})) || ':' || {change} END"])
    ctes = [
        f"d AS (SELECT doc_id, source, sha256({row}) AS leaf, {crc32_sql('CAST(doc_id AS VARCHAR)')} % {TAMPERED_EACH} = 0 AS t, sha256({new}) AS changed FROM documents)",
        "p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
        "a0 AS (SELECT source AS g, i AS j, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM p)",
    ]

    def climb(name: str, n: int) -> None:
        for k in range(n):
            ctes.append(f"{name}r{k} AS (SELECT g, j // 16 AS j, any_value(n) AS n, list(h ORDER BY j) AS run FROM {name}{k} GROUP BY g, j // 16)")
            ctes.append(f"{name}{k + 1} AS (SELECT g, j, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h, (n + 15) // 16 AS n FROM {name}r{k})")

    def fold(name: str, base: str, n: int, first: int) -> None:
        for k in range(n):
            step = (
                f"{base}.*, CASE WHEN r.n > 1 THEN sibs || array_to_string(list_filter(r.run, lambda x, q: q <> place % 16 + 1), '') ELSE sibs END AS sibs_, "
                "CASE WHEN r.n > 1 THEN sha256(array_to_string(list_transform(r.run, lambda x, q: CASE WHEN q = place % 16 + 1 THEN v ELSE x END), '')) ELSE v END AS v_, place // 16 AS place_"
            )
            ctes.append(f"f{first + k + 1} AS (SELECT * EXCLUDE (sibs, v, place, sibs_, v_, place_), sibs_ AS sibs, v_ AS v, place_ AS place FROM (SELECT {step} FROM {base} JOIN {name}r{k} r ON r.g IS NOT DISTINCT FROM {base}.{'source' if name == 'a' else 'one'} AND r.j = {base}.place // 16))")
            base = f"f{first + k + 1}"

    climb("a", levels)
    ctes.append(f"s AS (SELECT g AS source, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, 1 AS one, count(*) OVER () AS n FROM a{levels})")
    ctes.append("b0 AS (SELECT one AS g, i AS j, subroot AS h, n FROM s)")
    climb("b", above)
    ctes.append("f0 AS (SELECT p.doc_id, p.source, p.leaf, 1 AS one, '' AS sibs, CASE WHEN t THEN changed ELSE leaf END AS v, i AS place FROM p)")
    fold("a", "f0", levels, 0)
    ctes.append(f"g AS (SELECT f.doc_id, f.source, f.leaf, f.one, f.sibs, f.v, s.i AS place, s.subroot FROM f{levels} f JOIN s ON s.source IS NOT DISTINCT FROM f.source)")
    fold("b", "g", above, levels)
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(sibs) AS proof_sha256, v AS folded_root, v = h AS verified FROM f{levels + above}, b{above}"
    )


SQL = _sql()
