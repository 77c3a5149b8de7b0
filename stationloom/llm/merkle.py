"""A Merkle manifest of a dataset, with an inclusion proof for every row.

Each row is a leaf; leaves of one language form a tree of a fixed fanout, and the languages' subroots
form the tree of the whole. A task hashes aligned blocks of leaves up to one digest each. From there on
blocks exchange digests like a butterfly: in each round a block meets those whose index differs in one
digit only, so every member of a group of ``FANOUT`` subtrees learns the others' roots and hashes the same
ancestor for itself. After the last round each block holds its whole upper proof, and nothing has to be
handed down. Only digests move: the texts are hashed where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationloom.llm.buckets import group_starts, grouped
from stationloom.session import checkpointed

FANOUT = 8
#: Levels that a block of leaves covers, so it holds ``FANOUT ** BLOCK_LEVELS`` leaves.
BLOCK_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def measured(value: Column) -> Column:
    """A value as it enters a digest: ``-`` for null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of strings in a row."""
    return F.sha2(F.concat(*parts), 256)


def is_tampered_with(doc_id: Column) -> Column:
    """The rows of the drill: 3 divides crc32 of the id as text. A null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _placed(rows: DataFrame, tree: str, order: list[str], keep: list[str]) -> DataFrame:
    """Number the rows of every tree in ``order``: adds ``_index`` and ``_n``, the size of the tree.

    Rows are sorted over all machines, then counted per tree and partition. Equal rows are dealt out by a
    number of their own, so many of them don't meet in one task.
    """
    rows = rows.select(*keep, F.monotonically_increasing_id().alias("_salt"))
    ranges = rows.repartitionByRange(*order, "_salt").sortWithinPartitions(*order, "_salt").drop("_salt")
    ranges = checkpointed(ranges.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    whole = Window.partitionBy(tree)
    parts = ranges.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    parts = parts.withColumn("_n", F.sum("_rows").over(whole))
    parts = parts.withColumn("_before", F.sum("_rows").over(whole.orderBy("_part")) - F.col("_rows")).drop("_rows")
    return ranges.join(parts, [tree, "_part"]).select(*keep, (F.col("_at") - F.col("_first") + F.col("_before")).alias("_index"), "_n")


def butterfly(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Roots and proofs of many trees at once.

    ``nodes`` has ``_tree, _index, _n, _root``: the digest of leaf ``_index`` of a tree of ``_n``. The result has
    the same rows, with ``_root`` the root of the tree and ``_path``, for every level upwards the others of the
    run (``others``) and how many of them stand left of it (``at``). One shuffle of digests per level, in groups
    of at most ``fanout``. The last subtree of a level can have fewer holders than the others: they then serve
    several partners each.
    """
    nodes = nodes.select("_tree", "_index", "_n", "_root", F.expr("cast(array() as array<struct<at:int,others:array<string>>>)").alias("_path"))
    nodes = checkpointed(nodes)
    most = nodes.agg(F.max("_n")).first()[0] or 0
    width = 1
    while width < most:
        own = nodes.filter(F.col("_n") > width)
        node, place = F.expr(f"_index div {width}"), F.col("_index") % width
        holders = F.least(F.lit(width), F.col("_n") - node * width)
        alone = F.col("_n") <= F.expr(f"_index div {width * fanout}") * (width * fanout) + width
        last = F.when(alone, place).otherwise(F.lit(width - 1))
        sent = own.select(
            "*", F.expr(f"_index div {width * fanout}").alias("_group"), (node % fanout).cast("int").alias("_digit"),
            place.alias("_place"), F.explode(F.sequence(place, last, holders)).alias("_to"))
        met = F.collect_list(F.struct("_digit", "_root")).over(Window.partitionBy("_tree", "_group", "_to"))
        heard = sent.withColumn("_met", met).filter("_to = _place").withColumn("_met", F.sort_array("_met"))
        step = F.struct(F.col("_digit").alias("at"), F.expr("transform(filter(_met, x -> x._digit <> _digit), x -> x._root)").alias("others"))
        heard = heard.select(
            "_tree", "_index", "_n", F.sha2(F.array_join("_met._root", ""), 256).alias("_root"), F.concat("_path", F.array(step)).alias("_path"))
        nodes = checkpointed(heard.unionByName(nodes.filter(F.col("_n") <= width)))
        width *= fanout
    return nodes


def fold(leaf: str, path: list[dict]) -> str:
    """The root that a leaf and its siblings give."""
    for step in path:
        others, at = step["others"], step["at"]
        leaf = sha256("".join([*others[:at], leaf, *others[at:]]).encode()).hexdigest()
    return leaf


def levels_of(n: int, fanout: int) -> int:
    """Levels of hashing above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _climb(leaves: list[str], levels: int, fanout: int) -> list[list[str]]:
    """All levels of a block, leaves first."""
    found = [leaves]
    for _ in range(levels):
        low = found[-1]
        found.append([sha256("".join(low[k : k + fanout]).encode()).hexdigest() for k in range(0, len(low), fanout)])
    return found


def _block_digests(fanout: int, block_levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["_tree", "_block"]):
            starts = group_starts(table, ["_tree", "_block"])
            ends = [*starts[1:].tolist(), table.num_rows]
            leaves, sizes = table.column("leaf").to_pylist(), table.column("_n").take(pa.array(starts)).to_pylist()
            roots = [_climb(leaves[a:b], min(block_levels, levels_of(n, fanout)), fanout)[-1][0]
                     for a, b, n in zip(starts.tolist(), ends, sizes, strict=True)]
            first = table.take(pa.array(starts))
            span = fanout**block_levels
            yield pa.RecordBatch.from_arrays(
                [first.column("_tree").combine_chunks(), first.column("_block").combine_chunks(), pa.array([-(-n // span) for n in sizes], pa.int64()), pa.array(roots)],
                ["_tree", "_index", "_n", "_root"])

    return run


def _prove(leaves: list[str], altered: list[str | None], n: int, upper: list[dict], fanout: int, block_levels: int) -> Iterator[tuple[str, str, list[dict]]]:
    """For each leaf of a block: the digest of its siblings, what its leaf folds to, and the siblings."""
    levels = _climb(leaves, min(block_levels, levels_of(n, fanout)), fanout)
    # from a node upwards the siblings are the same for all leaves below it
    upward = ["".join("".join(step["others"]) for step in upper)]
    for low in reversed(levels[:-1]):
        found = []
        for k in range(len(low)):
            start = k - k % fanout
            found.append("".join(low[start:k] + low[k + 1 : start + fanout]) + upward[k // fanout])
        upward = found
    for k, leaf in enumerate(leaves):
        path, at = [], k
        for low in levels[:-1]:
            start = at - at % fanout
            path.append({"at": at - start, "others": low[start:at] + low[at + 1 : start + fanout]})
            at //= fanout
        path += upper
        yield sha256(upward[k].encode()).hexdigest(), fold(altered[k] or leaf, path), path


def _proofs(fanout: int, block_levels: int):
    """Over rows sorted by block, each block with the row of its upper proof first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["_tree", "_block"]):
            starts = group_starts(table, ["_tree", "_block"]).tolist()
            for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
                top, own = table.slice(a, 1).to_pylist()[0], table.slice(a + 1, b - a - 1)
                found = list(_prove(own.column("leaf").to_pylist(), own.column("_altered").to_pylist(), own.column("_n")[0].as_py(), top["_path"], fanout, block_levels))
                folded = [f for _, f, _ in found]
                yield pa.RecordBatch.from_arrays([
                    own.column("doc_id").combine_chunks(), own.column("leaf").combine_chunks(),
                    pa.array([top["_subroot"]] * len(found)), pa.array([top["_whole"]] * len(found)), pa.array([p for p, _, _ in found]),
                    pa.array(folded), pa.array([f == top["_whole"] for f in folded]),
                    pa.array([[step["others"] for step in path] for _, _, path in found], pa.list_(pa.list_(pa.string()))),
                ], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "siblings"])

    return run


def merkle_manifest(
    docs: DataFrame,
    altered_text: Column | None = None,
    fanout: int = FANOUT,
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, siblings``.

    ``altered_text`` is the text as it is found at verification (null: the row is as it was): ``folded_root`` is what
    the leaf of that text and the stored ``siblings`` (level by level upwards, left to right) give, and ``verified``
    whether it is the root. A null value enters a leaf as ``-``, unlike an empty text (``0:``). Documents without a
    language form a tree of their own, the first one; documents without an id come first in theirs. Of rows with one
    id the one with the smaller leaf comes first; equal rows are leaves of their own. An empty table has no rows and
    no root. Other columns of ``docs``, whatever their names, are not read.
    """
    values = [measured(F.col(c)) for c in FIELDS]
    leaves = docs.select(
        F.col("doc_id").alias("doc_id"), F.col("lang").alias("_lang"), measured(F.col("lang")).alias("_tree"), digest(*values).alias("leaf"),
        (digest(*values[:-1], measured(altered_text)) if altered_text is not None else F.lit(None).cast("string")).alias("_altered"))
    if altered_text is not None:
        leaves = leaves.withColumn("_altered", F.when(F.col("_altered") != F.col("leaf"), F.col("_altered")))
    # the texts are hashed once: what follows reads digests
    leaves = checkpointed(leaves)
    kept = ["doc_id", "_lang", "_tree", "leaf", "_altered"]
    span = fanout**block_levels
    placed = _placed(leaves, "_tree", ["_lang", "doc_id", "leaf"], kept)
    placed = placed.withColumn("_block", F.expr(f"_index div {span}"))

    blocks = placed.select("_tree", "_block", "_index", "_n", "leaf").repartition("_tree", "_block").sortWithinPartitions("_tree", "_block", "_index")
    blocks = butterfly(blocks.mapInArrow(_block_digests(fanout, block_levels), "_tree string, _index long, _n long, _root string"), fanout)
    subroots = blocks.filter("_index = 0").select("_tree", F.col("_root").alias("_subroot"))
    langs = leaves.groupBy("_lang", "_tree").count().join(subroots, "_tree").withColumn("_all", F.lit("all"))
    langs = _placed(langs, "_all", ["_lang"], ["_all", "_tree", "_subroot"])
    whole = butterfly(langs.select(F.col("_all").alias("_tree"), "_index", "_n", F.col("_subroot").alias("_root")), fanout)
    above = langs.join(whole.select("_index", F.col("_root").alias("_whole"), F.col("_path").alias("_top")), "_index")
    upper = blocks.join(above.select("_tree", "_subroot", "_whole", "_top"), "_tree").select(
        "_tree", F.col("_index").alias("_block"), F.concat("_path", "_top").alias("_path"), "_subroot", "_whole", F.lit(-1).cast("long").alias("_index"))

    rows = placed.drop("_lang").unionByName(upper, allowMissingColumns=True)
    rows = rows.repartition("_tree", "_block").sortWithinPartitions("_tree", "_block", "_index")
    kind = leaves.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_proofs(fanout, block_levels), (
        f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, siblings array<array<string>>"))


def oracle_sql(levels: int = 8, lang_levels: int = 4) -> str:
    """The manifest of ``documents`` in SQL, unrolled for up to ``8 ** levels`` documents of a language."""

    def leaf(text: str) -> str:
        values = [*(f"CAST({c} AS VARCHAR)" for c in FIELDS[:-1]), text]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    def tree(name: str, base: str, key: str, depth: int) -> list[str]:
        ctes = [f"{name}0 AS (SELECT {key} AS k, i, n, x FROM {base})"]
        for d in range(depth):
            ctes.append(f"""{name}{d + 1} AS (SELECT k, i // {FANOUT} AS i, (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n,
  CASE WHEN any_value(n) > 1 THEN sha256(string_agg(x, '' ORDER BY i)) ELSE any_value(x) END AS x FROM {name}{d} GROUP BY k, i // {FANOUT})""")
            # of every node: what stands left and right of it in its run
            ctes.append(f"""{name}s{d} AS (SELECT k, i, CASE WHEN n > 1 THEN coalesce(string_agg(x, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS a,
  CASE WHEN n > 1 THEN coalesce(string_agg(x, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS b
  FROM {name}{d} WINDOW w AS (PARTITION BY k, i // {FANOUT} ORDER BY i))""")
        return ctes

    low = f"translate(text, '{_UPPER}', '{_LOWER}')"
    ctes = [
        """crc AS (SELECT list(list_reduce(list_prepend(byte, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)
  ORDER BY byte) AS t FROM (SELECT unnest(range(256)) AS byte))""",
        """ids AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c))),
  lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1]))) AS crc32 FROM documents, crc)""",
        f"leaves AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS k, {leaf('text')} AS x, "
        f"CASE WHEN crc32 % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS y FROM ids)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, x) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM leaves)",
        *tree("t", "placed", "k", levels),
        f"subs AS (SELECT k AS lang_key, x, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM t{levels})",
        *tree("u", "subs", "0", lang_levels),
        "f0 AS (SELECT p.doc_id, p.x AS leaf, p.y AS c, '' AS sib, p.i, p.k, subs.i AS li, subs.x AS subroot FROM placed p JOIN subs ON p.k = subs.lang_key)",
    ]
    step = 0
    for name, depth, key, index in (("t", levels, "f.k", "f.i"), ("u", lang_levels, "0", "f.li")):
        for d in range(depth):
            ctes.append(f"""f{step + 1} AS (SELECT f.* REPLACE (CASE WHEN a IS NULL THEN c ELSE sha256(a || c || b) END AS c,
  CASE WHEN a IS NULL THEN sib ELSE sib || a || b END AS sib) FROM f{step} f JOIN {name}s{d} s ON s.k = {key} AND s.i = {index} // {FANOUT**d})""")
            step += 1
    return f"""WITH {", ".join(ctes)}
SELECT doc_id, leaf, subroot, u{lang_levels}.x AS root, sha256(sib) AS proof_sha256, c AS folded_root, c = u{lang_levels}.x AS verified
FROM f{step} CROSS JOIN u{lang_levels}"""
