"""A Merkle manifest of a table: a leaf for each row, a tree for each group, a tree over groups.

Nodes of a level are rows (tree, i, digest). A level is a self-join: every node sends its digest to
the computed indices of its siblings (i XOR 1 in a binary tree, otherwise the slots of its run), and
every node meets there what was sent to it. The node in slot zero of a run then has the whole run and
emits the parent. What a node has met is also its step of every proof that passes through it.

Positions of leaves come from a range layout, so a group that holds a third of all rows is spread
over many ranges, and every join key is (tree, index). The number of rounds is the height of the
tallest tree. Paths go down again level by level: a node's path is its own step and its parent's
path, so a leaf is joined once, with the path that the leaves of its run share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import read_table
from driftline.operators.ordered import lay_out, running_totals
from driftline.session import materialise

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "struct<left:string,right:string>"


def encoded(value: Column) -> Column:
    """A field without ambiguity: `-` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def row_digest(values: list[Column]) -> Column:
    return digest_of(*[encoded(v) for v in values])


def name_of(group: Column) -> Column:
    """A non-null name whose order by bytes is the group's, null first."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def meet(nodes: DataFrame, fanout: int) -> DataFrame:
    """nodes (tree, i, digest, n, ...) with `met`: the (slot, digest) of each sibling, by slot.

    n is the number of nodes of the tree on this level; nothing is sent to places beyond it."""
    i = F.col("i")
    if fanout == 2:
        places = F.array(i.bitwiseXOR(F.lit(1).cast("long")))
    else:
        places = F.transform(F.sequence(F.lit(0), F.lit(fanout - 1)), lambda slot: i - i % fanout + slot)
    places = F.filter(places, lambda to: (to != i) & (to < F.col("n")))
    sent = nodes.select(
        "tree", F.explode(places).alias("i"), F.struct((i % fanout).cast("int").alias("slot"), "digest").alias("one")
    )
    own = [c for c in nodes.columns if c not in ("tree", "i")]
    return nodes.join(sent, ["tree", "i"], "left").groupBy("tree", "i").agg(
        *[F.first(c).alias(c) for c in own], F.array_sort(F.collect_list("one")).alias("met")
    )


def parents(level: DataFrame, fanout: int) -> DataFrame:
    """The nodes above: each is emitted by the slot-zero row of its run."""
    run = F.concat(_text(F.col("digest")), F.array_join(F.transform("met", lambda x: _text(x.digest)), ""))
    return level.where(F.col("i") % fanout == 0).select(
        "tree",
        F.floor(F.col("i") / fanout).alias("i"),
        F.unhex(digest_of(run)).alias("digest"),
        F.ceil(F.col("n") / fanout).alias("n"),
    )


def climb(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels that have siblings, lowest first, and (tree, digest) of every tree's root."""
    levels, roots = [], nodes.where("n = 1").select("tree", "digest")
    tallest = nodes.agg(F.max("n")).first()[0] or 0
    while tallest > 1:
        level = materialise(meet(nodes.where("n > 1"), fanout), "level")
        levels.append(level)
        nodes = materialise(parents(level, fanout), "parents")
        roots = roots.unionByName(nodes.where("n = 1").select("tree", "digest"))
        tallest = -(-tallest // fanout)
    return levels, roots


def step(fanout: int) -> Column:
    """What stands left and right of a node in its run, as hexadecimal text."""
    slot = (F.col("i") % fanout).cast("int")
    side = lambda keep: F.array_join(F.transform(F.filter("met", keep), lambda x: _text(x.digest)), "")
    return F.struct(side(lambda x: x.slot < slot).alias("left"), side(lambda x: x.slot > slot).alias("right"))


def descend(levels: list[DataFrame], roots: DataFrame, fanout: int) -> DataFrame | None:
    """The lowest level with `path`, its steps up to the root, and the columns of roots (tree, path, ...)."""
    paths, given = None, [c for c in roots.columns if c not in ("tree", "path")]
    for number in range(len(levels) - 1, -1, -1):
        # The levels between carry only what the join needs.
        names = ["n", "met"] if number else [c for c in levels[0].columns if c not in ("tree", "i")]
        level = levels[number].select("tree", "i", *names).withColumn("up", F.floor(F.col("i") / fanout))
        below = level.where(F.col("n") <= fanout).join(roots, "tree")
        if paths is not None:
            above = paths.select("tree", F.col("i").alias("up"), "path", *given)
            below = below.unionByName(level.where(F.col("n") > fanout).join(above, ["tree", "up"]))
        own = [c for c in names if c != "met"]
        paths = below.select("tree", "i", *own, F.concat(F.array(step(fanout)), "path").alias("path"), *given)
    return paths


def manifest(
    df: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS,
    fanout: int = FANOUT, tampered: Column | None = None,
) -> DataFrame:
    """key, leaf, subroot, root, path, and folded_root for each row.

    path is the array of (left, right) hexadecimal digests from the leaf up to the root; folded_root
    is what the path makes of the leaf, or of `tampered`, the digest of a changed row, where that is
    not null. The leaf is the digest of `fields`. Leaves of a group ascend by key, null first; rows
    with one key by their leaf, and equal rows are a leaf each, side by side. Null is a group of its
    own, the first. A group of one row has its leaf as root, and a table of one group has the
    group's root as root. Nulls in fields are `-`, empty and very long texts are values like
    others. An empty table gives an empty result, other columns are ignored.
    """
    spark = df.sparkSession
    leaf = row_digest([F.col(c) for c in fields])
    leaves = materialise(
        df.select(
            F.col(key).alias("key"), name_of(F.col(group)).alias("name"), F.unhex(leaf).alias("digest"),
            F.unhex(tampered if tampered is not None else F.lit(None).cast("string")).alias("changed"),
        ),
        "leaves",
    )
    groups = leaves.groupBy("name").agg(F.count("*").alias("n")).select(
        F.lit(0).cast("long").alias("all"), "name", "n", F.lit(1).alias("one")
    )
    named = running_totals(lay_out(groups, ["all"], ["name"], ["one"]))
    trees = materialise(named.select("name", "n", F.col("one_prior").alias("tree")), "trees")
    # Equal rows are told apart by their place in the written table, which no retry changes.
    placed = leaves.join(trees, "name").select("tree", "key", "digest", "changed", "n", F.monotonically_increasing_id().alias("tie"))
    runs = lay_out(materialise(placed, "placed").withColumn("one", F.lit(1)), ["tree"], ["key", "digest", "tie"], ["one"])
    nodes = materialise(
        running_totals(runs).select("tree", F.col("one_prior").alias("i"), "digest", "n", "key", "changed"), "nodes"
    )
    levels, roots = climb(nodes, fanout)
    roots = materialise(roots, "roots")
    count = trees.count()
    forest = roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), "digest", F.lit(count).cast("long").alias("n"))
    upper, root = climb(forest, fanout)
    found = root.first()
    root_text = found.digest.hex() if found is not None else None
    no_steps = F.from_json(F.lit("[]"), f"array<{STEP}>")
    start = spark.range(1).select(F.lit(0).cast("long").alias("tree"), no_steps.alias("path"))
    tops = descend(upper, start, fanout)
    if tops is None:
        subroots = roots.select("tree", F.col("digest").alias("subroot"), no_steps.alias("path"))
    else:
        subroots = tops.select(F.col("i").alias("tree"), F.col("digest").alias("subroot"), "path")
    subroots = materialise(subroots, "subroots")
    rows = nodes.where("n = 1").join(subroots, "tree").select("key", "digest", "changed", "subroot", "path")
    below = descend(levels, subroots, fanout)
    if below is not None:
        rows = rows.unionByName(below.select(*rows.columns))
    fold = F.aggregate(
        "path", _text(F.coalesce("changed", "digest")), lambda at, s: digest_of(s.left, at, s.right)
    )
    return rows.select(
        F.col("key").alias(key),
        _text(F.col("digest")).alias("leaf"),
        _text(F.col("subroot")).alias("subroot"),
        F.lit(root_text).cast("string").alias("root"),
        "path",
        fold.alias("folded_root"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, its proofs as digests, and each proof tried on a leaf whose text
    may have been put into lower case."""
    docs = read_table(spark, sf_dir, "documents")
    lowered = row_digest([F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS])
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = manifest(docs, tampered=F.when(hit, lowered))
    proof = F.array_join(F.transform("path", lambda s: F.concat(s.left, s.right)), "")
    return found.select(
        "doc_id", "leaf", "subroot", "root", digest_of(proof).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )



LEVELS = 7  # of the SQL only, which has no loop over aggregates: enough for 16 ** 7 rows of a group


def _sql_field(name: str, value: str | None = None) -> str:
    value = f"CAST({value or name} AS VARCHAR)"
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _sql_tree(prefix: str, first: str) -> str:
    """Levels of all trees of `first` (tree, i, d), each node with its parent's index and run."""
    parts = [f"{prefix}0 AS ({first})"]
    for k in range(LEVELS):
        parts.append(
            f"{prefix}{k + 1} AS (SELECT tree, i // 16 AS i, CASE WHEN any_value(c) = 1 THEN any_value(d) "
            f"ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c "
            f"FROM {prefix}{k}) GROUP BY tree, i // 16)"
        )
    return ",\n".join(parts)


def _sql_sides(prefix: str, k: int) -> str:
    """Of each node of level k, what stands left and right of it in its run."""
    side = lambda sign: f"coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i {sign} a.i), '')"
    return (
        f"{prefix}s{k} AS (SELECT a.tree, a.i, {side('<')} AS l, {side('>')} AS r FROM {prefix}{k} a JOIN {prefix}{k} b "
        f"ON a.tree = b.tree AND a.i // 16 = b.i // 16 GROUP BY a.tree, a.i)"
    )


def _sql_folds() -> str:
    """The leaf's fold through all levels; a tree that has ended hands its digest on unchanged."""
    parts, last = [], "leaves"
    for prefix in ("t", "g"):
        for k in range(LEVELS):
            here = f"{prefix}f{k}"
            at = f"p.i // {16**k}" if prefix == "t" else f"p.tree // {16**k}"
            tree = "s.tree = p.tree" if prefix == "t" else "true"
            parts.append(
                f"{here} AS (SELECT p.* EXCLUDE (f, proof), CASE WHEN c.n = 1 THEN p.f ELSE sha256(s.l || p.f || s.r) END AS f, "
                f"p.proof || s.l || s.r AS proof FROM {last} p JOIN {prefix}s{k} s ON {tree} AND s.i = {at} "
                f"JOIN (SELECT tree, count(*) AS n FROM {prefix}{k} GROUP BY tree) c ON c.tree = s.tree)"
            )
            last = here
    return ",\n".join(parts)


# Trees as unrolled levels; CRC-32 bit by bit over the digits of doc_id.
OP13_SQL = f"""
WITH raw AS (
  SELECT *, list_reduce(flatten([[4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
         lambda ch: [CAST(ord(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))]),
         lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf, '' AS proof,
    CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN changed ELSE leaf END AS f
  FROM (SELECT doc_id, source, crc, sha256({" || ".join(_sql_field(c) for c in FIELDS)}) AS leaf,
        sha256({" || ".join(_sql_field(c, f"translate(text, '{UPPER}', '{LOWER}')" if c == "text" else None) for c in FIELDS)}) AS changed
        FROM raw)),
{_sql_tree("t", "SELECT tree, i, leaf AS d FROM leaves")},
{_sql_tree("g", f"SELECT 0 AS tree, tree AS i, d FROM t{LEVELS}")},
{", ".join(_sql_sides(p, k) for p in "tg" for k in range(LEVELS))},
{_sql_folds()}
SELECT p.doc_id, p.leaf, t.d AS subroot, g.d AS root, sha256(p.proof) AS proof_sha256, p.f AS folded_root, p.f = g.d AS verified
FROM gf{LEVELS - 1} p JOIN t{LEVELS} t ON t.tree = p.tree JOIN g{LEVELS} g ON true
"""

QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
ORACLES = {"op13_merkle_manifest": OP13_SQL}
