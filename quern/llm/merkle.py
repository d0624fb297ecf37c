"""A Merkle manifest of a dataset: a tree of digests for each group of rows, a tree over the groups, and a proof for every row.

The trees are built by supersteps over RDDs. A superstep deals nodes out by their ancestor ``LEVELS`` levels up: children send their digests
to it, and a vertex whose children have all arrived hashes them and sends the digest of its top on to the next superstep. The reverse supersteps
start at the tops: every vertex gets the siblings on the way from its top to the root, puts those of its own levels before them, and sends them to
its children, down to the rows. No vertex ever holds more than ``ARITY ** LEVELS`` digests and one path, so no group, however large, meets in one task.
Lineages start at tables written to the shared folder and are as long as the tree has supersteps; a lost executor's part is computed again from there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ranking import places
from quern.state import cut

#: Children of a node, and levels that one superstep climbs.
ARITY, LEVELS = 3, 4
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf(columns: list[Column]) -> Column:
    """SHA-256 over the values: ``-`` for null, else number of UTF-8 bytes, ``:``, value as text."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, columns)).cast("binary"), 256)


def parent(children: list[bytes]) -> bytes:
    """The digest of a run of children: over their hexadecimal texts, one after the other."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def climb(digests: list[bytes], n: int, levels: int) -> list[list[bytes]]:
    """Levels of the subtree over ``digests``, its leaves first, in a tree whose level of leaves has ``n`` nodes.

    At most ``levels`` levels are added; a level that is its tree's only node ends the tree.
    """
    out = [digests]
    while len(out) <= levels and n > 1:
        below = out[-1]
        out.append([parent(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
        n = -(-n // ARITY)
    return out


def paths(levels: list[list[bytes]]) -> Iterator[tuple[bytes, bytes]]:
    """For each leaf of a subtree: its steps (a byte each: place in its run times 16, plus the run's length) and siblings, bottom up."""
    for at in range(len(levels[0])):
        steps, siblings, i = bytearray(), [], at
        for level in levels[:-1]:
            run = i - i % ARITY
            group = level[run : run + ARITY]
            steps.append((i - run) * 16 + len(group))
            siblings += group[: i - run] + group[i - run + 1 :]
            i //= ARITY
        yield bytes(steps), b"".join(siblings)


def _ordered(slots) -> list[tuple]:
    return sorted(slots, key=lambda s: s[0])


def upward(nodes: RDD, largest: int, parts: int, levels: int) -> tuple[list[RDD], RDD]:
    """Supersteps up. ``nodes``: ((tree, index), (nodes of its level, digest, payload)).

    Returns each superstep's vertices ((tree, block), slots) and the roots (tree, (superstep, digest)). ``largest``: leaves of the largest tree.
    """
    width = ARITY**levels
    deal = lambda rdd: rdd.map(lambda x: ((x[0][0], x[0][1] // width), (x[0][1] % width, *x[1]))).groupByKey(parts)
    steps, roots = [], None

    def top(vertex):
        (tree, block), slots = vertex
        slots = _ordered(slots)
        n = slots[0][1]
        last = climb([s[2] for s in slots], n, levels)[-1][0]
        return (tree, block), (-(-n // width), last, None), n <= width

    while True:
        vertices = deal(nodes)
        tops = vertices.map(top)
        number = len(steps)
        steps.append(vertices)
        done = tops.filter(lambda x: x[2]).map(lambda x, number=number: (x[0][0], (number, x[1][1])))
        roots = done if roots is None else roots.union(done)
        if largest <= width:
            return steps, roots
        nodes = tops.filter(lambda x: not x[2]).map(lambda x: (x[0], x[1]))
        largest = -(-largest // width)


def downward(steps: list[RDD], above: RDD, parts: int, levels: int) -> RDD:
    """Supersteps down. ``above``: (tree, (superstep of its root, steps, siblings, note)), the way from the tree's root on.

    Returns ((tree, index), (payload, digest, steps, siblings, note)) for every leaf.
    """
    width = ARITY**levels

    def send(vertex):
        (tree, block), (slots, messages) = vertex
        slots = _ordered(next(iter(slots)))
        own, siblings, note = next(iter(messages))
        below = climb([s[2] for s in slots], slots[0][1], levels)
        for slot, (s, sib) in zip(slots, paths(below), strict=True):
            yield (tree, block * width + slot[0]), (slot[3], slot[2], s + own, sib + siblings, note)

    messages = None
    for number in range(len(steps) - 1, -1, -1):
        starts = above.filter(lambda x, number=number: x[1][0] == number).map(lambda x: ((x[0], 0), x[1][1:]))
        messages = starts if messages is None else messages.map(lambda x: (x[0], x[1][2:])).union(starts)
        messages = steps[number].mapValues(list).cogroup(messages, parts).flatMap(send)
    return messages


def manifest(rows: DataFrame, columns: list[str] | None = None, group: str = "source", key: str = "doc_id", also: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """Per row: ``key``, leaf, the columns of ``also``, subroot, root, steps, siblings.

    Leaves hash ``columns``; those of a group ascend by ``key`` (null first; rows that repeat a key in the order of their leaves), groups by UTF-8 bytes
    (null first, a group of its own). Every ``ARITY`` consecutive nodes of a level have a parent, the last run may be shorter, and a level of one node ends a
    tree. ``siblings``: hexadecimal digests, end to end, of the other nodes of the row's run, level by level, up to the root. ``steps``: for each
    level the row's place in its run times 16, plus the run's length. ``also``: further columns computed from a row (such as another version's
    leaf). Rows that repeat are leaves each. Other columns of ``rows``, whatever they are called, are not read. An empty table gives no rows.
    """
    spark, also = rows.sparkSession, also or {}
    made = rows.select(F.col(key).alias("key"), F.col(group).isNotNull().alias("named"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("group"), leaf([F.col(c) for c in columns or COLUMNS]).alias("leaf"), *(c.alias(f"also{i}") for i, c in enumerate(also.values())))
    made = cut(made.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    placed = places(made, ["named", "group"], ["key", "leaf", "tie"], "place")
    sizes = cut(made.groupBy("named", "group").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)), "groups")
    groups = places(sizes, ["all"], ["named", "group"], "tree").drop("all")
    n_groups, largest = sizes.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    kinds = {f.name: f.dataType.simpleString() for f in made.schema.fields}
    names = [f"also{i}" for i in range(len(also))]
    schema = ", ".join([f"key {kinds['key']}", "leaf string", *(f"{n} {kinds[n]}" for n in names), "subroot string, root string, steps array<int>, siblings string"])
    if n_groups:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        joined = placed.join(groups, ["named", "group"]).select("tree", "place", "n", "key", F.unhex("leaf").alias("digest"), *names)
        nodes = joined.rdd.map(lambda r: ((r[0], r[1]), (r[2], bytes(r[4]), (r[3], *r[5:]))))
        steps, roots = upward(nodes, largest, parts, levels)
        over, whole = upward(roots.map(lambda x: ((0, x[0]), (n_groups, x[1][1], x[1][0]))), n_groups, parts, levels)
        # the way of each group's root to the root of all, which every group is told
        tops = downward(over, whole.map(lambda x: (0, (x[1][0], b"", b"", x[1][1]))), parts, levels)
        tops = tops.map(lambda x: (x[0][1], (x[1][0], x[1][2], x[1][3], (x[1][1], x[1][4]))))
        leaves = downward(steps, tops, parts, levels)
        out = leaves.map(lambda x: (x[1][0][0], x[1][1].hex(), *x[1][0][1:], x[1][4][0].hex(), x[1][4][1].hex(), list(x[1][2]), x[1][3].hex()))
        found = spark.createDataFrame(out, schema, verifySchema=False)
    else:
        found = spark.createDataFrame([], schema)
    return found.select(F.col("key").alias(key), "leaf", *(F.col(n).alias(a) for n, a in zip(names, also, strict=True)), "subroot", "root", "steps", "siblings")


def folded(leaf: Column, steps: Column, siblings: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    def up(done: Column, step: Column) -> Column:
        left, others = F.floor(step / 16).cast("int"), (step % 16 - 1).cast("int")
        before = F.substr(siblings, done["at"], 64 * left)
        after = F.substr(siblings, done["at"] + 64 * left, 64 * (others - left))
        return F.struct(F.sha2(F.concat(before, done["digest"], after).cast("binary"), 256).alias("digest"), (done["at"] + 64 * others).alias("at"))

    return F.aggregate(steps, F.struct(leaf.alias("digest"), F.lit(1).alias("at")), up, lambda done: done["digest"])


def verified(proofs: DataFrame, leaf_col: str = "leaf") -> DataFrame:
    """``proofs`` with folded_root, the root that ``leaf_col`` and the row's siblings give, and verified: whether it is the root."""
    return proofs.withColumn("folded_root", folded(F.col(leaf_col), F.col("steps"), F.col("siblings"))).withColumn("verified", F.col("folded_root") == F.col("root"))


def tamper_check(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of ``docs`` and what it finds of a fixed tampering: every second row, by crc32 of doc_id, lost its line feeds.

    Rows: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Rows without doc_id are not tampered with, null texts stay null.
    """
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    now = leaf([text if c == "text" else F.col(c) for c in COLUMNS])
    proofs = verified(manifest(docs, also={"now": now}, levels=levels), "now")
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified")


def brute_force(rows: list[tuple], tampered) -> dict:
    """The same for ``(doc_id, source, lang, n_chars, text)`` held whole: what tests compare with."""
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for way, i in zip(ways, at, strict=True):
                way.append((i % ARITY, nodes[i - i % ARITY : i - i % ARITY + ARITY]))
            at = [i // ARITY for i in at]
            nodes = [h(*nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
        return nodes[0], ways

    groups: dict = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row, h(*map(enc, row))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[g] = tree([x[1] for x in groups[g]])
    root, over = tree([trees[g][0] for g in names])
    out = []
    for g, way_up in zip(names, over, strict=True):
        for (row, mine), way in zip(groups[g], trees[g][1], strict=True):
            siblings = "".join(x for at, run in way + way_up for x in run[:at] + run[at + 1 :])
            now = h(*map(enc, (*row[:4], row[4].replace("\n", "") if row[4] is not None and tampered(row[0]) else row[4])))
            for at, run in way + way_up:
                now = h(*run[:at], now, *run[at + 1 :])
            out.append((row[0], mine, trees[g][0], root, h(siblings), now, now == root))
    return out


#: crc32 of decimal ``doc_id`` in plain SQL, over the one-row table ``crc(t)`` of the 256 remainders.
CRC_TABLE = "SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)"
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ord(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


def oracle_sql() -> str:
    """The rows of ``tamper_check`` in plain SQL: trees level by level, each row's way up by joins."""
    part = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    row = lambda text: "sha256(" + " || ".join(part(text if c == "text" else c) for c in COLUMNS) + ")"

    def levels(name: str, leaves: str) -> str:
        climb = f"SELECT tree, lvl + 1, i // {ARITY}, sha256(string_agg(digest, '' ORDER BY i)), (n + {ARITY - 1}) // {ARITY} FROM {name} WHERE n > 1 GROUP BY tree, lvl, n, i // {ARITY}"
        run = lambda op, alias: f"coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (WHERE b.i {op} a.i), '') AS {alias}"
        return f"""{name}(tree, lvl, i, digest, n) AS ({leaves} UNION ALL {climb}),
            {name}_runs AS (SELECT a.tree, a.lvl, a.i, {run("<", "l")}, {run(">", "r")} FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.lvl = b.lvl AND a.i // {ARITY} = b.i // {ARITY} WHERE a.n > 1 GROUP BY a.tree, a.lvl, a.i)"""

    def walk(name: str, runs: str, start: str) -> str:
        return f"{name}(id, tree, lvl, i, proof, h) AS ({start} UNION ALL SELECT w.id, w.tree, w.lvl + 1, w.i // {ARITY}, w.proof || x.l || x.r, sha256(x.l || w.h || x.r) FROM {name} w JOIN {runs} x ON w.tree = x.tree AND w.lvl = x.lvl AND w.i = x.i)"

    return f"""WITH RECURSIVE crc AS ({CRC_TABLE}),
        hashed AS (SELECT doc_id, source, {row("text")} AS leaf, {row(f"CASE WHEN {CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS now FROM documents, crc),
        leaves AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM hashed),
        {levels("nodes", "SELECT tree, 0, i, leaf, n FROM leaves")},
        subroots AS (SELECT tree, digest FROM nodes WHERE n = 1),
        {levels("tops", "SELECT 0, 0, tree, digest, (SELECT count(*) FROM subroots) FROM subroots")},
        {walk("inner_way", "nodes_runs", "SELECT id, tree, 0, i, '', now FROM leaves")},
        inner_end AS (SELECT id, tree, max_by(proof, lvl) AS proof, max_by(h, lvl) AS h FROM inner_way GROUP BY id, tree),
        {walk("outer_way", "tops_runs", "SELECT id, 0, 0, tree, proof, h FROM inner_end")},
        outer_end AS (SELECT id, max_by(proof, lvl) AS proof, max_by(h, lvl) AS h FROM outer_way GROUP BY id)
        SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = t.digest AS verified
        FROM leaves JOIN outer_end USING (id) JOIN subroots s USING (tree), (SELECT digest FROM tops WHERE n = 1) t"""
