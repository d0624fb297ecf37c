"""Differences of two snapshots of a table whose keys may have changed.

Texts never move: what is shuffled of a row is its key, a digest of its content and of each compared column. Bloom filters of both snapshots' keys,
held as tables of 64-bit words, tell rows whose key the other side certainly lacks from candidates. An exact join resolves the candidates. Rows
without a partner are then paired by content: numbered within equal content by key, rising on the earlier side and falling on the later one.
A filter has as many words as its side has keys; it is spread over tasks like any table, so nothing of it goes to the driver or is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ranking import places
from quern.state import cut

#: Bits of the filter for each key, and bits that a key sets in its word.
BITS, PROBES = 12, 4
COMPARED, CONTENT = ["text", "lang", "source"], ["text", "lang"]
#: Values up to this length stand for themselves; a longer one's digest is longer too, so the two never meet.
SHORT = 32


def _mark(c: Column) -> Column:
    """A short stand-in for a value, equal just where the values are; null stays null."""
    s = c.cast("string")
    return F.when(F.length(s) <= SHORT, s).otherwise(F.sha2(s.cast("binary"), 256))


def _narrow(rows: DataFrame, key: str, compared: list[str], content: list[str], digest: bool) -> DataFrame:
    """k, c0.. (compared columns' marks), content, tie, and for the later side row_sha256."""
    marks = [_mark(F.col(c)).alias(f"c{i}") for i, c in enumerate(compared)]
    whole = F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in compared))
    row = [F.sha2(whole.cast("binary"), 256).alias("row_sha256")] if digest else []
    out = rows.select(F.col(key).alias("k"), *marks, *row)
    named = F.concat_ws(",", *(F.coalesce(F.concat(F.length(f"c{compared.index(c)}").cast("string"), F.lit(":"), F.col(f"c{compared.index(c)}")), F.lit("-")) for c in content))
    return cut(out.withColumn("content", F.unhex(F.sha2(named.cast("binary"), 256))).withColumn("tie", F.monotonically_increasing_id()), "side")


def _address(k: Column, words: int) -> Column:
    """The word of the filter that a key lies in; null is a key like others."""
    return F.pmod(F.xxhash64(F.lit(1), k), F.lit(words))


def _bits(k: Column) -> Column:
    """The bits that a key sets in its word."""
    hashes = F.xxhash64(F.lit(2), k)
    picks = [F.pmod(F.shiftrightunsigned(hashes, 6 * i), F.lit(64)).cast("int") for i in range(PROBES)]
    one = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n)
    out = one(picks[0])
    for n in picks[1:]:
        out = out.bitwiseOR(one(n))
    return out


def filter_words(rows: DataFrame, words: int) -> DataFrame:
    """The filter of the keys ``k``: (word, bits) of the words that are not empty."""
    return cut(rows.select(_address(F.col("k"), words).alias("word"), _bits(F.col("k")).alias("b")).groupBy("word").agg(F.bit_or("b").alias("bits")), "filter")


def maybe_in(rows: DataFrame, words_of: DataFrame, words: int) -> DataFrame:
    """``rows`` with ``maybe``: false where the filter proves that the key is not among its keys."""
    asked = rows.withColumn("_bits", _bits(F.col("k"))).withColumn("word", _address(F.col("k"), words))
    found = asked.join(words_of.hint("merge"), "word", "left")  # the filter grows with the keys: never broadcast
    return found.withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(F.col("_bits")) == F.col("_bits"), F.lit(False))).drop("word", "bits", "_bits")


def _numbered_keys(rows: DataFrame, marks: list[str]) -> DataFrame:
    """``rows`` with ``named``, ``key`` (never null) and ``at``, the row's number among those of its key; only repeated keys need more than a count."""
    rows = rows.withColumn("named", F.col("k").isNotNull()).withColumn("key", F.coalesce(F.col("k").cast("string"), F.lit("")))
    many = cut(rows.groupBy("named", "key").agg(F.count("*").alias("n")).filter("n > 1").select("named", "key"), "repeated")
    many = many.hint("merge")
    once = rows.join(many, ["named", "key"], "left_anti").withColumn("at", F.lit(0).cast("bigint"))
    return once.unionByName(places(rows.join(many, ["named", "key"], "left_semi"), ["named", "key"], [*marks, "tie"], "at"))


def snapshot_diff(earlier: DataFrame, later: DataFrame, key: str = "doc_id", compared: list[str] | None = None, content: list[str] | None = None) -> DataFrame:
    """Per pair or row without partner: key (later, else earlier), old_key (earlier, else null), op, changed, row_sha256.

    Rows with equal keys pair: ``same``, or ``update`` where a compared column differs. Of those left, rows with equal ``content`` columns do:
    the i-th smallest earlier key with the i-th largest later key (``rekey``). The rest is ``insert`` or ``delete``. ``changed``: a pair's differing columns.
    row_sha256: of the later row's compared columns, one a line, null as ``~``; null for ``delete``. Nulls equal only nulls, as keys too (null is the
    smallest). Where rows repeat a key, i-th pairs with i-th in the order of their columns, surplus rows are left over; rows of one content with equal keys
    follow in the order of their columns. Columns that are not compared are ignored, whatever they are called. Two empty tables give no rows.
    """
    compared, content = compared or COMPARED, content or CONTENT
    marks = [f"c{i}" for i in range(len(compared))]
    old, new = _narrow(earlier, key, compared, content, False), _narrow(later, key, compared, content, True)
    words = {side: rows.count() * BITS // 64 + 1 for side, rows in (("old", old), ("new", new))}
    old_words, new_words = filter_words(old, words["old"]), filter_words(new, words["new"])
    old_asked, new_asked = cut(maybe_in(old, new_words, words["new"]), "asked"), cut(maybe_in(new, old_words, words["old"]), "asked")
    a = _numbered_keys(old_asked.filter("maybe"), marks)
    b = _numbered_keys(new_asked.filter("maybe"), marks)
    on = ["named", "key", "at"]
    tell = lambda side, cols: F.struct(*cols).alias(side)
    old_cols, new_cols = ["k", *marks, "content", "tie"], ["k", *marks, "row_sha256", "content", "tie"]
    joined = cut(a.select(*on, tell("o", old_cols)).join(b.select(*on, tell("n", new_cols)), on, "full").select("o", "n"), "joined")
    left = old_asked.filter("not maybe").select(*old_cols).unionByName(joined.filter("n is null").select("o.*"))
    right = new_asked.filter("not maybe").select(*new_cols).unionByName(joined.filter("o is null").select("n.*"))
    # content windows: a content's rows may be a third of all
    left = places(left, ["content"], [F.asc_nulls_first("k"), *marks, "tie"], "at").select("content", "at", tell("o", old_cols))
    right = places(right, ["content"], [F.desc_nulls_last("k"), *marks, "tie"], "at").select("content", "at", tell("n", new_cols))
    rest = left.join(right, ["content", "at"], "full").select("o", "n", F.lit("rekey").alias("paired"))
    pairs = joined.filter("o is not null and n is not null").select("o", "n", F.lit("same").alias("paired")).unionByName(rest)
    differs = [F.when(~F.col(f"o.{m}").eqNullSafe(F.col(f"n.{m}")), F.lit(c)) for m, c in zip(marks, compared, strict=True)]
    changed = F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), F.concat_ws(",", *differs)).otherwise("")
    op = F.when(F.col("n").isNull(), "delete").when(F.col("o").isNull(), "insert").when(F.col("paired") == "rekey", "rekey").when(changed == "", "same").otherwise("update")
    return pairs.select(F.when(F.col("n").isNull(), F.col("o.k")).otherwise(F.col("n.k")).alias("key"), F.col("o.k").alias("old_key"), op.alias("op"), changed.alias("changed"), F.col("n.row_sha256").alias("row_sha256"))


def later_snapshot(docs: DataFrame) -> DataFrame:
    """A later snapshot of ``docs`` by fixed rules on crc32 of doc_id modulo 25.

    0: row dropped; 1: ``+`` appended to the text; 2: lang and source swapped; 3: key becomes ``-1 - key``; 4: the same, source null; 5: a copy under
    ``-1 - key`` added. Rows without doc_id stay as they are.
    """
    m = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 25, F.lit(99))
    versions = F.when(m == 0, F.array().cast("array<int>")).when(m == 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = docs.select("doc_id", "text", "lang", "source", m.alias("m"), F.explode(versions).alias("copy"))
    key = F.when(F.col("m").isin(3, 4) | (F.col("copy") == 1), -1 - F.col("doc_id")).otherwise(F.col("doc_id"))
    text = F.when(F.col("m") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text"))
    lang, source = (F.when(F.col("m") == 2, F.col(other)).otherwise(F.col(own)) for own, other in (("lang", "source"), ("source", "lang")))
    return rows.select(key.alias("doc_id"), text.alias("text"), lang.alias("lang"), F.when(F.col("m") != 4, source).alias("source"))


def brute_force(old: list[tuple], new: list[tuple]) -> list[tuple]:
    """The same for ``(key, text, lang, source)`` held whole: what tests compare with."""
    import hashlib

    order = lambda row: tuple((x is not None, "" if x is None else x) for x in (_py_mark(row[1]), row[2], row[3]))
    rank = lambda k: (k is not None, k or 0)
    sha = lambda r: hashlib.sha256("\n".join("~" if x is None else x for x in r[1:]).encode()).hexdigest()
    by_key: dict = {}
    for side, rows in enumerate((old, new)):
        for r in sorted(rows, key=order):
            by_key.setdefault(r[0], ([], []))[side].append(r)
    pairs, rest = [], ([], [])
    for a, b in by_key.values():
        n = min(len(a), len(b))
        pairs += [(x, y, "same") for x, y in zip(a[:n], b[:n], strict=True)]
        rest[0].extend(a[n:])
        rest[1].extend(b[n:])
    by_content: dict = {}
    for side, rows in enumerate(rest):
        for r in sorted(sorted(rows, key=order), key=lambda r: rank(r[0]), reverse=bool(side)):
            by_content.setdefault(r[1:3], ([], []))[side].append(r)
    for a, b in by_content.values():
        n = min(len(a), len(b))
        pairs += [(x, y, "rekey") for x, y in zip(a[:n], b[:n], strict=True)] + [(x, None, "") for x in a[n:]] + [(None, y, "") for y in b[n:]]
    out = []
    for x, y, kind in pairs:
        changed = ",".join(c for c, p, q in zip(COMPARED, x[1:], y[1:], strict=True) if p != q) if x and y else ""
        op = "delete" if y is None else "insert" if x is None else kind if kind == "rekey" else "update" if changed else "same"
        out.append(((y or x)[0], x[0] if x else None, op, changed, sha(y) if y else None))
    return out


def _py_mark(text: str | None) -> str | None:
    import hashlib

    return text if text is None or len(text) <= SHORT else hashlib.sha256(text.encode()).hexdigest()


def oracle_sql() -> str:
    """The rows of ``snapshot_diff`` over ``documents`` and its ``later_snapshot`` in plain SQL."""
    from quern.llm.merkle import CRC, CRC_TABLE

    row = "sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~'))"
    changed = "concat_ws(',', " + ", ".join(f"CASE WHEN o.{c} IS DISTINCT FROM n.{c} THEN '{c}' END" for c in COMPARED) + ")"
    return f"""WITH crc AS ({CRC_TABLE}),
        old AS (SELECT doc_id, text, lang, source, coalesce({CRC} % 25, 99) AS m FROM documents, crc),
        new0 AS (SELECT CASE WHEN m IN (3, 4) THEN -1 - doc_id ELSE doc_id END AS doc_id, CASE WHEN m = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
            CASE WHEN m = 2 THEN source ELSE lang END AS lang, CASE WHEN m = 2 THEN lang WHEN m = 4 THEN NULL ELSE source END AS source FROM old WHERE m <> 0
            UNION ALL SELECT -1 - doc_id, text, lang, source FROM old WHERE m = 5),
        new AS (SELECT *, {row} AS row_sha256 FROM new0),
        by_key AS (SELECT n.doc_id AS key, o.doc_id AS old_key, {changed} AS changed, n.row_sha256 FROM old o JOIN new n ON o.doc_id IS NOT DISTINCT FROM n.doc_id),
        a AS (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id NULLS FIRST) AS i FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.doc_id IS NOT DISTINCT FROM o.doc_id)),
        b AS (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id DESC NULLS LAST) AS i FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE n.doc_id IS NOT DISTINCT FROM o.doc_id)),
        rest AS (SELECT o.i AS oi, n.i AS ni, n.doc_id AS key, o.doc_id AS old_key, {changed} AS changed, n.row_sha256 FROM a o FULL JOIN b n ON o.text IS NOT DISTINCT FROM n.text AND o.lang IS NOT DISTINCT FROM n.lang AND o.i = n.i)
        SELECT key, old_key, CASE WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed, row_sha256 FROM by_key
        UNION ALL SELECT CASE WHEN ni IS NULL THEN old_key ELSE key END, old_key, CASE WHEN ni IS NULL THEN 'delete' WHEN oi IS NULL THEN 'insert' ELSE 'rekey' END,
            CASE WHEN ni IS NULL OR oi IS NULL THEN '' ELSE changed END, row_sha256 FROM rest"""
