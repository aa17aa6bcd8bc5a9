"""Three-way merge of a table's branches: hash partitions by id, and in each an embedded DuckDB that joins the branches' changes and puts the texts together."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora.llm.spelling import crc32_sql

#: Of a branch's changes. part: row (dropped), added (a whole row: its columns in cols, its text in value), column, line, gap (a line put in after one). place: the number of the
#: column or line, from 0. value: the new state, null if dropped. tag: of the row changed (see tagged).
CHANGES = "side int, id long, tag long, part string, place long, value string, cols array<string>"
_COUNTS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


def tagged(docs: DataFrame, columns: Sequence[str] = ("lang", "source"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tag, cols, text of each row, nulls as empty strings. The tag is a hash of all of it, which tells rows apart that repeat an id or have none."""
    cols = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]) if columns else F.array().cast("array<string>")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), cols.alias("cols"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("id", F.xxhash64("id", "cols", "text").alias("tag"), "cols", "text")


def edits(rows: DataFrame, columns: Sequence[str] = ("lang", "source"), modulus: int = 17) -> DataFrame:
    """CHANGES of the branches L (side 1) and R (side 2) of tagged rows, by the CRC of `branch:id:name` modulo 17: name is row, a column's or a line's number. 0 drops (empties a
    column); 1 and 2 append ! and ? to a column or line; 3 and 4 put the line ! or ? after a line, and add for a row another one with that text, under the id -1 - id (R: -5 - id).
    One pass over the texts, all in the JVM; unchanged parts make no row. Rows without an id have an empty one in the names, and add no rows."""
    n = len(columns) + 1
    items = rows.select("id", "tag", "cols", F.posexplode(F.concat(F.array(F.lit("")), "cols", F.split("text", "\n"))).alias("pos", "item"))
    name = F.when(F.col("pos") == 0, "row")
    for i, c in enumerate(columns, 1):
        name = name.when(F.col("pos") == i, c)
    name = name.otherwise((F.col("pos") - n).cast("string"))
    items = items.withColumn("name", F.concat_ws(":", F.lit(""), F.coalesce(F.col("id").cast("string"), F.lit("")), name))

    def code(branch: str) -> Column:
        return F.crc32(F.concat(F.lit(branch), F.col("name")).cast("binary")) % modulus

    items = items.select("id", "tag", "cols", "pos", "item", code("L").alias("l"), code("R").alias("r")).where("l < 5 or r < 5")
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(c).alias("code")) for side, c in ((1, "l"), (2, "r"))]))
    each = items.select("*", sides.alias("x")).select("*", "x.side", "x.code").where("code < 5")
    pos, item, code_ = F.col("pos"), F.col("item"), F.col("code")
    mark = F.when(code_ % 2 == 1, "!").otherwise("?")
    row, column = pos == 0, (pos > 0) & (pos < n)
    adds = row & (code_ >= 3)
    edited = F.when(code_ == 0, F.when(column, F.lit(""))).when((code_ < 3) & ~row, F.concat(item, mark)).otherwise(mark)
    part = F.when(row, F.when(code_ == 0, "row").when(code_ >= 3, "added")).when(column, F.when((code_ < 3) & (edited != item), "column")).when(code_ >= 3, "gap").otherwise("line")
    new_id = F.when(adds, F.try_subtract(F.when(F.col("side") == 1, -1).otherwise(-5).cast("long"), F.col("id"))).otherwise(F.col("id"))
    at = F.when(row, 0).when(column, pos - 1).otherwise(pos - n).cast("long")
    tag = F.when(adds, F.xxhash64("cols", edited)).otherwise(F.col("tag"))
    out = each.select("side", new_id.alias("id"), tag.alias("tag"), part.alias("part"), at.alias("place"), edited.alias("value"), F.when(adds, F.col("cols")).alias("cols"))
    return out.where("part is not null and (part <> 'added' or id is not null)")


#: Over the registered batches: base (id, tag, cols, text; each has its row number n) and changes. Parts of one-sided or equal changes are clean; of others the left state is taken.
_MERGE = """
WITH l AS (SELECT DISTINCT id, tag, part, place, value FROM changes WHERE side = 1 AND part <> 'added'),
r AS (SELECT DISTINCT id, tag, part, place, value FROM changes WHERE side = 2 AND part <> 'added'),
paired AS (SELECT coalesce(l.id, r.id) AS id, coalesce(l.tag, r.tag) AS tag, coalesce(l.part, r.part) AS part, coalesce(l.place, r.place) AS place,
    l.part IS NOT NULL AS in_l, r.part IS NOT NULL AS in_r, l.value AS lv, r.value AS rv, in_l AND in_r AND lv IS DISTINCT FROM rv AS conflict
  FROM l FULL JOIN r ON l.id IS NOT DISTINCT FROM r.id AND l.tag = r.tag AND l.part = r.part AND l.place = r.place),
sums AS (SELECT id, tag, bool_or(part = 'row' AND in_l) AS l_gone, bool_or(part = 'row' AND in_r) AS r_gone, bool_or(part <> 'row' AND in_l) AS l_edits, bool_or(part <> 'row' AND in_r) AS r_edits,
    count(*) FILTER (WHERE NOT conflict) AS clean, count(*) FILTER (WHERE conflict AND (part = 'column' OR part = 'line' AND lv IS NOT NULL AND rv IS NOT NULL)) AS edit_edit,
    count(*) FILTER (WHERE conflict AND part = 'line' AND (lv IS NULL OR rv IS NULL)) AS edit_delete, count(*) FILTER (WHERE conflict AND part = 'gap') AS insert_insert
  FROM paired GROUP BY id, tag),
judged AS (SELECT b.n, b.id, b.tag, b.cols, b.text, coalesce(l_gone, false) AS l_gone, coalesce(r_gone, false) AS r_gone, l_gone OR r_gone AS whole, NOT l_gone AND r_gone AND l_edits AS left_only,
    (l_gone AND NOT r_gone AND r_edits) OR (r_gone AND NOT l_gone AND l_edits) AS fight, s.clean, s.edit_edit, s.edit_delete, s.insert_insert
  FROM base b LEFT JOIN sums s ON b.id IS NOT DISTINCT FROM s.id AND b.tag = s.tag),
kept AS (SELECT n, id, tag, cols, text, coalesce(left_only, false) AS left_only FROM judged WHERE NOT coalesce(whole, false) OR left_only),
states AS (SELECT k.n, c.part, c.place, CASE WHEN in_l THEN lv ELSE rv END AS value FROM kept k JOIN paired c ON k.id IS NOT DISTINCT FROM c.id AND k.tag = c.tag WHERE c.part <> 'row' AND (in_l OR NOT left_only)),
split_lines AS (SELECT n, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM kept WHERE n IN (SELECT n FROM states WHERE part <> 'column')),
placed AS (SELECT x.n, x.place, 0 AS sub, CASE WHEN s.n IS NULL THEN x.line ELSE s.value END AS line FROM split_lines x LEFT JOIN states s ON s.n = x.n AND s.place = x.place AND s.part = 'line'
  UNION ALL SELECT n, place, 1, value FROM states WHERE part = 'gap'),
texts AS (SELECT n, coalesce(string_agg(line, chr(10) ORDER BY place, sub), '') AS text FROM placed GROUP BY n),
fields AS (SELECT n, map_from_entries(list((place, value))) AS new FROM states WHERE part = 'column' GROUP BY n),
added AS (SELECT side, id, cols, value, row_number() OVER (PARTITION BY side, id ORDER BY cols, value) AS k FROM (SELECT DISTINCT side, id, cols, value FROM changes WHERE part = 'added')),
new_rows AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN b.cols ELSE a.cols END AS cols, CASE WHEN a.id IS NULL THEN b.value ELSE a.value END AS text,
    coalesce(a.cols IS DISTINCT FROM b.cols OR a.value IS DISTINCT FROM b.value, false) AND a.id IS NOT NULL AND b.id IS NOT NULL AS conflict
  FROM (SELECT * FROM added WHERE side = 1) a FULL JOIN (SELECT * FROM added WHERE side = 2) b ON a.id = b.id AND a.k = b.k),
clashes AS (SELECT id, count(*) AS more FROM new_rows GROUP BY id)
SELECT r.id, CASE WHEN k.n IS NULL THEN NULL WHEN c.n IS NULL THEN r.cols ELSE list_transform(r.cols, lambda x, i: coalesce(c.new[i - 1], x)) END AS cols,
  CASE WHEN k.n IS NOT NULL THEN coalesce(t.text, r.text) END AS text,
  CASE WHEN whole THEN (NOT fight)::BIGINT ELSE coalesce(clean, 0) END AS n_clean, CASE WHEN whole THEN 0 ELSE coalesce(edit_edit, 0) END AS n_edit_edit,
  CASE WHEN whole THEN fight::BIGINT ELSE coalesce(edit_delete, 0) END AS n_edit_delete, (CASE WHEN whole THEN 0 ELSE coalesce(insert_insert, 0) END + coalesce(more, 0))::BIGINT AS n_insert_insert
FROM judged r LEFT JOIN kept k ON k.n = r.n LEFT JOIN texts t ON t.n = r.n LEFT JOIN fields c ON c.n = r.n LEFT JOIN clashes x ON x.id = r.id
UNION ALL SELECT id, cols, text, (NOT conflict)::BIGINT, 0, 0, conflict::BIGINT FROM new_rows WHERE id NOT IN (SELECT id FROM base WHERE id IS NOT NULL)
"""
_OUT = pa.schema([("id", pa.int64()), ("cols", pa.list_(pa.string())), ("text", pa.string()), *[(c, pa.int64()) for c in _COUNTS]])


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of a partition (an id's added rows, then for each of its tags the changes and the base rows) in tables of about `most` bytes that end between ids. An id of
    more rows is cut after a base row, and what comes next has its added rows and that row's changes, too."""
    held: list[pa.RecordBatch] = []
    size = carried = 0

    def ended(table: pa.Table) -> pa.Table:
        """Without the rows carried along, if no base row of their id has come."""
        if carried:
            side, known = table.column("side").to_numpy(), table.column("id").is_valid().to_numpy()
            ids = table.column("id").fill_null(0).to_numpy()
            if not ((side == 0) & (ids == ids[0]) & (known == known[0])).any():
                return table.slice(carried)
        return table

    for whole in batches:
        for batch in _pieces(whole, most):
            size += batch.nbytes
            held.append(batch)
            if size <= most:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            ids, unknown = table.column("id").fill_null(0).to_numpy(), table.column("id").is_null().to_numpy()
            same = (unknown == unknown[-1]) & (ids == ids[-1])
            if not same.all():
                end = len(ids) - int(np.argmin(same[::-1]))
                again = np.zeros(end, bool)
            else:
                side, tag = (table.column(c).to_numpy() for c in ("side", "tag"))
                rows = np.flatnonzero(side == 0)
                if not len(rows):
                    continue
                end = int(rows[-1]) + 1
                again = (side[:end] > 0) & ((tag[:end] == tag[end - 1]) | (table.column("part").to_numpy()[:end] == "added"))
            yield ended(table.slice(0, end))
            carried = int(again.sum())
            rest = pa.concat_tables([table.slice(0, end).filter(pa.array(again)), table.slice(end)]).combine_chunks()
            held = rest.to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield ended(pa.Table.from_batches(held))


def _pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    n = max(1, batch.num_rows * most // max(1, 4 * batch.nbytes))
    for i in range(0, batch.num_rows, n):
        yield pa.RecordBatch.from_arrays([c.take(pa.array(range(min(n, batch.num_rows - i)))) for c in batch.slice(i, n).columns], names=batch.schema.names)


def _merge(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as db:
            for table in _chunks(batches, most):
                side = table.column("side").to_numpy()
                base = table.filter(pa.array(side == 0)).select(["id", "tag", "cols", "value"]).rename_columns(["id", "tag", "cols", "text"])
                db.register("base", base.append_column("n", pa.array(np.arange(base.num_rows))))
                db.register("changes", table.filter(pa.array(side > 0)))
                out = db.sql(_MERGE).to_arrow_table().cast(_OUT)
                db.unregister("base")
                db.unregister("changes")
                yield from out.combine_chunks().to_batches()

    return run


def merged(rows: DataFrame, changes: DataFrame, most: int = 1 << 23) -> DataFrame:
    """id, cols, text, n_clean, n_edit_edit, n_edit_delete, n_insert_insert: tagged rows with both branches' CHANGES, one row for each of theirs and each id that was added.

    Columns, lines, the gaps after lines and whole added rows merge each by itself: changes of one branch, and equal ones of both, are clean; of others the left state is taken, a
    conflict. A dropped row counts alone: clean, or one edit-delete conflict if the other branch has changed columns, lines or gaps of it; then, too, the left state holds. Rows
    that are gone have null cols and text.

    Rows and changes are hash-partitioned by id in one shuffle: only what a branch has changed travels besides the base, and added rows come to where their new id is at
    home. A task sorts its rows by id and hands DuckDB about `most` bytes of them at a time, as Arrow tables: a full join of the branches' changes, then lines put together in
    order. So memory is bounded by `most` and the longest document, and a lost executor's partitions are made again from the shuffle.

    Rows that repeat an id merge each by itself, with the changes of its tag; those equal in all are alike and all stay. Rows without an id are dealt by their tag. An added row
    whose id the base has leaves the base's row as it is and counts as an insert-insert conflict; rows that one branch adds under one id stay apart, paired with the other's in
    their order. Empty tables give no rows."""
    both = rows.select(F.lit(0).alias("side"), "id", "tag", F.lit("base").alias("part"), F.lit(0).cast("long").alias("place"), F.col("text").alias("value"), "cols").unionByName(changes)
    dealt = both.repartition(F.coalesce("id", "tag")).sortWithinPartitions("id", F.col("part") != "added", "tag", F.desc("side"))
    return dealt.mapInArrow(_merge(most), "id long, cols array<string>, text string, " + ", ".join(f"{c} long" for c in _COUNTS))


def merge_branches(docs: DataFrame, columns: Sequence[str] = ("lang", "source"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the columns, text, and the counts of merged(): docs with its branches L and R (see edits). Other columns are no part of a version."""
    rows = tagged(docs, columns, id_col, text_col)
    out = merged(rows, edits(rows, columns))
    return out.select(F.col("id").alias(id_col), *[F.col("cols")[i].alias(c) for i, c in enumerate(columns)], F.col("text").alias(text_col), *_COUNTS)


def query(spark, sf_dir: str) -> DataFrame:
    out = merge_branches(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), *_COUNTS)


def _code(branch: str, name: str) -> str:
    return crc32_sql(f"('{branch}:' || doc_id || ':' || {name})") + " % 17"


def _sum(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


#: From the codes themselves, for documents whose ids are distinct, not null and not negative: a and b are those of L and R (0 drops, 1 and 2 edit, 3 and 4 add).
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
codes AS (SELECT *, {_code('L', "'row'")} AS a, {_code('R', "'row'")} AS b, {_code('L', "'lang'")} AS al, {_code('R', "'lang'")} AS bl, {_code('L', "'source'")} AS sl, {_code('R', "'source'")} AS sr FROM d),
cols AS (SELECT *, CASE al WHEN 0 THEN '' WHEN 1 THEN lang || '!' WHEN 2 THEN lang || '?' ELSE lang END AS l1, CASE bl WHEN 0 THEN '' WHEN 1 THEN lang || '!' WHEN 2 THEN lang || '?' ELSE lang END AS r1,
  CASE sl WHEN 0 THEN '' WHEN 1 THEN source || '!' WHEN 2 THEN source || '?' ELSE source END AS l2, CASE sr WHEN 0 THEN '' WHEN 1 THEN source || '!' WHEN 2 THEN source || '?' ELSE source END AS r2 FROM codes),
li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM d),
lc AS (SELECT *, {_code('L', 'k')} AS a, {_code('R', 'k')} AS b FROM li),
st AS (SELECT *, CASE WHEN a < 3 THEN a WHEN b < 3 THEN b END AS x, CASE WHEN a IN (3, 4) THEN a WHEN b IN (3, 4) THEN b END AS g, CASE WHEN a < 3 THEN a END AS xl, CASE WHEN a IN (3, 4) THEN a END AS gl FROM lc),
pc AS (SELECT *, CASE x WHEN 0 THEN NULL WHEN 1 THEN line || '!' WHEN 2 THEN line || '?' ELSE line END AS m, CASE g WHEN 3 THEN '!' WHEN 4 THEN '?' END AS mg,
  CASE xl WHEN 0 THEN NULL WHEN 1 THEN line || '!' WHEN 2 THEN line || '?' ELSE line END AS ml, CASE gl WHEN 3 THEN '!' WHEN 4 THEN '?' END AS mgl FROM st),
tx AS (SELECT doc_id, coalesce(string_agg(CASE WHEN m IS NOT NULL OR mg IS NOT NULL THEN concat_ws(chr(10), m, mg) END, chr(10) ORDER BY k), '') AS text,
  coalesce(string_agg(CASE WHEN ml IS NOT NULL OR mgl IS NOT NULL THEN concat_ws(chr(10), ml, mgl) END, chr(10) ORDER BY k), '') AS left_text,
  {_sum('x IS NOT NULL AND (a >= 3 OR b >= 3 OR a = b)')} + {_sum('g IS NOT NULL AND (a NOT IN (3, 4) OR b NOT IN (3, 4) OR a = b)')} AS clean,
  {_sum('a IN (1, 2) AND b IN (1, 2) AND a <> b')} AS ee, {_sum('a < 3 AND b < 3 AND a <> b AND (a = 0 OR b = 0)')} AS ed, {_sum('a IN (3, 4) AND b IN (3, 4) AND a <> b')} AS ii,
  bool_or(a < 5) AS le, bool_or(b < 5) AS re FROM pc GROUP BY doc_id),
f AS (SELECT c.*, t.text AS merged, left_text, clean, ee, ed, ii, le OR l1 <> lang OR l2 <> source AS le, re OR r1 <> lang OR r2 <> source AS re,
  CASE WHEN a = 0 THEN 'gone' WHEN b = 0 AND (le OR l1 <> lang OR l2 <> source) THEN 'left' WHEN b = 0 THEN 'gone' ELSE 'both' END AS how FROM cols c JOIN tx t USING (doc_id)),
ad AS (SELECT coalesce(x.id, y.id) AS id, CASE WHEN x.id IS NULL THEN y.v ELSE x.v END AS v, x.id IS NOT NULL AND y.id IS NOT NULL AND x.v <> y.v AS fight
  FROM (SELECT -1 - doc_id AS id, {{'l': lang, 's': source, 't': CASE a WHEN 3 THEN '!' ELSE '?' END}} AS v FROM codes WHERE a IN (3, 4)) x
  FULL JOIN (SELECT -5 - doc_id AS id, {{'l': lang, 's': source, 't': CASE b WHEN 3 THEN '!' ELSE '?' END}} AS v FROM codes WHERE b IN (3, 4)) y ON x.id = y.id)
SELECT doc_id, CASE how WHEN 'left' THEN l1 WHEN 'both' THEN CASE WHEN l1 <> lang THEN l1 ELSE r1 END END AS lang, CASE how WHEN 'left' THEN l2 WHEN 'both' THEN CASE WHEN l2 <> source THEN l2 ELSE r2 END END AS source,
  CASE how WHEN 'left' THEN sha256(left_text) WHEN 'both' THEN sha256(merged) END AS text_sha256,
  CASE WHEN how = 'both' THEN clean + (l1 <> lang OR r1 <> lang)::INT - (l1 <> lang AND r1 <> lang AND l1 <> r1)::INT + (l2 <> source OR r2 <> source)::INT - (l2 <> source AND r2 <> source AND l2 <> r2)::INT
    ELSE (how = 'gone' AND (a = b OR a = 0 AND NOT re OR b = 0))::INT END::BIGINT AS n_clean,
  CASE WHEN how = 'both' THEN ee + (l1 <> lang AND r1 <> lang AND l1 <> r1)::INT + (l2 <> source AND r2 <> source AND l2 <> r2)::INT ELSE 0 END::BIGINT AS n_edit_edit,
  CASE WHEN how = 'both' THEN ed ELSE (how = 'left' OR a = 0 AND b <> 0 AND re)::INT END::BIGINT AS n_edit_delete, CASE WHEN how = 'both' THEN ii ELSE 0 END::BIGINT AS n_insert_insert FROM f
UNION ALL SELECT id, v.l, v.s, sha256(v.t), (NOT fight)::BIGINT, 0, 0, fight::BIGINT FROM ad
"""
