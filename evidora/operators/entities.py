"""Entities by an Aho-Corasick automaton over a dictionary from a table: leftmost-longest, at word boundaries."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora.functions.text import tokens
from evidora.operators.links import cut

#: Characters of names that one automaton holds (some 30 bytes of memory each); more names are more automata, one after another.
AUTOMATON_CHARS = 1 << 20


def normal(text: Column) -> Column:
    """The tokens of a text parted by single spaces, with one at either end: what stands between spaces is whole words."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def _build(table: pa.Table) -> pa.Table:
    import ahocorasick

    a = ahocorasick.Automaton()
    for name in table.column("name").to_pylist():
        a.add_word(name, (name.count(" ") - 1, name[1:-1]))
    a.make_automaton()
    return pa.table({"part": table.column("part")[:1], "automaton": pa.array([pickle.dumps(a)], pa.binary())})


def automata(names: DataFrame, name_col: str = "name", most: int = AUTOMATON_CHARS) -> tuple[DataFrame, int]:
    """part, automaton: the dictionary (any rows; nulls and names without a token are none) dealt by hash into automata of about `most` characters, each built by a task and
    pickled; and their number. Written down in the shared folder."""
    distinct = cut(names.select(normal(F.col(name_col)).alias("name")).where(F.length("name") > 2).distinct(), "names")
    parts = -(-(distinct.agg(F.sum(F.length("name"))).first()[0] or 0) // most)
    dealt = distinct.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(max(1, parts))).cast("int"))
    return cut(dealt.groupBy("part").applyInArrow(_build, "part int, automaton binary"), "automata"), parts


_loaded: dict[str, object] = {}


def _matches(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _loaded:  # once a worker
            _loaded.clear()
            _loaded[key] = pickle.loads(shared.value)
        a = _loaded[key]
        for batch in batches:
            row, pos, size, name = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                at = seen = 0
                best: dict[int, tuple[int, str]] = {}
                for end, (n, found) in a.iter(text):
                    seen += text.count(" ", at, end)  # spaces before the one that ends the name
                    at = end
                    best[seen - n] = max(best.get(seen - n, (0, "")), (n, found))
                for p, (n, found) in best.items():
                    row.append(i)
                    pos.append(p)
                    size.append(n)
                    name.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(pos, pa.int64()), pa.array(size, pa.int64()), pa.array(name, pa.string())], names=["id", "pos", "n", "entity"])

    return run


def recognised(texts: DataFrame, names: DataFrame, id_cols: tuple[str, ...] = ("item_id",), text_col: str = "text", name_col: str = "name", most: int = AUTOMATON_CHARS) -> DataFrame:
    """The id columns, pos, entity: the names in each text, leftmost first, of those that start together the longest, none within another. pos counts tokens from 0.

    Each automaton is built once, by a task from its part of the dictionary's table, written to a file, and shared with all tasks by Spark's broadcast, one at a time: that much is
    in the driver's and a worker's memory, however large the dictionary is. A pass over the texts finds the longest of an automaton's names at each place, and
    what the passes find meets per text before the choice. Null and empty texts have no entities, rows with equal ids are one text each."""
    sc = texts.sparkSession.sparkContext
    rows = texts.select(F.struct(*id_cols, F.monotonically_increasing_id().alias("_row")).alias("id"), normal(F.col(text_col)).alias("text")).where("text is not null")
    schema = rows.schema["id"].dataType.simpleString()
    built, parts = automata(names, name_col, most)
    found = None
    for part in range(parts):
        for r in built.where(F.col("part") == part).collect():  # one row, unless the part has no name
            shared = sc.broadcast(bytes(r["automaton"]))
            one = cut(rows.mapInArrow(_matches(shared, uuid.uuid4().hex), f"id {schema}, pos long, n long, entity string"), "entities")
            shared.destroy()
            found = one if found is None else found.unionByName(one)
    if found is None:
        return texts.select(*id_cols, F.lit(0).cast("long").alias("pos"), F.lit("").alias("entity")).limit(0)
    lists = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", (-F.col("n")).alias("m"), "entity"))).alias("m"))  # the finds of one text
    start = F.struct(F.lit(0).cast("long").alias("free"), F.array().cast("array<struct<pos:bigint,entity:string>>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        kept = F.concat(s["kept"], F.array(F.struct(x["pos"].alias("pos"), x["entity"].alias("entity"))))
        return F.when(x["pos"] >= s["free"], F.struct((x["pos"] - x["m"]).alias("free"), kept.alias("kept"))).otherwise(s)

    chosen = lists.select("id", F.explode(F.aggregate("m", start, step)["kept"]).alias("x"))
    return chosen.select(*[F.col(f"id.{c}").alias(c) for c in id_cols], "x.pos", "x.entity")
