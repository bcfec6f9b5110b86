"""Operator 12: a Merkle manifest of a dataset, with an authentication path for every row.

Leaves are hashed where the rows lie; from then on a row is its digest, its key and what it
carries. Rows are sorted over all tasks, numbered within their group by offsets of the tasks, and
dealt into aligned blocks of 3**HEIGHT leaves, so neither a group nor a hot group is ever in one
place. A block's root is its treehash; the blocks' roots are the leaves of the next forest, until
every group has one block. The groups' roots, in order, make one more forest of the same kind.

Within a block paths are scheduled: at each height the current run of three nodes is held, and a
treehash stack prepares the next run from the leaves ahead. At every leaf the stacks share as many
steps as there are heights, each step going to the stack whose lowest unfinished node is lowest,
so a run is ready when the walk comes to it and the nodes held grow with the height, not with the
leaves. The path above the block is one for all its leaves and is appended from the forest above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm.common import crc_mod, trim
from glossa.session import cut

#: Nodes of a run, and the height of an aligned block: 2,187 leaves, what a task holds at once.
ARITY, HEIGHT = 3, 7
PATH = "array<struct<place:int,siblings:array<string>>>"


def parent(children: list[bytes]) -> bytes:
    """The digest, as hex, of the children's digests as hex."""
    return hashlib.sha256(b"".join(children)).hexdigest().encode()


def height_of(n: int) -> int:
    """Levels of runs above n nodes."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


class Treehash:
    """Consumes leaves [start, end) and gives the nodes of one height above them; a last run of fewer than three counts as a run."""

    def __init__(self, leaves: list[bytes], height: int, start: int, end: int):
        self.leaves, self.height, self.at, self.end = leaves, height, start, end
        self.open: list[list[bytes]] = [[] for _ in range(height)]
        self.nodes: list[bytes] = []

    def _put(self, h: int, node: bytes) -> None:
        while h < self.height:
            self.open[h].append(node)
            if len(self.open[h]) < ARITY:
                return
            node, self.open[h], h = parent(self.open[h]), [], h + 1
        self.nodes.append(node)

    def step(self) -> None:
        self._put(0, self.leaves[self.at])
        self.at += 1
        if self.at == self.end:
            for h in range(self.height):
                if self.open[h]:
                    node, self.open[h] = parent(self.open[h]), []
                    self._put(h + 1, node)

    @property
    def done(self) -> bool:
        return self.at >= self.end

    @property
    def low(self) -> int:
        """The height of the lowest unfinished node; before and between nodes, the height wanted."""
        return next((h for h, nodes in enumerate(self.open) if nodes), self.height)

    @property
    def held(self) -> int:
        return len(self.nodes) + sum(map(len, self.open))

    def finish(self) -> list[bytes]:
        while not self.done:
            self.step()
        return self.nodes


def root_of(leaves: list[bytes], height: int) -> bytes:
    return Treehash(leaves, height, 0, len(leaves)).finish()[0]


def paths(leaves: list[bytes], height: int, watch: dict | None = None) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Each leaf's path, leaf by leaf: at every height its place in the run of up to three and the others of the run.

    watch, if given, gets the most nodes held at once and the steps that were taken late.
    """
    n = len(leaves)

    def run(h: int, r: int) -> Treehash:
        size = ARITY ** (h + 1)
        return Treehash(leaves, h, min(r * size, n), min((r + 1) * size, n))

    now = [run(h, 0).finish() for h in range(height)]
    ahead = [run(h, 1) for h in range(height)]
    for i in range(n):
        path, at = [], i
        for h in range(height):
            place = at % ARITY
            path.append((place, now[h][:place] + now[h][place + 1 :]))
            at //= ARITY
        yield path
        for h in range(height):
            size = ARITY ** (h + 1)
            if (i + 1) % size:
                break
            if i + 1 < n:
                if watch is not None:
                    watch["late"] = watch.get("late", 0) + ahead[h].end - ahead[h].at
                now[h] = ahead[h].finish()
                ahead[h] = run(h, (i + 1) // size + 1)
        for _ in range(height):
            waiting = [s for s in ahead if not s.done]
            if not waiting:
                break
            min(waiting, key=lambda s: s.low).step()
        if watch is not None:
            watch["held"] = max(watch.get("held", 0), sum(map(len, now)) + sum(s.held for s in ahead))


def _hexed(raw: pa.Array) -> list[bytes]:
    return [v.hex().encode() for v in raw.to_pylist()]


def _pack(full: int):
    """One aligned block: its rows in order and its root."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["ord"].to_numpy(), kind="stable"))).combine_chunks()
        leaves = _hexed(table["digest"])
        total = table["total"][0].as_py()
        kept = pa.concat_arrays(table["kept"].chunks)
        root = root_of(leaves, full if total > ARITY**full else height_of(total))
        cells = [pa.array([key[0].as_py()], pa.binary()), pa.array([key[1].as_py()]), pa.array([total]), pa.ListArray.from_arrays(pa.array([0, len(leaves)], pa.int32()), kept), pa.array([b"".join(table["digest"].to_pylist())], pa.binary()), pa.array([bytes.fromhex(root.decode())], pa.binary())]
        return pa.table(cells, ["g", "block", "total", "kept", "digests", "root"])

    return run


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with ord, a row's place in its group by keys, and total, the group's rows. Equal keys: in any, but a fixed, order."""
    before = cut(rows).withColumn("tie", F.monotonically_increasing_id())
    by = ["g", *keys, "tie"]
    placed = cut(before.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie").withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("task", F.shiftright("at", 33))
    runs = placed.groupBy("g", "task").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = F.sum("n").over(W.partitionBy("g").orderBy("task")) - F.col("n")
    runs = runs.select("g", "task", "first", earlier.alias("earlier"), F.sum("n").over(W.partitionBy("g")).alias("total"))
    return placed.join(runs, ["g", "task"]).withColumn("ord", F.col("at") - F.col("first") + F.col("earlier")).drop("at", "task", "first", "earlier")


def _forest(rows: DataFrame, keys: list[str], height: int) -> tuple[list[DataFrame], DataFrame]:
    """(blocks of each level, (g, top) of each group). rows: g, kept, digest and the keys that order a group."""
    levels, tops, size = [], None, ARITY**height
    numbered = _numbered(rows, keys)
    while True:
        kept = T.StructField("kept", T.ArrayType(numbered.schema["kept"].dataType))
        schema = T.StructType([*T.StructType.fromDDL("g binary, block long, total long").fields, kept, *T.StructType.fromDDL("digests binary, root binary").fields])
        blocks = numbered.select("g", F.expr(f"ord div {size}").alias("block"), "ord", "total", "kept", "digest")
        levels.append(cut(blocks.groupBy("g", "block").applyInArrow(_pack(height), schema)))
        found = levels[-1].where(F.col("total") <= size).select("g", F.col("root").alias("top"))
        tops = found if tops is None else tops.unionByName(found)
        above = levels[-1].where(F.col("total") > size)
        if above.isEmpty():
            return levels, tops
        numbered = above.select("g", F.col("block").alias("ord"), F.expr(f"(total + {size - 1}) div {size}").alias("total"), F.struct(F.lit(True).alias("node")).alias("kept"), F.col("root").alias("digest"))


def _walk(full: int):
    """Blocks with their leaves and the leaves' paths inside the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                kept = row.column("kept").flatten()
                raw, total = row.column("digests")[0].as_py(), row.column("total")[0].as_py()
                leaves = [raw[a : a + 32].hex().encode() for a in range(0, len(raw), 32)]
                height = full if total > ARITY**full else height_of(total)
                places, width, siblings = [], [0], []
                for path in paths(leaves, height):
                    for place, others in path:
                        places.append(place)
                        siblings += others
                        width.append(len(siblings))
                steps = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.ListArray.from_arrays(pa.array(width, pa.int32()), pa.array([s.decode() for s in siblings], pa.string()))], ["place", "siblings"])
                path = pa.ListArray.from_arrays(pa.array(np.arange(len(leaves) + 1) * height, pa.int32()), steps)
                items = pa.StructArray.from_arrays([kept, pa.array([v.decode() for v in leaves], pa.string()), path], ["kept", "leaf", "path"])
                yield pa.RecordBatch.from_arrays([row.column("g"), row.column("block"), pa.ListArray.from_arrays(pa.array([0, len(leaves)], pa.int32()), items)], ["g", "block", "leaves"])
            trim()

    return run


def _descend(levels: list[DataFrame], shared: DataFrame, height: int) -> DataFrame:
    """(g, kept, leaf, path and the other columns of shared): every leaf's whole path. shared: g, path above the group's top, and more."""
    more = [c for c in shared.columns if c not in ("g", "path")]
    above, size = None, ARITY**height
    for k in range(len(levels) - 1, -1, -1):
        blocks = levels[k]
        last = blocks.where(F.col("total") <= size).select("g", "block").join(shared, "g")
        above = last if above is None else last.unionByName(above)
        schema = T.StructType([*blocks.select("g", "block").schema.fields, T.StructField("leaves", T.ArrayType(T.StructType([T.StructField("kept", blocks.schema["kept"].dataType.elementType), *T.StructType.fromDDL(f"leaf string, path {PATH}").fields])))])
        inside = blocks.select("g", "block", "total", "kept", "digests").mapInArrow(_walk(height), schema)
        joined = inside.join(above.withColumnRenamed("path", "upper"), ["g", "block"])
        leaves = joined.select("g", "block", "upper", *more, F.posexplode("leaves").alias("nth", "item"))
        whole = F.concat("item.path", "upper").alias("path")
        if not k:
            return leaves.select("g", "item.kept", "item.leaf", whole, *more)
        above = leaves.select("g", (F.col("block") * size + F.col("nth")).alias("block"), whole, *more)


def _fields(columns):
    """Each value as `-` if null, else its bytes' count, a colon, and itself."""
    text = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text])


def leaf_digest(*columns):
    """A row's digest, hex, from its columns."""
    return F.sha2(_fields(columns).cast("binary"), 256)


def fold(leaf, path):
    """The root that a leaf, hex, and its path lead to."""
    lay = lambda acc, s: F.concat(F.slice(s["siblings"], F.lit(1), s["place"]), F.array(acc), F.slice(s["siblings"], s["place"] + 1, F.size(s["siblings"])))
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.array_join(lay(acc, s), "").cast("binary"), 256))


def manifest(rows: DataFrame, id_col: str, group: str, leaf, carry: dict | None = None, height: int = HEIGHT) -> DataFrame:
    """(id, group, leaf, subroot, root, path, carried columns): the manifest of rows, hashed by the expression `leaf`.

    The group's leaves ascend by id, null first, rows of one id by their digests; groups ascend by
    their UTF-8 bytes, null first. path: from the leaf up, at every level the leaf's or node's
    place and the siblings' digests. Rows that repeat are leaves of their own. An empty table
    gives no rows. carry: further columns, by name, as expressions over rows. The columns are
    named id, group, leaf, subroot, root and path; carried ones come as a struct `carried`.
    """
    carried = F.struct(*[v.alias(k) for k, v in carry.items()]) if carry else F.struct(F.lit(True).alias("none"))
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).cast("binary")
    narrow = rows.select(g.alias("g"), F.col(id_col).alias("order"), F.struct(F.col(id_col).alias("id"), F.col(group).alias("group"), carried.alias("carried")).alias("kept"), F.unhex(leaf).alias("digest"))
    levels, tops = _forest(narrow, ["order", "digest"], height)
    groups = tops.select(F.lit(b"").alias("g"), F.col("g").alias("order"), F.struct(F.col("g").alias("group")).alias("kept"), F.col("top").alias("digest"))
    above, root = _forest(groups, ["order"], height)
    end = root.select("g", F.lower(F.hex("top")).alias("root"), F.expr(f"cast(array() as {PATH})").alias("path"))
    shared = cut(_descend(above, end, height).select(F.col("kept.group").alias("g"), F.col("leaf").alias("subroot"), "path", "root"))
    found = _descend(levels, shared, height)
    return found.select("kept.id", "kept.group", "leaf", "subroot", "root", "path", "kept.carried")


def query(spark, sf_dir):
    """op12: the manifest of documents, and what a deleted line end does to it (null ids: nothing is deleted)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = ["doc_id", "source", "lang", "n_chars"]
    even = F.col("doc_id").isNotNull() & (crc_mod("doc_id", 2) == 0) & F.contains("text", F.lit("\n"))
    changed = F.when(even, F.unhex(leaf_digest(*[F.col(c) for c in columns], F.translate("text", "\n", ""))))
    found = manifest(docs, "doc_id", "source", leaf_digest(*[F.col(c) for c in columns], F.col("text")), {"changed": changed})
    proof = F.sha2(F.array_join(F.flatten(F.transform("path", lambda s: s["siblings"])), "").cast("binary"), 256)
    found = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.coalesce(F.lower(F.hex("carried.changed")), F.col("leaf")), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = """with recursive crc(i, c, k) as (select i::bigint, i::bigint, 0 from range(256) t(i) union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc where k < 8),
 tab as (select list(c order by i) as t from crc where k = 8),
 odd as (select d.*, doc_id is not null and xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 as tampered from documents d, tab),
 net as (select doc_id, source, tampered, text,
   coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head from odd),
 leaves as materialized (select doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
   case when tampered then sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) end as changed from net),
 placed as materialized (select row_number() over () as r, *, (row_number() over (partition by source order by doc_id nulls first, leaf) - 1)::bigint as o from leaves),
 groups as (select source, count(*) as n from placed group by source),
 up(source, level, o, h, n) as (select p.source, 0, o, leaf, n from placed p join groups g on p.source is not distinct from g.source
  union all select source, level + 1, o // 3, sha256(string_agg(h, '' order by o)), (n + 2) // 3 from up where n > 1 group by source, level, o // 3, n),
 nodes as materialized (select * from up),
 tops as materialized (select source, h, (row_number() over (order by source nulls first) - 1)::bigint as o, count(*) over () as n from nodes where n = 1),
 over_(level, o, h, n) as (select 0, o, h, n from tops union all select level + 1, o // 3, sha256(string_agg(h, '' order by o)), (n + 2) // 3 from over_ where n > 1 group by level, o // 3, n),
 high as materialized (select * from over_),
 sib as (select p.r, a.level, s.o % 3 as place, s.h from placed p join (select distinct source, level, n from nodes where n > 1) a on a.source is not distinct from p.source
    join nodes s on s.source is not distinct from a.source and s.level = a.level and s.o // 3 = (p.o // (3 ** a.level)::bigint) // 3 and s.o <> p.o // (3 ** a.level)::bigint
  union all select p.r, 1000 + a.level, s.o % 3, s.h from placed p join tops t on t.source is not distinct from p.source, (select distinct level, n from high where n > 1) a
    join high s on s.level = a.level and s.o // 3 = (t.o // (3 ** a.level)::bigint) // 3 and s.o <> t.o // (3 ** a.level)::bigint),
 steps as (select p.r, a.level, row_number() over (partition by p.r order by a.level) as k, (o // (3 ** a.level)::bigint) % 3 as place from placed p join (select distinct source, level from nodes where n > 1) a on a.source is not distinct from p.source
  union all select p.r, 1000 + a.level, 500 + row_number() over (partition by p.r order by a.level), (t.o // (3 ** a.level)::bigint) % 3 from placed p join tops t on t.source is not distinct from p.source, (select distinct level from high where n > 1) a),
 run as materialized (select s.r, row_number() over (partition by s.r order by s.level) as k,
   coalesce(string_agg(b.h, '' order by b.place) filter (b.place < s.place), '') as lo, coalesce(string_agg(b.h, '' order by b.place) filter (b.place > s.place), '') as hi
   from steps s left join sib b on b.r = s.r and b.level = s.level group by s.r, s.level),
 fold(r, k, h) as (select r, 0, coalesce(changed, leaf) from placed union all select f.r, f.k + 1, sha256(lo || f.h || hi) from fold f join run on run.r = f.r and run.k = f.k + 1),
 proofs as (select r, string_agg(lo || hi, '' order by k) as proof from run group by r)
select p.doc_id, p.leaf, t.h as subroot, (select h from high where n = 1) as root, sha256(coalesce(proof, '')) as proof_sha256,
  f.h as folded_root, f.h = (select h from high where n = 1) as verified
from placed p join tops t on t.source is not distinct from p.source left join proofs using (r)
 join (select r, arg_max(h, k) as h from fold group by r) f on f.r = p.r"""
