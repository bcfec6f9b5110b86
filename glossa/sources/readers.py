"""Readers that keep bad rows as errors, and grammars of lexical files. All are Spark scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.sources import ranges

MIB = 1 << 20


def read_lexicon_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """`TRAD SIMP [pinyin] /def/def/` lines as rows; others are left out. A gzip file is read by read.text as it is."""
    pattern = r"^(\S+) (\S+) \[([^\]]+)\] /(.+)/$"
    line = F.regexp_replace(col, r"\s+$", "")
    return lines.where(line.rlike(pattern)).select(
        F.regexp_extract(line, pattern, 1).alias("traditional"), F.regexp_extract(line, pattern, 2).alias("simplified"), F.regexp_extract(line, pattern, 3).alias("pinyin"),
        F.split(F.regexp_extract(line, pattern, 4), "/").alias("definitions"))


def header_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Comment lines."""
    return lines.where(F.col(col).startswith("#"))


def parse_json_lines(lines: DataFrame, schema: str, col: str = "value", most: int = MIB, keep: list[str] | None = None) -> DataFrame:
    """(row, error) of each non-blank line, after the columns to keep; error is oversized-record or malformed-json, with a null row."""
    bare = F.regexp_replace(col, "^﻿", "")
    fields = T.StructType.fromDDL(schema).add("__corrupt", T.StringType())
    parsed = F.from_json(bare, fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    error = F.when(F.octet_length(col) > most, "oversized-record").when(F.get_json_object(bare, "$").isNull(), "malformed-json")
    kept = F.struct(*[F.col("__p")[f.name].alias(f.name) for f in fields if f.name != "__corrupt"])
    rows = lines.where(F.trim(col) != "").select(*(keep or []), parsed.alias("__p"), error.alias("error"))
    return rows.select(*(keep or []), F.when(F.col("error").isNull(), kept).alias("row"), "error")


def read_json_array(spark: SparkSession, path: str, schema: str, most: int = MIB, part: int = ranges.PART) -> DataFrame:
    """(row, error) of the elements of JSON array files; error is oversized-record or malformed-json, with a
    null row. Files are read by byte ranges (`ranges.array_elements`); one that is no array, is cut short, or goes on after its end fails."""
    values = ranges.array_elements(spark, path, most, part)
    fields = T.StructType.fromDDL(schema)
    error = F.when(F.col("large"), "oversized-record").when(F.get_json_object("value", "$").isNull(), "malformed-json")
    rows = values.select(F.from_json("value", fields).alias("row"), error.alias("error"))
    return rows.select(F.when(F.col("error").isNull(), F.col("row")).alias("row"), "error")


def tar_glosses(lines: DataFrame) -> DataFrame:
    """(synset, gloss) of the data lines of an archive's members `.../data.<part of speech>` (lines: member, line); the
    synset is its offset with the letter of its part of speech."""
    letter = F.create_map(*[F.lit(x) for x in ("noun", "n", "verb", "v", "adj", "a", "adv", "r")])
    kind = letter[F.regexp_extract("member", r"/data\.(\w+)$", 1)]
    rows = lines.where(F.col("line").rlike(r"^\d{8} ") & kind.isNotNull())
    return rows.select(F.concat_ws("-", F.substring("line", 1, 8), kind).alias("synset"), F.trim(F.regexp_extract("line", r"\|(.*)$", 1)).alias("gloss"))


def read_json_map(lines: DataFrame, col: str, key: str, value: str) -> DataFrame:
    """One row a pair of JSON objects of strings."""
    return lines.select(F.explode(F.from_json(col, "map<string,string>")).alias(key, value))


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """RFC-style quoted rows with a header; a row of another arity comes back with its text in `malformed`."""
    full = T.StructType.fromDDL(schema).add("malformed", T.StringType())
    return spark.read.schema(full).csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="malformed")


def read_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """By extension; an unknown one is an error."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("jsonl", "ndjson"):
        return parse_json_lines(spark.read.text(path), schema)
    if kind == "json":
        return read_json_array(spark, path, schema)
    if kind in ("csv", "tsv"):
        return read_delimited(spark, path, schema, "\t" if kind == "tsv" else ",")
    raise ValueError(f"unsupported format: {kind}")


def read_commented_tsv(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """A table with `#` comments whose cells are not blank and whose keys are unique; else an error."""
    df = spark.read.schema(schema).csv(path, sep="\t", comment="#", mode="FAILFAST")
    blank = F.lit(False)
    for c in df.columns:
        blank = blank | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    if df.where(blank).limit(1).count() or df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError("a cell is blank or a key is not unique")
    return df


def wordnet_tab(lines: DataFrame, field: str, col: str = "value") -> DataFrame:
    """(synset, lemma) of `synset TAB field TAB lemma` lines of a field, underscores as spaces, lower case."""
    parts = F.split(col, "\t")
    rows = lines.where(~F.col(col).startswith("#")).select(parts.alias("p")).where((F.size("p") >= 3) & (F.get("p", F.lit(1)) == field))
    return rows.select(F.get("p", F.lit(0)).alias("synset"), F.lower(F.replace(F.get("p", F.lit(2)), F.lit("_"), F.lit(" "))).alias("lemma"))


def wordnet_data(lines: DataFrame, col: str = "value") -> DataFrame:
    """(offset, lexfile, words, parents, gloss) of fixed-grammar data lines: a hexadecimal count of words with stride
    2, then a decimal count of pointers with stride 4; parents are the pointers marked @."""
    f = F.split(F.regexp_extract(col, r"^([^|]*)", 1), " ")
    n = F.conv(F.get(f, F.lit(3)), 16, 10).cast("int")
    words = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(f, 4 + 2 * i)))
    at = 4 + 2 * n
    m = F.get(f, at).cast("int")
    pointers = F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.struct(F.get(f, at + 1 + 4 * i).alias("kind"), F.get(f, at + 2 + 4 * i).alias("target"))))
    parents = F.transform(F.filter(F.coalesce(pointers, F.array().cast("array<struct<kind:string,target:string>>")), lambda p: p["kind"] == "@"), lambda p: p["target"])
    return lines.where(F.col(col).rlike(r"^\d{8} ")).select(F.get(f, F.lit(0)).alias("offset"), F.get(f, F.lit(1)).alias("lexfile"), words.alias("words"), parents.alias("parents"), F.trim(F.regexp_extract(col, r"\|\s*(.*)$", 1)).alias("gloss"))


def tar_members(files: DataFrame) -> DataFrame:
    """(archive, member, content) of tar files (path, content), as `read.format("binaryFile")` gives them; a member at a time."""
    import io
    import tarfile

    import pandas as pd

    def unpack(parts):
        for pdf in parts:
            for p, raw in zip(pdf["path"], pdf["content"]):
                with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                    for m in t:
                        if m.isfile():
                            yield pd.DataFrame({"archive": [p], "member": [m.name], "content": [t.extractfile(m).read()]})

    return files.select("path", "content").mapInPandas(unpack, "archive string, member string, content binary")


def flatten_senses(df: DataFrame, word: str, senses: str, drop_tags: str) -> DataFrame:
    """One row a gloss of nested senses, without senses that are forms or carry a tag to drop."""
    s = df.select(word, F.explode(senses).alias("s"))
    tags = F.array_join(F.coalesce("s.tags", F.array().cast("array<string>")), " ")
    kept = s.where(F.col("s.form_of").isNull() & ~tags.rlike(drop_tags))
    return kept.select(word, F.explode("s.glosses").alias("gloss"), F.col("s.tags").alias("tags"))


def oriented(df: DataFrame, english: list[str], other: list[str]) -> DataFrame:
    """(english, other) from the first of several columns on either side; a list gives a row an element."""
    def pick(names: list[str]):
        return F.coalesce(*[F.col(n) for n in names if n in df.columns])

    o = [n for n in other if n in df.columns]
    lists = [n for n in o if isinstance(df.schema[n].dataType, T.ArrayType)]
    value = F.coalesce(*[F.col(n) if n in lists else F.array(F.col(n)) for n in o])
    return df.select(pick(english).alias("english"), F.explode(value).alias("other")).where("english is not null and other is not null")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files of a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def changed_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(path, change) of files that are not as a manifest (path, length, sha256) says: changed, missing or added."""
    now = inventory(spark, path).select("path", F.col("sha256").alias("__now"))
    both = manifest.select("path", F.col("sha256").alias("__then")).join(now, "path", "full_outer")
    change = F.when(F.col("__then").isNull(), "added").when(F.col("__now").isNull(), "missing").when(F.col("__then") != F.col("__now"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def restore(snapshots: DataFrame, schema: str, key: str, expected: int) -> DataFrame:
    """The rows of snapshots (`store.snapshots`); fails if a payload is not what its SHA-256 says, holds another number
    of rows, a batch is missing or twice, keys repeat, or the rows are not `expected` in all."""
    rows = snapshots.withColumn("__rows", F.from_json("payload", F.lit(f"array<struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in T.StructType.fromDDL(schema))}>>")))
    bad = F.count_if((F.sha2("payload", 256) != F.col("sha256")) | (F.size("__rows") != F.col("records")))
    told = rows.agg(bad.alias("bad"), F.count("*").alias("n"), F.count_distinct("batch").alias("batches"), F.coalesce(F.max("batch") + 1, F.lit(0)).alias("last"), F.sum("records").alias("records")).first()
    if told["bad"] or told["n"] != told["batches"] or told["n"] != told["last"] or (told["records"] or 0) != expected:
        raise ValueError("a snapshot is not what its checkpoint says")
    out = rows.select("batch", F.posexplode("__rows").alias("place", "row")).select("batch", "place", "row.*")
    if out.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("a key stands in two snapshots")
    return out
