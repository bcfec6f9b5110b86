"""Source and sink queries: parsing of text columns, and round trips through files in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glossa.operators import store
from glossa.plans.registry import query
from glossa.session import ensure_checkpoint_dir, table
from glossa.sources import ranges
from glossa.sources import readers as r


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


@query("source_lexicon_lines", "S01 S02", """
SELECT p_type AS traditional, p_brand AS simplified, 'pin1 yin1' AS pinyin, 2 AS n, p_name AS first_def FROM (SELECT replace(p_type, ' ', '_') AS p_type, p_brand, p_name, p_partkey FROM part) WHERE p_partkey % 3 <> 0""")
def _(spark, d):
    p = table(spark, d, "part")
    line = F.concat(F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(" "), "p_brand", F.lit(" [pin1 yin1] /"), "p_name", F.lit("/second/ "))
    lines = p.select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value"))
    rows = r.read_lexicon_lines(lines)
    return rows.select("traditional", "simplified", "pinyin", F.size("definitions").alias("n"), F.get("definitions", F.lit(0)).alias("first_def"))


@query("source_comment_lines", "S02", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE starts_with(l, '#') OR starts_with(l, 'T') GROUP BY doc_id")
def _(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    lines = lines.withColumn("value", F.regexp_replace("value", "^T", "#"))
    return r.header_lines(lines).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("source_json_lines", "S04", """
SELECT event_id, CASE WHEN event_id % 5 = 1 THEN 'malformed-json' WHEN event_id % 5 = 2 THEN 'oversized-record' END AS error, CASE WHEN event_id % 5 NOT IN (1, 2) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def _(spark, d):
    k = F.col("event_id") % 5
    e = table(spark, d, "events").select("event_id", F.when(k == 1, F.concat(F.lit("{"), "props")).when(k == 2, F.concat("props", F.repeat(F.lit(" "), 60))).otherwise(F.col("props")).alias("value"))
    # ids travel inside the line, so each line's own error comes from the reader
    lines = e.select(F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"p":'), "value", F.lit("}")).alias("value"), "event_id")
    parsed = r.parse_json_lines(lines, "id bigint, p struct<k:bigint>", most=70, keep=["event_id"])
    return parsed.select("event_id", "error", F.col("row.p.k").alias("k"))


@query("source_files_round_trip", "S07 S08 K02", "SELECT 'json' AS format, count(*) AS n, 0::BIGINT AS lost FROM nation UNION ALL SELECT 'csv', count(*), 0 FROM nation UNION ALL SELECT 'tsv', count(*), 0 FROM nation UNION ALL SELECT 'parquet', count(*), 0 FROM nation")
def _(spark, d):
    n, folder = table(spark, d, "nation"), _folder(spark)
    n.write.json(f"{folder}/a.json")
    n.write.csv(f"{folder}/a.csv", header=True, quote='"', escape='"')
    n.write.csv(f"{folder}/a.tsv", header=True, sep="\t", quote='"', escape='"')
    n.write.parquet(f"{folder}/a.parquet")
    schema = "n_nationkey int, n_name string, n_regionkey int"
    back = {"json": spark.read.schema(schema).json(f"{folder}/a.json"), "csv": r.read_any(spark, f"{folder}/a.csv", schema).where("malformed is null").drop("malformed"),
            "tsv": r.read_any(spark, f"{folder}/a.tsv", schema).where("malformed is null").drop("malformed"), "parquet": spark.read.parquet(f"{folder}/a.parquet")}
    out = None
    for name, df in back.items():
        one = df.agg(F.count("n_nationkey").alias("n")).crossJoin(n.exceptAll(df).agg(F.count("*").alias("lost"))).select(F.lit(name).alias("format"), "n", "lost")  # single rows
        out = one if out is None else out.union(one)
    return out


@query("source_json_map", "S06 S14", "SELECT key, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def _(spark, d):
    return r.read_json_map(table(spark, d, "events"), "props", "key", "value").groupBy("key").agg(F.count("*").alias("n"))


@query("source_json_array", "S03 S05 S08", """
SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 1 THEN 'oversized-record' END AS error, CASE WHEN n_nationkey % 5 <> 1 THEN n_name END AS name FROM nation""")
def _(spark, d):
    n, folder = table(spark, d, "nation"), _folder(spark)
    big = F.when(F.col("n_nationkey") % 5 == 1, F.repeat(F.lit("[]{},\\\""), 40)).otherwise("")
    one = F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), big.alias("more")))
    # one array a region, as files that no line break divides
    arrays = n.groupBy("n_regionkey").agg(F.concat(F.lit(" ["), F.concat_ws(" , ", F.collect_list(one)), F.lit("]\n")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(f"{folder}/a.json")
    rows = r.read_json_array(spark, f"{folder}/a.json/*.txt", "id int, name string, more string", most=200)
    ok = rows.where("error is null").select(F.col("row.id").alias("n_nationkey"), "error", F.col("row.name").alias("name"))
    # what a record over the bound held is not read; as many as there are in the table come back
    gone = rows.where("error is not null").agg(F.count("*").alias("n"), F.max("error").alias("error"))
    lost = n.where("n_nationkey % 5 = 1").select("n_nationkey").crossJoin(gone).where(F.col("n") == n.where("n_nationkey % 5 = 1").count())  # one row
    return ok.union(lost.select("n_nationkey", "error", F.lit(None).cast("string")))


@query("source_commented_tsv", "S09", "SELECT n_name AS term, 'Istilah ' || n_nationkey AS malay FROM nation")
def _(spark, d):
    n, folder = table(spark, d, "nation"), _folder(spark)
    lines = n.select(F.concat_ws("\t", "n_name", F.concat(F.lit("Istilah "), F.col("n_nationkey").cast("string"))).alias("value"))
    lines.union(n.select(F.concat(F.lit("# "), "n_name"))).write.text(f"{folder}/terms.tsv")
    return r.read_commented_tsv(spark, f"{folder}/terms.tsv", "term string, malay string", ["term"])


@query("source_tar_members", "S12", "SELECT n_regionkey || '.txt' AS member, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS bytes FROM nation GROUP BY n_regionkey")
def _(spark, d):
    import io
    import tarfile

    import pandas as pd

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        raw = io.BytesIO()
        with tarfile.open(fileobj=raw, mode="w") as t:
            body = "".join(x + "\n" for x in pdf["n_name"]).encode()
            info = tarfile.TarInfo(f"{key[0]}.txt")
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
        return pd.DataFrame({"path": [f"{key[0]}.tar"], "content": [raw.getvalue()]})

    archives = table(spark, d, "nation").groupBy("n_regionkey").applyInPandas(pack, "path string, content binary")
    return r.tar_members(archives).select("member", F.octet_length("content").cast("long").alias("bytes"))


@query("source_tar_glosses", "S12 S20", """
SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') || CASE p_partkey % 4 WHEN 0 THEN '-n' WHEN 1 THEN '-v' WHEN 2 THEN '-a' ELSE '-r' END AS synset, trim(p_name) || ' | ' || p_type AS gloss FROM part""")
def _(spark, d):
    import io
    import tarfile

    import pandas as pd

    p = table(spark, d, "part")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("noun", "verb", "adj", "adv")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    lines = p.select(kind.alias("kind"), F.floor(F.col("p_partkey") / 10_000).alias("block"), F.format_string("%08d 03 x 01 a 0 000 | %s | %s", "p_partkey", "p_name", "p_type").alias("line"))

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        raw = io.BytesIO()
        with tarfile.open(fileobj=raw, mode="w") as t:
            for kind, rows in pdf.groupby("kind"):
                body = ("  1 a header\n" + "".join(x + "\n" for x in rows["line"])).encode()
                for name, text in ((f"w/data.{kind}", body), (f"w/index.{kind}", b"00000000 none | none\n")):
                    info = tarfile.TarInfo(name)
                    info.size = len(text)
                    t.addfile(info, io.BytesIO(text))
        return pd.DataFrame({"name": [f"{key[0]}.tar"], "content": [raw.getvalue()]})

    folder = _folder(spark)

    def save(parts):
        for pdf in parts:
            for name, content in zip(pdf["name"], pdf["content"]):
                with ranges.open_file(f"{folder}/{name}", write=True) as f:
                    f.write(content)
            yield pdf[["name"]]

    lines.groupBy("block").applyInPandas(pack, "name string, content binary").mapInPandas(save, "name string").count()  # an archive for each 10,000 parts
    return r.tar_glosses(ranges.read_tar_lines(spark, folder, 1 << 20, r"^w/data\."))


@query("source_wordnet_tab", "S10", "SELECT n_nationkey || '-n' AS synset, lower(replace(n_name, '_', ' ')) AS lemma FROM nation WHERE n_nationkey % 2 = 0")
def _(spark, d):
    field = F.when(F.col("n_nationkey") % 2 == 0, "lemma").otherwise("def")
    lines = table(spark, d, "nation").select(F.concat_ws("\t", F.concat(F.col("n_nationkey").cast("string"), F.lit("-n")), field, F.upper("n_name")).alias("value"))
    return r.wordnet_tab(lines, "lemma")


@query("source_wordnet_data", "S11", "SELECT lpad(CAST(n_nationkey AS VARCHAR), 8, '0') AS \"offset\", 2 AS n_words, lpad(CAST(n_regionkey AS VARCHAR), 8, '0') AS parent, 'gloss of ' || n_name AS gloss FROM nation")
def _(spark, d):
    lines = table(spark, d, "nation").select(F.format_string("%08d 03 n 02 %s 0 other 0 002 @ %08d n 0000 ~ 00000001 n 0000 | gloss of %s", "n_nationkey", F.replace("n_name", F.lit(" "), F.lit("_")), "n_regionkey", "n_name").alias("value"))
    w = r.wordnet_data(lines)
    return w.select("offset", F.size("words").alias("n_words"), F.get("parents", F.lit(0)).alias("parent"), "gloss")


@query("source_flatten", "S13", """
SELECT conv_id, count(*) FILTER (role <> 'system' AND length(text) > 20) AS glosses FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role <> 'system' AND length(text) > 20) > 0""")
def _(spark, d):
    sense = F.struct(F.array(F.col("role")).alias("tags"), F.when(F.length("text") <= 20, "form").alias("form_of"), F.array("text").alias("glosses"))
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(sense).alias("senses"))
    return r.flatten_senses(nested, "conv_id", "senses", "system").groupBy("conv_id").agg(F.count("*").alias("glosses"))


@query("source_oriented", "S14", "SELECT c_name AS english, unnest([c_mktsegment, 'x']) AS other FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_mktsegment, unnest([c_mktsegment, 'x']) FROM customer WHERE c_custkey % 2 <> 0")
def _(spark, d):
    c = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("en"), F.col("c_mktsegment").alias("headword"), F.array("c_mktsegment", F.lit("x")).alias("translations"))
    return r.oriented(c, ["english", "en", "headword"], ["malay", "ms", "translations"])


@query("source_shards", "S16 T14", "SELECT count(*) AS rows_, count(*) = (SELECT count(*) FROM orders) AS complete, true AS contiguous FROM orders")
def _(spark, d):
    from pyspark.sql import Window as W

    o, folder = table(spark, d, "orders"), _folder(spark)
    for k in range(3):
        o.where(F.col("o_orderkey") % 3 == k).write.parquet(f"{folder}/shard={k}")
    back = spark.read.parquet(folder)
    w = W.orderBy("shard")  # one row a shard
    runs = back.groupBy("shard").agg(F.count("*").alias("n")).withColumn("end", F.sum("n").over(w)).withColumn("start", F.col("end") - F.col("n"))
    gap = F.coalesce(F.lag("end").over(w), F.lit(0)) != F.col("start")
    return runs.withColumn("gap", gap).agg(F.sum("n").alias("rows_"), (F.sum("n") == F.lit(o.count())).alias("complete"), (F.count_if(F.col("gap")) == 0).alias("contiguous"))


@query("source_inventory", "S17 K10", "SELECT 'missing' AS change, 1::BIGINT AS n UNION ALL SELECT 'changed', 1 UNION ALL SELECT 'added', 1")
def _(spark, d):
    from glossa.session import cut

    o, folder = table(spark, d, "orders").coalesce(1), _folder(spark)
    for k in range(3):
        o.where(F.col("o_orderkey") % 3 == k).write.parquet(f"{folder}/shard={k}")
    files = f"{folder}/shard=*/*.parquet"
    backup = cut(r.inventory(spark, files))  # a manifest of the files as they were
    now = backup.withColumn("shard", F.regexp_extract("path", "shard=([0-9])", 1))
    # as if since then a file had been dropped, one rewritten, and one put in
    manifest = now.where("shard <> '0'").withColumn("sha256", F.when(F.col("shard") == "1", F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256"))).select("path", "length", "sha256")
    manifest = manifest.union(spark.createDataFrame([("gone.parquet", 1, "x")], "path string, length long, sha256 string"))
    return r.changed_files(spark, files, manifest).groupBy("change").agg(F.count("*").alias("n"))


@query("sink_snapshots", "K06 S15 T14", "SELECT o_orderkey, o_orderstatus, (row_number() OVER (ORDER BY o_orderkey) - 1) // 128 AS batch FROM orders")
def _(spark, d):
    o, folder = table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), _folder(spark)
    planned = store.snapshots(o, ["o_orderkey"])
    planned.where("batch < 3").write.parquet(f"{folder}/run")  # a run that was stopped
    store.resume(spark.read.parquet(f"{folder}/run"), planned).write.mode("append").parquet(f"{folder}/run")
    return r.restore(spark.read.parquet(f"{folder}/run"), "o_orderkey long, o_orderstatus string", "o_orderkey", o.count()).select("o_orderkey", "o_orderstatus", "batch")


@query("sink_publish", "K01 K05 M03", "SELECT count(*) AS n, true AS same_version, count(*) FILTER (c_custkey % 2 = 0) AS before, true AS refused FROM customer")
def _(spark, d):
    c, root = table(spark, d, "customer"), _folder(spark)
    store.publish(c.where("c_custkey % 2 = 0"), root, ["c_custkey"])
    first = store.publish(c, root, ["c_custkey"])
    again = store.publish(c.repartition(3), root, ["c_custkey"])
    n = store.load(spark, root).agg(F.count("*").alias("n"))
    try:  # a version whose keys repeat is refused and leaves the store as it is
        store.publish(c.union(c.limit(1)), root, ["c_custkey"])
        refused = False
    except ValueError:
        refused = store.current(spark, root) == first
    store.rollback(spark, root)
    before = store.load(spark, root).agg(F.count("*").alias("before"))
    return n.crossJoin(before).select("n", F.lit(first == again).alias("same_version"), "before", F.lit(refused).alias("refused"))  # single rows
