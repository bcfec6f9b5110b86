"""Validation of generated structured content, as expressions over JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_keys(value: Column, names: list[str]) -> Column:
    """Whether a JSON object has exactly these keys."""
    found = F.array_sort(F.json_object_keys(value))
    return F.coalesce(found == F.array_sort(F.array(*[F.lit(n) for n in names])), F.lit(False))


def norm_content(c: Column) -> Column:
    """Text without punctuation and white space, in lower case: what makes two sentences the same."""
    return F.lower(F.regexp_replace(c, r"(?U)[\p{P}\p{Z}\s]", ""))


def sentences_verdict(content: Column, word: Column, n: int = 3, limit: int = 400) -> Column:
    """Why generated sentences are refused, or `valid`: wrong keys, not exactly n sentences, control
    characters or length, a sentence twice, or one without the headword."""
    rows = F.from_json(F.get_json_object(content, "$.sentences"), "array<struct<text:string>>")
    texts = F.transform(rows, lambda r: F.trim(r["text"]))
    bad = F.exists(texts, lambda t: t.isNull() | (t == "") | (F.length(t) > limit) | t.rlike(r"[\x00-\x1f\x7f<>]"))
    keys = F.transform(texts, norm_content)
    return (
        F.when(~exact_keys(content, ["word", "sentences"]), "keys").when(F.get_json_object(content, "$.word") != word, "word")
        .when(rows.isNull() | (F.size(rows) != n), "count").when(bad, "text").when(F.size(F.array_distinct(keys)) != n, "duplicate")
        .when(F.exists(texts, lambda t: ~F.contains(t, word)), "headword").otherwise("valid")
    )


def corpus_audit(entries: DataFrame) -> DataFrame:
    """One row of counts over entries (traditional, simplified, pinyin, definitions): a sense is a definition that is
    no measure-word note. Distinct characters are counted after they are exploded, so no set is collected."""
    notes = F.filter("definitions", lambda x: x.rlike("(?i)^CL:"))
    senses = F.filter("definitions", lambda x: ~x.rlike("(?i)^CL:"))
    rows = entries.withColumn("notes", F.size(notes)).withColumn("senses", senses)
    simple = F.col("simplified")
    one, han = F.length(simple) == 1, simple.rlike(r"^\p{IsHan}$")
    count = lambda c: F.sum(F.size(c)).cast("long")
    told = rows.agg(
        F.count("*").alias("rows"), F.count_distinct("traditional", "simplified", "pinyin").alias("unique_entries"), F.count_distinct("simplified").alias("unique_headwords"), count("senses").alias("sense_records"),
        count("definitions").alias("raw_definitions"), F.sum("notes").cast("long").alias("classifier_only"), F.count_if(one).alias("single_entries"), F.count_distinct(F.when(one, simple)).alias("single_characters"),
        F.count_if(han).alias("single_han_entries"), F.count_distinct(F.when(han, simple)).alias("single_han_characters"), F.count_if(F.length(simple) > 1).alias("compound_entries"),
        count(F.filter("senses", lambda x: x.rlike(r"\(idiom\)"))).alias("idiom_senses"), count(F.filter("senses", lambda x: F.trim(x) != "")).alias("english_nonempty"), F.count_if(F.size("senses") > 1).alias("multiple_sense_entries"),
    )
    characters = entries.select(F.explode(F.regexp_extract_all(F.concat("traditional", "simplified"), F.lit(r"(\p{IsHan})"), F.lit(1))).alias("c")).agg(F.count_distinct("c").alias("han_characters"))
    return told.crossJoin(characters)  # single rows
