"""Data-quality queries over documents, labels and conversations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.operators import quality as q
from glossa.plans.registry import query
from glossa.session import spread, table

_RULES = r"""[CASE WHEN trim(text) = '' THEN 'missing' END, CASE WHEN regexp_matches(text, '(?i)\b(todo|placeholder|tbd)\b') THEN 'placeholder' END, CASE WHEN contains(text, chr(65533)) THEN 'unicode' END,
  CASE WHEN regexp_matches(text, '\|') THEN 'table' END, CASE WHEN length(text) > 10000 THEN 'long' END, CASE WHEN regexp_matches(text, '[$%&#*]{3}') THEN 'noise' END, CASE WHEN upper(text) = text THEN 'shouting' END]"""


def _rules():
    c = F.col("text")
    return {
        "missing": F.trim(c) == "", "placeholder": c.rlike(r"(?i)\b(todo|placeholder|tbd)\b"), "unicode": F.contains(c, F.lit("�")), "table": c.rlike(r"\|"),
        "long": F.length(c) > 10000, "noise": c.rlike(r"[$%&#*]{3}"), "shouting": F.upper(c) == c,
    }


@query("quality_issues", "V01 P15 A07", f"SELECT issue, count(*) AS n FROM (SELECT unnest(list_filter({_RULES}, lambda x: x IS NOT NULL)) AS issue FROM documents) GROUP BY issue")
def _(spark, d):
    return table(spark, d, "documents").select(F.explode(q.issues(_rules())).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query("quality_waterfall", "V07 A08", f"SELECT category, count(*) AS n FROM (SELECT COALESCE(list_filter({_RULES}, lambda x: x IS NOT NULL)[1], 'clean') AS category FROM documents) GROUP BY category")
def _(spark, d):
    return table(spark, d, "documents").select(q.waterfall(_rules(), "clean").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("quality_split_flags", "V08", f"""
WITH i AS (SELECT doc_id, list_filter({_RULES}, lambda x: x IS NOT NULL) AS found FROM documents)
SELECT doc_id, CAST(len(list_filter(found, lambda x: x NOT IN ('table', 'long'))) AS INTEGER) AS errors, CAST(len(list_filter(found, lambda x: x IN ('table', 'long'))) AS INTEGER) AS flags FROM i""")
def _(spark, d):
    s = q.split_flags(q.issues(_rules()), ["table", "long"])
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s.errors").alias("errors"), F.size("s.flags").alias("flags"))


@query("quality_output", "V02 A28", r"""
WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS source FROM conversations)
SELECT conv_id, turn, trim(text) = '' AS empty, text = source AS copy, length(text) > greatest(160, 4 * length(source)) AS length_, list_sort(regexp_extract_all(text, '\d+')) = list_sort(regexp_extract_all(source, '\d+')) AS same_numbers FROM t WHERE source IS NOT NULL""")
def _(spark, d):
    t = table(spark, d, "conversations").withColumn("source", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))).where("source is not null")
    numbers = [F.array_sort(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))) for c in ("text", "source")]
    return t.select("conv_id", "turn", (F.trim("text") == "").alias("empty"), (F.col("text") == F.col("source")).alias("copy"), (F.length("text") > F.greatest(F.lit(160), F.length("source") * 4)).alias("length_"), (numbers[0] == numbers[1]).alias("same_numbers"))


#: A gloss, its part of speech, whether it is an idiom, an output, and the codes against it; references of all: bendera, me-something.
_EVIDENCE = (
    ("flag", "n", False, "bendera", ""), ("flag", "n", False, "• Bendera; untuk bendera", ""), ("flag", "n", False, "panji", "whole-output-reference-mismatch"), ("flag", "n", False, "bendera ✔", "corrupt-or-hallucinated,non-lexical-symbols-or-script"),
    ("flag", "n", False, "kain: bendera", "unresolved-definition-structure,whole-output-reference-mismatch"), ("flag (idiom)", "n", False, "bendera", "special-sense-needs-context-review"), ("flag", "n", True, "bendera", "special-sense-needs-context-review"),
    ("banner", "n", False, "bendera", "no-independent-sense-reference,whole-output-reference-mismatch"), ("ensign", "n", False, "bendera", "known-synset-scope-conflict"), ("flag", "n", False, "mobil", "malaysian-scope-review,whole-output-reference-mismatch"),
    ("standard", "n", False, "bendera", "mandarin-context-conflict"), ("to flag", "v", False, "bendera", "bare-verb-needs-review"), ("to flag", "v", False, "menanda", ""), ("to flag", "v", False, "ikat", ""), ("flag", "n", False, " ", "empty,non-lexical-symbols-or-script"),
)


@query("quality_concordance", "V03", f"SELECT p_partkey, codes FROM part JOIN (VALUES " + ", ".join(f"({i}, '{c[4]}')" for i, c in enumerate(_EVIDENCE)) + f") v(i, codes) ON p_partkey % {len(_EVIDENCE)} = i")
def _(spark, d):
    from glossa.operators import qualify

    cases = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(_EVIDENCE)], "i long, gloss string, pos string, idiom boolean, output string")
    rows = spread(table(spark, d, "part").select("p_partkey"), "p_partkey").select("p_partkey", (F.col("p_partkey") % len(_EVIDENCE)).alias("i")).join(F.broadcast(cases), "i")  # a table of fixed size
    words = lambda *w: F.array(*[F.lit(x) for x in w]).cast("array<string>")
    gloss = F.col("gloss")
    found = qualify.output_evidence(F.col("output"), F.lit(True), gloss, F.col("pos"), F.col("idiom"), F.when(gloss == "banner", words()).otherwise(words("Bendera", "menanda", "ikat")), gloss == "ensign",
                                    words("mobil"), F.when(gloss == "standard", words("bendera")).otherwise(words()), words("ikat"))
    return rows.select("p_partkey", F.array_join(F.array_sort(found), ",").alias("codes"))


#: A gloss, an output, whether a second source attests it, and what it is.
_RECOVERED = (
    ("variant of 猫[mao1]", "varian 猫[mao1]", False, "definition", "variant"), ("see also 猫[mao1]", "Lihat juga 猫[mao1]", False, "definition", "see"), ("abbr. for 猫[mao1]", "singkatan bagi 猫[mao1]", False, "definition", "abbreviation"),
    ("see 猫[mao1]", "lihat 狗[gou3]", False, "invalid", None), ("cat", "kucing", True, "lexical", None), ("cat", "kucing", False, "mixed", None), ("cat", "anjing", True, "mixed", None), ("cat", "anjing", False, "invalid", None),
)


@query("quality_recovery", "V04 V06 F26", "SELECT p_partkey, kind, rule FROM part JOIN (VALUES " + ", ".join(f"({i}, '{r[3]}', {'NULL' if r[4] is None else repr(r[4])})" for i, r in enumerate(_RECOVERED)) + f") v(i, kind, rule) ON p_partkey % {len(_RECOVERED)} = i")
def _(spark, d):
    from glossa.operators import qualify

    cases = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(_RECOVERED)], "i long, gloss string, output string, attested boolean")
    rows = spread(table(spark, d, "part").select("p_partkey"), "p_partkey").select("p_partkey", (F.col("p_partkey") % len(_RECOVERED)).alias("i")).join(F.broadcast(cases), "i")  # a table of fixed size
    no, none = F.lit(False), F.array().cast("array<string>")
    definition = qualify.reference_definition(F.col("gloss"), F.col("output"))
    codes = qualify.output_evidence(F.col("output"), F.lit(True), F.col("gloss"), F.lit("n"), no, F.array(F.lit("kucing")), no, none, none, none)
    return rows.select("p_partkey", qualify.recovered(definition, codes, F.col("attested")).alias("kind"), definition["rule"].alias("rule"))


@query("quality_whole_batches", "V10", """
SELECT lang, count(*) AS n FROM documents WHERE lang NOT IN (SELECT lang FROM documents WHERE length(text) > 100000 OR contains(text, '|  |')) AND lang <> (SELECT min(lang) FROM documents) GROUP BY lang""")
def _(spark, d):
    docs = table(spark, d, "documents")
    first = docs.agg(F.min("lang").alias("first"))  # a batch with a bad row for certain
    docs = docs.crossJoin(first)  # one row
    found = q.issues({"long": F.length("text") > 100000, "cells": F.contains("text", F.lit("|  |")), "first": F.col("lang") == F.col("first")})
    return q.accept_batches(docs, "lang", found).groupBy("lang").agg(F.count("*").alias("n"))


@query("quality_provenance", "V18", """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'license' WHEN 1 THEN 'particulars' WHEN 2 THEN 'sha256' WHEN 3 THEN 'not-redistributable' WHEN 4 THEN 'not-redistributable,license,particulars' ELSE '' END AS issues FROM pages""")
def _(spark, d):
    from glossa.operators import qualify

    k = F.col("page_id") % 6
    actual = F.sha2("html", 256)
    found = qualify.provenance(F.when(k.isin(0, 4), "unknown").otherwise("CC-BY-SA-4.0"), F.lit("the site"), F.when(k != 1, "1"), F.when(k != 4, F.col("url")), ~k.isin(3, 4), F.when(k == 2, F.sha2(F.lit("other"), 256)).when(k != 5, actual), actual)
    return table(spark, d, "pages").select("page_id", F.array_join(found, ",").alias("issues"))


@query("quality_exclusions", "P10 V14", r"""
SELECT coalesce(reason, 'PLAN') AS reason, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(l), '^(because|although|though|if|whether|unless|despite)\b') THEN 'NON_VISUAL_LOGICAL_RELATION' WHEN regexp_matches(lower(l), '^(perhaps|maybe|still|yet|and|but|however|very)\b') THEN 'FUNCTION_WORD'
  WHEN regexp_matches(lower(l), '^(variant of|see also|cf\.)') THEN 'VARIANT_REFERENCE_ONLY' WHEN regexp_matches(l, '\b(Inc\.|Corp\.|Ltd\.)') THEN 'NAMED_ENTITY_POLICY' WHEN regexp_matches(lower(l), '^not\b') THEN 'NEGATION_WITHOUT_VALIDATED_SCENE' WHEN length(l) < 3 THEN 'UNSEARCHABLE_FRAGMENT' END AS reason
  FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)) GROUP BY 1""")
def _(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("l"))
    low, end = F.lower("l"), "(?![A-Za-z0-9_])"  # an ASCII word ends
    reason = q.waterfall({
        "NON_VISUAL_LOGICAL_RELATION": low.rlike(r"^(because|although|though|if|whether|unless|despite)" + end), "FUNCTION_WORD": low.rlike(r"^(perhaps|maybe|still|yet|and|but|however|very)" + end),
        "VARIANT_REFERENCE_ONLY": low.rlike(r"^(variant of|see also|cf\.)"), "NAMED_ENTITY_POLICY": F.col("l").rlike(r"(?<![A-Za-z0-9_])(Inc\.|Corp\.|Ltd\.)"),
        "NEGATION_WITHOUT_VALIDATED_SCENE": low.rlike("^not" + end), "UNSEARCHABLE_FRAGMENT": F.length("l") < 3,
    }, "PLAN")
    return lines.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("quality_secrets", "V16 V17", r"""
SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS mail, regexp_matches(text, '\b(?:sk|pk|ghp|AKIA)[-_A-Za-z0-9]{12,}') AS secret, regexp_matches(text, 'Ã.|â€') AS mojibake, regexp_matches(text, '[ \t]+(\n|$)') AS trailing FROM documents""")
def _(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", c.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("mail"), c.rlike(r"\b(?:sk|pk|ghp|AKIA)[-_A-Za-z0-9]{12,}").alias("secret"), c.rlike("Ã.|â€").alias("mojibake"), c.rlike(r"[ \t]+(\n|$)").alias("trailing"))


@query("quality_gate", "V09 A23", """
SELECT lang, count(*) AS n, CASE WHEN avg(quality) < 0.8 OR count(*) < 20 THEN 'blocked' ELSE 'open' END AS gate FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def _(spark, d):
    g = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.avg("quality").alias("rate"))
    return g.select("lang", "n", F.when((F.col("rate") < 0.8) | (F.col("n") < 20), "blocked").otherwise("open").alias("gate"))


@query("quality_structured_content", "V11 U06", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'keys' WHEN event_id % 5 = 1 THEN 'count' WHEN event_id % 5 = 2 THEN 'duplicate' WHEN event_id % 5 = 3 THEN 'headword' ELSE 'valid' END AS verdict FROM events""")
def _(spark, d):
    from glossa.operators.validate import sentences_verdict

    k = F.col("event_id") % 5
    row = lambda s: '{"text":"' + s + '"}'
    a, b, c = row("w one"), row("w two"), row("w three")
    content = F.when(k == 0, '{"word":"w","other":[]}').when(k == 1, f'{{"word":"w","sentences":[{a}]}}').when(k == 2, f'{{"word":"w","sentences":[{a},{a},{b}]}}').when(k == 3, f'{{"word":"w","sentences":[{a},{b},{row("none")}]}}').otherwise(f'{{"word":"w","sentences":[{a},{b},{c}]}}')
    return table(spark, d, "events").select("event_id", sentences_verdict(content, F.lit("w")).alias("verdict"))


@query("quality_integrity", "V12 A28", """
SELECT count(*) AS rows_, count(*) - count(DISTINCT o_orderkey) AS repeated, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer)) AS dangling FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.agg(F.count("*").alias("rows_"), (F.count("*") - F.count_distinct("o_orderkey")).alias("repeated"), F.count_if(F.col("c_custkey").isNull()).alias("dangling"))


_HUMAN = "human-verified"
#: A field of a record (or of a supplement, after a dot), a bad value, and the codes that it gives.
_CASES = (
    ("malay", "", "missing-malay"), ("malay", "flag", "english-copy"), ("malay", "TODO bendera", "placeholder"), ("malay", "旗 bendera", "invalid-language-or-unicode"), ("malay", "bendera of", "english-language-warning"),
    ("malay", "mobil merah", "indonesian-localization-review"), ("malay", "brim topi", "corrupt-or-untranslated-output"), ("quality", "best", "invalid-quality-status"), ("status", "new", "invalid-status"),
    ("kind", "other", "invalid-translation-kind"), ("confidence", 1.5, "invalid-confidence"), ("license", "", "missing-provenance"), ("source", "PRPM list", "unsupported-dbp-attribution"), ("status", "verified", "missing-reviewer"),
    ("english", "flags", "sense-misalignment"), ("quality", _HUMAN, "unsupported-human-verification"), ("sense_idiom", True, "idiom-needs-semantic-explanation"), ("search_terms", "--", "invalid-malaySearchTerms"),
    ("synonyms", "", "invalid-malaySynonyms"), ("morphology", " ", "invalid-malayMorphology"),
    ("lexical.text", " ", "invalid-malayLexical"), ("lexical.status", "new", "invalid-malayLexical-status"), ("lexical.quality", _HUMAN, "unsupported-malayLexical-verification"), ("lexical.source", "", "missing-malayLexical-provenance"),
    ("lexical.text", "undefined", "invalid-malayLexical-text"), ("lexical.text", "bendera 2", "invalid-lexical-supplement"), ("lexical.kind", "lexical-equivalent", "duplicate-malayLexical-kind"),
    ("definition.text", "", "invalid-malayDefinition"), ("definition.quality", "best", "invalid-malayDefinition-status"), ("definition.status", "verified", "unsupported-malayDefinition-verification"),
    ("definition.version", "", "missing-malayDefinition-provenance"), ("definition.text", "kain TBD", "invalid-malayDefinition-text"), ("definition.kind", "definition-translation", "duplicate-malayDefinition-kind"),
    ("malay", "bendera", ""), ("malay", "the TODO mobil", "english-language-warning,indonesian-localization-review,placeholder"),
)
_EXPECTED = " ".join(f"WHEN {i} THEN '{code}'" for i, (_, _, code) in enumerate(_CASES))


def _record_cases(spark, d):
    """Every row of part with a good record, but for the one field that its case makes bad."""
    from glossa.operators.record_quality import SUPPLEMENT

    base = {"key": "k", "entry_id": "e", "sense_id": "sense-0", "english": "flag", "malay": "bendera", "sense_key": "k", "sense_entry_id": "e", "sense_sense_id": "sense-0", "sense_english": "flag", "sense_idiom": False,
            "status": "generated", "quality": "automated-review-required", "kind": None, "confidence": 0.5, "source": "list", "license": "cc0", "version": "1", "reviewer": None, "permission": None, "justification": None,
            "idiom_explanation": None, "search_terms": "bendera", "synonyms": "panji", "morphology": "bendera-bendera"}
    extra = {"text": "panji", "status": "generated", "quality": "automated-review-required", "source": "list", "license": "cc0", "version": "1", "reviewer": None}
    case = F.col("p_partkey") % len(_CASES)

    def column(field, value):
        c = F.lit(value)
        for i, (name, bad, _) in enumerate(_CASES):
            if name == field or (field == "kind" and name.endswith(".kind")):
                c = F.when(case == i, bad).otherwise(c)
        return c

    cols = {name: column(name, value).cast("double" if name == "confidence" else "boolean" if name == "sense_idiom" else "string") for name, value in base.items()}
    for name in ("search_terms", "synonyms", "morphology"):
        cols[name] = F.array(cols[name])
    for name in ("lexical", "definition"):
        used = [i for i, (field, _, _) in enumerate(_CASES) if field.startswith(name + ".")]
        made = F.struct(*[column(f"{name}.{f}", v).cast("string").alias(f) for f, v in extra.items()])
        cols[name] = F.when(case.isin(*used), made).cast(SUPPLEMENT)
    return table(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in cols.items()])


@query("quality_record_rules", "V01 P15", f"SELECT p_partkey, CASE p_partkey % {len(_CASES)} {_EXPECTED} END AS codes FROM part")
def _(spark, d):
    from glossa.operators.record_quality import codes, record_rules

    return _record_cases(spark, d).select("p_partkey", F.array_join(codes(record_rules()), ",").alias("codes"))


_FLAGS = ("english-copy", "english-language-warning", "indonesian-localization-review", "idiom-needs-semantic-explanation")


@query("quality_record_severity", "V08 V01", "SELECT p_partkey, CASE p_partkey % " + str(len(_CASES)) + " " + " ".join(
    f"WHEN {i} THEN '{','.join(c for c in code.split(',') if c and c not in _FLAGS)}|{','.join(c for c in code.split(',') if c in _FLAGS)}'" for i, (_, _, code) in enumerate(_CASES)) + " END AS parts FROM part")
def _(spark, d):
    from glossa.operators.record_quality import errors_and_flags, record_rules

    rows = _record_cases(spark, d).select("p_partkey", errors_and_flags(record_rules()).alias("s"))
    return rows.select("p_partkey", F.concat_ws("|", F.array_join("s.errors", ","), F.array_join("s.flags", ",")).alias("parts"))


#: Source, output, tokens, codes from elsewhere, all codes, review category.
_OUTPUTS = (
    ("land x", " ", 1, "", "empty", "empty-output"), ("Land x", "land X", 5, "", "english-copy", "identical-source-review-including-loanwords"), ("land", "国 negara", 5, "", "unicode-or-target-script", "script-or-format-review"),
    ("land", "negara which", 5, "", "untranslated-or-placeholder", "language-warning-review"), ("land", "kantor", 5, "", "indonesian-localization", "language-warning-review"),
    ("land 12", "negara 13", 5, "", "number-changed", "other-recorded-rule-review"), ("land", "negara", 200, "", "length-or-truncation", "length-or-truncation-review"),
    ("land", "ya ya ya ya ya dan lagi satu dua tiga", 20, "", "repetition", "corruption-or-repetition-review"), ("land", "", 0, "local-inference-failed", "empty,local-inference-failed", "inference-failed"),
    ("land", "negeri", 5, "known-synset-scope-conflict", "known-synset-scope-conflict", "known-sense-conflict"), ("land", "negeri", 5, "no-independent-sense-reference", "no-independent-sense-reference", "unknown-semantics-reference-gap"),
    ("land", "negeri", 5, "whole-output-reference-mismatch", "whole-output-reference-mismatch", "reference-mismatch-needs-semantic-review"), ("land 1", "negara", 191, "english-copy", "english-copy,length-or-truncation,number-changed", "length-or-truncation-review"),
    ("land 1,5", "negara 1,5", 5, "", "", "other-recorded-rule-review"),
)


@query("quality_output_rules", "V02 V07", "SELECT p_partkey, codes, category FROM part JOIN (VALUES " + ", ".join(f"({i}, '{codes}', '{category}')" for i, (*_, codes, category) in enumerate(_OUTPUTS)) + f") v(i, codes, category) ON p_partkey % {len(_OUTPUTS)} = i")
def _(spark, d):
    from glossa.operators.record_quality import codes, output_rules, review_category

    cases = spark.createDataFrame([(i, *o[:4]) for i, o in enumerate(_OUTPUTS)], "i long, source string, text string, tokens int, more string")
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(_OUTPUTS)).alias("i")).join(F.broadcast(cases), "i")  # a table of fixed size
    found = F.array_sort(F.array_union(codes(output_rules(F.col("source"), F.col("text"), F.col("tokens"))), F.filter(F.array("more"), lambda x: x != "")))
    return rows.withColumn("found", found).select("p_partkey", F.array_join("found", ",").alias("codes"), review_category(F.col("found")).alias("category"))
