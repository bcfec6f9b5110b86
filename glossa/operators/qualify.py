"""Qualification of generated equivalents: evidence, issues, and the record or the reasons against it.

A task is a row with the sense it belongs to; its output and its evidence are columns beside it.
Rules are the tables of `record_quality`; this module adds those that weigh evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import named, norm_terms
from glossa.operators.quality import issues, waterfall

# What no lexical output holds, and glosses that need more than a reference.
LEXICAL_OUTPUT = r"^[\p{IsLatin}\p{M}\p{N} ,;:.'’()-]+$"
CORRUPT_OUTPUT = r"(?i)\p{Co}|<unk>|sitemap|bookingsuite|tel/fax|artikel-nr|pilihan peminat|copyright|[✔←]"
SPECIAL_GLOSS = r"(?i)(?<![A-Za-z0-9_])(?:idiom|fig\.|lit\.|surname|variant|abbr\.|classifier)"
VERB_PREFIXES = "^(?:me|ber|ter|memper)"
#: Grammar of cross-references in glosses (fixed values): rule, pattern of the gloss, pattern of its translation.
REFERENCES = (
    ("variant", r"^(?:old |archaic )?variant of (\S+\[[^\]]+\])$", r"^varian (?:lama |arkaik )?(?:daripada |bagi )?(\S+\[[^\]]+\])$"),
    ("see", r"^see (?:also )?(\S+\[[^\]]+\])$", r"^lihat (?:juga )?(\S+\[[^\]]+\])$"),
    ("abbreviation", r"^abbr\. for (\S+\[[^\]]+\])$", r"^singkatan (?:bagi |untuk )?(\S+\[[^\]]+\])$"),
)


def clean(text: Column) -> Column:
    """An output without surrounding white space and a leading bullet."""
    return F.regexp_replace(F.trim(text), r"^[•·]\s*", "")


def _forms(parts: Column) -> Column:
    return F.transform(parts, norm_terms)


def _parts(text: Column) -> Column:
    """The parts of an output between semicolons, without a leading `untuk`."""
    return F.filter(F.transform(F.split(clean(text), ";"), lambda p: F.regexp_replace(F.trim(p), r"(?i)^untuk\s+", "")), lambda p: p != "")


def equivalents(text: Column) -> Column:
    """The parts of an output between semicolons, without a leading `untuk`, each once by its normal form."""
    told = F.struct(_parts(text).alias("parts"))
    told = named(told, lambda x: F.struct(x["parts"].alias("parts"), _forms(x["parts"]).alias("forms")))
    return named(told, lambda x: F.filter(x["parts"], lambda p, i: F.array_position(x["forms"], F.get(x["forms"], i)) == i + 1))


def output_evidence(output: Column, aligned: Column, gloss: Column, part_of_speech: Column, idiom: Column, references: Column, excluded_synset: Column,
                    excluded_terms: Column, excluded_pairs: Column, bare_verbs: Column) -> Column:
    """The codes against a model's output, judged by what is known of its sense.

    references: terms attested for the sense, an array; excluded_synset: whether the sense is
    barred whole; excluded_terms, excluded_pairs: normal forms barred everywhere, and for this
    gloss; bare_verbs: verbs that may stand without a prefix. No codes: it qualifies.
    """
    # normal forms, each once, are those of the equivalents
    known = F.struct(
        clean(output).alias("text"), F.array_distinct(_forms(_parts(output))).alias("forms"), _forms(F.coalesce(references, F.array().cast("array<string>"))).alias("allowed"), aligned.alias("aligned"), gloss.alias("gloss"),
        (part_of_speech == "v").alias("verb"), idiom.alias("idiom"), excluded_synset.alias("barred"), excluded_terms.alias("terms"), excluded_pairs.alias("pairs"), bare_verbs.alias("bare"),
    )

    def judged(k: Column) -> Column:
        text, forms = k["text"], k["forms"]
        bare = F.exists(forms, lambda f: ~f.rlike(VERB_PREFIXES) & ~F.contains(f, F.lit(" ")) & ~F.array_contains(k["bare"], f))
        return issues({
            "sense-misalignment": ~k["aligned"], "non-lexical-symbols-or-script": ~text.rlike(LEXICAL_OUTPUT), "corrupt-or-hallucinated": text.rlike(CORRUPT_OUTPUT),
            "unresolved-definition-structure": F.contains(text, F.lit(":")), "special-sense-needs-context-review": k["idiom"] | k["gloss"].rlike(SPECIAL_GLOSS),
            "no-independent-sense-reference": F.size(k["allowed"]) == 0, "known-synset-scope-conflict": k["barred"],
            "whole-output-reference-mismatch": F.size(F.array_except(forms, k["allowed"])) > 0, "mandarin-context-conflict": F.arrays_overlap(forms, k["pairs"]),
            "malaysian-scope-review": F.arrays_overlap(forms, k["terms"]), "bare-verb-needs-review": k["verb"] & bare | F.array_contains(forms, "terima"),
            "empty": F.size(forms) == 0,
        })

    return named(known, judged)


def reference_definition(gloss: Column, output: Column) -> Column:
    """Struct (rule, reference) if the gloss is a cross-reference and the output says the same with the reference unchanged; else null."""
    found = None
    for rule, english, other in REFERENCES:
        a, b = F.regexp_extract(F.trim(gloss), english, 1), F.regexp_extract(F.trim(output), "(?i)" + other, 1)
        made = F.struct(F.lit(rule).alias("rule"), a.alias("reference"))
        found = F.when((a != "") & (a == b), made) if found is None else found.when((a != "") & (a == b), made)
    return found


def recovered(definition: Column, codes: Column, attested: Column) -> Column:
    """What a recovered output is: a definition, by its cross-reference; else a lexical equivalent, if no code
    stands against it and a second source attests it; mixed, if only one of both holds; else invalid."""
    known = F.struct(definition.isNotNull().alias("definition"), (F.size(codes) == 0).alias("none"), attested.alias("attested"))
    return named(known, lambda k: waterfall({"definition": k["definition"], "lexical": k["none"] & k["attested"], "mixed": k["none"] | k["attested"]}, "invalid"))


def qualify_terms(senses: DataFrame, terms: DataFrame, idioms: DataFrame, excluded: DataFrame, concordance: DataFrame) -> DataFrame:
    """X02, the built-in adapter: senses (key, headword, english, ...) with `malay` or the `reason` why there is none.

    idioms (headword, english, malay): explanations of exact senses come first. terms (english,
    malay): one term for a gloss. excluded (headword or null for any, english): judged wrong.
    concordance (headword, english, malay): terms that both languages' evidence attests.
    """
    i = idioms.select("headword", "english", F.col("malay").alias("__idiom"))
    t = terms.select("english", F.col("malay").alias("__term"))
    bad = excluded.select("headword", "english", F.lit(True).alias("__bad"))
    here = bad.where("headword is not null").withColumnRenamed("__bad", "__bad_here")
    everywhere = bad.where("headword is null").drop("headword")
    c = concordance.select("headword", "english", norm_terms(F.col("malay")).alias("__form")).distinct().withColumn("__met", F.lit(True))
    rows = senses.join(i, ["headword", "english"], "left").join(here, ["headword", "english"], "left").join(everywhere, "english", "left").join(t, "english", "left")
    rows = rows.withColumn("__form", norm_terms(F.col("__term"))).join(c, ["headword", "english", "__form"], "left")
    own = F.col("__idiom").isNotNull()
    reason = F.when(own, None).when(F.col("__bad").isNotNull() | F.col("__bad_here").isNotNull(), "linguistic-assessment-rejected").when(F.col("__term").isNull(), "no-qualified-exact-sense-term").when(F.col("__met").isNull(), "qualified-term-not-in-concordant-synset")
    rows = rows.withColumn("reason", reason).withColumn("malay", F.when(F.col("reason").isNull(), F.coalesce("__idiom", "__term")))
    return rows.select(*senses.columns, "malay", "reason")


def provenance(license: Column, attribution: Column, version: Column, url: Column, redistributable: Column, expected: Column, actual: Column, licenses: tuple[str, ...] = ("CC-BY-SA-4.0",)) -> Column:
    """Why a source may not be taken in: no approved licence, missing particulars, or other bytes than were promised."""
    gone = F.lit(False)
    for c in (attribution, version, url):
        gone = gone | (F.coalesce(c, F.lit("")) == "")
    return issues({
        "not-redistributable": ~F.coalesce(redistributable, F.lit(False)), "license": ~F.coalesce(license.isin(*licenses), F.lit(False)), "particulars": gone, "sha256": expected.isNotNull() & (expected != actual),
    })
