"""What a gloss shows, and the query for a picture of it: rule packs as lookups, the first rule that meets decides.

Families, domains, actions and nouns are tables (`packs`); a rule is a name, a condition over
the normalised phrase, and what it makes. Adding words is adding rows, not code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import participle, squeeze, without_parentheses
from glossa.operators import packs

_END = "(?![A-Za-z0-9_])"
_START = "(?<![A-Za-z0-9_])"


def _lookup(table: dict[str, str], key: Column) -> Column:
    """table[key], null if it is not there."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


_any = lambda words: "(?:" + "|".join(re.escape(w) for w in words) + ")"
_METADATA = f"^(?:{_any(packs.METADATA_WORDS)}{_END}|{_any(packs.METADATA_BEGINNINGS)})"
_BARRING = rf"\({_any(packs.BARRING_MARKS)}\.?\)"
_GRAMMAR_NOTE = rf"\([^)]*{_any(packs.GRAMMAR_NOTE_WORDS)}[^)]*\)"
_LABELS = rf"(?i)^\s*(?:{_any(packs.SHORT_LABELS)}\.\s*|{_any(packs.WORD_LABELS)}\s*:\s*)+"
_FAMILY_OF = {word: name for name, (_, _, _, words) in packs.FAMILIES.items() for word in words} | packs.FAMILY_PHRASES
_DOMAIN_OF = {word: name for name, (_, words) in packs.DOMAINS.items() for word in words}


def phrase(meaning: Column) -> Column:
    """The phrase that rules look at: no notes, labels, annotations or leading article, the first alternative, in lower case; null if nothing is left."""
    text = F.regexp_replace(meaning, "[‘’]", "'")
    text = F.regexp_replace(text, _LABELS, "")
    text = F.regexp_replace(F.regexp_replace(without_parentheses(text), r"\[[^\]]*\]", " "), r"\bCL:.*$", "")
    text = F.trim(F.regexp_extract(text, "^([^;/,]*)", 1))
    text = squeeze(F.lower(F.regexp_replace(text, "(?i)^(?:a|an|the) ", "")))
    return F.when(text.rlike("[a-z]") & ~text.rlike(r"[^a-z0-9\s'.:-]"), text)


def exclusion(meaning: Column, part_of_speech: Column) -> Column:
    """Why a gloss gets no picture, null if it may: metadata, barred, grammar."""
    low = F.lower(F.trim(meaning))
    return (
        F.when(low.rlike(_METADATA), "metadata")
        .when(low.rlike(f"{_START}(?:{packs.BARRED_WORDS}){_END}") | low.rlike(_BARRING), "barred")
        .when(F.coalesce(F.lower(part_of_speech), F.lit("")).rlike(f"^(?:{packs.FUNCTION_CLASSES}){_END}"), "grammar")
        .when(low.rlike(rf"^(?:(?:{packs.GRAMMAR_STARTS}){_END}.*|(?:{packs.GRAMMAR_WORDS}))$"), "grammar")
        .when(low.rlike(_GRAMMAR_NOTE), "grammar")
    )


def verb_of(words: Column, verbs: Column) -> Column:
    """The verb a phrase begins with, as its root, if verbs has it: as it stands, or from its -ing form; null without one."""
    first = F.get(F.split(F.regexp_replace(words, "^to ", ""), " "), F.lit(0))
    stem = F.when(first.endswith("ing"), F.regexp_replace(first, "ing$", ""))
    roots = F.array_compact(F.array(stem, F.concat(stem, F.lit("e")), F.regexp_replace(stem, ".$", "")))
    known = F.filter(roots, lambda v: F.array_contains(verbs, v) & (participle(v) == first))
    return F.when(F.array_contains(verbs, first), first).otherwise(F.get(known, F.lit(0)))


def noun_of(words: Column, nouns: Column) -> Column:
    """The category of a noun phrase: of the whole, else of its last word or that word's singular, in phrases of five words and without a preposition."""
    head = F.element_at(F.split(words, " "), -1)
    one = F.when(head.endswith("ies"), F.regexp_replace(head, "ies$", "y")).when(head.endswith("s"), F.regexp_replace(head, "s$", ""))
    short = (F.size(F.split(words, " ")) <= 5) & ~words.rlike(f"{_START}(?:{packs.NOT_IN_NOUNS}){_END}")
    return F.coalesce(F.element_at(nouns, words), F.when(short, F.coalesce(F.element_at(nouns, head), F.element_at(nouns, one))))


@dataclass(frozen=True)
class Made:
    kind: Column
    subject: Column
    query: Column
    fallback: Column
    domain: Column


def _struct(rule: str, m: Made) -> Column:
    cut = lambda c: F.substring(squeeze(c), 1, 100)
    return F.struct(F.lit(rule).alias("rule"), m.kind.cast("string").alias("kind"), m.subject.cast("string").alias("subject"), cut(m.query).alias("query"), cut(m.fallback).alias("fallback"), m.domain.cast("string").alias("domain"))


def parts(words: Column, verbs: Column, nouns: Column) -> dict[str, Column]:
    """What the rules ask of a phrase: without its `to`, the family and the domain that it names, its verb, its noun's category."""
    plain = F.regexp_replace(words, "^to ", "")
    state = F.regexp_replace(F.regexp_replace(plain, f"^(?:{packs.COPULAS}) ", ""), f"^(?:{packs.INTENSIFIERS}) ", "")
    shown = F.coalesce(_lookup(packs.ACTION_PHRASES, plain), verb_of(words, verbs))
    return {"plain": plain, "family": _lookup(_FAMILY_OF, F.regexp_replace(state, "-", " ")), "domain": _lookup(_DOMAIN_OF, plain), "shown": shown, "category": noun_of(words, nouns), "known": F.element_at(nouns, words)}


def rules(words: Column, part_of_speech: Column, p: dict[str, Column]) -> list[tuple[str, Column, Made]]:
    """(name, condition, what it makes) in order; p: parts()."""
    none = F.lit(None).cast("string")
    plain, family, domain, shown, category = (p[n] for n in ("plain", "family", "domain", "shown", "category"))
    of = lambda i: _lookup({name: row[i] for name, row in packs.FAMILIES.items()}, family)
    verb = F.coalesce(_lookup(packs.SHOWN_AS, shown), shown)
    phrase_of = _lookup(packs.ACTION_PHRASES, plain).isNotNull()
    acts = words.startswith("to ") | F.coalesce(F.lower(part_of_speech), F.lit("")).rlike("^v(?:erb)?" + _END) | (p["known"].isNull() & ((plain == shown) | words.rlike("^[a-z]+ing(?: |$)"))) | phrase_of
    doing = F.concat(F.lit("person "), participle(verb))
    subject = F.trim(F.concat_ws(" ", doing, F.regexp_extract(plain, f"^[a-z]+ ({packs.PARTICLES})$", 1)))
    concept = Made(F.lit("conceptual"), plain, F.concat(plain, F.lit(" concept")), plain, F.coalesce(F.regexp_replace(category, "^concept:", ""), F.lit("general")))
    return [
        ("state", family.isNotNull(), Made(of(0), of(2), of(1), of(2), none)),
        ("domain", domain.isNotNull(), Made(F.lit("conceptual"), plain, _lookup({n: q for n, (q, _) in packs.DOMAINS.items()}, domain), plain, domain)),
        ("barred-verb", acts & F.coalesce(verb, F.get(F.split(plain, " "), F.lit(0))).isin(*packs.BARRED_VERBS), Made(none, none, none, none, none)),
        ("concept-verb", acts & (verb.isNull() | verb.isin(*packs.CONCEPT_VERBS)), concept),
        ("action", acts, Made(F.lit("action"), subject, F.concat_ws(" ", subject, _lookup(packs.ACTION_CONTEXT, verb)), subject, none)),
        ("colour", words.rlike(f"^(?:{packs.COLOURS})$"), Made(F.lit("property"), F.concat(words, F.lit(" color")), F.concat(words, F.lit(" color objects")), words, none)),
        ("noun", category.isNotNull() & ~category.startswith("concept:"), Made(category, words, F.concat_ws(" ", words, F.coalesce(_lookup(packs.NOUN_CONTEXT, category), F.lit("object"))), words, none)),
        ("concept", F.lit(True), concept),
    ]


def _lexicon(verbs: Column | None, nouns: Column | None) -> tuple[Column, Column]:
    return (F.array().cast("array<string>") if verbs is None else verbs), (F.create_map().cast("map<string,string>") if nouns is None else nouns)


def classify(df: DataFrame, meaning: Column, part_of_speech: Column | None = None, verbs: Column | None = None, nouns: Column | None = None) -> DataFrame:
    """Df with `excluded` (why there is no picture), `phrase` (what rules look at), `met` (all rules that
    hold) and `plan`: struct (rule, kind, subject, query, fallback, domain) of the first of them; null for an excluded or
    empty gloss.

    verbs: an array of known verbs; nouns: a map of nouns to categories (`lexicon`). What the rules
    ask of a phrase is computed once, in columns of its own.
    """
    pos = F.lit(None).cast("string") if part_of_speech is None else part_of_speech
    v, n = _lexicon(verbs, nouns)
    rows = df.withColumns({"excluded": exclusion(meaning, pos), "phrase": phrase(meaning), "__pos": pos, "__verbs": v, "__nouns": n})
    asked = parts(F.col("phrase"), F.col("__verbs"), F.col("__nouns"))
    rows = rows.withColumns({f"__{name}": c for name, c in asked.items()})
    table = rules(F.col("phrase"), F.col("__pos"), {name: F.col(f"__{name}") for name in asked})
    met = F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds, _ in table]))
    rows = rows.withColumn("met", F.when(F.col("excluded").isNull() & F.col("phrase").isNotNull(), met))
    first = F.get("met", F.lit(0))
    plan = None
    for name, _, made in table:
        if name != "barred-verb":
            plan = F.when(first == name, _struct(name, made)) if plan is None else plan.when(first == name, _struct(name, made))
    return rows.withColumn("plan", plan).drop("__pos", "__verbs", "__nouns", *[f"__{name}" for name in asked])


def lexicon(packed: DataFrame, category: str, words: str) -> DataFrame:
    """One row (verbs, nouns) from rows of a category and its words joined by `|`: the array of the category
    `verb`, and the map of all other words to their category, the first by name if a word has several."""
    each = packed.select(F.col(category).alias("c"), F.explode(F.split(words, r"\|")).alias("w")).where("w <> ''")
    one = each.where("c <> 'verb'").groupBy("w").agg(F.min("c").alias("c"))
    nouns = one.agg(F.map_from_entries(F.coalesce(F.collect_list(F.struct("w", "c")), F.array())).alias("nouns"))
    verbs = each.where("c = 'verb'").agg(F.array_sort(F.collect_set("w")).alias("verbs"))
    return verbs.crossJoin(nouns)  # one row by one row


def search_plan(kind: Column, query: Column, fallback: Column) -> Column:
    """Candidate queries with tiers A to C, most specific first, each once."""
    tiers = F.array(F.struct(F.lit("A").alias("tier"), query.alias("q")), F.struct(F.lit("B").alias("tier"), F.concat_ws(" ", fallback, kind).alias("q")), F.struct(F.lit("C").alias("tier"), fallback.alias("q")))
    return F.filter(tiers, lambda x: x["q"].isNotNull() & (F.length(x["q"]) > 0))
