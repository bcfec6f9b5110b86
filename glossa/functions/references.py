"""References from one entry to another: what a gloss says of them, and templates that protect them in translation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions.text import norm_terms


@dataclass(frozen=True)
class Rule:
    """One way to refer: how the gloss begins, the form that is translated in its place, how the translation begins, and how a model may begin it."""

    kind: str
    lead: str
    protected: str
    restored: str
    starts: tuple[str, ...]


#: Ways to refer, in the order in which they are tried (fixed values).
RULES = (
    Rule("old-variant", "old variant of ", "old written form of X", "Varian lama bagi ", ("varian lama", "versi lama", "bentuk lama", "bentuk tulisan lama", "bentuk bertulis lama")),
    Rule("erhua-variant", "erhua variant of ", "erhua variant of X", "Varian erhua bagi ", ("varian erhua", "erhua varian")),
    Rule("variant", "variant of ", "alternative written form of X", "Varian bagi ", ("varian", "bentuk lain", "bentuk alternatif", "bentuk tulisan alternatif", "bentuk bertulis alternatif")),
    Rule("erhua-form", "erhua form of ", "erhua form of X", "Bentuk erhua bagi ", ("bentuk erhua",)),
    Rule("abbreviation", "abbr. for ", "abbreviation for X", "Singkatan bagi ", ("singkatan",)),
    Rule("see", "see ", "see X", "Lihat ", ("lihat",)),
    Rule("also-written", "also written ", "also written as X", "Juga ditulis ", ("juga ditulis", "ditulis juga")),
)
#: Words that may follow a start, by kind (fixed values).
PREPOSITIONS = {"abbreviation": ("untuk", "dari", "daripada", "bagi"), "see": (), "also-written": ("sebagai",)}
USUAL_PREPOSITIONS = ("dari", "daripada", "bagi")
#: A reference is one word of letters, digits or `|` and one reading in brackets, and holds a Han character (fixed values).
WHOLE = r"^[\p{L}\p{N}〇○·|]+\[[A-Za-züÜvV0-5 :'’-]+\]$"
HAN = r"[\p{IsHan}〇○]"
#: What stands for the reference while a gloss is translated (fixed values).
SLOT = "KANJIANREF"
#: Kinds that say two entries mean the same; `see` does not (fixed values).
EQUIVALENCES = ("variant", "old-variant", "erhua-variant", "erhua-form", "abbreviation", "also-written")


def _by_kind(kind: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), kind)


def source(gloss: Column) -> Column:
    """struct (kind, reference) of a gloss that is one whole reference, else null."""
    kind = F.coalesce(*[F.when(gloss.startswith(r.lead), F.lit(r.kind)) for r in RULES])
    reference = F.substr(gloss, F.length(_by_kind(kind, {r.kind: r.lead for r in RULES})) + 1)
    return F.when(reference.rlike(WHOLE) & reference.rlike(HAN), F.struct(kind.alias("kind"), reference.alias("reference")))


def protected_input(kind: Column) -> Column:
    """what is translated in place of a reference of this kind."""
    return _by_kind(kind, {r.kind: r.protected for r in RULES})


def _start(rule: Rule) -> str:
    after = PREPOSITIONS.get(rule.kind, USUAL_PREPOSITIONS)
    return f"(?iu)^(?:{'|'.join(rule.starts)})" + (f"(?: (?:{'|'.join(after)}))?" if after else "") + r"\s+"


def restore(gloss: Column, translated: Column, asked: Column) -> Column:
    """struct (kind, reference, definition): the translation of a gloss with its reference put back; null unless the
    translation has the shape that was asked for. asked: the text given to the model: the gloss itself, the gloss
    with SLOT for its reference, or the protected input."""
    found = source(gloss)
    kind, reference = found["kind"], found["reference"]
    slotted = F.concat(_by_kind(kind, {r.kind: r.lead for r in RULES}), F.lit(SLOT))
    raw = F.regexp_replace(F.regexp_replace(F.trim(translated), r"^[•·]\s*", ""), r"\.$", "")
    start = _by_kind(kind, {r.kind: _start(r) for r in RULES})
    rest = F.when(F.regexp_like(raw, start), F.regexp_replace(raw, start, F.lit("")))
    held = F.when(asked == gloss, rest == reference).when(asked == slotted, rest == SLOT).when(asked == protected_input(kind), rest.rlike("^[Xx]$"))
    text = F.concat(_by_kind(kind, {r.kind: r.restored for r in RULES}), reference, F.lit("."))
    return F.when(held, F.struct(kind.alias("kind"), reference.alias("reference"), text.alias("definition")))


def terms_key(text: Column) -> Column:
    """Terms between `;`, normalised and in order: equal for texts that give the same terms."""
    return F.array_join(F.array_sort(F.transform(F.split(text, ";"), norm_terms)), ";")
