"""Phrase rules as rows: what a phrase shows, its guards, and the queries for a picture.

A pack is a table in the order in which its rules are tried; `rows` turns the tables into rows of
`phrase_rules.SCHEMA`. In a phrase, {poss} stands for each possessive and {verb} for each form of
a rule's verb; in a query, {text} stands for the phrase's whole text.
"""

from __future__ import annotations

#: Speech acts: predicate, query, and how they begin (fixed values).
EXPRESSIONS = (
    ("warn", "person warning another person", ("watch out", "look out", "beware", "proceed with caution", "fore!", "timber!", "warning shouted")),
    ("toast", "people raising glasses in toast", ("cheers!", "bottoms up!", "here's to you!")),
    ("celebrate", "people celebrating together", ("congratulations", "hurray", "hurrah", "yippee", "happy new year", "may you have a prosperous new year")),
    ("thank", "person thanking another person", ("thank you", "we are most grateful")),
    ("greet", "people greeting each other", ("good morning", "good afternoon", "good evening", "hi!", "greetings!", "welcome!")),
    ("farewell", "person waving goodbye", ("bye", "have a nice trip", "bon voyage", "take good care", "take care!")),
    ("surprise", "surprised person expression", ("wow!", "amazing!", "just incredible!", "oh my!", "my goodness!", "good heavens!", "omg!")),
    ("hurry", "person hurrying", ("hurry up!", "get a move on!")),
    ("wait", "person waiting", ("wait a minute!", "wait a moment!", "hold on!", "stay a bit!")),
    ("stand", "person standing up", ("stand up!",)),
    ("march", "people marching in formation", ("march!", "number off!", "count off!")),
    ("attention", "people standing at attention", ("stand at ease!", "attention!")),
    ("stop", "person signaling stop", ("halt!",)),
    ("move aside", "person moving aside", ("move aside!",)),
    ("quiet", "person requesting silence", ("hush!", "shut up!")),
    ("announce", "person making announcement", ("spread the word!",)),
    ("wake", "person waking up", ("rise and shine!",)),
    ("encourage", "person encouraging another person", ("come on!", "let's do this!", "bring it on!", "give me all you got!")),
    ("apologize", "person apologizing", ("sorry!", "excuse me!")),
    ("sad", "sad person expression", ("what a pity!", "oh no!", "alas!")),
    ("pain", "person wincing in pain", ("ouch!",)),
    ("sleep", "person going to bed", ("good night!",)),
    ("refuse comment", "person refusing to comment", ("no comment!",)),
    ("calm", "person calming down", ("calm down",)),
    ("help", "person helping another person", ("save me!", "may i help you", "what can i do for you")),
    ("ask", "person asking question", ("could i have a word", "may i ask", "what happened?", "what's up?", "what's wrong?", "what's the matter?", "what do you think?")),
    ("no smoking", "no smoking sign", ("no smoking!",)),
    ("do not enter", "do not enter road sign", ("do not enter!",)),
)
#: Single glosses that were looked at one by one: how they begin, what else they must hold, predicate, query (fixed values).
REVIEWED = (
    ("stripping ratio", "", "mining stripping ratio", "mining overburden to ore ratio diagram"),
    ("stabbing pain", "", "sharp pain", "sharp pain illustration"),
    ("if three walk together", "", "learn", "person learning from other people"),
    ("if you work at it hard enough", "", "persevere", "person persevering at difficult task"),
    ("if you tough it out", "", "persevere", "person persevering through difficulty"),
    ("if something doesn't work here", "", "adapt", "person trying another approach"),
    ("although i don't understand it", "", "admire", "person admiring unfamiliar work"),
    ("cutting the gordian knot", "", "solve", "person solving difficult problem"),
    ("can the leopard change his spots", "", "unchanging character", "unchanging personal character concept"),
    ("a still", "for distilling alcohol", "distillation", "alcohol distillation apparatus"),
    ("a still", "from a movie", "film still", "film still photograph"),
    ("a can", "loanword", "tin can", "tin can container"),
    ("5-1", "may 1st", "may day", "may day calendar"),
    ("the who", "rock band", "the who", "the who rock band"),
    ("turkish", "canakkale", "canakkale strait", "canakkale strait"),
    ("hua quan", "martial art", "hua quan", "hua quan martial art"),
    ("yu-gi-oh!", "", "yu-gi-oh", "yu-gi-oh card game"),
    ("smiley", "", "smiley", "smiley face symbol"),
    ("identity", "math", "mathematical identity", "mathematical identity equation"),
    ("the not-very-distant past", "", "recent past", "recent past timeline"),
    ("lightly touching the water", "", "touch water", "lightly touching water surface"),
    ("i've got a solution!", "", "solve", "person solving problem"),
)
#: Idioms of any headword: kind, predicate, queries, phrases, and phrases of which one must stand beside (fixed values).
IDIOMS = (
    ("action", "eat", ("person eating ravenously", "person eating quickly", "person eating food"), ("wolf down", "devour ravenously", "eat ravenously", "eat very quickly"), ()),
    ("emotion", "panicked", ("panicked person", "frightened person", "scared confused person"), ("lose {poss} head",), ("fear",)),
    ("emotion", "panicked", ("panicked person", "frightened person", "scared confused person"), ("panic", "panicked"), ()),
    ("place", "crowd", ("large crowd", "dense crowd", "crowd of people"), ("packed like sardines", "vast crowd", "huge crowd", "large crowd", "dense crowd"), ()),
    ("place", "chaos", ("chaotic crowded scene", "disorder crowded scene", "chaos"), ("complete chaos", "chaotic"), ()),
    ("action", "run", ("person running away", "person running quickly", "person running"), ("run for {poss} life",), ()),
    ("conceptual", "rapid growth", ("rapid growth", "growth progress"), ("growth", "improvement", "progress"), ("leaps and bounds", "rapid", "rapidly")),
)
IDIOM_NEGATIONS = ("not", "never", "without")
POSSESSIVES = ("one's", "his", "her", "your", "their")
#: Whole glosses that show a state or a lack: kind, predicate, queries, related words, phrases (fixed values).
STATES = (
    ("human-state", "sleepless", ("sleepless person lying awake",), ("insomnia",), ("unable to sleep",)),
    ("conceptual", "water shortage", ("water shortage",), (), ("lack of water",)),
    ("conceptual", "food shortage", ("food shortage",), (), ("lack of food",)),
    ("conceptual", "sleep shortage", ("sleep shortage",), (), ("lack of sleep",)),
    ("human-state", "exhausted", ("exhausted person resting",), ("exhaustion", "tired"), ("state of exhaustion", "state of being exhausted", "the state of exhaustion", "the state of being exhausted", "state of exhausted")),
    ("emotion", "happy", ("happy excited person", "happy person", "excited person"), (), ("overjoyed",)),
)
#: Turns of phrase: predicate, queries, related words, place, phrases, each also after `to` (fixed values).
TURNS = (
    ("exaggerate", ("person exaggerating small problem", "person overreacting to problem"), ("exaggeration", "overreact", "overreaction"), "start",
        ("make a mountain out of a molehill", "make a big fuss over a small issue", "make a big fuss over a minor issue", "make a big fuss over a small problem", "make a big fuss over a minor problem")),
    ("mistake", ("person making mistake", "person correcting error"), ("error", "incorrect"), "whole",
        ("make mistake", "make a mistake", "make error", "make an error", "making mistake", "making a mistake", "making error", "making an error")),
)
#: Dealings between people: verb, queries, related words, words that make it another act (fixed values).
SOCIAL = (
    ("ask", ("person asking question", "people asking for advice", "person seeking guidance"), ("question", "inquire", "advice", "guidance"), ("price", "trouble", "troubles", "permission", "leave", "money")),
    ("learn", ("people learning together", "person learning from another person", "students studying together"), ("study", "education", "lesson"), ()),
    ("teach", ("person teaching students", "teacher explaining lesson", "people learning together"), ("teaching", "lesson", "instruct"), ()),
    ("help", ("person helping another person", "people offering assistance"), ("assist", "assistance", "helpful"), ("oneself", "himself", "herself", "themselves")),
    ("cooperate", ("people cooperating on task", "team working together"), ("cooperation", "teamwork", "collaborate", "collaboration"), ()),
    ("think", ("person thinking", "thoughtful person"), ("thoughtful", "contemplate", "ponder"), ()),
    ("warn", ("person warning another person", "person giving warning"), ("warning", "caution"), ()),
)
#: What may stand before the verb of such a dealing (fixed values).
AGENTS = ("one who", "a person who", "person who", "someone who", "somebody who", "a worker who", "worker who")
ACTIVITIES = ("act of", "the act of", "activity of", "process of", "the process of", "practice of", "the practice of", "way of", "a way of", "method of", "a method of")
#: Words that turn a gloss around, and words after a head that describe its use (fixed values).
NEGATIONS = ("not", "never", "without", "unable", "cannot", "can't", "don't", "doesn't", "neither", "nor")
DESCRIBING = ("that", "which", "used for", "used to", "made from", "made of", "fed on", "found in", "grown in", "stuffed with", "such as", "for")
#: Kinds of nouns that are no picture by themselves (fixed values).
NOT_SHOWN = ("abstract", "conceptual", "action", "emotion")


def _forms(verb: str) -> tuple[str, str, str]:
    stem = verb[:-1] if verb.endswith("e") else verb
    return verb, verb + ("es" if verb.endswith("ch") else "s"), stem + "ing"


def rows() -> list[tuple]:
    """All packs as rows of phrase_rules.SCHEMA, in the order of their priorities."""
    out: list[tuple] = []

    def add(rule, phrases, place, kind, predicate, queries, related=(), also=(), without=(), after=()):
        for p in phrases:
            for q in [p.replace("{poss}", x) for x in POSSESSIVES] if "{poss}" in p else [p]:
                out.append((rule, len(out), q, place, list(also), list(without), list(after), kind, predicate, list(queries), list(related)))

    for predicate, query, phrases in EXPRESSIONS:
        add("expression", phrases, "start", "action", predicate, (query,))
    for phrase, also, predicate, query in REVIEWED:
        add("reviewed", (phrase,), "start", "conceptual", predicate, (query,), also=(also,) if also else ())
    for kind, predicate, queries, related, phrases in STATES:
        add("state", phrases, "whole", kind, predicate, queries, related)
    for predicate, queries, related, place, phrases in TURNS:
        add("turn", [lead + p for p in phrases for lead in ("", "to ")], place, "action", predicate, queries, related, without=NEGATIONS)
    for kind, predicate, queries, phrases, also in IDIOMS:
        add("idiom", phrases, "any", kind, predicate, queries, also=also, without=IDIOM_NEGATIONS)
    for verb, queries, related, other in SOCIAL:
        root, third, ing = _forms(verb)
        leads = [f"{a} {third}" for a in AGENTS] + [f"{a} {ing}" for a in ACTIVITIES] + [f"to {root}", ing]
        add("social", leads, "start", "action", verb, queries, related, without=(*NEGATIONS, *other))
    return out


def noun_rows(nouns: dict[str, str], first: int) -> list[tuple]:
    """Rules of a lexicon of concrete nouns and their kinds: a described head, and a head at the end of a short name."""
    out: list[tuple] = []
    for rule, place, after, queries in (("described", "any", DESCRIBING, ("{phrase} {kind}", "{phrase}")), ("named", "end", (), ("{text}",))):
        for noun, kind in nouns.items():
            if kind not in NOT_SHOWN:
                out.append((rule, first + len(out), noun, place, [], list(NEGATIONS), list(after), kind, noun, [q.replace("{phrase}", noun).replace("{kind}", kind) for q in queries], []))
    return out
