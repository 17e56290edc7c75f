"""Closed word classes, as plain data. Words of a class are listed by their endings."""

from __future__ import annotations

#: Words that carry grammar rather than content.
FUNCTION_WORDS = (
    "a had did could should would and be since once made he she the make like while me some are here there where were before more these else "
    "those whose because quite have above we off if yourself itself myself of being something doing during having each which much such though "
    "although through with i until all well still will am them him whom from an can than been between then when often even in again within on own "
    "down do ago who no too so also to into up under her rather whether either neither other further after however over their or for nor our your "
    "as has was does is his this perhaps its us at that what get yet might it got not except most just must but out about without you few how now "
    "may by they only my any many very every"
).split()

#: Words that weaken a claim.
HEDGES = (
    "could would tend maybe indicate seem often appear tends sometimes indicates seems perhaps appears suggests somewhat might suggest may "
    "presumably possibly likely unlikely roughly occasionally generally apparently"
).split()

#: Words that strengthen a claim.
BOOSTERS = (
    "impossible never always must invariably inevitably undoubtedly definitely absolutely necessarily certainly clearly obviously unambiguously"
).split()

#: Pronouns by person.
FIRST_SINGULAR = (
    "me mine myself i my"
).split()

#: Pronouns by person.
FIRST_PLURAL = (
    "we our ourselves ours us"
).split()

#: Pronouns by person.
SECOND_PERSON = (
    "yourself your yourselves yours you"
).split()

#: Pronouns by person.
THIRD_PERSON = (
    "he she himself herself itself them him her their themselves his hers theirs its it they"
).split()

#: Words that open a concession.
CONCESSIONS = (
    "while despite notwithstanding though although however whereas nonetheless nevertheless yet but"
).split()

#: Phrases that weaken a claim; counted as substrings of the lower-cased prose.
HEDGE_PHRASES = [
    "to some degree",
    "in a sense",
    "in some sense",
    "i believe",
    "i think",
    "in many ways",
    "i suspect",
    "to some extent",
]

#: Substrings that mark a turn as an assistant's.
ASSISTANT_PHRASES = [
    "certainly!",
    "certainly,",
    "i'm claude",
    "claude here",
    "i'm an ai",
    "i am an ai",
    "as an ai",
    "i don't have personal",
    "as a language model",
    "i'd be happy to",
    "i cannot have opinions",
    "let me know if you",
    "i'll help you",
]
