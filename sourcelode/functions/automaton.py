"""Which of very many rules are worth a regex on a line: literal factors in one automaton."""

import re
from re import _constants as parts, _parser as parser

#: Factors shorter than this tell little.
LEAST_LENGTH = 2


def _best(options: list):
    """Of several sets of factors the one with the longest shortest factor, then the fewest."""
    usable = [o for o in options if o and min(map(len, o)) >= LEAST_LENGTH]
    return max(usable, key=lambda o: (min(map(len, o)), -len(o)), default=None)


def _factors(items) -> list:
    """Sets of texts of which every match of a parsed sequence holds one, in lower case."""
    found, run = [], ""

    def close():
        nonlocal run
        if run:
            found.append(frozenset((run,)))
        run = ""

    for kind, value in items:
        if kind is parts.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if kind is parts.SUBPATTERN:
            inner = value[3]
            if all(k is parts.LITERAL and v < 128 for k, v in inner):
                run += "".join(chr(v).lower() for _, v in inner)
                continue
        close()
        if kind is parts.SUBPATTERN:
            found += _factors(value[3])
        elif kind is parts.BRANCH:
            sets = [_best(_factors(branch)) for branch in value[1]]
            if all(sets):
                found.append(frozenset().union(*sets))
        elif kind in (parts.MAX_REPEAT, parts.MIN_REPEAT, parts.POSSESSIVE_REPEAT) and value[0] > 0:
            found += _factors(value[2])
        elif kind is parts.ATOMIC_GROUP:
            found += _factors(value)
    close()
    return found


def required_factors(pattern: str):
    """Lower-case texts of which each match of a case-insensitive pattern holds at least one; None if none are known.

    Letters with further case forms beyond ASCII (see ``FOLDING_LETTERS``) may stand for k, s and i, so lines
    with one of these are not decided by factors.
    """
    return _best(_factors(parser.parse(pattern, re.IGNORECASE | re.MULTILINE)))


class RuleChooser:
    """The rules that can match a line, by one run of an Aho-Corasick automaton over it.

    ``specs`` are (rule id, pattern, languages). The automaton holds the factors of all rules; its run over a line costs the same
    for ten rules and for ten thousand. Rules without factors are worth a regex on every line.
    """

    def __init__(self, specs, folding: tuple):
        from ahocorasick import Automaton

        self.specs, self.folding = list(specs), folding
        self.automaton, self.always = Automaton(), []
        owners: dict = {}
        for at, (_, pattern, _) in enumerate(self.specs):
            factors = required_factors(pattern)
            if factors is None:
                self.always.append(at)
            for factor in factors or ():
                owners.setdefault(factor, []).append(at)
        for factor, rules in owners.items():
            self.automaton.add_word(factor, tuple(rules))
        self.automaton.make_automaton()
        self.compiled: dict = {}
        #: Regexes run so far.
        self.tried = 0

    def pattern(self, at: int):
        if at not in self.compiled:
            self.compiled[at] = re.compile(self.specs[at][1], re.IGNORECASE | re.MULTILINE)
        return self.compiled[at]

    def chosen(self, line: str) -> list:
        if any(letter in line for letter in self.folding):
            return list(range(len(self.specs)))
        hits = set(self.always)
        if len(self.automaton):
            for _, rules in self.automaton.iter(line.lower()):
                hits.update(rules)
        return sorted(hits)

    def matches(self, line: str, language: str):
        """(rule id, match) of every rule for a language, in the order of the rules."""
        for at in self.chosen(line):
            rule_id, _, langs = self.specs[at]
            if language in langs:
                self.tried += 1
                for match in self.pattern(at).finditer(line):
                    yield rule_id, match
