"""License scans: templates compiled into one token automaton.

A template is wording with markup: optional regions may be left out, replaceable regions hold any words (at least and
at most so many) or one of some wordings, and all other words must stand there exactly, in order. Every template
becomes a non-deterministic automaton over words; all of them share one start, and sets of states are made
deterministic when a text first reaches them, so a word costs one table look-up however many templates there are.
Plain phrases are templates without markup.

A text is read once, in runs of words that overlap by the longest match, so it may be of any length. Nothing is
shuffled, and the tables depend on the templates alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.common import batches, prepare
from cartlens.llm.license_templates import PHRASES, TEMPLATES

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARKUP = re.compile(r"<<(.*?)>>", re.DOTALL)
_ATTRIBUTE = re.compile(r'(\w+)="([^"]*)"')
#: Words of a text that are looked at together.
RUN = 1 << 16
#: Sets of states that are held before the tables are made anew.
HELD = 50_000
ANY = None
DEAD = -1


def _lower(text: str) -> str:
    return text.encode().lower().decode()  # bytes.lower() changes A-Z only


def words_in(text: str | None) -> Iterator[str]:
    """Words of a text, A-Z lower-cased, one after the other."""
    return (found.group() for found in _WORD.finditer(_lower(text))) if text else iter(())


def parse(template: str) -> list[tuple]:
    """Wording as parts: ("word", w), ("any", least, most), ("one", [[words] ...]) and ("optional", parts)."""
    stack: list[list[tuple]] = [[]]
    at = 0
    for markup in _MARKUP.finditer(template):
        stack[-1].extend(("word", w) for w in words_in(template[at : markup.start()]))
        at = markup.end()
        kind, _, rest = markup.group(1).strip().partition(";")
        values = dict(_ATTRIBUTE.findall(rest))
        if kind == "beginOptional":
            stack.append([])
        elif kind == "endOptional" and len(stack) > 1:
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif kind == "var" and "match" in values:
            stack[-1].append(("one", [list(words_in(choice)) for choice in values["match"].split("|")]))
        elif kind == "var" and "words" in values:
            least, _, most = values["words"].partition("-")
            stack[-1].append(("any", int(least), int(most or least)))
        else:
            raise ValueError(f"markup not understood: <<{markup.group(1)}>>")
    stack[-1].extend(("word", w) for w in words_in(template[at:]))
    if len(stack) > 1:
        raise ValueError("an optional region is not closed")
    return stack[0]


def longest(parts: Sequence[tuple]) -> int:
    """Words of the longest text that fits."""
    total = 0
    for kind, *value in parts:
        total += {"word": lambda v: 1, "any": lambda v: v[1], "one": lambda v: max(map(len, v[0])), "optional": lambda v: longest(v[0])}[kind](value)
    return total


def _mandatory_first(parts: Sequence[tuple]) -> bool:
    """Whether a match starts with a given word, so that a search knows where to start."""
    for kind, *value in parts:
        if kind == "any":
            return False
        if kind == "optional":
            if not _mandatory_first(value[0]):
                return False
        elif kind == "word" or all(value[0]):
            return True
    return False


class Automaton:
    """All templates at once. States of the tables are numbers; ``accepts[state]`` lists the templates that end there."""

    def __init__(self, templates: Sequence[tuple[str, str]]) -> None:
        """``templates``: (label, template); matches name templates by their number."""
        self.labels = [label for label, _ in templates]
        self.moves: list[list[tuple[str | None, int]]] = []
        self.skips: list[list[int]] = []
        self.ends: dict[int, int] = {}
        self.longest = 0
        starts = []
        for number, (label, template) in enumerate(templates):
            parts = parse(template)
            if not _mandatory_first(parts):
                raise ValueError(f"template {label} does not start with given words")
            self.longest = max(self.longest, longest(parts))
            start = self._state()
            starts.append(start)
            self.ends[self._add(parts, start)] = number
        self.vocabulary = {word for moves in self.moves for word, _ in moves if word is not ANY}
        self.starts = self._closure(starts)
        self._reset()
        self.first = {w for w in self.vocabulary if self.step(0, w) != DEAD}

    def _state(self) -> int:
        self.moves.append([])
        self.skips.append([])
        return len(self.moves) - 1

    def _move(self, state: int, word: str | None) -> int:
        after = self._state()
        self.moves[state].append((word, after))
        return after

    def _add(self, parts: Sequence[tuple], state: int) -> int:
        for kind, *value in parts:
            if kind == "word":
                state = self._move(state, value[0])
            elif kind == "any":
                end = self._state()
                for k in range(value[1]):
                    if k >= value[0]:
                        self.skips[state].append(end)
                    state = self._move(state, ANY)
                self.skips[state].append(end)
                state = end
            else:
                choices = [[("word", w) for w in words] for words in value[0]] if kind == "one" else [value[0], []]
                end = self._state()
                for choice in choices:
                    self.skips[self._add(choice, state)].append(end)
                state = end
        return state

    def _closure(self, states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for after in self.skips[todo.pop()]:
                if after not in found:
                    found.add(after)
                    todo.append(after)
        return frozenset(found)

    def _reset(self) -> None:
        self.sets: list[frozenset[int]] = []
        self.number: dict[frozenset[int], int] = {}
        self.table: list[dict[str | None, int]] = []
        self.accepts: list[tuple[int, ...]] = []
        self._number(self.starts)

    def _number(self, states: frozenset[int]) -> int:
        if states not in self.number:
            self.number[states] = len(self.sets)
            self.sets.append(states)
            self.table.append({})
            self.accepts.append(tuple(sorted(self.ends[s] for s in states if s in self.ends)))
        return self.number[states]

    def step(self, state: int, word: str) -> int:
        """The state behind ``word``, or DEAD. Words of no template are all alike."""
        key = word if word in self.vocabulary else ANY
        after = self.table[state].get(key)
        if after is None:
            reached = {to for s in self.sets[state] for on, to in self.moves[s] if on is ANY or on == key}
            after = self.table[state][key] = self._number(self._closure(reached)) if reached else DEAD
        return after

    def at(self, words: Sequence[str], start: int) -> dict[int, int]:
        """Templates that match from word ``start``, with the end of their longest match."""
        state, found = 0, {}
        for place in range(start, min(len(words), start + self.longest)):
            state = self.step(state, words[place])
            if state == DEAD:
                break
            for number in self.accepts[state]:
                found[number] = place + 1
        return found

    def search(self, words: Iterator[str]) -> tuple[int, list[tuple[int, int, int]]]:
        """Number of words, and (start, end, template) of every match, by start."""
        first, matches, offset, held = self.first, [], 0, []
        while True:
            if len(self.sets) > HELD:
                self._reset()
            fresh = list(islice(words, RUN))
            held += fresh
            # A match from the last words could go on in the next run.
            ready = max(0, len(held) - self.longest + 1) if fresh else len(held)
            for start in [i for i, word in enumerate(held[:ready]) if word in first]:
                matches += [(offset + start, offset + end, number) for number, end in self.at(held, start).items()]
            offset += ready
            held = held[ready:]
            if not fresh:
                return offset, matches

    def whole(self, words: Sequence[str]) -> list[str]:
        """Labels of the templates that accept the words as a whole."""
        state = 0
        for word in words:
            state = self.step(state, word)
            if state == DEAD:
                return []
        return [self.labels[number] for number in self.accepts[state]]


def covered(matches: Sequence[tuple[int, int, int]]) -> int:
    """Words inside matches; words inside several count once."""
    total = reached = 0
    for start, end, _ in matches:  # by start
        total += max(0, end - max(start, reached))
        reached = max(reached, end)
    return total


_MATCH = "array<struct<label: string, phrase: boolean, start: long, end: long>>"


def scan_licenses(
    docs: DataFrame,
    *,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
) -> DataFrame:
    """``keep`` columns, n_words, ``matches`` and score of every row.

    A match is the place of a phrase or the longest text from a word on that a template accepts: words [start, end),
    its label, and whether it is a phrase. All places count, also overlapping ones. Score is the share of the text's
    words inside matches. Null and empty texts have no words, no matches and score 0. Repeated rows get equal results;
    other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(docs.sparkSession)
    added = T._parse_datatype_string(f"n_words long, matches {_MATCH}, score double").fields
    schema = T.StructType([*[docs.select(k).schema[0] for k in keep], *added])
    arrow = to_arrow_schema(schema)
    entries = [*[(label, phrase) for phrase, label in phrases.items()], *templates.items()]
    n_phrases = len(phrases)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(entries)
        for batch in batches(source):
            sizes, found, scores = [], [], []
            for value in batch.column(text):
                n, matches = automaton.search(words_in(value.as_py()))
                sizes.append(n)
                scores.append(covered(matches) / n if n else 0.0)
                found.append(
                    [
                        {"label": automaton.labels[k], "phrase": k < n_phrases, "start": start, "end": end}
                        for start, end, k in matches
                    ]
                )
            values = [pa.array(v, arrow.field(len(keep) + i).type) for i, v in enumerate((sizes, found, scores))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], *values], schema=arrow)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def phrase_places(matches: str = "matches") -> Column:
    """The matches that are places of phrases."""
    return F.filter(matches, lambda m: m["phrase"])


def labels_of(matches: Column | str) -> Column:
    """Distinct labels, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")
