"""Dictionary matching inside Arrow batches: sentences, phrase spans, unmentions, assertion.

The dictionary travels with the function, so matching is map-only.  Plain
phrases of any number are found in one pass of an automaton over a batch;
phrases with regular-expression characters are tried sentence by sentence.
Positions are code points, as in SQL.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from studybank import constants as K

#: A sentence ends at . ! or ? followed by one space (cleaned text has single spaces).
SENTENCE_BREAK = r"(?<=[.!?]) "
_BREAK = re.compile(SENTENCE_BREAK)
#: Bytes of the texts of a batch that are matched at a time.
PART_BYTES = 1 << 20
_META = re.compile(r"[\\.^$*+?{}\[\]|()\0]")


def split_pattern(pattern: str) -> tuple[str, str]:
    """``A{m}B`` -> ``(A, B)``: what the text before a mention ends with, and
    what the text after it starts with."""
    if "{m}" not in pattern:
        raise ValueError(f"pattern without {{m}}: {pattern!r}")
    return tuple(pattern.split("{m}", 1))


def sentences_of(text: str | None) -> list[tuple[int, int, str]]:
    """(sent_idx, offset, sentence) of one cleaned text; empty sentences are left out."""
    out, at = [], 0
    for i, piece in enumerate(_BREAK.split(text or "")):
        if piece:
            out.append((i, at, piece))
        at += len(piece) + 1
    return out


def _apart(word: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Matches (sorted by word and start) that don't overlap an earlier kept one of their word."""
    keep = np.ones(len(word), dtype=bool)
    close = (word[1:] == word[:-1]) & (start[1:] < end[:-1])
    for w in np.unique(word[1:][close]):
        last = -1
        for i in range(*np.searchsorted(word, (w, w + 1))):
            keep[i] = start[i] >= last
            last = end[i] if keep[i] else last
    return keep


class Dictionary:
    """(observation, phrase) rows in order; ``find`` gives all their matches in a list of units."""

    def __init__(self, rows):
        self.rows = sorted(set(rows))
        self._ready = None

    def __getstate__(self):
        return {"rows": self.rows, "_ready": None}

    def _prepare(self):
        by_word: dict[str, list[int]] = {}
        patterns = []
        for i, (_, phrase) in enumerate(self.rows):
            if _META.search(phrase):
                patterns.append((i, re.compile(phrase)))
            elif phrase:
                by_word.setdefault(phrase, []).append(i)
        automaton = ahocorasick.Automaton()
        for n, word in enumerate(by_word):
            automaton.add_word(word, n)
        if by_word:
            automaton.make_automaton()
        count = np.array([len(r) for r in by_word.values()], dtype=np.int64)
        self._ready = (automaton if by_word else None, np.array([len(w) for w in by_word], dtype=np.int64),
                       count, np.cumsum(count) - count,
                       np.array([i for r in by_word.values() for i in r], dtype=np.int64), patterns)

    def find(self, units: list[str], base: np.ndarray):
        """(row, unit, start, end) arrays of the matches, ordered by unit, start and row.

        ``base`` holds the place of each unit in a text that has all of them, one
        separator apart; start and end are places in that text.  No plain phrase
        holds the separator, so none crosses units."""
        if self._ready is None:
            self._prepare()
        automaton, lengths, count, first, flat, patterns = self._ready
        rows, starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        joined = np.cumsum([0] + [len(u) + 1 for u in units[:-1]])
        if automaton is not None and units:
            hits = np.array(list(automaton.iter("\0".join(units))), dtype=np.int64).reshape(-1, 2)
            word, end = hits[:, 1], hits[:, 0] + 1
            start = end - lengths[word]
            order = np.lexsort((start, word))
            word, start, end = word[order], start[order], end[order]
            keep = _apart(word, start, end)
            word, start, end = word[keep], start[keep], end[keep]
            n = count[word]
            shift = base[np.searchsorted(joined, start, side="right") - 1] - \
                joined[np.searchsorted(joined, start, side="right") - 1]
            rows.append(flat[np.repeat(first[word], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
            starts.append(np.repeat(start + shift, n))
            ends.append(np.repeat(end + shift, n))
        for i, pattern in patterns:
            spans = [(base[u] + m.start(), base[u] + m.end()) for u, unit in enumerate(units)
                     for m in pattern.finditer(unit)]
            if spans:
                s, e = np.array(spans, dtype=np.int64).T
                rows.append(np.full(len(s), i))
                starts.append(s)
                ends.append(e)
        row, start, end = np.concatenate(rows), np.concatenate(starts), np.concatenate(ends)
        order = np.lexsort((row, start))
        row, start, end = row[order], start[order], end[order]
        return row, np.searchsorted(base, start, side="right") - 1, start, end


class Matcher:
    """Mentions that no unmention of their observation overlaps."""

    def __init__(self, mentions, unmentions=()):
        self.mentions = Dictionary(mentions)
        self.unmentions = Dictionary(unmentions)
        names = sorted({o for o, _ in self.mentions.rows} | {o for o, _ in self.unmentions.rows})
        number = {o: i for i, o in enumerate(names)}
        self.of_mention = np.array([number[o] for o, _ in self.mentions.rows], dtype=np.int64)
        self.of_unmention = np.array([number[o] for o, _ in self.unmentions.rows], dtype=np.int64)

    def find(self, units: list[str]):
        """(row of ``mentions``, unit, start, end), start and end within the unit."""
        base = np.cumsum([0] + [len(u) + 1 for u in units[:-1]])
        row, unit, start, end = self.mentions.find(units, base)
        observation = self.of_mention[row]
        some = np.unique(unit[np.isin(observation, self.of_unmention)])
        if len(some):
            r, _, us, ue = self.unmentions.find([units[i] for i in some], base[some])
            blocked = np.zeros(len(row), dtype=bool)
            for o in np.unique(self.of_unmention[r]):
                own = self.of_unmention[r] == o
                at = np.flatnonzero(observation == o)
                s, reach = us[own], np.maximum.accumulate(ue[own])
                last = np.searchsorted(s, end[at], side="left") - 1
                blocked[at] = (last >= 0) & (reach[last] > start[at])
            row, unit, start, end = (x[~blocked] for x in (row, unit, start, end))
        return row, unit, start - base[unit], end - base[unit]

    def names(self, row: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Observation and phrase of each row number."""
        index = pa.array(row)
        return tuple(pa.array([r[i] for r in self.mentions.rows], pa.string()).take(index) for i in (0, 1))


class Assertion:
    """Status of a mention: pre-negation uncertainty, negation, post-negation uncertainty, else positive."""

    ORDER = (("pre_uncertain", "uncertain"), ("negation", "negative"), ("post_uncertain", "uncertain"))

    def __init__(self, rows):
        self.rows = [(status, *split_pattern(p)) for role, status in self.ORDER for r, p in rows if r == role]
        self._ready = None

    def __getstate__(self):
        return {"rows": self.rows, "_ready": None}

    def status(self, text: str, start: int, end: int) -> str:
        if self._ready is None:
            # a look-behind is matched backwards from the mention, so a test costs what it matches
            self._ready = [(s, regex.compile(f"(?<=(?:{a}))") if a else None, regex.compile(f"(?:{b})") if b else None)
                           for s, a, b in self.rows]
        for status, before, after in self._ready:
            if (after is None or after.match(text, end)) and (before is None or before.match(text, start)):
                return status
        return "positive"


LABELS = {"negative": K.NEGATIVE, "uncertain": K.UNCERTAIN, "positive": K.POSITIVE}

SENTENCES_TYPE = "array<struct<sent_idx:int,offset:int,text:string>>"
SPANS_TYPE = "array<struct<observation:string,phrase:string,start:int,end:int>>"
FOUND_FIELDS = ("sent_idx int, offset int, observation string, phrase string, start int, end int, ann_id int, "
                "doc_offset int, length int, mention string, status string, label int")
DOCUMENT_TYPE = ("struct<sentences:array<string>,found:array<struct<pos:int,"
                 + FOUND_FIELDS.replace(", ", ",").replace(" ", ":") + ">>>")


def _lists(counts, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)


def _ints(values) -> pa.Array:
    return pa.array(values, pa.int32())


def _struct(**fields) -> pa.Array:
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))


def _in_parts(texts: pa.Array, work) -> pa.Array:
    """``work`` over the texts, about PART_BYTES of them at a time: what a batch costs beside its result doesn't grow with
    its rows."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()))) // PART_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
    parts = [work(texts.slice(lo, hi - lo)) for lo, hi in zip(cuts, cuts[1:])]
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def sentence_lists(texts: pa.Array) -> pa.Array:
    """Sentences of every text with their numbers and offsets."""
    return _in_parts(texts, _sentence_lists)


def _sentence_lists(texts: pa.Array) -> pa.Array:
    docs = [sentences_of(t) for t in texts.to_pylist()]
    flat = [s for d in docs for s in d]
    return _lists([len(d) for d in docs], _struct(
        sent_idx=_ints([s[0] for s in flat]), offset=_ints([s[1] for s in flat]),
        text=pa.array([s[2] for s in flat], pa.string())))


def span_lists(texts: pa.Array, matcher: Matcher) -> pa.Array:
    """Mentions of every text, each text taken as one sentence."""
    return _in_parts(texts, lambda part: _span_lists(part, matcher))


def _span_lists(texts: pa.Array, matcher: Matcher) -> pa.Array:
    units = [t or "" for t in texts.to_pylist()]
    row, unit, start, end = matcher.find(units)
    observation, phrase = matcher.names(row)
    return _lists(np.bincount(unit, minlength=len(units)), _struct(
        observation=observation, phrase=phrase, start=_ints(start), end=_ints(end)))


def document_lists(texts: pa.Array, matcher: Matcher, assertion: Assertion) -> pa.Array:
    """Sentences of every cleaned text, and its asserted mentions in the order of their ``ann_id``.

    Offsets and ids count within the text, whatever key the text has; ``pos`` is the
    place of the mention's sentence in the list of sentences."""
    return _in_parts(texts, lambda part: _document_lists(part, matcher, assertion))


def _document_lists(texts: pa.Array, matcher: Matcher, assertion: Assertion) -> pa.Array:
    docs = [sentences_of(t) for t in texts.to_pylist()]
    flat = [s for d in docs for s in d]
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    doc = np.repeat(np.arange(len(docs)), sizes)
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    units = [s[2] for s in flat]
    number, offset = (np.array([s[i] for s in flat], dtype=np.int64) for i in (0, 1))
    row, unit, start, end = matcher.find(units)
    observation, phrase = matcher.names(row)
    counts = np.bincount(doc[unit], minlength=len(docs))
    status = [assertion.status(units[u], s, e) for u, s, e in zip(unit.tolist(), start.tolist(), end.tolist())]
    found = _struct(
        pos=_ints(pos[unit]), sent_idx=_ints(number[unit]), offset=_ints(offset[unit]),
        observation=observation, phrase=phrase, start=_ints(start), end=_ints(end),
        ann_id=_ints(np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)),
        doc_offset=_ints(offset[unit] + start), length=_ints(end - start),
        mention=pa.array([units[u][s:e] for u, s, e in zip(unit.tolist(), start.tolist(), end.tolist())], pa.string()),
        status=pa.array(status, pa.string()), label=_ints([LABELS[s] for s in status]))
    return _struct(sentences=_lists(sizes, pa.array(units, pa.string())), found=_lists(counts, found))
