"""License detection by ordered signature rules.

A rule is a regular expression with a label, a priority, a confidence and a keyword without which it
cannot match; the rules are written by hand in ``license_rules``: clauses of the licenses' own texts,
names with and without versions, addresses, notices and hints, and the SPDX tag. One Aho-Corasick
pass finds the keywords that a text has, and only the rules behind them run, over the whole text.
Detections that lie inside another one of higher priority (or of the same and longer) are suppressed;
what is left gives the labels. Base places (the fixed phrases) are counted on the words and their
labels always stay.

Defined results: a null text counts as empty; a text without words has n_words 0, no labels and
score 0; repeated rows each give a row; ties between detections of one span go to the rule that
stands first; very long texts are scanned whole; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import license_rules as rules
from .common import record_batch, text_slices

#: Phrases whose places are counted, with their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Rule:
    """``label`` None: the label is what the pattern's group ``id`` matched."""

    label: str | None
    priority: int
    confidence: float
    keyword: str
    pattern: re.Pattern


def _version(v: str) -> str:
    """Matches a version number, with or without its last zero."""
    number = re.escape(v.removesuffix(".0")) + r"(?:\.0)?" if v.endswith(".0") else re.escape(v)
    return r"[,\s-]*(?:v\.?\s*|version\s+)?" + number + r"(?![\d.]*\d)"


def compiled(pattern: str) -> re.Pattern:
    """A hand-written pattern (see ``license_rules``) as a regular expression of whole words."""
    full = re.sub(r"~(\d+(?:\.\d+)?)", lambda m: _version(m[1]), pattern.replace("license", "licen[sc]e"))
    return re.compile(r"(?<![a-z0-9])(?:" + full.replace(" ", r"\s+") + r")(?![a-z0-9])")


def build_rules() -> list[Rule]:
    """All rules, in the order of their priority."""
    tables = {"clause": rules.CLAUSES, "versioned": rules.VERSIONED, "address": rules.ADDRESSES, "notice": rules.NOTICES, "name": rules.NAMES, "hint": rules.HINTS}
    out = [Rule(None, *rules.SECTIONS["tag"], rules.TAG[0], re.compile(rules.TAG[1]))]
    for section, table in tables.items():
        out += [Rule(label, *rules.SECTIONS[section], keyword, compiled(pattern)) for label, keyword, pattern in table]
    return sorted(out, key=lambda r: -r.priority)


def tag_label(identifier: str) -> str:
    """The label of an SPDX identifier: without "only", "or later" and its plus."""
    return re.sub(r"(?:-only|-or-later|\+)+$", "", identifier)


class Scanner:
    """The rules behind one Aho-Corasick automaton of their keywords."""

    def __init__(self, rules_: list[Rule] | None = None):
        import ahocorasick

        self.rules = build_rules() if rules_ is None else rules_
        self.by_keyword: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            self.by_keyword.setdefault(r.keyword, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for k in self.by_keyword:
            self.automaton.add_word(k, k)
        self.automaton.make_automaton()

    def detections(self, text: str) -> list[tuple[int, int, Rule]]:
        """All matches in the lower-cased text, by start; contained ones suppressed."""
        present = {k for _, k in self.automaton.iter(text)}
        return suppress([x for k in present for i in self.by_keyword[k] for x in self.matches(i, text)])

    def matches(self, i: int, text: str) -> list[tuple[int, int, Rule, int]]:
        """All matches of rule ``i``, each with the rule under its label."""
        rule = self.rules[i]
        return [(m.start(), m.end(), rule if rule.label else replace(rule, label=tag_label(m["id"])), i) for m in rule.pattern.finditer(text)]


def scanner() -> Scanner:
    """One scanner for each process: a task does not build the rules anew."""
    held = sys.modules.setdefault("_engramic_scanner", types.ModuleType("_engramic_scanner")).__dict__
    if "scanner" not in held:
        held["scanner"] = Scanner()
    return held["scanner"]


def suppress(found: list[tuple[int, int, Rule, int]]) -> list[tuple[int, int, Rule]]:
    """Drops detections inside another of higher priority, or of equal priority and greater length
    (equal spans: the rule that stands first stays)."""
    kept: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    reach: list[int] = []
    for a, b, r, _ in sorted(found, key=lambda x: (-x[2].priority, x[0] - x[1], x[3], x[0])):
        at = int(np.searchsorted(starts, a, side="right"))
        if at and reach[at - 1] >= b:
            continue
        kept.append((a, b, r))
        starts.insert(at, a)
        reach.insert(at, max(b, reach[at - 1] if at else 0))
        for k in range(at + 1, len(reach)):
            if reach[k] >= reach[at]:
                break
            reach[k] = reach[at]
    return sorted(kept, key=lambda x: (x[0], x[1]))


_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BASE = [(p.split()[0].encode(), b" " + p.encode() + b" ", label) for p, label in BASE_PHRASES.items()]


def base_places(text: bytes) -> tuple[int, list[int], list[str]]:
    """(number of words, ascending start words of all places of the base phrases, their labels)."""
    words = text.translate(_WORD_BYTES).split()
    joined = b" " + b" ".join(words) + b" "
    places, labels = [], set()
    for _, phrase, label in _BASE:
        at = joined.find(phrase)
        word, scanned = 0, 0
        while at >= 0:
            word += joined.count(b" ", scanned, at)
            scanned = at
            places.append(word)
            labels.add(label)
            at = joined.find(phrase, at + 1)
    return len(words), sorted(places), sorted(labels)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:int,end:int,label:string>>"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """For each document its base places and labels, all labels, a score and the detections left
    (character spans in the text)."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())])
    ints = ("doc_id", "n_words", "n_base", "first_word", "last_word")
    schema = pa.schema([(c, pa.int64()) for c in ints] + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner()
        upper = {c: c + 32 for c in range(65, 91)}
        for batch, texts in text_slices(batches):
            out: dict[str, list] = {f.name: [] for f in schema}
            for text in texts:
                n, places, base = base_places(text)
                low = text.decode().translate(upper)
                found = scan.detections(low)
                labels = {r.label for _, _, r in found} | set(base)
                # a base phrase is certain of its family, a rule as certain as it is specific
                score = 1.0 - float(np.prod([1.0 - r.confidence * 0.95 for _, _, r in found])) * (0.2 if base else 1.0) if labels else 0.0
                row = (n, len(places), places[0] if places else None, places[-1] if places else None, ",".join(base), ",".join(sorted(labels)), min(1.0, max(0.0, score)))
                for c, v in zip([*ints[1:], "base_labels", "labels", "score"], row, strict=True):
                    out[c].append(v)
                out["spans"].append([{"start": a, "end": b, "label": r.label} for a, b, r in found])
            out["doc_id"] = batch.column("doc_id")
            yield record_batch(out, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
