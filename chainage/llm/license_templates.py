"""License scans by template markup.

A template is a text with markup: ``<<beginOptional>> ... <<endOptional>>`` may be left out, and
``<<var;name=...;match=...>>`` is replaceable: ``.+`` stands for any words, one at least, ``.*`` for any words or none, ``.{a,b}`` for a to b words, a
repeated class such as ``[a-z ]+`` with a blank in it for words of it, and any other pattern for a run of words, of
whatever number, that match it when joined by blanks. Everything else is mandatory. Templates are compiled
into token automata; a text has a template's label where a run of its words is accepted, so the mandatory wording
must match exactly, in words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lowered.

An automaton reads a text once, from every place at the same time: its states after a word are those that any place before leads
to, so the work grows with the text's length, however often a template's opening is repeated. (Only a pattern of the last sort is
compared anew with every further word of its run.) Texts that lack a mandatory run of words are passed over. All is a map over
the documents without a shuffle. Apart from templates, plain phrases are counted
wherever their words stand consecutively, overlapping places included.

The score is 0 without a finding, 0.5 with phrases only and 1 with an accepted template. Null and empty texts have no words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainage.llm.common import alnum_words, text_bytes

PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public licenses and of the notices that name them.
TEMPLATES = {
    "mit-notice": """<<beginOptional>><<var;name=verb;match=(released|licensed|available|distributed)>><<endOptional>>
        under the <<beginOptional>>terms of the<<endOptional>> MIT License""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0
        <<beginOptional>>(the "License"); you may not use this file except in compliance with the License<<endOptional>>""",
    "gpl-notice": """licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License
        <<beginOptional>><<beginOptional>>as published by the Free Software Foundation, either<<endOptional>>
        version <<var;name=version;match=[123]>><<endOptional>>""",
    "cc-by-nc-4.0-notice": "Licensed under <<beginOptional>>a<<endOptional>> CC BY-NC 4.0",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of
        <<var;name=software;match=.+>> (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>>
        shall be included in all copies or substantial portions of the Software.
        <<beginOptional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL <<var;name=holder;match=.+>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY<<endOptional>>""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
        <<beginOptional>>If a copy of the MPL was not distributed with this file, You can obtain one at<<endOptional>>""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will
        <<var;name=holder;match=.+>> be held liable for any damages arising from the use of this software. Permission is granted
        to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
        freely, subject to the following restrictions""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
        for any purpose, commercial or non-commercial, and by any means.""",
    "bsl-1.0-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
        software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
        execute, and transmit the Software, and to prepare derivative works of the Software""",
    "isc-text": """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any
        purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: <<var;name=bullet;match=.{0,1}>> Redistributions of source code must retain the
        above copyright notice, this list of conditions and the following disclaimer. <<var;name=bullet;match=.{0,1}>>
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.
        <<beginOptional>><<var;name=bullet;match=.{0,1}>> Neither the name of <<var;name=organization;match=.+>> nor the names of
        its contributors may be used to endorse or promote products derived from this software without specific prior
        written permission.<<endOptional>>""",
}


@dataclass
class Automaton:
    """States 0..n; ``words[s]``: the states after a word, ``any[s]``: after any word, ``like[s]``: after a word that
    matches, ``skip[s]``: without a word. ``runs``: from a state, words that match when joined, to a state."""

    words: list[dict[bytes, list[int]]] = field(default_factory=lambda: [{}])
    any: list[list[int]] = field(default_factory=lambda: [[]])
    like: list[list[tuple[regex.Pattern, int]]] = field(default_factory=lambda: [[]])
    skip: list[list[int]] = field(default_factory=lambda: [[]])
    runs: list[tuple[int, regex.Pattern, int]] = field(default_factory=list)
    mandatory: list[bytes] = field(default_factory=list)
    end: int = 0

    def state(self) -> int:
        self.words.append({})
        self.any.append([])
        self.like.append([])
        self.skip.append([])
        return len(self.skip) - 1

    def closed(self, states) -> set[int]:
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                todo += self.skip[s]
        return out

    def firsts(self) -> set[bytes] | None:
        """The words that can begin a text, None if any can."""
        start = self.closed({0})
        if any(self.any[s] or self.like[s] for s in start) or any(s == r[0] for r in self.runs for s in start):
            return None
        return {w for s in start for w in self.words[s]}

    def found_in(self, words: list[bytes], first: set[bytes] | None) -> bool:
        """Is any run of one word at least accepted? ``first`` is what ``firsts`` gives."""
        start, active = self.closed({0}), set()
        # Where a run of words that may yet match begins, for each of the runs.
        begun: list[list[int]] = [[] for _ in self.runs]
        for i, word in enumerate(words):
            if first is None or word in first:
                active = active | start
            elif not active and not any(begun):
                continue
            after = set()
            for s in active:
                after.update(self.words[s].get(word, ()))
                after.update(self.any[s])
                after.update(to for pattern, to in self.like[s] if pattern.fullmatch(word))
            for k, (begin, pattern, to) in enumerate(self.runs):
                if begin in active:
                    begun[k].append(i)
                left = []
                for b in begun[k]:
                    match = pattern.fullmatch(b" ".join(words[b : i + 1]), partial=True)
                    if match:
                        left.append(b)
                        if not match.partial:
                            after.add(to)
                begun[k] = left
            active = self.closed(after)
            if self.end in active:
                return True
        return False


def compile_template(template: str) -> Automaton:
    """Raises ValueError for markup that is not closed."""
    a = Automaton()
    now, opened, run = 0, [], []

    def finish_run():
        if run:
            a.mandatory.append(b" ".join(run))
            run.clear()

    for part in re.split(r"(<<.*?>>)", template, flags=re.S):
        if part.startswith("<<"):
            finish_run()
            kind = part[2:-2].strip()
            if kind == "beginOptional":
                opened.append(now)
                inner = a.state()
                a.skip[now].append(inner)
                now = inner
            elif kind == "endOptional":
                if not opened:
                    raise ValueError("endOptional without beginOptional")
                after = a.state()
                a.skip[now].append(after)
                a.skip[opened.pop()].append(after)
                now = after
            else:
                pattern = re.fullmatch(r"var;.*?match=(.*)", kind, re.S)
                if not pattern:
                    raise ValueError(f"unknown markup {part}")
                now = _replaceable(a, now, pattern[1].strip().strip('"'))
        else:
            for word in alnum_words(part.encode()):
                after = a.state()
                a.words[now].setdefault(word, []).append(after)
                now = after
                if not opened:
                    run.append(word)
    finish_run()
    if opened:
        raise ValueError("beginOptional without endOptional")
    a.end = now
    return a


def _replaceable(a: Automaton, now: int, pattern: str) -> int:
    bounds = re.fullmatch(r"\.(?:(\+)|(\*)|\{(\d+),(\d+)\})", pattern)
    after = a.state()
    if not bounds:
        repeated = re.fullmatch(r"(\[\^?[^\[\]]+\])([+*])", pattern)
        whole = regex.compile(pattern.encode())
        if whole.fullmatch(b""):
            a.skip[now].append(after)
        if repeated and regex.fullmatch(repeated[1].encode(), b" "):
            # Blanks belong to the class, so every word of its characters may follow.
            word = regex.compile(f"{repeated[1]}+".encode())
            a.like[now].append((word, after))
            a.like[after].append((word, after))
            then = a.state()
            a.skip[after].append(then)
            return then
        a.runs.append((now, whole, after))
        return after
    if not bounds[3]:
        # A state that any word leads back to; with .+ the first word leads there.
        loop = a.state()
        (a.any if bounds[1] else a.skip)[now].append(loop)
        a.any[loop].append(loop)
        a.skip[loop].append(after)
        return after
    least, most = int(bounds[3]), int(bounds[4])
    for i in range(most + 1):
        if i >= least:
            a.skip[now].append(after)
        if i < most:
            then = a.state()
            a.any[now].append(then)
            now = then
    return after


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(alnum_words(p.encode()), label) for p, label in phrases.items()]
        self.templates = [(label, compile_template(t)) for label, t in templates.items()]
        # An automaton that any word can begin is tried from every place.
        self.first = [a.firsts() for _, a in self.templates]
        self.mandatory = [[b" " + m + b" " for m in a.mandatory] for _, a in self.templates]

    def scan(self, text: bytes) -> dict:
        words = alnum_words(text)
        joined = b" " + b" ".join(words) + b" "
        places, base, own, blanks = [], set(), set(), None
        for phrase, label in self.phrases:
            needle = b" " + b" ".join(phrase) + b" "
            hits, at = [], joined.find(needle)
            while at >= 0:
                hits.append(at)
                at = joined.find(needle, at + 1)
            if hits:
                if blanks is None:
                    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
                places += np.searchsorted(blanks, hits).tolist()
                base.add(label)
        for (label, a), first, mandatory in zip(self.templates, self.first, self.mandatory, strict=True):
            if all(m in joined for m in mandatory) and a.found_in(words, first):
                own.add(label)
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | own)),
            "score": 1.0 if own else 0.5 if base else 0.0,
        }


def scan_licenses(docs: DataFrame, phrases=None, templates=None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row."""
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    kinds = {
        "doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(),
        "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
    }

    def scanned(batches):
        scanner, schema = Scanner(phrases, templates), pa.schema(list(kinds.items()))
        for batch in batches:
            rows = [{"doc_id": i} | scanner.scan(t) for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(
        scanned,
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint,"
        " base_labels string, labels string, score double",
    )
