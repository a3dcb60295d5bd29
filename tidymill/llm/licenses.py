"""License detection by ordered signature rules, in DataFrame expressions only.

Texts become lower-case words, each with a space on either side, so that a rule is a plain regular
expression on words. A rule is tried only on documents that hold all its keywords; which ones a
document holds is told by one pass of one expression. Matches are intervals of words. A match gives
way to one that contains it and has a higher priority, or the same priority and more words, or the
very same words and an earlier rule. What stays gives the labels; the score is its largest weight.

Everything happens within a row: no shuffle, no group to be hot. Suppression compares a match with
those that begin in its own block of ``BLOCK`` words or the one before; no rule spans more words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from ._arrow import once

BLOCK = 64

# The base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]


@dataclass(frozen=True)
class Rule:
    label: str
    needs: tuple[str, ...]  # keywords, all of which the text must hold as words
    pattern: str  # words with single spaces; groups do not capture
    weight: float
    priority: int


# label; keywords of its name; its name; its identifier, as words
LICENSES = [
    ("mit", "mit", "mit(?: license| licence)", "mit"),
    ("mit-0", "mit attribution", "mit no attribution(?: license| licence)?", "mit 0"),
    ("x11", "x11", "(?:mit )?x11(?: license| licence)", "x11"),
    ("isc", "isc", "isc(?: license| licence)", "isc"),
    ("apache-2", "apache", "apache(?: software)?(?: license| licence)?(?: version| v)? (?:2|v2)(?: 0)?", "apache 2 0"),
    ("apache-2", "apache", "apache(?: software)?(?: license| licence)? (?:license|licence|version)(?:2|v2)(?: 0)?", "apache 2"),
    ("apache-2", "apache2", "apache2(?: 0)?", "apache2"),
    ("apache-2", "apachev2", "apachev2(?: 0)?", "apachev2"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license| licence)(?: version)? (?:1|v1) 1", "apache 1 1"),
    ("apache-1.0", "apache", "apache(?: software)?(?: license| licence)(?: version)? (?:1|v1) 0", "apache 1 0"),
    ("bsd-2", "bsd", "(?:bsd 2|2|two) clause(?: simplified)?(?: bsd)?(?: license| licence)", "bsd 2 clause"),
    ("bsd-2", "bsd simplified", "simplified bsd(?: license| licence)", "bsd 2 clause freebsd"),
    ("bsd-3", "bsd", "(?:bsd 3|3|three) clause(?: bsd)?(?: license| licence)", "bsd 3 clause"),
    ("bsd-3", "bsd", "(?:new|revised|modified) bsd(?: license| licence)", "bsd 3 clause clear"),
    ("bsd-4", "bsd", "(?:bsd 4|4|four) clause(?: bsd)?(?: license| licence)", "bsd 4 clause"),
    ("bsd-0", "bsd", "(?:bsd 0|0|zero) clause bsd(?: license| licence)?", "0bsd"),
    ("bsd", "bsd", "bsd(?: style)?(?: license| licence)", "bsd"),
    ("gpl-1", "gnu", "gnu general public(?: license| licence)(?: version| v)? (?:1|v1)(?: 0)?", "gpl 1 0"),
    ("gpl-2", "gnu", "gnu general public(?: license| licence)(?: version| v)? (?:2|v2)(?: 0)?", "gpl 2 0"),
    ("gpl-2", "gpl", "(?:gnu )?gpl(?: version| v)? (?:2|v2)(?: 0)?(?: only)?", "gpl 2 0 only"),
    ("gpl-2+", "gpl", "(?:gnu )?gpl(?: version| v)? (?:2|v2)(?: 0)? or(?: any)? later(?: version)?", "gpl 2 0 or later"),
    ("gpl-3", "gnu", "gnu general public(?: license| licence)(?: version| v)? (?:3|v3)(?: 0)?", "gpl 3 0"),
    ("gpl-3", "gpl", "(?:gnu )?gpl(?: version| v)? (?:3|v3)(?: 0)?(?: only)?", "gpl 3 0 only"),
    ("gpl-3+", "gpl", "(?:gnu )?gpl(?: version| v)? (?:3|v3)(?: 0)? or(?: any)? later(?: version)?", "gpl 3 0 or later"),
    ("gpl", "gnu", "gnu general public(?: license| licence)", "gpl"),
    ("lgpl-2", "gnu", "gnu library general public(?: license| licence)", "lgpl 2 0"),
    ("lgpl-2.1", "gnu lesser", "gnu lesser general public(?: license| licence)(?: version)? (?:2|v2) 1", "lgpl 2 1"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl(?: version)? (?:2|v2) 1", "lgpl 2 1 only"),
    ("lgpl-3", "gnu lesser", "gnu lesser general public(?: license| licence)(?: version)? (?:3|v3)(?: 0)?", "lgpl 3 0"),
    ("lgpl-3", "lgpl", "(?:gnu )?lgpl(?: version)? (?:3|v3)(?: 0)?", "lgpl 3 0 only"),
    ("lgpl", "gnu lesser", "gnu lesser general public(?: license| licence)", "lgpl"),
    ("agpl-3", "affero", "(?:gnu )?affero general public(?: license| licence)(?: version)?(?: (?:3|v3)(?: 0)?)?", "agpl 3 0"),
    ("agpl-3", "agpl", "(?:gnu )?agpl(?: version)?(?: (?:3|v3)(?: 0)?)?", "agpl 3 0 only"),
    ("gfdl", "gnu documentation", "gnu free documentation(?: license| licence)", "gfdl 1 3"),
    ("mpl-1.1", "mozilla", "mozilla public(?: license| licence)(?: version)? (?:1|v1) 1", "mpl 1 1"),
    ("mpl-2", "mozilla", "mozilla public(?: license| licence)(?: version)?(?: (?:2|v2)(?: 0)?)?", "mpl 2 0"),
    ("mpl-2", "mpl", "mpl(?: version)? (?:2|v2)(?: 0)?", "mpl 2 0 no copyleft exception"),
    ("epl-1", "eclipse", "eclipse public(?: license| licence)(?: version)? (?:1|v1)(?: 0)?", "epl 1 0"),
    ("epl-2", "eclipse", "eclipse public(?: license| licence)(?: version)?(?: (?:2|v2)(?: 0)?)?", "epl 2 0"),
    ("cddl-1", "cddl", "(?:common development and distribution license )?cddl(?: version)?(?: 1 [01])?", "cddl 1 0"),
    ("cpl-1", "common", "common public(?: license| licence)(?: version)?(?: 1 0)?", "cpl 1 0"),
    ("eupl-1.2", "eupl", "(?:european union public licence )?eupl(?: v)?(?: 1 [12])?", "eupl 1 2"),
    ("osl-3", "open", "open software(?: license| licence)(?: version)?(?: 3 0)?", "osl 3 0"),
    ("afl-3", "academic", "academic free(?: license| licence)(?: version)?(?: 3 0)?", "afl 3 0"),
    ("artistic-1", "artistic", "artistic(?: license| licence)(?: version)? (?:1|v1)(?: 0)?", "artistic 1 0"),
    ("artistic-2", "artistic", "artistic(?: license| licence)(?: version)?(?: (?:2|v2)(?: 0)?)?", "artistic 2 0"),
    ("zlib", "zlib", "zlib(?: libpng)?(?: license| licence)", "zlib"),
    ("libpng", "libpng", "libpng(?: license| licence)", "libpng"),
    ("boost-1", "boost", "boost software(?: license| licence)(?: version)?(?: 1 0)?", "bsl 1 0"),
    ("bsl-1.1", "business", "business source(?: license| licence)(?: version)?(?: 1 1)?", "busl 1 1"),
    ("sspl-1", "sspl", "(?:server side public license )?sspl(?: version)?(?: 1)?", "sspl 1 0"),
    ("elastic-2", "elastic", "elastic(?: license| licence)(?: version)?(?: 2(?: 0)?)?", "elastic 2 0"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl(?: version)?(?: 2)?", "wtfpl"),
    ("psf-2", "python", "python software foundation(?: license| licence)(?: version)?(?: 2)?", "psf 2 0"),
    ("postgresql", "postgresql", "postgresql(?: license| licence)", "postgresql"),
    ("openssl", "openssl", "openssl(?: license| licence)", "openssl"),
    ("php-3", "php", "php(?: license| licence)(?: version)?(?: 3(?: 0[01])?)?", "php 3 01"),
    ("ruby", "ruby", "ruby(?: license| licence)", "ruby"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?(?: license| licence)", "ncsa"),
    ("ofl-1.1", "ofl", "(?:sil )?(?:open font license )?ofl(?: version)?(?: 1 1)?", "ofl 1 1"),
    ("ofl-1.1", "sil font", "sil open font(?: license| licence)(?: version)?(?: 1 1)?", "ofl 1 1 rfn"),
    ("ms-pl", "microsoft", "microsoft public(?: license| licence)", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal(?: license| licence)", "ms rl"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc0", "creative zero", "creative commons zero(?: license)?(?: 1 0)?", "cc0 1 0 universal"),
    ("cc-by", "creative", "creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: license)?", "cc by 4 0"),
    ("cc-by", "cc", "cc by(?: [1-4] [05])?", "cc by 3 0"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: license)?", "cc by sa 4 0"),
    ("cc-by-sa", "cc", "cc by sa(?: [1-4] [05])?", "cc by sa 3 0"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: license)?", "cc by nc 4 0"),
    ("cc-by-nc", "cc", "cc by nc(?: [1-4] [05])?", "cc by nc 3 0"),
    ("cc-by-nd", "creative", "creative commons attribution no ?derivatives(?: [1-4] [05])?(?: international| unported)?(?: license)?", "cc by nd 4 0"),
    ("cc-by-nd", "cc", "cc by nd(?: [1-4] [05])?", "cc by nd 3 0"),
    ("cc-by-nc-sa", "creative", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: license)?", "cc by nc sa 4 0"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4] [05])?", "cc by nc sa 3 0"),
    ("cc-by-nc-nd", "creative", "creative commons attribution non ?commercial no ?derivatives(?: [1-4] [05])?(?: license)?", "cc by nc nd 4 0"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4] [05])?", "cc by nc nd 3 0"),
    ("odbl", "odbl", "(?:open database license )?odbl(?: 1 0)?", "odbl 1 0"),
    ("odc-by", "odc", "odc by(?: 1 0)?", "odc by 1 0"),
    ("pddl", "pddl", "(?:public domain dedication and license )?pddl(?: 1 0)?", "pddl 1 0"),
]

# Sentences of the license texts themselves: label, keywords, words.
NOTICES = [
    ("mit", "permission granted charge", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "warranty noninfringement", "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc", "permission distribute fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "endorse promote products", "may be used to endorse or promote products derived from this software"),
    ("bsd-4", "advertising materials acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2", "apache compliance license", "you may not use this file except in compliance with the license"),
    ("apache-2", "unless applicable law", "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("gpl", "gnu free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public(?: license| licence)"),
    ("lgpl", "gnu free lesser", "redistribute it and or modify it under the terms of the gnu lesser general public(?: license| licence)"),
    ("agpl-3", "affero free software", "redistribute it and or modify it under the terms of the gnu affero general public(?: license| licence)"),
    ("gpl", "gpl see copying", "see the gnu general public license for more details"),
    ("mpl-2", "mozilla source form", "this source code form is subject to the terms of the mozilla public license"),
    ("epl-2", "eclipse accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("zlib", "origin misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "altered plainly marked", "altered source versions must be plainly marked as such"),
    ("boost-1", "boost distributed software", "distributed under the boost software license"),
    ("unlicense", "unencumbered public domain", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "(?:released|dedicated|placed) (?:into|to|in) the public domain"),
    ("public-domain", "public domain", "public domain"),
    ("cc0", "waived copyright related", "waived all copyright and related or neighboring rights"),
    ("proprietary", "rights reserved", "all rights reserved"),
    ("proprietary", "proprietary confidential", "proprietary and confidential"),
    ("proprietary", "unauthorized copying", "unauthorized copying of this file"),
    ("commercial", "commercial license", "commercial(?: license| licence)(?: agreement)?"),
    ("non-commercial", "commercial use", "(?:for )?non ?commercial use only"),
    ("research-only", "research purposes", "for research purposes only"),
    ("wtfpl", "fuck public license", "do what the fuck you want to public license"),
    ("beerware", "beer ware", "beer ware license"),
    ("copyleft", "copyleft", "copyleft"),
]


def _rules() -> list[Rule]:
    rules = [Rule(label, tuple(p.split()), p, 0.9, 50) for p, label in BASE]
    verbs = "(?:licensed|released|distributed|published|available|provided|offered|covered|shared|redistributed)"
    for label, needs, name, identifier in LICENSES:
        words = tuple(needs.split())
        own = tuple(identifier.split())
        rules.append(Rule(label, ("spdx", *own), f"spdx license identifier {identifier}", 1.0, 60))
        rules.append(Rule(
            label, (*words, "under"),
            f"{verbs} under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}", 0.95, 40,
        ))
        rules.append(Rule(label, words, f"(?:see|subject to|license:?|licence|licensed as) (?:the )?{name}", 0.8, 30))
        rules.append(Rule(label, words, name, 0.6, 20))
    rules += [Rule(label, tuple(n.split()), words, 0.85, 45) for label, n, words in NOTICES]
    return rules


RULES = _rules()


def compiled(pattern: str) -> str:
    """The pattern on words that each have a space on either side."""
    return " " + pattern.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + " "


def required_words(pattern: str) -> frozenset[str]:
    """The words that every match of the pattern holds."""
    group = re.search(r"\(\?:([^()]*)\)(\??)", pattern)
    if group:
        forms = group[1].split("|") + [""] * bool(group[2])
        return frozenset.intersection(*[
            required_words(pattern[: group.start()] + form + pattern[group.end() :]) for form in forms
        ])
    plain = pattern.replace(":?", "")
    before, optional, after = plain.partition(" ?")
    if optional:
        return required_words(f"{before} {after}") & required_words(before + after)
    return frozenset(plain.split())


def gated(rule: Rule) -> Rule:
    """The rule with the keywords that each of its matches holds, or else the longest word that each holds.
    A rule without any would be tried on every text."""
    held = required_words(rule.pattern)
    needs = tuple(w for w in rule.needs if w in held) or tuple(sorted(held, key=lambda w: (-len(w), w))[:1])
    return replace(rule, needs=needs)


GATED = [gated(r) for r in RULES]


def _ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, and in other letters whatever makes no ASCII word of them. Lower-casing all letters is
    several times faster than translating A-Z; two letters would become ASCII ones, so texts with these are translated."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    odd = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a"))
    return F.when(odd, F.translate(text, upper, lower)).otherwise(F.lower(text))


def spaced_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, each with a space on either side."""
    words = F.regexp_replace(_ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  ")
    words = F.btrim(words)
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _count_words(spaced: Column) -> Column:
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def _first_place(spaced: Column, phrase: Column) -> Column:
    """Words before the first place of a phrase, null without one. Both spaced."""
    at = F.locate(phrase, spaced) if isinstance(phrase, str) else F.instr(spaced, phrase)
    return F.when(at > 0, _count_words(F.substring(spaced, F.lit(1), at - 1)))


def base_columns(spaced: Column, n_words: Column) -> dict[str, Column]:
    """Places and labels of the base phrases."""
    counts, firsts, lasts, labels = [], [], [], []
    backwards = F.reverse(spaced)
    for phrase, label in BASE:
        form = compiled(phrase)
        held = F.contains(spaced, F.lit(form))
        size = len(phrase.split())
        removed = F.length(spaced) - F.length(F.replace(spaced, F.lit(form), F.lit("")))
        counts.append(F.when(held, (removed / len(form)).cast("long")).otherwise(F.lit(0)))
        firsts.append(F.when(held, _first_place(spaced, F.lit(form))))
        lasts.append(F.when(held, n_words - size - _first_place(backwards, F.lit(form[::-1]))))
        labels.append(F.when(held, F.lit(label)))
    return {
        "n_base": sum(counts[1:], counts[0]).cast("long"), "first_word": F.least(*firsts), "last_word": F.greatest(*lasts),
        "base_found": F.array_compact(F.array(*labels)),
    }


def keywords_in(spaced: Column, rules: list[Rule]) -> Column:
    """The keywords of the rules that the text holds as words."""
    keywords = F.array(*[F.lit(w) for w in sorted({w for r in rules for w in r.needs})])
    return F.array_intersect(keywords, F.split(spaced, " "))


def _matches(spaced: Column, found: Column, rules: list[Rule]) -> Column:
    """All matches ``rule, label, weight, priority, start, stop`` of the rules whose keywords are there."""
    table = F.array(*[
        F.struct(
            F.lit(i).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.weight).alias("weight"),
            F.lit(r.priority).alias("priority"), F.array(*[F.lit(n) for n in r.needs]).alias("needs"),
            F.lit(compiled(r.pattern)).alias("pattern"),
        )
        for i, r in enumerate(rules)
    ])
    tried = F.filter(table, lambda r: F.size(F.array_except(r["needs"], found)) == 0)

    def places(r: Column) -> Column:
        gaps = F.transform(F.split(spaced, r["pattern"], -1), _count_words)
        sizes = F.transform(F.regexp_extract_all(spaced, r["pattern"], F.lit(0)), _count_words)
        none = F.array().cast("array<struct<rule:int,label:string,weight:double,priority:int,start:bigint,stop:bigint>>")
        # Along the text: words before the match, then the match itself.
        start = lambda state, pair: state["at"] + pair["gap"]
        walked = F.aggregate(
            F.zip_with(F.slice(gaps, F.lit(1), F.size(sizes)), sizes, lambda g, s: F.struct(g.alias("gap"), s.alias("size"))),
            F.struct(F.lit(0).cast("long").alias("at"), none.alias("found")),
            lambda state, pair: F.struct(
                (start(state, pair) + pair["size"]).alias("at"),
                F.array_append(state["found"], F.struct(
                    r["rule"].alias("rule"), r["label"].alias("label"), r["weight"].alias("weight"),
                    r["priority"].alias("priority"), start(state, pair).alias("start"),
                    (start(state, pair) + pair["size"]).alias("stop"),
                )).alias("found"),
            ),
        )
        return walked["found"]

    return F.flatten(F.transform(F.filter(tried, lambda r: F.regexp_like(spaced, r["pattern"])), places))


def _beats(b: Column, a: Column) -> Column:
    inside = (b["start"] <= a["start"]) & (b["stop"] >= a["stop"])
    longer = (b["stop"] - b["start"]) > (a["stop"] - a["start"])
    same = (b["stop"] - b["start"]) == (a["stop"] - a["start"])
    return inside & (
        (b["priority"] > a["priority"])
        | (b["priority"] == a["priority"]) & (longer | same & (b["rule"] < a["rule"]))
    )


def _resolved(matches: Column) -> Column:
    """The matches that no other one suppresses. One that contains a match begins at most one block
    before it."""
    block = lambda m: F.floor(m["start"] / BLOCK)
    blocks = F.map_from_entries(F.transform(
        F.array_distinct(F.transform(matches, block)),
        lambda k: F.struct(k.alias("key"), F.filter(matches, lambda m: block(m) == k).alias("value")),
    ))

    def stays(a: Column) -> Column:
        near = F.array(F.try_element_at(blocks, block(a)), F.try_element_at(blocks, block(a) - 1))
        return ~F.exists(F.flatten(F.array_compact(near)), lambda b: _beats(b, a))

    return F.filter(matches, stays)


def detect(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Every row of ``docs`` as ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, detections``.

    ``detections`` are the matches that stay: ``rule, label, weight, priority, start, stop`` in words.
    ``labels`` adds theirs to the base phrases' labels. Null and empty texts have no words, no labels
    and score 0. Repeated rows get equal results; other columns of ``docs`` are not read.
    """
    rules = GATED if rules is None else [gated(r) for r in rules]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), once(spaced_words(F.col("text").cast("string"))).alias("spaced"))
    rows = rows.withColumn("n_words", _count_words(F.col("spaced")))
    rows = rows.withColumns(base_columns(F.col("spaced"), F.col("n_words")))
    rows = rows.withColumn("keywords", once(keywords_in(F.col("spaced"), rules)))
    none = F.array().cast("array<struct<rule:int,label:string,weight:double,priority:int,start:bigint,stop:bigint>>")
    some = (F.size("keywords") > 0) | F.lit(any(not r.needs for r in rules))
    rows = rows.withColumn("matches", once(F.when(some, _matches(F.col("spaced"), F.col("keywords"), rules)).otherwise(none)))
    rows = rows.withColumn("detections", once(F.when(F.size("matches") > 0, _resolved(F.col("matches"))).otherwise(none)))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base_found")).alias("base_labels"),
        joined(F.concat("base_found", F.transform("detections", lambda d: d["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
        "detections",
    )


def detection_sql(rules: list[Rule] | None = None) -> str:
    """The same rows but for ``detections`` as a query on ``documents``, built from joins."""
    rules = GATED if rules is None else [gated(r) for r in rules]
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ",\n".join(
        f"({i}, {quote(r.label)}, CAST({r.weight} AS DOUBLE), {r.priority}, [{', '.join(map(quote, r.needs))}], "
        f"{quote(compiled(r.pattern))})"
        for i, r in enumerate(rules)
    )
    base = ",\n".join(f"({quote(p)}, {quote(label)}, {len(p.split())})" for p, label in BASE)
    return f"""
WITH rules(rule, label, weight, priority, needs, pattern) AS (VALUES {table}),
base(phrase, label, size) AS (VALUES {base}),
texts AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
spaced AS (
  SELECT row_no, doc_id, len(words) AS n_words,
         list_aggregate(list_transform(words, lambda w: ' ' || w || ' '), 'string_agg', '') AS spaced FROM texts),
base_parts AS (
  SELECT row_no, label, size, [(len(g) - len(replace(g, ' ', ''))) // 2 for g in
         string_split(spaced, ' ' || replace(phrase, ' ', '  ') || ' ')] AS gaps
  FROM spaced, base WHERE contains(spaced, ' ' || replace(phrase, ' ', '  ') || ' ')),
base_hits AS (
  SELECT row_no, label, unnest(list_transform(range(1, len(gaps)), lambda k: list_sum(gaps[1:k]) + (k - 1) * size)) AS place
  FROM base_parts),
tried AS (SELECT row_no, spaced, rule, label, weight, priority, pattern
          FROM spaced JOIN rules ON len(list_filter(needs, lambda n: NOT contains(spaced, ' ' || n || ' '))) = 0
          WHERE regexp_matches(spaced, pattern)),
parts AS (SELECT row_no, rule, label, weight, priority,
          [(len(g) - len(replace(g, ' ', ''))) // 2 for g in string_split_regex(spaced, pattern)] AS gaps,
          [(len(h) - len(replace(h, ' ', ''))) // 2 for h in regexp_extract_all(spaced, pattern)] AS sizes FROM tried),
places AS (SELECT row_no, rule, label, weight, priority, unnest(list_transform(range(1, len(sizes) + 1), lambda k:
           struct_pack(start := list_sum(gaps[1:k]) + coalesce(list_sum(sizes[1:k - 1]), 0), size := sizes[k]))) AS found FROM parts),
matches AS (SELECT row_no, rule, label, weight, priority, CAST(found.start AS BIGINT) AS start,
            CAST(found.size AS BIGINT) AS size FROM places),
kept AS (
  SELECT * FROM matches a WHERE NOT EXISTS (
    SELECT 1 FROM matches b WHERE b.row_no = a.row_no AND b.start <= a.start AND b.start + b.size >= a.start + a.size
      AND (b.priority > a.priority OR b.priority = a.priority AND
           (b.size > a.size OR b.size = a.size AND b.rule < a.rule)))),
labelled AS (
  SELECT row_no, label, weight FROM kept UNION ALL SELECT row_no, label, NULL FROM base_hits)
SELECT s.doc_id, s.n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word,
       coalesce(b.base_labels, '') AS base_labels, coalesce(l.labels, '') AS labels, coalesce(l.score, 0.0) AS score
FROM spaced s
LEFT JOIN (SELECT row_no, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base_hits GROUP BY row_no) b USING (row_no)
LEFT JOIN (SELECT row_no, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score
           FROM labelled GROUP BY row_no) l USING (row_no)
"""
