"""License detection by ordered signature rules.

A text is brought to its words: A-Z lower-cased, every run of other characters one space, a space at either end. Rules
are regular expressions on that form. Each is gated by a keyword: texts without any keyword are not looked at again, and
of the rest only the rules whose keyword occurs are run. Detections are intervals; ordered by start, longest and most
specific first, one that lies inside an interval of equal or higher priority is suppressed.

The rules are data, and the scan is one expression of higher-order functions over them: no Python, no shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Characters that part words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that are always looked for, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
_BASE_ANY = "(?:" + "|".join(p for p, _ in BASE) + ")"

#: Priorities: a full grant or an identifier, a name with its version, a bare name or mention.
GRANT, NAMED, MENTION = 3, 2, 1


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str


_UNDER = "(?:(?:licensed|released|distributed|available|provided|published|made available|redistributed) under(?: the)?(?: terms of(?: the)?)?) "
_VERSION = "(?: (?:license|licence))?(?: (?:version|v))? v?"
_LATER = "(?: or(?: at your option)? (?:any )?later(?: version)?)"


def _versioned(names: str, keyword: str, label: str, versions: dict[str, str], later: bool = False) -> list[Rule]:
    """Grant, name and SPDX rules of a license that has versions; versions: written form to suffix of the label."""
    out = []
    for written, suffix in versions.items():
        name = f"{names}{_VERSION}{written}"
        out += [Rule(f"{label}-{suffix}", GRANT, keyword, f"{_UNDER}{name}"), Rule(f"{label}-{suffix}", NAMED, keyword, name)]
        out.append(Rule(f"{label}-{suffix}", GRANT, "spdx", f"spdx license identifier {label.replace('-', ' ')} {written}(?: only)?"))
        if later:
            out += [Rule(f"{label}-{suffix}-or-later", GRANT, keyword, f"(?:{_UNDER})?{name}{_LATER}"), Rule(f"{label}-{suffix}-or-later", GRANT, "spdx", f"spdx license identifier {label.replace('-', ' ')} {written} or later")]
    return [*out, Rule(label, MENTION, keyword, names)]


def _plain(label: str, keyword: str, names: str, spdx: str) -> list[Rule]:
    return [Rule(label, GRANT, keyword, f"{_UNDER}{names}"), Rule(label, GRANT, "spdx", f"spdx license identifier {spdx}"), Rule(label, NAMED, keyword, names)]


def _creative_commons() -> list[Rule]:
    out = []
    terms = {"": "", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc-sa": "non ?commercial share ?alike", "nc-nd": "non ?commercial no ?deriv(?:ative)?s?(?: works)?"}
    for short, words in terms.items():
        label = f"cc-by-{short}" if short else "cc-by"
        code = f"cc by{' ' + short.replace('-', ' ') if short else ''}"
        long = f"creative commons attribution{' ' + words if words else ''}"
        for written, version in (("1 0", "1.0"), ("2 0", "2.0"), ("2 5", "2.5"), ("3 0", "3.0"), ("4 0", "4.0")):
            out += [Rule(f"{label}-{version}", GRANT, "cc by", f"{_UNDER}(?:a )?{code} {written}"), Rule(f"{label}-{version}", NAMED, "cc by", f"{code} {written}")]
            out.append(Rule(f"{label}-{version}", NAMED, "creative commons", f"{long}(?: {written}| (?:international|unported|generic) {written}|(?: license)? v?{written})"))
        out += [Rule(label, MENTION, "cc by", code), Rule(label, MENTION, "creative commons", long)]
    return out


#: The rules in order: of equal detections the first counts.
RULES: list[Rule] = [
    *_creative_commons(),
    *_plain("cc0-1.0", "cc0", "cc0(?: 1 0(?: universal)?)?", "cc0 1 0"),
    Rule("cc0-1.0", NAMED, "creative commons", "creative commons (?:zero|public domain dedication)"),
    *_versioned("(?:gnu )?affero general public license", "affero", "agpl", {"1(?: 0)?": "1.0", "3(?: 0)?": "3.0"}, later=True),
    *_versioned("(?:gnu )?agpl", "agpl", "agpl", {"1(?: 0)?": "1.0", "3(?: 0)?": "3.0"}),
    *_versioned("(?:gnu )?(?:lesser|library) general public license", "general public license", "lgpl", {"2(?: 0)?": "2.0", "2 1": "2.1", "3(?: 0)?": "3.0"}, later=True),
    *_versioned("(?:gnu )?lgpl", "lgpl", "lgpl", {"2(?: 0)?": "2.0", "2 1": "2.1", "3(?: 0)?": "3.0"}),
    *_versioned("(?:gnu )?general public license", "general public license", "gpl", {"1(?: 0)?": "1.0", "2(?: 0)?": "2.0", "3(?: 0)?": "3.0"}, later=True),
    *_versioned("(?:gnu )?gpl", "gpl", "gpl", {"1(?: 0)?": "1.0", "2(?: 0)?": "2.0", "3(?: 0)?": "3.0"}),
    *_versioned("(?:gnu )?free documentation license", "free documentation", "gfdl", {"1 1": "1.1", "1 2": "1.2", "1 3": "1.3"}, later=True),
    *_versioned("apache(?: software)?", "apache", "apache", {"1 0": "1.0", "1 1": "1.1", "2(?: 0)?": "2.0"})[:-1],
    Rule("apache", MENTION, "apache", "apache(?: software)? license"),
    *_versioned("mozilla public license", "mozilla", "mpl", {"1 0": "1.0", "1 1": "1.1", "2 0": "2.0"}),
    *_versioned("mpl", "mpl", "mpl", {"1 0": "1.0", "1 1": "1.1", "2 0": "2.0"})[:-1],
    *_versioned("eclipse public license", "eclipse", "epl", {"1 0": "1.0", "2 0": "2.0"}),
    *_versioned("european union public (?:license|licence)", "european union public", "eupl", {"1 0": "1.0", "1 1": "1.1", "1 2": "1.2"}),
    *_versioned("common development and distribution license", "common development", "cddl", {"1 0": "1.0", "1 1": "1.1"}),
    *_versioned("common public license", "common public", "cpl", {"1 0": "1.0"}),
    *_versioned("artistic license", "artistic", "artistic", {"1 0": "1.0", "2 0": "2.0"}),
    *_versioned("open software license", "open software", "osl", {"1 0": "1.0", "2 0": "2.0", "2 1": "2.1", "3 0": "3.0"}),
    *_versioned("academic free license", "academic free", "afl", {"1 1": "1.1", "2 0": "2.0", "2 1": "2.1", "3 0": "3.0"}),
    *_versioned("sil open font license", "open font", "ofl", {"1 0": "1.0", "1 1": "1.1"}),
    *_versioned("open database license", "open database", "odbl", {"1 0": "1.0"}),
    *_versioned("open data commons attribution license", "open data commons", "odc-by", {"1 0": "1.0"}),
    *_versioned("server side public license", "server side public", "sspl", {"1(?: 0)?": "1.0"}),
    *_versioned("business source license", "business source", "busl", {"1 1": "1.1"}),
    *_versioned("boost software license", "boost", "bsl", {"1 0": "1.0"}),
    *_versioned("python software foundation license", "python software", "psf", {"2(?: 0)?": "2.0"}),
    *_versioned("php license", "php license", "php", {"3 0": "3.0", "3 01": "3.01"}),
    *_versioned("zope public license", "zope", "zpl", {"2 0": "2.0", "2 1": "2.1"}),
    *_versioned("microsoft (?:public|reciprocal) license", "microsoft", "ms-pl", {"1 0": "1.0"}),
    *_plain("mit", "mit", "mit(?: style)? (?:license|licence)", "mit"),
    *[Rule("mit", p, name, f"{under}{name}(?: style)? (?:license|licence)") for name in ("expat", "x11") for p, under in ((GRANT, _UNDER), (NAMED, ""))],
    Rule("mit", GRANT, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    Rule("isc", GRANT, "permission to use", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee"),
    *_plain("isc", "isc", "isc (?:license|licence)", "isc"),
    *_plain("bsd-2-clause", "bsd", "(?:2|two) clause bsd|(?:simplified|freebsd) bsd|bsd 2 clause", "bsd 2 clause"),
    *_plain("bsd-3-clause", "bsd", "(?:3|three) clause bsd|(?:new|revised|modified) bsd|bsd 3 clause", "bsd 3 clause"),
    *_plain("bsd-4-clause", "bsd", "(?:4|four) clause bsd|(?:old|original) bsd|bsd 4 clause", "bsd 4 clause"),
    *_plain("0bsd", "bsd", "zero clause bsd|0bsd", "0bsd"),
    Rule("bsd", GRANT, "redistribution and use", "redistribution and use in source and binary forms"),
    Rule("bsd", MENTION, "bsd", "bsd(?: style)? (?:license|licence)"),
    *_plain("zlib", "zlib", "zlib(?: libpng)? (?:license|licence)", "zlib"),
    *_plain("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    Rule("unlicense", GRANT, "public domain", "this is free and unencumbered software released into the public domain"),
    *_plain("wtfpl", "what the", "do what the [a-z]+ you want to(?: public license)?", "wtfpl"),
    *_plain("postgresql", "postgresql", "postgresql (?:license|licence)", "postgresql"),
    *_plain("openssl", "openssl", "openssl (?:license|licence)", "openssl"),
    *_plain("ncsa", "ncsa", "(?:university of illinois )?ncsa open source license", "ncsa"),
    *_plain("beerware", "beer", "beer ?ware(?: license)?", "beerware"),
    *_plain("public-domain", "public domain", "(?:released |dedicated |placed )?(?:in|into|to) the public domain", "public domain"),
    Rule("public-domain", MENTION, "public domain", "public domain"),
    Rule("proprietary", GRANT, "proprietary", "(?:this (?:software|document|work) is )?(?:confidential and )?proprietary(?: and confidential)?"),
    Rule("proprietary", NAMED, "reproduc", "no part of this (?:publication|document|work|book) may be reproduced"),
    Rule("proprietary", NAMED, "permission", "(?:may not be|do not) (?:copied|copy|redistributed|redistribute|reproduced|reproduce)(?: [a-z]+){0,4} without(?: [a-z]+){0,3} permission"),
    Rule("reserved", NAMED, "all rights reserved", "(?:copyright (?:c )?(?:[0-9]{4} )?)?all rights reserved"),
    Rule("some-reserved", NAMED, "some rights reserved", "some rights reserved"),
    Rule("no-warranty", MENTION, "warrant", "provided as is without warrant(?:y|ies) of any kind"),
    Rule("editorial", MENTION, "use only", "for (?:personal|editorial) use only"),
    Rule("noncommercial", MENTION, "commercial", "(?:for )?non ?commercial use only"),
    Rule("copyright", MENTION, "copyright", "copyright (?:c )?[0-9]{4}"),
    Rule("license", MENTION, "licensed under", "licensed under"),
]

#: Parts of single words of which every text that a rule or base phrase matches has one; "cc by" is looked for apart.
_GATE = ("licens", "licenc", "rights", "domain", "copyright", "spdx", "permission", "warrant", "proprietary", "redistribution", "commercial", "reproduced", "editorial", "personal", "commons", "public", "bsd", "cc0", "gpl", "beer", "mpl", "apache", "what")
_GATE_GAPS = r"cc[^0-9A-Za-z\x80-\x{10FFFF}]+by"


def _words(low: Column) -> Column:
    """A lower-cased text's words with one space before each and after the last; two spaces if there is none.

    Beyond A-Z lower-casing only maps letters to letters, so words stay where they are.
    """
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, GAP, " ")), F.lit(" "))


_HITS = "array<struct<start:int,neg_stop:int,neg_priority:int,place:int,label:string>>"


def _detections(norm: Column, rules: list[Rule]) -> Column:
    """All matches of the rules whose keyword occurs: array of (start, stop, priority, place of the rule, label).

    The rules of one keyword are first tried together, as one literal expression that is compiled once.
    """
    none = F.array().cast(_HITS)

    def of(r: Column) -> Column:
        found, between = F.regexp_extract_all(norm, r["pattern"], F.lit(0)), F.split(norm, r["pattern"])

        def fold(a: Column, pair: Column) -> Column:
            start = a["at"] + F.length(pair["gap"])
            stop = start + F.length(pair["hit"])
            hit = F.struct((start + 1).alias("start"), (-stop).alias("neg_stop"), (-r["priority"]).alias("neg_priority"), r["place"].alias("place"), r["label"].alias("label"))
            return F.struct(stop.alias("at"), F.when(pair["hit"].isNull(), a["hits"]).otherwise(F.concat(a["hits"], F.array(hit))).alias("hits"))

        pairs = F.zip_with(between, found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("hits")), fold, lambda a: a["hits"])

    by_keyword: dict[str, list[tuple[int, Rule]]] = {}
    for k, r in enumerate(rules):
        by_keyword.setdefault(r.keyword, []).append((k, r))
    # the rules are written as one SQL literal for each keyword: building them column by column takes seconds
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    picked = []
    for keyword, group in by_keyword.items():
        table = F.expr("array(" + ", ".join(f"named_struct('label', {text(r.label)}, 'priority', {r.priority}, 'place', {k}, 'pattern', {text(f' (?:{r.pattern})(?= )')})" for k, r in group) + ")")
        some = F.contains(norm, F.lit(keyword)) & norm.rlike(f" (?:{'|'.join(dict.fromkeys(r.pattern for _, r in group))})(?= )")
        picked.append(F.when(some, table).otherwise(F.expr("array()").cast("array<struct<label:string,priority:int,place:int,pattern:string>>")))
    return F.flatten(F.transform(F.concat(*picked), of))


def _survivors(hits: Column) -> Column:
    """Interval containment: by start, longest, highest priority; kept if it ends beyond all kept ones of its priority or higher."""
    none = F.array().cast("array<struct<priority:int,label:string>>")
    start = F.struct(*[F.lit(0).alias(f"to{p}") for p in (MENTION, NAMED, GRANT)], none.alias("kept"))

    def fold(a: Column, h: Column) -> Column:
        stop, priority = -h["neg_stop"], -h["neg_priority"]
        reach = F.greatest(*[F.when(F.lit(p) >= priority, a[f"to{p}"]).otherwise(F.lit(0)) for p in (MENTION, NAMED, GRANT)])
        keep = stop > reach
        to = [F.when(keep & (priority == p), F.greatest(stop, a[f"to{p}"])).otherwise(a[f"to{p}"]).alias(f"to{p}") for p in (MENTION, NAMED, GRANT)]
        return F.struct(*to, F.when(keep, F.concat(a["kept"], F.array(F.struct(priority.alias("priority"), h["label"].alias("label"))))).otherwise(a["kept"]).alias("kept"))

    return F.aggregate(F.array_sort(hits), start, fold, lambda a: a["kept"])


def _spaces(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" ")))).cast("long")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of the BASE phrases; labels adds those of the surviving detections. score is the confidence
    of the best detection: 1 for a grant or identifier, 0.8 for a name, 0.5 for a mention or base phrase, else 0. Null
    and empty texts have no words, null places and empty labels. Repeated rows are scanned each; an empty table gives an
    empty result; other input columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # the generators keep costly columns from being evaluated again in each use
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.inline(F.array(F.struct(F.lower(text).alias("low")))))
    low = F.col("low")
    gate = low.rlike(_GATE_GAPS)
    for word in _GATE:
        gate = gate | F.contains(low, F.lit(word))
    rows = rows.select("doc_id", F.inline(F.array(F.struct(_words(low).alias("norm"), gate.alias("gate")))))
    norm = F.col("norm")
    any_base = f" {_BASE_ANY}(?= )"
    some_base = F.contains(norm, F.lit(BASE[0][0]))
    for p, _ in BASE[1:]:
        some_base = some_base | F.contains(norm, F.lit(p))
    counted = lambda p: F.when(F.contains(norm, F.lit(p)), F.regexp_count(norm, F.lit(f" {p}(?= )"))).otherwise(0).cast("long")
    found = F.struct(
        F.when(norm == "  ", F.lit(0).cast("long")).otherwise(_spaces(norm) - 1).alias("n_words"),
        *[counted(p).alias(f"b{k}") for k, (p, _) in enumerate(BASE)],
        F.when(some_base, F.regexp_extract(norm, rf"(?s)^(.*?){any_base}", 1)).alias("before_first"),
        F.when(some_base, F.regexp_extract(norm, rf"(?s)^(.*){any_base}", 1)).alias("before_last"),
        F.when(F.col("gate"), let(_detections(norm, rules or RULES), _survivors)).otherwise(F.array().cast("array<struct<priority:int,label:string>>")).alias("kept"),
    )
    got = rows.select("doc_id", F.inline(F.array(found)))
    n_base = F.col("b0") + F.col("b1") + F.col("b2")
    some = n_base > 0
    base_labels = F.array_compact(F.array(*[F.when(F.col(f"b{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    best = F.array_max(F.transform("kept", lambda h: h["priority"]))
    return got.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.when(some, _spaces(F.col("before_first"))).alias("first_word"),
        F.when(some, _spaces(F.col("before_last"))).alias("last_word"),
        F.array_join(F.sort_array(base_labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_labels, F.transform("kept", lambda h: h["label"]))), ",").alias("labels"),
        F.coalesce(F.when(best == GRANT, 1.0).when(best == NAMED, 0.8).when(best == MENTION, 0.5), F.when(some, 0.5), F.lit(0.0)).alias("score"),
    )
