"""Operator 9: licence scans by sentence rules.

A text is cut into sentences (after ``.!?;`` and white space, and at blank lines, in comments too),
each sentence is normalised (lower case, everything but a-z0-9 one space) and mapped to the
identifier of the first sentence rule that knows it; an SPDX line gives the identifiers of its
expression, a sentence that denies a licence names none. A sentence may be wrapped over lines: its
lines are read in order, joined to those before since the last rule; a rule that holds only for
the joined lines takes the place of what its lines said alone, a line that begins in lower case
adds nothing to a higher rule, and other lines with a rule of their own (headings, lists,
notices) are named by themselves. The identifiers of a text, in order, are then matched against the
ordered licence rules: the leftmost match first, the earlier rule first where several start.

Scale: every row for itself, built-in functions only, no shuffle. Texts without any hint word
skip the sentence work. Lines are joined to at most ``JOINED`` characters before them, so a long
text without sentence ends takes linear time.

The DuckDB oracle cuts at line ends, has no ``MORE`` rules and gives a sentence one identifier (here a
GNU licence with its later versions has two); elsewhere both agree.

Defined results: null or empty text has no sentences (empty strings, zero). A repeated sentence
is repeated in the identifiers. Repeated rows give repeated results. Null ids are kept. Extra
columns are ignored by the query and kept by ``recognise``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of which every sentence rule below needs one; sentences without any are passed over.
HINT = ("(?i)licen[sc]|copyright|permission|redistribut|spdx|public[^A-Za-z0-9]+domain|rights[^A-Za-z0-9]+reserved"
        "|software[^A-Za-z0-9]+is[^A-Za-z0-9]+provided|used[^A-Za-z0-9]+to[^A-Za-z0-9]+endorse"
        "|cc0|creative[^A-Za-z0-9]+commons|cc[^A-Za-z0-9]+by|attribution[^A-Za-z0-9]+(?:noncommercial|sharealike)")

# (identifier, pattern on a normalised sentence); the first that matches names the sentence.
SENTENCES = [
    ("spdx", r"spdx license identifier"),
    ("denied", r"\b(?:not|never|no longer) (?:[a-z]+ ){0,3}under (?:the |an? |any )"),
    ("agpl3", r"gnu affero general public license|\bagpl ?v?(?:ersion )?3"),
    ("lgpl21", r"gnu lesser general public license(?: as published by the free software foundation)? (?:v ?|version )2|\blgpl ?v?(?:ersion )?2"),
    ("lgpl3", r"gnu lesser general public license(?: as published by the free software foundation)? (?:v ?|version )3|\blgpl ?v?(?:ersion )?3"),
    ("lgpl", r"gnu lesser general public license|gnu library general public license|\blgpl\b"),
    ("gpl2", r"gnu general public license( as published by the free software foundation)? (v|version )2|\bgpl ?v?(?:ersion )?2"),
    ("gpl3", r"gnu general public license( as published by the free software foundation)? (v|version )3|\bgpl ?v?(?:ersion )?3"),
    ("gpl", r"gnu general public license|\bgpl\b"),
    ("gpl_later", r"either version [0-9]+ of the license or at your option any later version"),
    ("apache1", r"apache (?:software )?license (?:v ?|version )?1"),
    ("apache2", r"apache license|\bapache 2 0\b|\bapache v?2\b"),
    ("apache_use", r"you may not use this file except in compliance with the license"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included"),
    ("mit", r"\bmit licen[sc]e"),
    ("isc_grant", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd_use", r"redistribution and use in source and binary forms"),
    ("bsd_source", r"redistributions of source code must retain"),
    ("bsd_binary", r"redistributions in binary form must reproduce"),
    ("bsd_endorse", r"neither the name of .* may be used to endorse"),
    ("bsd0", r"\b(?:0 clause bsd|bsd 0 clause|zero clause bsd)\b"),
    ("bsd3", r"\bbsd (?:3|three) clause\b|\b(?:3|three) clause bsd\b|\b(?:new|modified|revised) bsd licen[sc]e"),
    ("bsd2", r"\bbsd (?:2|two) clause\b|\b(?:2|two) clause bsd\b|\b(?:simplified|freebsd) (?:bsd )?licen[sc]e"),
    ("bsd4", r"\bbsd (?:4|four) clause\b|\b(?:4|four) clause bsd\b|\boriginal bsd licen[sc]e"),
    ("bsd", r"\bbsd licen[sc]e"),
    ("isc", r"\bisc licen[sc]e"),
    ("boost", r"\bboost software licen[sc]e"),
    ("zlib", r"\bzlib licen[sc]e|\bzlib libpng licen[sc]e"),
    ("unlicense", r"\bthe unlicense\b|\bunlicense licen[sc]e"),
    ("artistic", r"\bartistic licen[sc]e"),
    ("psf", r"\bpython software foundation licen[sc]e"),
    ("eupl", r"\beuropean union public licen[sc]e|\beupl\b"),
    ("cddl", r"\bcommon development and distribution licen[sc]e|\bcddl\b"),
    ("as_is", r"software is provided .*as is"),
    ("mpl11", r"mozilla public license (?:v ?|version )?1 1"),
    ("mpl10", r"mozilla public license (?:v ?|version )?1 0"),
    ("mpl2", r"mozilla public license|\bmpl 2 0\b"),
    ("epl1", r"eclipse public license (?:v ?|version )?1"),
    ("epl2", r"eclipse public license (?:v ?|version )?2"),
    ("epl", r"eclipse public license"),
    ("cc0", r"\bcc0\b|creative commons zero"),
    ("cc_by_nc_nd", r"\bcc by nc nd\b"),
    ("cc_by_nc_sa", r"\bcc by nc sa\b"),
    ("cc_by_nc", r"\bcc by nc\b|attribution noncommercial"),
    ("cc_by_sa", r"\bcc by sa\b|attribution sharealike"),
    ("cc_by_nd", r"\bcc by nd\b"),
    ("cc_by", r"\bcc by\b|creative commons attribution"),
    ("public_domain", r"(released|placed|dedicated) (in)?to the public domain|is in the public domain"),
    ("reserved", r"all rights reserved"),
    ("copyright", r"copyright"),
]

# Licence identifiers that an SPDX line may name, alone or in an expression (AND, OR, WITH).
SPDX = ("0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 "
        "CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GPL-2.0 GPL-2.0+ "
        "GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1+ LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only "
        "LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL NCSA OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 Unlicense UPL-1.0 WTFPL Zlib").split()
SPDX_LINE = r"(?i)spdx-license-identifier\s*:\s*(.*)"

# Rules after those above that the oracle does not have.
MORE = [("public_domain", r"placed in the public domain")]
JOINED = 4000
GNU = ["agpl3", "lgpl21", "lgpl3", "lgpl", "gpl2", "gpl3", "gpl"]
BREAK = r"\n[ \t\r]*(?:#+|\*+/?|/\*+|//+|;+|--)?[ \t\r]*\n"

# (licence, pattern on the identifiers, each written as "identifier;"); earlier rules first.
LICENCES = [
    ("", r"spdx:[A-Za-z0-9.+-]+;"),  # named by its identifier
    ("MIT", r"mit_grant;(?:mit_notice;)?(?:as_is;)?|mit;(?:mit_grant;)?(?:mit_notice;)?(?:as_is;)?"),
    ("BSD-3-Clause", r"bsd_use;bsd_source;bsd_binary;bsd_endorse;(?:as_is;)?"),
    ("BSD-2-Clause", r"bsd_use;bsd_source;bsd_binary;(?:as_is;)?"),
    ("0BSD", r"bsd0;"),
    ("BSD-3-Clause", r"bsd3;(?:bsd_use;)?(?:bsd_source;)?(?:bsd_binary;)?(?:bsd_endorse;)?(?:as_is;)?"),
    ("BSD-2-Clause", r"bsd2;(?:bsd_use;)?(?:bsd_source;)?(?:bsd_binary;)?(?:as_is;)?"),
    ("BSD-4-Clause", r"bsd4;"),
    ("BSD", r"bsd_use;|bsd;"),
    ("ISC", r"(?:isc;)?isc_grant;(?:as_is;)?|isc;"),
    ("BSL-1.0", r"boost;"),
    ("Zlib", r"zlib;"),
    ("Unlicense", r"unlicense;"),
    ("Artistic", r"artistic;"),
    ("PSF", r"psf;"),
    ("EUPL", r"eupl;"),
    ("CDDL", r"cddl;"),
    ("Apache-1", r"apache1;"),
    ("Apache-2.0", r"apache2;(?:apache_use;)?|apache_use;"),
    ("GPL-or-later", r"gpl[23]?;gpl_later;"),
    ("AGPL-3.0", r"agpl3;(?:gpl_later;)?"),
    ("LGPL-2.1", r"lgpl21;(?:gpl_later;)?"),
    ("LGPL-3.0", r"lgpl3;(?:gpl_later;)?"),
    ("LGPL", r"lgpl;(?:gpl_later;)?"),
    ("GPL-2.0", r"gpl2;"),
    ("GPL-3.0", r"gpl3;"),
    ("GPL", r"gpl;"),
    ("MPL-1.1", r"mpl11;"),
    ("MPL-1.0", r"mpl10;"),
    ("MPL-2.0", r"mpl2;"),
    ("EPL-1.0", r"epl1;"),
    ("EPL-2.0", r"epl2;"),
    ("EPL", r"epl;"),
    ("CC0-1.0", r"cc0;"),
    ("CC-BY-NC-ND", r"cc_by_nc_nd;"),
    ("CC-BY-NC-SA", r"cc_by_nc_sa;"),
    ("CC-BY-NC", r"cc_by_nc;"),
    ("CC-BY-SA", r"cc_by_sa;"),
    ("CC-BY-ND", r"cc_by_nd;"),
    ("CC-BY", r"cc_by;"),
    ("Public-Domain", r"public_domain;"),
    ("All-Rights-Reserved", r"(?:copyright;)*reserved;"),
]


def recognise(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``sentence_ids`` (array of identifiers) and ``licences`` (array, in order)."""
    t = F.coalesce(F.col(text), F.lit(""))
    sentences = F.split(F.regexp_replace(t, r"([.!?;])[ \t\r\n]+", "$1\n\n"), BREAK)
    rules = [r for r in SENTENCES if r[0] != "copyright" and r[0] != "reserved"] + MORE + SENTENCES[-2:]
    none = F.lit(None).cast("string")

    def spdx(piece):
        """The identifiers of an SPDX expression, in order, as one name (cut up at the end)."""
        known = F.create_map(*[F.lit(x) for i in SPDX for x in (i.lower(), f"spdx:{i}")])
        ids = F.transform(F.regexp_extract_all(F.regexp_extract(piece, SPDX_LINE, 1), F.lit("[A-Za-z0-9.+-]+"), F.lit(0)), lambda w: F.try_element_at(known, F.lower(w)))
        ids = F.filter(ids, lambda i: i.isNotNull())
        return F.when(F.size(ids) > 0, F.array_join(ids, ";")).otherwise(F.lit("spdx"))

    def name(piece):
        def rule(plain):
            known = none
            for identifier, pattern in reversed(rules):
                known = F.when(plain.rlike(pattern), spdx(piece) if identifier == "spdx" else F.lit(identifier)).otherwise(known)
            return known
        return F.element_at(F.transform(F.array(F.trim(F.regexp_replace(F.lower(piece), "[^a-z0-9]+", " "))), rule), 1)

    def state(ids, before, last):
        return F.struct(ids.alias("ids"), before.alias("before"), last.alias("last"))

    def read(acc, line):
        joined = F.concat_ws(" ", F.substring(acc["before"], -JOINED, JOINED), line)
        own = F.when(line.rlike(HINT), name(line))
        seen = F.transform(F.array(F.struct(own.alias("own"), joined.alias("joined"))), lambda x: F.struct(
            x["own"].alias("own"), x["joined"].alias("joined"), F.when(acc["before"] == "", x["own"]).otherwise(name(x["joined"])).alias("both")))

        def decide(x):
            own, both, last, ids = x["own"], x["both"], acc["last"], acc["ids"]
            inner = line.rlike(r"^[^A-Za-z0-9]*[a-z]")
            without = F.when(last.isNull(), ids).otherwise(F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0))))
            wrapped = both.isNotNull() & ~both.eqNullSafe(own) & ~both.eqNullSafe(last)
            return F.when(wrapped, state(F.concat(without, F.array(both)), x["joined"], both)) \
                .when(own.isNull() | (inner & both.eqNullSafe(last)), state(ids, x["joined"], last)) \
                .when(inner & both.eqNullSafe(own), state(F.concat(without, F.array(own)), x["joined"], own)) \
                .otherwise(state(F.concat(ids, F.array(own)), line, own))

        return F.element_at(F.transform(seen, decide), 1)

    def names(sentence):
        start = state(F.array().cast("array<string>"), F.lit(""), none)
        found = F.aggregate(F.split(sentence, "\n"), start, read, lambda acc: acc["ids"])
        # one sentence may name a GNU licence and allow its later versions
        later = F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " ").rlike(dict(SENTENCES)["gpl_later"])
        both = lambda ids: F.flatten(F.transform(ids, lambda x: F.when(x.isin(*GNU), F.array(x, F.lit("gpl_later"))).otherwise(F.array(x))))
        return F.element_at(F.transform(F.array(found), lambda ids: F.when(later & ~F.array_contains(ids, "gpl_later"), both(ids)).otherwise(ids)), 1)

    ids = F.flatten(F.transform(F.flatten(F.transform(F.filter(sentences, lambda x: x.rlike(HINT)), names)), lambda x: F.split(x, ";")))
    out = docs.withColumn("sentence_ids", F.when(t.rlike(HINT), ids).otherwise(F.array().cast("array<string>")))
    trail = F.concat_ws("", F.transform("sentence_ids", lambda x: F.concat(x, F.lit(";"))))
    any_rule = r"(?<![a-z0-9_])(?:" + "|".join(f"(?:{p})" for _, p in LICENCES) + ")"

    def licence(hit):
        out = F.lit(None).cast("string")
        for label, pattern in reversed(LICENCES):
            out = F.when(hit.rlike(f"^(?:{pattern})"), F.lit(label) if label else F.regexp_extract(hit, "^spdx:(.*);$", 1)).otherwise(out)
        return out

    hits = F.regexp_extract_all(trail, F.lit(any_rule), F.lit(0))
    return out.withColumn("licences", F.when(F.size("sentence_ids") > 0, F.transform(hits, licence)).otherwise(F.array().cast("array<string>")))


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return recognise(docs.select("doc_id", "text")).select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
                                                           F.array_join("licences", ",").alias("licences"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    plain = "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))"
    known = ", ".join(q(i.lower()) for i in SPDX)
    canon = "CASE w " + " ".join(f"WHEN {q(i.lower())} THEN {q('spdx:' + i)}" for i in SPDX) + " END"
    words = f"list_filter(list_transform(regexp_extract_all(regexp_extract(s, {q(SPDX_LINE)}, 1), '[A-Za-z0-9.+-]+'), lambda w: lower(w)), lambda w: w IN ({known}))"
    spdx = f"coalesce(nullif(array_to_string(list_transform({words}, lambda w: {canon}), ';'), ''), 'spdx')"
    name = "CASE " + " ".join(f"WHEN regexp_matches({plain}, {q(p)}) THEN {spdx if i == 'spdx' else q(i)}" for i, p in SENTENCES) + " END"
    rule = "CASE " + " ".join(f"WHEN regexp_matches(h, {q('^(?:' + p + ')')}) THEN {q(n) if n else 'h[6:-2]'}" for n, p in LICENCES) + " END"
    # the engine has no look-behind: identifiers are closed by ';' and opened by ' ', rules likewise
    return f"""
    WITH d AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)) AS lines FROM documents),
    i AS (SELECT doc_id, list_filter(list_transform(list_filter(lines, lambda s: regexp_matches(s, {q(HINT)})), lambda s: {name}), lambda x: x IS NOT NULL) AS names FROM d),
    e AS (SELECT doc_id, flatten(list_transform(names, lambda x: string_split(x, ';'))) AS ids FROM i),
    t AS (SELECT doc_id, ids, regexp_extract_all(list_aggregate(list_transform(ids, lambda x: x || ';'), 'string_agg', ''), {q('|'.join('(?:' + p + ')' for _, p in LICENCES))}) AS hits FROM e)
    SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
           coalesce(array_to_string(list_transform(hits, lambda h: {rule}), ','), '') AS licences FROM t"""


OP9_SQL = _sql()
