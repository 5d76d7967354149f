"""License scans: ordered signature rules, gated by keywords, with containment suppression.

Texts are lower-cased (A-Z) and reduced to words joined by single spaces.  A rule is a regular
expression over that form, a label, a keyword that every match of it holds as a whole word (itself
or one of its forms, as gplv3 of gpl), a priority and a confidence.  Some rules are signatures of
license texts and headers, others the wordings that name a family of licenses.  Texts that hold no
trigger in any letters skip the rules before they are normalised; the keywords of the others fetch
their candidate rules by an equi-join with the fixed rule table, and only those are matched.  A
detection inside a longer one, or an equal one of a higher priority, is suppressed unless its own
priority is higher.  DataFrame operations only.

Defined results: a null text is empty and has no words; repeated rows get the same result; an
empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LETTER_GAP, lower_ascii, table

# The stated phrases, in the order of their labels.
BASE_PHRASES = {"apache": "apache license", "cc-by": "cc by", "gpl": "gnu general public license", "mit": "mit license"}
# License families: label, keyword, name as words (a regular expression), versions.
FAMILIES = (
    ("apache", "apache", "apache(?: software)?", ("1 0", "1 1", "2 0")),
    ("gpl", "gnu", "gnu general public", ("1", "2", "3", "2 0", "3 0")),
    ("gpl", "gpl", "(?:gnu )?gpl(?:v[123])?", ("1", "2", "3", "2 0", "3 0")),
    ("lgpl", "lesser", "gnu lesser general public", ("2 1", "3", "3 0")),
    ("lgpl", "lgpl", "(?:gnu )?lgpl(?:v[23])?", ("2 1", "3", "3 0")),
    ("agpl", "affero", "gnu affero general public", ("3", "3 0")),
    ("agpl", "agpl", "(?:gnu )?agpl(?:v3)?", ("3", "3 0")),
    ("gfdl", "documentation", "gnu free documentation", ("1 1", "1 2", "1 3")),
    ("mit", "mit", "(?:the )?mit(?: x11)?", ()),
    ("bsd", "bsd", "(?:(?:new|modified|simplified|[234] clause) )?bsd(?: [234] clause)?", ()),
    ("isc", "isc", "isc", ()),
    ("mpl", "mozilla", "mozilla public", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse public", ("1 0", "2 0")),
    ("edl", "distribution", "eclipse distribution", ("1 0",)),
    ("cddl", "cddl", "cddl", ("1 0", "1 1")),
    ("cddl", "development", "common development and distribution", ("1 0", "1 1")),
    ("cpl", "common", "common public", ("1 0",)),
    ("eupl", "eupl", "eupl", ("1 1", "1 2")),
    ("eupl", "european", "european union public", ("1 1", "1 2")),
    ("artistic", "artistic", "artistic", ("1 0", "2 0")),
    ("zlib", "zlib", "zlib(?: libpng)?", ()),
    ("boost", "boost", "boost(?: software)?", ("1 0",)),
    ("unlicense", "unlicense", "unlicense", ()),
    ("wtfpl", "wtfpl", "wtfpl", ("2",)),
    ("cc0", "cc0", "cc0", ("1 0",)),
    ("cc-by", "attribution", "creative commons attribution", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "cc", "cc by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "sharealike", "creative commons attribution sharealike", ("2 0", "3 0", "4 0")),
    ("cc-by-sa", "sa", "cc by sa", ("2 0", "3 0", "4 0")),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial", ("2 0", "3 0", "4 0")),
    ("cc-by-nc", "nc", "cc by nc(?: sa| nd)?", ("2 0", "3 0", "4 0")),
    ("cc-by-nd", "nd", "cc by nd", ("2 0", "3 0", "4 0")),
    ("ofl", "sil", "sil open font", ("1 0", "1 1")),
    ("psf", "python", "python software foundation", ("2",)),
    ("php", "php", "php", ("3 0", "3 01")),
    ("ruby", "ruby", "ruby", ()),
    ("w3c", "w3c", "w3c(?: software)?", ()),
    ("openssl", "openssl", "openssl", ()),
    ("postgresql", "postgresql", "postgresql", ()),
    ("unicode", "unicode", "unicode", ()),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?", ()),
    ("odbl", "odbl", "odbl", ("1 0",)),
    ("odbl", "database", "open database", ("1 0",)),
    ("proprietary", "proprietary", "proprietary", ()),
)
#: Other words that a match may hold instead of its keyword.
FORMS = {"gplv1": "gpl", "gplv2": "gpl", "gplv3": "gpl", "lgplv2": "lgpl", "lgplv3": "lgpl", "agplv3": "agpl"}
# Wordings around a family's name: regular expression, priority, confidence.
WORDINGS = (
    (r"(?:dual )?licen[sc]ed under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]e)?(?: version)?(?: {version})?", 3, 0.99),
    (r"(?:released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]e)?(?: version)?(?: {version})?", 3, 0.97),
    (r"spdx licen[sc]e identifier {name}(?: {version})?(?: only| or later)?", 3, 1.0),
    (r"under (?:the )?terms (?:and conditions )?of (?:the )?{name}(?: licen[sc]e)?(?: version)?(?: {version})?", 2, 0.95),
    (r"(?:covered|governed) by (?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]e)?(?: version)?(?: {version})?", 2, 0.95),
    (r"subject to (?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]e)?(?: version)?(?: {version})?", 2, 0.93),
    (r"{name} licen[sc]e(?: agreement)?(?: version)?(?: {version})?", 2, 0.9),
    (r"licen[sc]e {name}(?: version)?(?: {version})?", 1, 0.7),
)
# Signatures of license texts, headers and notices: label, keyword, regular expression.
TEXTS = (
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "noninfringement", r"provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "sublicense", r"use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("x11", "consortium", r"the name of the x consortium shall not be used in advertising"),
    ("isc", "permission", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", r"the author disclaims all warranties with regard to this software"),
    ("0bsd", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "endorse", r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products"),
    ("bsd", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("apache", "apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "apache", r"www apache org licenses license 2 0"),
    ("apache", "apache", r"this product includes software developed (?:by|at) the apache software foundation"),
    ("apache", "asf", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl", "gnu", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "gnu", r"you should have received a copy of the gnu general public license"),
    ("gpl", "gnu", r"www gnu org licenses gpl"),
    ("gpl", "gpl", r"redistribute it and or modify it under the terms of the (?:gnu )?gpl(?:v[123])?"),
    ("gpl", "gpl", r"free software released under the (?:gnu )?gpl(?:v[123])?"),
    ("lgpl", "lesser", r"under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", "lesser", r"you should have received a copy of the gnu lesser general public license"),
    ("lgpl", "library", r"under the terms of the gnu library general public license"),
    ("agpl", "affero", r"under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "affero", r"you should have received a copy of the gnu affero general public license"),
    ("gfdl", "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("mpl", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "cddl", r"subject to the terms of the common development and distribution license the cddl"),
    ("eupl", "eupl", r"licensed under the eupl(?: version)? 1 [012]"),
    ("artistic", "artistic", r"this is free software you can redistribute it and or modify it under the terms of the artistic license"),
    ("artistic", "perl", r"under the same terms as perl(?: itself)?"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("boost", "boost", r"distributed under the boost software license version 1 0"),
    ("boost", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "wtfpl", r"do what the fuck you want to public license wtfpl"),
    ("cc0", "cc0", r"cc0 1 0 universal(?: public domain dedication)?"),
    ("cc0", "waived", r"has waived all copyright and related or neighboring rights"),
    ("cc-by", "attribution", r"this work is licensed under a creative commons attribution [1234] [05] (?:international|generic|unported) license"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by [1234] [05]"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa [1234] [05]"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc(?: sa| nd)? [1234] [05]"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd [1234] [05]"),
    ("cc-by-sa", "attribution", r"this work is licensed under a creative commons attribution share ?alike [1234] [05] (?:international|generic|unported) license"),
    ("ofl", "font", r"this font software is licensed under the sil open font license"),
    ("psf", "python", r"this license agreement is between the python software foundation psf"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("postgresql", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("unicode", "unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("ncsa", "illinois", r"developed by the university of illinois .{1,80}? permission is hereby granted free of charge"),
    ("odbl", "database", r"this .{1,40}? is made available under the open database license"),
    ("public-domain", "domain", r"(?:released into|dedicated to|placed in|in) the public domain"),
    ("proprietary", "confidential", r"(?:this (?:document|software|file) is )?(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|distribution|use) of this (?:file|software|document) (?:via any medium )?is strictly prohibited"),
    ("all-rights-reserved", "reserved", r"all rights reserved"),
)
#: Every wording above holds one of these words, every text its keyword.
TRIGGERS = ("license", "licence", "licensed", "licenced", "released", "distributed", "available", "published", "provided", "terms", "covered", "governed", "subject")
TRIGGERS += tuple(sorted({keyword for _, keyword, _ in TEXTS} - set(TRIGGERS)))
# Letters of which every match of every rule holds some; a text without them, in any case, has no match.
LETTERS = (
    "licen", "under", "covered", "governed", "subject", "unauthorized", "confidential", "public", "copyright",
    "without", "hereby", "consortium", "contributors", "distributed", "universal", "reserved", "software", "altered",
)


def rules() -> list[tuple]:
    """(rule_id, label, keyword, regex, priority, confidence): a wording for each family, and the signatures."""
    made = []
    for label, keyword, name, versions in FAMILIES:
        for wording, priority, sure in WORDINGS:
            body = wording.replace("{name}", name)
            body = body.replace("{version}", f"(?:{'|'.join(sorted(versions, key=len, reverse=True))})") if versions else body.replace("(?: {version})?", "")
            made.append((label, keyword, body, priority, sure))
    made += [(label, keyword, body, 4, 0.95) for label, keyword, body in TEXTS]
    return [(i, label, keyword, f"(?<= ){body}(?= )", priority, sure) for i, (label, keyword, body, priority, sure) in enumerate(made)]


def _spaces(c):
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def normalised(text):
    """' word word ': starts and ends with one space, also when there is no word."""
    return F.regexp_replace(F.concat(F.lit(" "), lower_ascii(F.coalesce(text, F.lit(""))), F.lit(" ")), LETTER_GAP, " ")


def detections(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, text_hash, rule_id, label, priority, confidence, start, stop (words): what survives suppression."""
    spark = docs.sparkSession
    table_ = spark.createDataFrame(rules(), "rule_id int, label string, keyword string, regex string, priority int, confidence double")
    keywords = F.array(*[F.lit(k) for k in sorted({r[2] for r in rules()} | set(FORMS))])
    forms = F.create_map(*[F.lit(x) for pair in FORMS.items() for x in pair])
    # Searches for plain letters are far cheaper than one regular expression of them all; the array makes
    # the lower-cased text a variable, which a filter would otherwise copy into each of them.
    near = docs.filter(F.exists(F.array(F.lower(F.col(text_col))), lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in LETTERS])))
    gated = near.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), normalised(F.col(text_col)).alias("norm"))
    # One reference to `norm`: the filter is pushed below the projection, with a copy of it for each.
    gated = gated.filter(F.regexp_like("norm", F.lit(f" (?:{'|'.join(TRIGGERS)}) "))).withColumn("row", F.monotonically_increasing_id())
    gated = gated.withColumn("held", F.array_intersect(F.split("norm", " "), keywords))
    # A text with several forms of a keyword tries its rules once.
    held = F.array_distinct(F.transform("held", lambda k: F.coalesce(forms[k], k)))
    gated = gated.withColumn("keyword", F.explode_outer(held)).drop("held").filter("keyword is not null")
    # The rule table is fixed in this file, some hundred short rows, so it may be broadcast.
    tried = gated.join(F.broadcast(table_), "keyword").filter(F.regexp_like("norm", F.col("regex")))
    both = F.arrays_zip(
        F.transform(F.split("norm", F.col("regex"), F.lit(-1)), _spaces).alias("gap"),
        F.transform(F.regexp_extract_all("norm", F.col("regex"), F.lit(0)), _spaces).alias("inside"),
    )
    ids = ("doc_id", "text_hash", "row", "rule_id", "label", "priority", "confidence")
    found = tried.select(*ids, F.posexplode(both).alias("i", "m")).select(*ids, "i", "m.gap", "m.inside")
    upto = Window.partitionBy("row", "rule_id").orderBy("i")
    start = F.sum("gap").over(upto) + F.coalesce(F.sum("inside").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - 1
    found = found.withColumn("start", start).filter("inside is not null").withColumn("stop", F.col("start") + F.col("inside") + 1)
    # Sorted so, whatever contains a detection stands before it.
    before = Window.partitionBy("row").orderBy("start", F.desc("stop"), F.desc("priority"), "rule_id").rowsBetween(Window.unboundedPreceding, -1)
    hidden = F.lit(False)
    for level in sorted({r[4] for r in rules()}):
        reach = F.max(F.when(F.col("priority") >= level, F.col("stop"))).over(before)
        hidden = hidden | ((F.col("priority") <= level) & (F.coalesce(reach, F.lit(-1)) >= F.col("stop")))
    return found.withColumn("hidden", hidden).filter(~F.col("hidden")).drop("hidden", "gap", "inside", "i")


def scan_licenses(docs: DataFrame, *, id_col="doc_id", text_col="text", phrases=None) -> DataFrame:
    """One row per document: places of the stated phrases, and the labels that phrases or rules give."""
    phrases = phrases or BASE_PHRASES
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), normalised(F.col(text_col)).alias("norm"))
    held = {label: F.contains("norm", F.lit(f" {p} ")) for label, p in phrases.items()}
    # Two places of a phrase may share the space between them, so the last one is left to a lookahead.
    counts = [F.when(held[label], F.regexp_count("norm", F.lit(f" {p}(?= )"))).otherwise(0) for label, p in phrases.items()]
    firsts = [F.when(held[label], _spaces(F.substring_index("norm", f" {p} ", 1))) for label, p in phrases.items()]
    # From the right: the words after the last place, from all words.
    lasts = [F.when(held[label], _spaces(F.col("norm")) - 1 - _spaces(F.substring_index("norm", f" {p} ", -1)) - len(p.split())) for label, p in phrases.items()]
    base = base.select(
        "doc_id", "text_hash", (_spaces(F.col("norm")) - 1).cast("long").alias("n_words"),
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.array_min(F.array(*firsts)).cast("long").alias("first_word"), F.array_max(F.array(*lasts)).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(held[label], F.lit(label)) for label in phrases])).alias("base_list"),
    )
    found = detections(docs, id_col=id_col, text_col=text_col)
    found = found.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(F.collect_set("label").alias("more"), F.max("confidence").alias("confidence"))
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    none = F.array().cast("array<string>")
    score = F.greatest(F.when(F.col("n_base") > 0, 0.9).otherwise(0.0), F.coalesce("confidence", F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base_list"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_list", F.coalesce("more", none))), ",").alias("labels"),
        score.alias("score"),
    )


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
