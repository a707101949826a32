"""Licence scan by sentence rules.

A text is cut into sentences that run over single line ends, each is normalised, and known licence
sentences get an identifier, also those with a slot for the holder's name; a short notice gets one from the
licence that it names. An unknown sentence is cut at its line ends too, and what stays unknown breaks a
sequence. Ordered rules are then matched against the sequence of identifiers: an earlier rule takes
its sentences away from later ones. The SQL twin knows single lines and ``SENTENCES`` only.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentences of public licence texts and notices -> identifier.
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheNotice2",
    "licensed under the apache license version 2 0 the license": "ApacheHead2",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopy",
    "released under the mit license": "MitNotice",
    "this project is licensed under the mit license": "MitNotice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitKeep",
    "licensed under cc by nc 4 0": "CcByNc4Notice",
    "licensed under cc by 4 0": "CcBy4Notice",
    "licensed under cc by sa 4 0": "CcBySa4Notice",
    "this work is licensed under the gnu general public license version 3": "Gpl3Notice",
    "this work is licensed under the gnu general public license version 2": "Gpl2Notice",
    "this program is free software": "GplFree",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Terms",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdNames",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Mpl2Notice",
    "all rights reserved": "AllRights",
}
#: Fixed values: (licence, identifiers in sequence), in the order in which they are tried.
RULES = (
    ("Apache-2.0", ("ApacheHead2", "ApacheComply", "ApacheCopy")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNames")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("MIT", ("MitGrant", "MitKeep")),
    ("GPL-3.0-or-later", ("GplFree", "Gpl3Terms")),
    ("GPL-2.0-or-later", ("GplFree", "Gpl2Terms")),
    ("Apache-2.0", ("ApacheHead2", "ApacheComply")),
    ("Apache-2.0", ("ApacheNotice2",)),
    ("Apache-2.0", ("ApacheHead2",)),
    ("MIT", ("MitGrant",)),
    ("MIT", ("MitNotice",)),
    ("CC-BY-NC-4.0", ("CcByNc4Notice",)),
    ("CC-BY-SA-4.0", ("CcBySa4Notice",)),
    ("CC-BY-4.0", ("CcBy4Notice",)),
    ("GPL-3.0-only", ("Gpl3Notice",)),
    ("GPL-2.0-only", ("Gpl2Notice",)),
    ("MPL-2.0", ("Mpl2Notice",)),
)
_TERMS = "you can redistribute it and or modify it under the terms of the gnu {}general public license "
_PUBLISHED = "as published by the free software foundation"
_LATER = "either version {} of the license or at your option any later version"
_GNU = {"Gpl": "", "Lgpl": "lesser ", "Agpl": "affero "}
_CC = {"by": "attribution", "by nc": "attribution noncommercial", "by sa": "attribution sharealike", "by nd": "attribution noderivatives", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
_SPDX = (
    "0BSD", "AFL-3.0", "Artistic-2.0", "BSL-1.0", "CDDL-1.0", "EUPL-1.2", "MIT-0", "MS-PL", "OFL-1.1", "PostgreSQL", "Python-2.0", "WTFPL", *(f"CC-{k.upper().replace(' ', '-')}-3.0" for k in _CC),
    "Apache-2.0", "MIT", "ISC", "Zlib", "Unlicense", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CC0-1.0", *(f"CC-{k.upper().replace(' ', '-')}-4.0" for k in _CC),
    *(f"{n}-{v}-{k}" for n, vs in (("GPL", ("2.0", "3.0")), ("LGPL", ("2.1", "3.0")), ("AGPL", ("3.0",))) for v in vs for k in ("only", "or-later")),
)
#: Whole sentences of standard licence texts and headers, as far as SENTENCES lacks them.
WHOLE = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "Epl1Terms",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "Epl2Terms",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0": "Epl2Terms",
    "this library is free software": "GplFree",
    _TERMS.format("") + "version 2 " + _PUBLISHED: "Gpl2OnlyTerms",
    **{_TERMS.format(w) + _PUBLISHED: f"{n}Terms" for n, w in _GNU.items()},
    **{f"{_TERMS.format(w)}{_PUBLISHED} {_LATER.format(v)}": f"{n}{v.replace(' ', '')}Terms" for n, w in _GNU.items() for v in ("2", "2 1", "3")},
    **{_LATER.format(v): f"Later{v.replace(' ', '')}" for v in ("2", "2 1", "3")},
    **{f"this work is licensed under {a} creative commons {name} 4 0 international license": f"Cc{k.title().replace(' ', '')}4License" for k, name in _CC.items() for a in ("a", "the")},
}
#: What may follow SPDX-License-Identifier, normalised -> identifier.
SPDX = {n.lower().replace("-", " ").replace(".", " "): f"Spdx {n}" for n in _SPDX}
#: Earlier forms of the GNU names, without a suffix and with a plus sign.
SPDX |= {f"{n} {v}{plus}": f"Spdx {n.upper()}-{v.replace(' ', '.')}-{k}" for n, vs in (("gpl", ("2 0", "3 0")), ("lgpl", ("2 1", "3 0")), ("agpl", ("3 0",))) for v in vs for plus, k in (("", "only"), (" plus", "or-later"))}
#: Headings of whole licence files, normalised -> licence. A heading decides over the sample
#: notices further down in its file.
TITLES = {
    "apache license version 2 0 january 2004 http www apache org licenses": "Apache-2.0",
    "apache license version 2 0 january 2004 https www apache org licenses": "Apache-2.0",
    "apache license version 2 0 january 2004": "Apache-2.0",
    "gnu general public license version 2 june 1991": "GPL-2.0-only",
    "gnu general public license version 3 29 june 2007": "GPL-3.0-only",
    "gnu lesser general public license version 2 1 february 1999": "LGPL-2.1-only",
    "gnu lesser general public license version 3 29 june 2007": "LGPL-3.0-only",
    "gnu affero general public license version 3 19 november 2007": "AGPL-3.0-only",
    "mozilla public license version 2 0": "MPL-2.0",
    "eclipse public license v 1 0": "EPL-1.0",
    "eclipse public license v 2 0": "EPL-2.0",
    "boost software license version 1 0 august 17th 2003": "BSL-1.0",
    "cc0 1 0 universal": "CC0-1.0",
    "creative commons legal code cc0 1 0 universal": "CC0-1.0",
    **{f"{name} {v} 0 international": f"CC-{k.upper().replace(' ', '-')}-{v}.0" for k, name in _CC.items() for v in ("4",)},
    **{f"creative commons {name} {v} 0 international public license": f"CC-{k.upper().replace(' ', '-')}-{v}.0" for k, name in _CC.items() for v in ("4",)},
}
#: Names by which a notice may call a licence, normalised and without the word license.
NAMES = {
    "mit": "MIT", "mit x11": "MIT", "expat": "MIT", "isc": "ISC", "zlib": "Zlib", "unlicense": "Unlicense",
    "apache 2": "Apache-2.0", "apache 2 0": "Apache-2.0", "apache license 2 0": "Apache-2.0", "apache license version 2 0": "Apache-2.0", "apache license v2 0": "Apache-2.0", "apache v2 0": "Apache-2.0", "apache version 2 0": "Apache-2.0", "apache software license version 2 0": "Apache-2.0",
    "bsd 2 clause": "BSD-2-Clause", "2 clause bsd": "BSD-2-Clause", "simplified bsd": "BSD-2-Clause", "bsd 3 clause": "BSD-3-Clause", "3 clause bsd": "BSD-3-Clause", "new bsd": "BSD-3-Clause", "modified bsd": "BSD-3-Clause",
    "mpl 2 0": "MPL-2.0", "mozilla public license 2 0": "MPL-2.0", "mozilla public license version 2 0": "MPL-2.0", "mozilla public license v 2 0": "MPL-2.0", "epl 2 0": "EPL-2.0", "eclipse public license 2 0": "EPL-2.0",
    "boost software license version 1 0": "BSL-1.0", "boost software license 1 0": "BSL-1.0", "cc0": "CC0-1.0", "cc0 1 0": "CC0-1.0", "cc0 1 0 universal": "CC0-1.0", "creative commons zero": "CC0-1.0",
    **{f"{g}{sep}{v}{tail}": f"{n}-{full}-{k}" for n, names in (("GPL", ("gpl", "gnu gpl", "gnu general public license")), ("LGPL", ("lgpl", "gnu lgpl", "gnu lesser general public license")), ("AGPL", ("agpl", "gnu agpl", "gnu affero general public license"))) for g in names for full, vs in {"GPL": (("2.0", ("2", "2 0")), ("3.0", ("3", "3 0"))), "LGPL": (("2.1", ("2 1",)), ("3.0", ("3", "3 0"))), "AGPL": (("3.0", ("3", "3 0")),)}[n] for v in vs for sep in (" ", " v", " version ") for tail, k in (("", "only"), (" only", "only"), (" or later", "or-later"), (" or any later version", "or-later"), (" or at your option any later version", "or-later"))},
    **{f"{pre}{n}{v} 0{end}": f"CC-{k.upper().replace(' ', '-')}-{v}.0" for k, name in _CC.items() for pre, n in (("cc ", k), ("creative commons ", name)) for v in (" 3", " 4") for end in ("", " international", " unported", " generic")},
}
NAMES = {k: v.replace("- ", "-") for k, v in NAMES.items()}
_NOTICE = r"^(?:.{0,80}\b)?(?:released|licensed|distributed|available|provided|published|covered|governed|redistributed|modified)(?: (?!under|by)[a-z]+){0,2} (?:under|by) (?:the |a |an )?(?:terms (?:and conditions )?of )?(?:the )?(.{2,70}?)(?: licen[cs]e)?(?: (?:see|in the|which|that|found|file|for|and) .*)?$"
#: Sentences with a slot -> identifier.
SLOTS = {
    r"^neither the names? of .{1,160} nor the names? of (?:its|their|any|the) contributors may be used to endorse or promote products derived from this software without specific prior written permission$": "BsdNames",
    r"^neither the names? of .{1,200} may be used to endorse or promote products derived from this software without specific prior written permission$": "BsdNames",
    r"^the names? of .{1,160} may not be used to endorse or promote products derived from this software without specific prior written permission$": "BsdNames",
    r"^(?:.{0,80} )?use of this source code is governed by a bsd style license(?: that can be found in the license file)?.{0,40}$": "BsdStyle",
}
#: Rules over the identifiers that SENTENCES lacks, tried after RULES.
WHOLE_RULES = (
    ("GPL-2.0-or-later", ("GplFree", "GplTerms", "Later2")),
    ("GPL-3.0-or-later", ("GplFree", "GplTerms", "Later3")),
    ("LGPL-2.1-or-later", ("GplFree", "LgplTerms", "Later21")),
    ("LGPL-3.0-or-later", ("GplFree", "LgplTerms", "Later3")),
    ("LGPL-2.1-or-later", ("GplFree", "Lgpl21Terms")),
    ("LGPL-3.0-or-later", ("GplFree", "Lgpl3Terms")),
    ("AGPL-3.0-or-later", ("GplFree", "AgplTerms", "Later3")),
    ("AGPL-3.0-or-later", ("GplFree", "Agpl3Terms")),
    ("GPL-2.0-only", ("GplFree", "Gpl2OnlyTerms")),
    ("ISC", ("IscGrant",)),
    ("Zlib", ("ZlibGrant",)),
    ("Unlicense", ("Unlicense",)),
    ("EPL-1.0", ("Epl1Terms",)),
    ("EPL-2.0", ("Epl2Terms",)),
    *((f"CC-{k.upper().replace(' ', '-')}-4.0", (f"Cc{k.title().replace(' ', '')}4License",)) for k in _CC),
    *((n, (f"Spdx {n}",)) for n in _SPDX),
    *((n, (f"Title {n}",)) for n in sorted(set(TITLES.values()))),
    *((n, (f"Notice {n}",)) for n in sorted(set(NAMES.values()))),
    ("BSD-style", ("BsdStyle",)),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_CUT = "[\n\r]+|[.!?;:]+[ \t]+"
#: Marks of a comment at the start of a line.
_COMMENT = r"(?m)^[ \t]*(?:/\*+|<!--|//+|#+|\*+/?|--+|;+|%+|\"{3})[ \t]*"
#: Lines that stand for themselves, whatever their end.
_ALONE = r"(?m)^([^a-z0-9\n]*(?:copyright|all rights reserved|spdx-license-identifier)[^\n]*)$"
_PREFIX = "spdx license identifier "


def _normal(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def sentences(text: Column) -> Column:
    """Sentences in lower case without comment marks: cut at ``. ! ? ; :`` before white space (not in
    ``v. 2`` or after ``SPDX-License-Identifier``) and at blank lines."""
    low = F.regexp_replace(F.translate(text, _UPPER, _LOWER), "\r\n?", "\n")
    low = F.regexp_replace(F.regexp_replace(low, _COMMENT, ""), _ALONE, "\n$1\n")
    # What stands before the grant of a licence on its line is no part of it.
    opening = r"[ \t\n]+(?=permission is hereby granted|permission to use, copy|redistribution and use in source|this (?:program|library) is free software)"
    return F.split(low, rf"(?<!\bv)(?<!\binc)(?<!\bltd)(?<!\bcorp)(?<!\bco)(?<!identifier)[.!?;:]+(?=[ \t\n])|\n[ \t]*\n|{opening}", -1)


def identifiers(parts: Column) -> Column:
    """Identifiers of the sentences in order; of an unknown one those of its lines, ``?`` for unknown
    lines. Numbers of a list are left out."""
    table = lambda d: F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))
    known, spdx, names = table(SENTENCES | WHOLE | {k: f"Title {v}" for k, v in TITLES.items()}), table(SPDX), table({k: f"Notice {v}" for k, v in NAMES.items()})

    def named(x: Column) -> Column:
        """Identifier of a normalised sentence: known as it stands, with a slot, or by the licence it names."""
        found = F.try_element_at(known, x)
        short = F.length(x) <= 400
        for pattern, name in SLOTS.items():
            found = F.coalesce(found, F.when(short & x.rlike(pattern), name))
        by = F.regexp_replace(F.regexp_extract(x, _NOTICE, 1), "^(.* public license|gpl|lgpl|agpl|gnu [al]?gpl)(?: version| v)? ?", "$1 ")
        return F.coalesce(found, F.when(short & x.rlike("under|governed"), F.coalesce(F.try_element_at(names, F.regexp_extract(x, _NOTICE, 1)), F.try_element_at(names, F.trim(by)))))

    def lines(s: Column) -> Column:
        held = F.filter(F.transform(F.split(s, _CUT, -1), _normal), lambda x: (x != "") & ~x.rlike("^(?:[0-9]{1,2}|[a-z]|i{2,3}|iv)$"))
        return F.transform(held, lambda x: F.coalesce(named(x), F.lit("?")))

    def of(s: Column, whole: Column) -> Column:
        marked = _normal(F.regexp_replace(s, r"(?<=[0-9])\+", " plus"))
        listed = F.transform(F.split(F.substring(marked, len(_PREFIX) + 1, F.length(marked)), " (?:or|and|with) "), lambda x: F.coalesce(F.try_element_at(spdx, x), F.lit("?")))
        name = named(whole)
        return F.when(whole.startswith(_PREFIX), listed).when(name.isNotNull(), F.array(name)).otherwise(lines(s))

    both = F.transform(parts, lambda s: F.struct(s.alias("s"), _normal(s).alias("whole")))
    return F.flatten(F.transform(both, lambda x: of(x["s"], x["whole"])))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, n_known, identifiers, licenses`` for every row of ``docs`` (doc_id, text, ...).

    ``identifiers``: known sentences in order, ``licenses``: distinct licences in alphabetical
    order, both comma-joined. Null texts count as empty. Repeated rows are scanned alike; other
    columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # A known sentence holds one of these words; other texts need no cutting.
    hint = F.translate(text, _UPPER, _LOWER).rlike("licens|permi|redistribut|software|rights|cc0|attribution")
    ids = F.when(hint, identifiers(sentences(text))).otherwise(F.array().cast("array<string>"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ids.alias("ids"))
    # Each sentence has two marks around it, so that neighbouring matches don't share one.
    line = F.concat(F.lit("|"), F.array_join("ids", "||"), F.lit("|"))
    licenses = F.array().cast("array<string>")
    for name, sequence in RULES + WHOLE_RULES:
        wanted = "|" + "||".join(sequence) + "|"
        licenses = F.concat(licenses, F.when(F.contains(line, F.lit(wanted)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>")))
        line = F.replace(line, F.lit(wanted), F.lit("|#|"))
    # A file's heading decides over the sample notices in it, which are of its family.
    heads = F.transform(F.filter("ids", lambda s: s.startswith("Title ")), lambda s: F.substring(s, 7, F.length(s)))
    family = lambda t: F.regexp_replace(t, "-(?:only|or-later)$", "")
    licenses = F.filter(licenses, lambda n: ~F.exists(heads, lambda t: (family(t) == family(n)) & (t != n)))
    known = F.filter("ids", lambda s: s != "?")
    # Most rows know no sentence; they skip the rules.
    return found.select("doc_id", F.size(known).cast("long").alias("n_known"), F.array_join(known, ",").alias("identifiers"), F.when(F.size(known) > 0, F.array_join(F.array_sort(F.array_distinct(licenses)), ",")).otherwise("").alias("licenses"))
