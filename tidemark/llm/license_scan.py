"""License scans by ordered signature rules, in DataFrame expressions only.

A text is reduced to its words (runs of letters, digits and non-ASCII characters, A-Z lower-cased) with
one space between them. Rules are regular expressions over that string, each with a label, a
priority and a keyword. Each rule has an anchor, a word that all its matches have (or else its keyword, looked
for as a string): the set of a text's words is met with all anchors at once, and a text without any is done.
The others try only the rules whose anchor and whose fixed parts they hold. A detection is dropped when a
detection of the same or a higher priority, ahead of it in rule order for equal spans, contains its interval.

Three plain phrases are counted beside the rules, wherever their words stand consecutively, and their
labels always stay.

Scale: one narrow scan; nothing is shuffled and no row leaves its task. Work is linear in the text
for the words and the anchors, and for each rule tried. Running sums and maxima over n detections are made in chunks
(see ``_scanned``), about n * ``CHUNK`` steps, so a very long text full of notices costs in proportion.

Defined results: null and empty texts have no words, no places and score 0; a null doc_id is kept;
repeated rows are scanned each on their own; an empty table gives an empty result; further columns
are carried when named in ``carry``, and the result's own names win over clashing ones.
"""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import settled

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that are always reported, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Rule families: label, keyword (which every match of the patterns holds), priority, confidence, patterns over lower-case words. ``{v}`` stands
#: for each of the versions, whose dots are spaces in the words; a family without versions has one form.
#: Priority 3: a notice's own wording; 2: a name with its version; 1: a name or a general clause.
_LICEN = "licen[cs]e"
_FAMILIES: tuple[tuple[str, str, int, float, tuple[str, ...], tuple[str, ...]], ...] = (
    ("apache-{v}", "apache", 3, 1.0, ("1.0", "1.1", "2.0"), (rf"licensed under the apache {_LICEN} version {{v}}", rf"under the terms of the apache {_LICEN} version {{v}}")),
    ("apache-{v}", "apache", 2, 0.9, ("1.0", "1.1", "2.0"), (rf"apache {_LICEN} (?:version |v)?{{v}}", r"apache {v}")),
    ("apache", "apache", 1, 0.6, (), (rf"apache (?:software )?{_LICEN}", r"apache software foundation")),
    ("mit", "mit", 3, 1.0, (), (rf"(?:released|licensed|distributed|available) under the (?:terms of the )?mit {_LICEN}",)),
    ("mit", "permission is hereby granted", 3, 1.0, (), (r"permission is hereby granted free of charge to any person obtaining a copy",)),
    ("mit", "mit", 2, 0.9, (), (rf"the mit {_LICEN}", rf"mit {_LICEN}", rf"{_LICEN} mit")),
    ("gpl-{v}", "general public", 3, 1.0, ("1", "2", "3"), (rf"licensed under the (?:terms of the )?gnu general public {_LICEN} (?:version |v)?{{v}}(?: or (?:any )?later)?", rf"terms of the gnu general public {_LICEN} as published by the free software foundation either version {{v}}")),
    ("gpl-{v}", "general public", 2, 0.9, ("1", "2", "3"), (rf"(?:gnu )?general public {_LICEN} (?:version |v)?{{v}}", rf"version {{v}} of the gnu general public {_LICEN}")),
    ("gpl-{v}", "gpl", 2, 0.8, ("1.0", "2.0", "3.0", "2", "3"), (r"gpl(?: version| v)? ?{v}", r"gplv{v}", r"gpl {v} (?:only|or later)")),
    ("gpl", "general public", 1, 0.6, (), (rf"gnu general public {_LICEN}",)),
    ("gpl", "gnu gpl", 1, 0.6, (), (r"gnu gpl",)),
    ("lgpl-{v}", "lesser general", 3, 1.0, ("2.1", "3"), (rf"gnu lesser general public {_LICEN} (?:version |v)?{{v}}",)),
    ("lgpl-{v}", "lgpl", 2, 0.8, ("2.0", "2.1", "3.0", "2", "3"), (r"lgpl(?: version| v)? ?{v}", r"lgplv{v}")),
    ("lgpl", "lesser general", 2, 0.7, (), (rf"lesser general public {_LICEN}",)),
    ("lgpl", "library general", 2, 0.7, (), (rf"library general public {_LICEN}",)),
    ("agpl-{v}", "affero", 3, 1.0, ("1", "3"), (rf"(?:gnu )?affero general public {_LICEN} (?:version |v)?{{v}}",)),
    ("agpl", "agpl", 2, 0.8, (), (r"agpl ?(?:v|version )?3?",)),
    ("bsd-{v}-clause", "bsd", 2, 0.9, ("0", "1", "2", "3", "4"), (r"bsd {v} clause", rf"{{v}} clause bsd(?: {_LICEN})?")),
    ("bsd", "redistribution and use", 3, 1.0, (), (r"redistribution and use in source and binary forms with or without modification are permitted",)),
    ("bsd", "bsd", 1, 0.6, (), (rf"(?:new |simplified |modified |revised )?bsd {_LICEN}",)),
    ("mpl-{v}", "mozilla", 3, 1.0, ("1.0", "1.1", "2.0"), (rf"subject to the terms of the mozilla public {_LICEN} (?:version |v ?)?{{v}}", rf"mozilla public {_LICEN} (?:version |v)?{{v}}")),
    ("mpl-{v}", "mpl", 2, 0.8, ("1.0", "1.1", "2.0"), (r"mpl(?: v| version)? ?{v}",)),
    ("epl-{v}", "eclipse", 2, 0.9, ("1.0", "2.0"), (rf"eclipse public {_LICEN} (?:version |v)?{{v}}", rf"eclipse distribution {_LICEN} (?:version |v)?{{v}}")),
    ("cddl-{v}", "common development", 2, 0.9, ("1.0", "1.1"), (rf"common development and distribution {_LICEN} (?:version |v)?{{v}}",)),
    ("eupl-{v}", "european union public", 2, 0.9, ("1.0", "1.1", "1.2"), (rf"european union public {_LICEN} (?:version |v)?{{v}}",)),
    ("artistic-{v}", "artistic", 2, 0.9, ("1.0", "2.0"), (rf"artistic {_LICEN} (?:version |v)?{{v}}",)),
    ("ofl-{v}", "open font", 2, 0.9, ("1.0", "1.1"), (rf"sil open font {_LICEN} (?:version |v)?{{v}}",)),
    ("afl-{v}", "academic free", 2, 0.9, ("1.1", "1.2", "2.0", "2.1", "3.0"), (rf"academic free {_LICEN} (?:version |v)?{{v}}",)),
    ("osl-{v}", "open software", 2, 0.9, ("1.0", "1.1", "2.0", "2.1", "3.0"), (rf"open software {_LICEN} (?:version |v)?{{v}}",)),
    ("gfdl-{v}", "free documentation", 2, 0.9, ("1.1", "1.2", "1.3"), (rf"gnu free documentation {_LICEN} (?:version |v)?{{v}}",)),
    ("odbl-{v}", "open database", 2, 0.9, ("1.0",), (rf"open database {_LICEN} (?:odbl )?(?:version |v)?{{v}}",)),
    ("bsl-{v}", "boost", 2, 0.9, ("1.0",), (rf"boost software {_LICEN} (?:version |v)?{{v}}",)),
    ("zpl-{v}", "zope", 2, 0.9, ("1.1", "2.0", "2.1"), (rf"zope public {_LICEN} (?:version |v)?{{v}}",)),
    ("php-{v}", "php", 2, 0.9, ("3.0", "3.01"), (rf"php {_LICEN} (?:version |v)?{{v}}",)),
    ("cc-by-{v}", "cc by", 2, 0.9, ("1.0", "2.0", "2.5", "3.0", "4.0"), (r"cc by {v}",)),
    ("cc-by-sa-{v}", "cc by", 2, 0.9, ("1.0", "2.0", "2.5", "3.0", "4.0"), (r"cc by sa {v}",)),
    ("cc-by-nd-{v}", "cc by", 2, 0.9, ("1.0", "2.0", "2.5", "3.0", "4.0"), (r"cc by nd {v}",)),
    ("cc-by-nc-{v}", "cc by", 2, 0.9, ("1.0", "2.0", "2.5", "3.0", "4.0"), (r"cc by nc {v}",)),
    ("cc-by-nc-sa-{v}", "cc by", 2, 0.9, ("1.0", "2.0", "2.5", "3.0", "4.0"), (r"cc by nc sa {v}",)),
    ("cc-by-nc-nd-{v}", "cc by", 2, 0.9, ("1.0", "2.0", "2.5", "3.0", "4.0"), (r"cc by nc nd {v}",)),
    ("cc-by-{v}", "creative commons", 3, 1.0, ("1.0", "2.0", "2.5", "3.0", "4.0"), (rf"creative commons attribution {{v}}(?: international| generic| unported)?(?: {_LICEN})?", rf"creative commons attribution {_LICEN} {{v}}")),
    ("cc-by-sa-{v}", "creative commons", 3, 1.0, ("1.0", "2.0", "2.5", "3.0", "4.0"), (rf"creative commons attribution share ?alike {{v}}(?: international| generic| unported)?(?: {_LICEN})?",)),
    ("cc-by-nc-{v}", "creative commons", 3, 1.0, ("1.0", "2.0", "2.5", "3.0", "4.0"), (rf"creative commons attribution non ?commercial {{v}}(?: international| generic| unported)?(?: {_LICEN})?",)),
    ("cc-by-nd-{v}", "creative commons", 3, 1.0, ("1.0", "2.0", "2.5", "3.0", "4.0"), (rf"creative commons attribution no ?deriv(?:ative|ativ|s)e?s? {{v}}(?: international| generic| unported)?(?: {_LICEN})?",)),
    ("cc-by-nc-sa-{v}", "creative commons", 3, 1.0, ("1.0", "2.0", "2.5", "3.0", "4.0"), (rf"creative commons attribution non ?commercial share ?alike {{v}}(?: international| generic| unported)?(?: {_LICEN})?",)),
    ("cc0-1.0", "cc0", 2, 0.9, (), (r"cc0(?: 1 0)?(?: universal)?",)),
    ("cc", "creative commons", 1, 0.5, (), (r"creative commons",)),
    ("public-domain", "public domain", 1, 0.6, (), (r"public domain(?: dedication)?", r"released into the public domain")),
    ("unlicense", "unencumbered", 3, 1.0, (), (r"free and unencumbered software released into the public domain",)),
    ("isc", "permission to use copy modify", 3, 1.0, (), (r"permission to use copy modify and or distribute this software for any purpose",)),
    ("isc", "isc", 1, 0.6, (), (rf"isc {_LICEN}",)),
    ("zlib", "zlib", 1, 0.7, (), (rf"zlib(?: libpng)? {_LICEN}",)),
    ("wtfpl", "wtfpl", 2, 0.9, (), (r"wtfpl",)),
    ("spdx", "spdx", 2, 0.8, (), (r"spdx license identifier [a-z0-9]+(?: [0-9]+)*",)),
    ("proprietary", "proprietary", 1, 0.5, (), (r"proprietary and confidential", r"confidential and proprietary", rf"proprietary {_LICEN}")),
    ("non-commercial", "commercial", 1, 0.5, (), (r"(?:for )?non ?commercial (?:use|purposes)(?: only)?", r"not for commercial use")),
    ("no-redistribution", " not be ", 1, 0.5, (), (r"(?:may|must) not be (?:copied|reproduced|redistributed)",)),
    ("no-redistribution", "redistribution is", 1, 0.5, (), (r"redistribution is (?:prohibited|not permitted)",)),
    ("epl-{v}", "epl", 2, 0.8, ("1.0", "2.0"), (r"epl(?: v| version)? ?{v}",)),
    ("cddl-{v}", "cddl", 2, 0.8, ("1.0", "1.1"), (r"cddl(?: v| version)? ?{v}",)),
    ("eupl-{v}", "eupl", 2, 0.8, ("1.0", "1.1", "1.2"), (r"eupl(?: v| version)? ?{v}",)),
    ("agpl-{v}", "agpl", 2, 0.85, ("1.0", "3.0"), (r"agpl(?: v| version)? ?{v}", r"agpl {v} (?:only|or later)")),
    ("gfdl-{v}", "gfdl", 2, 0.8, ("1.1", "1.2", "1.3"), (r"gfdl(?: v| version)? ?{v}",)),
    ("ofl-{v}", "ofl", 2, 0.8, ("1.0", "1.1"), (r"ofl(?: v| version)? ?{v}",)),
    ("odc-by-{v}", "data commons attribution", 2, 0.9, ("1.0",), (rf"open data commons attribution {_LICEN}(?: odc by)?(?: version| v)? {{v}}",)),
    ("pddl-{v}", "public domain dedication and", 2, 0.9, ("1.0",), (rf"public domain dedication and {_LICEN}(?: pddl)?(?: version| v)? {{v}}",)),
    ("lppl-{v}", "latex project public", 2, 0.9, ("1.0", "1.1", "1.2", "1.3a", "1.3c"), (rf"latex project public {_LICEN}(?: version| v)? ?{{v}}", rf"conditions of the latex project public {_LICEN} either version {{v}}")),
    ("cecill-{v}", "cecill", 2, 0.9, ("1.0", "1.1", "2.0", "2.1"), (r"cecill(?: version| v)? ?{v}",)),
    ("cecill", "cecill", 1, 0.6, (), (rf"cecill(?: free software)? {_LICEN}",)),
    ("cpl-{v}", "common public", 2, 0.9, ("1.0",), (rf"common public {_LICEN}(?: version| v)? ?{{v}}",)),
    ("ipl-{v}", "ibm public", 2, 0.9, ("1.0",), (rf"ibm public {_LICEN}(?: version| v)? ?{{v}}",)),
    ("apsl-{v}", "apple public source", 2, 0.9, ("1.0", "1.1", "1.2", "2.0"), (rf"apple public source {_LICEN}(?: version| v)? ?{{v}}",)),
    ("rpl-{v}", "reciprocal public", 2, 0.9, ("1.1", "1.5"), (rf"reciprocal public {_LICEN}(?: version| v)? ?{{v}}",)),
    ("spl-{v}", "sun public", 2, 0.9, ("1.0",), (rf"sun public {_LICEN}(?: version| v)? ?{{v}}",)),
    ("npl-{v}", "netscape public", 2, 0.9, ("1.0", "1.1"), (rf"netscape public {_LICEN}(?: version| v)? ?{{v}}",)),
    ("nasa-{v}", "nasa open source", 2, 0.9, ("1.3",), (r"nasa open source agreement(?: version| v)? ?{v}",)),
    ("ecl-{v}", "educational community", 2, 0.9, ("1.0", "2.0"), (rf"educational community {_LICEN}(?: version| v)? ?{{v}}",)),
    ("zend-{v}", "zend", 2, 0.9, ("2.0",), (rf"zend (?:engine )?{_LICEN}(?: version| v)? ?{{v}}",)),
    ("mulan-{v}", "mulan", 2, 0.9, ("1", "2"), (rf"mulan (?:psl|pubpl|permissive software {_LICEN})(?: version| v)? ?v?{{v}}",)),
    ("cern-ohl-{v}", "cern open hardware", 2, 0.9, ("1.1", "1.2", "2"), (rf"cern open hardware {_LICEN}(?: version| v)? ?v?{{v}}", rf"cern open hardware {_LICEN} strongly reciprocal(?: version| v)? ?{{v}}")),
    ("sspl-{v}", "server side public", 2, 0.9, ("1",), (rf"server side public {_LICEN}(?: sspl)?(?: version| v)? ?v?{{v}}",)),
    ("sspl", "server side public", 1, 0.6, (), (rf"server side public {_LICEN}",)),
    ("elastic-{v}", "elastic", 2, 0.9, ("2.0",), (rf"elastic {_LICEN}(?: version| v)? ?{{v}}",)),
    ("busl-{v}", "business source", 2, 0.9, ("1.0", "1.1"), (rf"business source {_LICEN}(?: version| v)? ?{{v}}",)),
    ("polyform-{v}", "polyform", 2, 0.9, ("1.0.0",), (rf"polyform (?:noncommercial|small business|shield|strict) {_LICEN} {{v}}",)),
    ("commons-clause", "commons clause", 2, 0.8, (), (rf"commons clause {_LICEN} condition", r"commons clause")),
    ("blueoak-{v}", "blue oak", 2, 0.9, ("1.0.0",), (rf"blue oak model {_LICEN}(?: version| v)? ?{{v}}",)),
    ("upl-{v}", "universal permissive", 2, 0.9, ("1.0",), (rf"universal permissive {_LICEN}(?: upl)?(?: version| v)? ?{{v}}",)),
    ("python-{v}", "python", 2, 0.8, ("2.0",), (rf"python (?:software foundation )?{_LICEN}(?: version| v)? ?{{v}}", rf"psf {_LICEN} agreement for python {{v}}")),
    ("psf", "python software foundation", 1, 0.6, (), (rf"python software foundation {_LICEN}",)),
    ("postgresql", "postgresql", 2, 0.8, (), (rf"postgresql {_LICEN}",)),
    ("ncsa", "illinois", 2, 0.9, (), (rf"university of illinois (?:ncsa )?open source {_LICEN}",)),
    ("w3c", "w3c", 2, 0.8, (), (rf"w3c software (?:notice and )?(?:and document )?{_LICEN}", r"w3c document notice")),
    ("x11", "x11", 2, 0.8, (), (rf"x11 {_LICEN}", rf"mit x11 {_LICEN}")),
    ("ms-pl", "microsoft public", 2, 0.9, (), (rf"microsoft public {_LICEN}(?: ms pl)?",)),
    ("ms-rl", "microsoft reciprocal", 2, 0.9, (), (rf"microsoft reciprocal {_LICEN}(?: ms rl)?",)),
    ("openssl", "openssl", 2, 0.8, (), (rf"openssl {_LICEN}", r"this product includes software developed by the openssl project")),
    ("ssleay", "eric young", 3, 0.9, (), (r"this product includes cryptographic software written by eric young",)),
    ("sleepycat", "sleepycat", 2, 0.8, (), (rf"sleepycat {_LICEN}", r"sleepycat software")),
    ("qpl-1.0", "q public", 2, 0.9, (), (rf"q public {_LICEN}(?: version)?(?: 1 0)?",)),
    ("ruby", "ruby", 1, 0.6, (), (rf"ruby {_LICEN}", rf"same terms as ruby(?: itself)?")),
    ("perl", "perl", 2, 0.8, (), (r"under the same terms as perl(?: itself)?", rf"perl artistic {_LICEN}")),
    ("vim", "vim", 1, 0.6, (), (rf"vim {_LICEN}",)),
    ("curl", "curl", 1, 0.6, (), (rf"curl {_LICEN}",)),
    ("libpng", "libpng", 1, 0.7, (), (rf"libpng {_LICEN}(?: version 2)?",)),
    ("ijg", "independent jpeg", 2, 0.9, (), (r"based in part on the work of the independent jpeg group", rf"independent jpeg group {_LICEN}")),
    ("freetype", "freetype", 2, 0.8, (), (rf"freetype (?:project )?{_LICEN}",)),
    ("info-zip", "info zip", 2, 0.8, (), (rf"info zip {_LICEN}",)),
    ("unicode", "unicode", 2, 0.8, (), (rf"unicode (?:inc )?{_LICEN} agreement", rf"unicode terms of use")),
    ("icu", "icu", 1, 0.6, (), (rf"icu {_LICEN}",)),
    ("json", "used for good", 3, 0.9, (), (r"software shall be used for good not evil",)),
    ("beerware", "beer", 2, 0.9, (), (rf"beer ?ware {_LICEN}", r"you can buy me a beer in return")),
    ("wtfpl", "what the fuck", 3, 1.0, (), (rf"do what the fuck you want to public {_LICEN}",)),
    ("0bsd", "zero clause bsd", 2, 0.9, (), (rf"zero clause bsd(?: {_LICEN})?",)),
    ("0bsd", "for any purpose with or without fee", 3, 0.9, (), (r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",)),
    ("hpnd", "appear in all copies", 3, 0.8, (), (r"provided that the above copyright notice appear in all copies",)),
    ("mit-0", "mit no attribution", 2, 0.9, (), (r"mit no attribution",)),
    ("mit", "shall be included in all copies", 3, 0.9, (), (r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",)),
    ("mit", "deal in the software without restriction", 3, 0.9, (), (r"to deal in the software without restriction",)),
    ("bsd", "redistributions of source code", 3, 0.9, (), (r"redistributions of source code must retain the above copyright notice",)),
    ("bsd", "redistributions in binary form", 3, 0.9, (), (r"redistributions in binary form must reproduce the above copyright notice",)),
    ("bsd-3-clause", "endorse or promote", 3, 0.9, (), (r"may be used to endorse or promote products derived from this software",)),
    ("bsd-4-clause", "advertising materials", 3, 0.9, (), (r"all advertising materials mentioning features or use of this software",)),
    ("gpl", "free software foundation", 2, 0.7, (), (r"free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation",)),
    ("gpl", "received a copy of the gnu", 3, 0.8, (), (r"you should have received a copy of the gnu general public licen[cs]e",)),
    ("lgpl", "received a copy of the gnu", 3, 0.8, (), (r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e",)),
    ("agpl", "received a copy of the gnu", 3, 0.8, (), (r"you should have received a copy of the gnu affero general public licen[cs]e",)),
    ("apache-2.0", "compliance with the license", 3, 0.9, (), (r"you may not use this file except in compliance with the license",)),
    ("apache-2.0", "apache org licenses", 3, 1.0, (), (r"www apache org licenses license 2 0",)),
    ("warranty-disclaimer", "warrant", 1, 0.4, (), (r"without (?:any )?warranty(?: of any kind)?", r"without warranties or conditions of any kind", r"no warranty(?: expressed or implied)?")),
    ("warranty-disclaimer", "as is", 1, 0.4, (), (r"provided as is(?: without (?:express or implied )?warranty)?", r"(?:is|are) provided (?:by [a-z ]{1,60} )?as is")),
    ("liability-disclaimer", "liable", 1, 0.4, (), (r"in no event shall (?:the )?(?:authors?|copyright (?:holders?|owners?)|[a-z]+) (?:or [a-z ]{1,40} )?be liable",)),
    ("free-of-charge", "free of charge", 1, 0.4, (), (r"(?:available|distributed|provided) free of charge",)),
    ("attribution-required", "attribution", 1, 0.4, (), (r"attribution (?:is )?required", r"with (?:proper|appropriate) attribution")),
    ("share-alike", "share alike", 1, 0.4, (), (r"share alike(?: [0-9] [0-9])?",)),
    ("no-derivatives", "derivative", 1, 0.4, (), (r"no derivative(?:s| works)(?: allowed| permitted)?",)),
    ("personal-use", "personal use", 1, 0.4, (), (r"for (?:private |your )?personal use only",)),
    ("research-only", "research", 1, 0.4, (), (r"for (?:academic |non commercial )?research (?:use|purposes) only",)),
    ("educational-use", "educational", 1, 0.4, (), (r"for educational (?:use|purposes)(?: only)?",)),
    ("evaluation-only", "evaluation", 1, 0.4, (), (r"for evaluation (?:use|purposes)(?: only)?",)),
    ("internal-use", "internal use", 1, 0.4, (), (r"(?:for )?internal use only",)),
    ("trade-secret", "trade secret", 1, 0.5, (), (r"(?:contains|constitutes?) (?:confidential information and )?trade secrets?",)),
    ("eula", "end user", 1, 0.5, (), (rf"end user {_LICEN} agreement",)),
    ("permission-required", "written permission", 1, 0.5, (), (r"without (?:the )?(?:express |prior )*written permission",)),
    ("permission-granted", "permission is granted", 1, 0.5, (), (r"permission is granted to (?:anyone|copy|make|use)",)),
    ("terms-of-use", "terms of", 1, 0.3, (), (r"subject to (?:our |the )?terms of (?:use|service)",)),
    ("public-domain", "no copyright", 1, 0.5, (), (r"no copyright(?: is claimed)?(?: reserved)?",)),
    ("public-domain", "dedicated", 2, 0.7, (), (r"dedicated to the public domain",)),
    ("reserved", "reservados", 1, 0.5, (), (r"todos los derechos reservados",)),
    ("reserved", "droits", 1, 0.5, (), ("tous droits réservés",)),
    ("reserved", "alle rechte", 1, 0.5, (), (r"alle rechte vorbehalten",)),
    ("copyright", "copyright", 1, 0.4, (), (r"copyright (?:c )?(?:19|20)[0-9]{2}", r"copyright (?:c )?[a-z0-9]+(?: [a-z0-9]+){0,3} all rights reserved")),
    ("reserved", "rights reserved", 1, 0.5, (), (r"all rights reserved", r"some rights reserved")),
)


def rules() -> list[tuple[int, str, str, int, float, str]]:
    """The ordered rules: number, label, keyword, priority, confidence, pattern. One for each family, version and form."""
    out: list[tuple[int, str, str, int, float, str]] = []
    for label, keyword, priority, confidence, versions, patterns in _FAMILIES:
        for v in versions or ("",):
            # a version names the same one with and without ".0", and never the beginning of a longer number
            words = v.replace(".", " ")
            short = label.replace("{v}", v[:-2] if v.endswith(".0") and label.startswith(("gpl", "lgpl")) else v)
            for p in patterns:
                out.append((len(out), short, keyword, priority, confidence, rf"(?<![^ ]){p.replace('{v}', words)}(?![^ ])"))
    return out


def _parts(pattern: str) -> list[str]:
    """What stands in every match of a pattern as it is, in order: the strings between groups, classes and optional characters."""
    while "(?:" in pattern:
        pattern = re.sub(r"\(\?:[^()]*\)(?:[?*+]|\{[^}]*\})?", "\0", pattern)
    pattern = re.sub(r"\[[^]]*\](?:[?*+]|\{[^}]*\})?", "\0", pattern)
    return re.sub(r".\?", "\0", pattern).split("\0")


def _bare(pattern: str) -> str:
    """A rule's pattern without its word bounds."""
    return pattern.removeprefix("(?<![^ ])").removesuffix("(?![^ ])")


def fixed_parts(pattern: str) -> list[str]:
    """Strings that every match of a rule's pattern contains."""
    return sorted({p for p in _parts(_bare(pattern)) if len(p) > 2}, key=len, reverse=True)


def fixed_words(pattern: str) -> set[str]:
    """Whole words that every match of a rule's pattern has."""
    before, pattern = "", _bare(pattern)
    while before != pattern:  # an optional group that brings its own space leaves the words beside it whole
        before = pattern
        pattern = re.sub(r"(^|(?<= ))\(\?:(?:[^()|]* \|)*[^()|]* \)[?*]", "", pattern)
        pattern = re.sub(r"\(\?:(?: [^()|]*\|)* [^()|]*\)[?*](?= |$)", "", pattern)
    return {w for w in "\0".join(_parts(pattern)).split(" ") if w and "\0" not in w}


def anchor(keyword: str, pattern: str) -> tuple[str, bool]:
    """What a text must hold for a rule to be tried, and whether as a whole word: the keyword's longest word, another one, or the keyword as a string."""
    found = fixed_words(pattern)
    of_keyword = {w for w in keyword.split() if len(w) > 2}
    return (max(found, key=lambda w: (w in of_keyword, len(w), w)), True) if found else (keyword, False)


def _words_string(text: Column) -> Column:
    """Words with one space between; A-Z are lower-cased and no other letter, which plain lower-casing does only for ASCII."""
    whole = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(whole) > F.char_length(whole), F.translate(whole, ascii_uppercase, ascii_lowercase)).otherwise(F.lower(whole))
    return F.btrim(F.regexp_replace(lower, NOT_WORD, " "))


def _spaces(s: Column) -> Column:
    return F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))


def _phrase_places(padded: Column, phrase: str, n_words: Column) -> Column:
    """(n, first, last) of a phrase in ' w0 w1 ... ': places and its smallest and largest start in words."""
    size = phrase.count(" ") + 1
    parts = F.split(padded, rf"(?<= ){phrase}(?= )")
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    found = F.struct((F.size(parts) - 1).cast("long").alias("n"), (_spaces(F.get(parts, F.lit(0))) - 1).cast("long").alias("first"), (n_words - (_spaces(F.element_at(parts, -1)) - 1) - size).cast("long").alias("last"))
    return F.when(F.contains(padded, F.lit(f" {phrase} ")), found).otherwise(none)


#: Items that one appending fold takes at most.
CHUNK = 128
#: Bytes of words up to which a text is split to be met with the anchors. A longer one is searched for each, as its words in an array take many times its memory.
SPLIT_BYTES = 1 << 20
_DETECTION = "array<struct<start:int,stop:int,rank:int,label:string,confidence:double>>"


def _once(value: Column, result) -> Column:
    """result(value) with the value computed once; a lambda's body computes an expression again wherever it stands."""
    return F.get(F.transform(F.array(value), result), F.lit(0))


def _scanned(items: Column, start: Column, merge, joined, emit, kind: str) -> Column:
    """emit(state before x, x) of every item in order, where merge(state, x) moves the state on.

    An appending fold copies its array at every step. So items go in chunks: a chunk's own state is folded
    from ``start``, states are joined chunk by chunk, and each chunk is scanned from the state it begins with.
    """
    whole = lambda acc: acc["out"]
    chunks = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    part = lambda c: F.slice(items, c * CHUNK + 1, F.lit(CHUNK))
    totals = F.transform(chunks, lambda c: F.aggregate(part(c), start, merge))
    none = F.slice(F.array(start), 1, 0)
    begins = F.aggregate(totals, F.struct(start.alias("at"), none.alias("out")), lambda acc, t: F.struct(joined(acc["at"], t).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), whole)
    empty = F.array().cast(f"array<{kind}>")

    def scan(begin: Column, c: Column) -> Column:
        step = lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(emit(acc["at"], x))).alias("out"))
        return F.aggregate(part(c), F.struct(begin.alias("at"), empty.alias("out")), step, whole)

    return F.flatten(F.transform(begins, scan))


def _found_by(words: Column, rule: Column) -> Column:
    """All matches of one rule with their character spans, told from the lengths between and of matches.

    rank orders rules: a higher priority first, then the earlier rule.
    """
    moved = lambda at, x: at + x["b"] + x["m"]
    one = lambda begin, x: F.struct(begin.alias("start"), (begin + x["m"]).alias("stop"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["confidence"].alias("confidence"))

    def placed(matches: Column) -> Column:
        between = F.slice(F.split(words, rule["pattern"]), F.lit(1), F.size(matches))
        lengths = F.zip_with(between, matches, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m")))
        spans = lambda x: F.zip_with(_scanned(x, F.lit(0), moved, lambda a, b: a + b, lambda at, y: at + y["b"], "int"), x, one)
        return F.when(F.size(matches) > 0, _once(lengths, spans)).otherwise(F.array().cast(_DETECTION))

    return _once(F.regexp_extract_all(words, rule["pattern"], F.lit(0)), placed)


def _uncontained(detections: Column) -> Column:
    """Detections (by start, longest first, best rule first) that none before them, of the same or a higher priority, contains.

    The state keeps how far the detections seen so far reach, for each priority 3 to 1 and those above it.
    """
    priority = lambda d: 3 - F.floor(d["rank"] / 10000).cast("int")
    levels = (3, 2, 1)
    start = F.struct(*[F.lit(-1).alias(f"p{p}") for p in levels])
    merge = lambda at, d: F.struct(*[F.when(priority(d) >= p, F.greatest(at[f"p{p}"], d["stop"])).otherwise(at[f"p{p}"]).alias(f"p{p}") for p in levels])
    joined = lambda a, b: F.struct(*[F.greatest(a[f"p{p}"], b[f"p{p}"]).alias(f"p{p}") for p in levels])
    reach = lambda at, d: F.when(priority(d) == 3, at["p3"]).when(priority(d) == 2, at["p2"]).otherwise(at["p1"])
    stays = _scanned(detections, start, merge, joined, lambda at, d: reach(at, d) < d["stop"], "boolean")
    return F.filter(F.zip_with(detections, stays, lambda d, s: F.when(s, d)), lambda d: d.isNotNull())


def license_detections(documents: DataFrame, carry: tuple[str, ...] = ("doc_id",), gated: bool = True) -> DataFrame:
    """The carried columns, n_words, the phrases' places, detections (spans in the word string), labels and score.

    gated: try only the rules whose anchor and fixed parts a text holds; the result is the same without.
    """
    table = [(*r, *anchor(r[2], r[5])) for r in rules()]
    df = documents.withColumn("_words", _words_string(F.col("text")))
    df = df.withColumns({"n_words": F.when(F.length("_words") == 0, F.lit(0)).otherwise(_spaces(F.col("_words")) + 1).cast("long"), "_padded": F.concat(F.lit(" "), F.col("_words"), F.lit(" "))})
    df = df.withColumn("_places", F.array(*[_phrase_places(F.col("_padded"), p, F.col("n_words")) for p, _ in PHRASES]))
    strings = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    literal = F.array(*[F.struct(F.lit((3 - priority) * 10000 + k).alias("rank"), F.lit(label).alias("label"), F.lit(held).alias("anchor"), strings(fixed_parts(pattern)).alias("parts"), F.lit(confidence).alias("confidence"), F.lit(pattern).alias("pattern")) for k, label, _, priority, confidence, pattern, held, _ in table])
    of_words, of_strings = (sorted({r[6] for r in table if r[7] is whole}) for whole in (True, False))
    searched = F.filter(strings(of_words), lambda w: F.contains(F.col("_padded"), F.concat(F.lit(" "), w, F.lit(" "))))
    words = F.when(F.octet_length("_words") <= SPLIT_BYTES, F.array_intersect(F.split(F.col("_words"), " "), strings(of_words))).otherwise(searched)
    df = df.withColumn("_held", F.concat(words, F.array_compact(F.array(*[F.when(F.contains("_words", F.lit(k)), F.lit(k)) for k in of_strings]))))
    tried = lambda r: F.array_contains("_held", r["anchor"]) & F.forall(r["parts"], lambda p: F.contains(F.col("_words"), p))
    df = df.withColumn("_rules", F.when(F.size("_held") > 0, F.filter(literal, tried)) if gated else literal)
    every = F.flatten(F.transform("_rules", lambda r: _found_by(F.col("_words"), r)))
    order = lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("far"), d["rank"].alias("rank"), d["stop"].alias("stop"), d["label"].alias("label"), d["confidence"].alias("confidence"))
    back = lambda d: F.struct(d["start"].alias("start"), d["stop"].alias("stop"), d["rank"].alias("rank"), d["label"].alias("label"), d["confidence"].alias("confidence"))
    df = df.withColumn("_sorted", F.transform(F.sort_array(F.transform(every, order)), back))
    df = df.withColumn("detections", F.coalesce(_uncontained(F.col("_sorted")), F.array().cast(_DETECTION)))
    hits = F.array_compact(F.array(*[F.when(F.get("_places", F.lit(i))["n"] > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]))
    df = df.withColumn("_base", hits)
    score = F.aggregate("detections", F.when(F.size("_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)), lambda s, d: F.greatest(s, d["confidence"]))
    own = {
        "n_base": F.aggregate("_places", F.lit(0).cast("long"), lambda s, p: s + p["n"]),
        "first_word": F.array_min(F.transform("_places", lambda p: p["first"])),
        "last_word": F.array_max(F.transform("_places", lambda p: p["last"])),
        "base_labels": F.array_join(F.sort_array(F.array_distinct("_base")), ","),
        "labels": F.array_join(F.sort_array(F.array_distinct(F.concat("_base", F.transform("detections", lambda d: d["label"])))), ","),
        "score": score,
    }
    names = ["n_words", *own, "detections"]
    return df.withColumns({c: settled(x) for c, x in own.items()}).select(*[c for c in carry if c not in names], *names)
