"""License scan by ordered signature rules, with built-in functions only.

A text is cut into words; keywords decide whether any rule is tried, and which. Each rule is a
regular expression over the words joined by spaces and has a rank: an explicit grant goes
before a license's name, and a name before a mere hint. A detection that lies within one of the
same or a better rank is suppressed; of equal spans of one rank the label that comes first in
the alphabet stays. A license has one label, however it is written.

Each text is split once by each rule that its keywords allow, and the ends of the pieces are summed
by doubling, so a text with n signatures takes n log n steps.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that are always looked for, and their labels.
BASE_PHRASES = {
    "cc-by": ("cc", "by"),
    "gpl": ("general", "public", "license"),
    "reserved": ("all", "rights", "reserved"),
}

GRANT, NAME, HINT = 0, 1, 2
CONFIDENCE = (1.0, 0.8, 0.4)

#: Label: keyword, name as a regular expression over words.
NAMES = {
    "agpl-3.0": ("affero", r"(?:gnu )?affero general public licen[cs]e(?: v(?:ersion)? ?3(?: 0)?)?"),
    "apache-1.1": ("apache", r"apache (?:software )?licen[cs]e (?:v(?:ersion)? ?)?1 1"),
    "apache-2.0": ("apache", r"apache (?:software )?licen[cs]e (?:v(?:ersion)? ?)?2(?: 0)?"),
    "artistic-2.0": ("artistic", r"artistic licen[cs]e(?: (?:v(?:ersion)? ?)?2(?: 0)?)?"),
    "bsd-2-clause": ("bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)?"),
    "bsd-3-clause": ("bsd", r"(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?"),
    "bsd": ("bsd", r"bsd(?: style)? licen[cs]e"),
    "boost-1.0": ("boost", r"boost software licen[cs]e(?: (?:v(?:ersion)? ?)?1(?: 0)?)?"),
    "cc-by-3.0": ("cc", r"cc by 3 0"),
    "cc-by-4.0": ("cc", r"cc by 4 0"),
    "cc-by-nc": ("cc", r"cc by nc"),
    "cc-by-nc-4.0": ("cc", r"cc by nc 4 0"),
    "cc-by-nc-nd-4.0": ("cc", r"cc by nc nd(?: 4 0)?"),
    "cc-by-nc-sa-4.0": ("cc", r"cc by nc sa(?: 4 0)?"),
    "cc-by-nd-4.0": ("cc", r"cc by nd(?: 4 0)?"),
    "cc-by-sa-3.0": ("cc", r"cc by sa 3 0"),
    "cc-by-sa-4.0": ("cc", r"cc by sa(?: 4 0)?"),
    "cc0-1.0": ("cc0", r"cc0(?: 1 0)?(?: universal)?"),
    "cddl-1.0": ("development", r"common development and distribution licen[cs]e"),
    "cecill-2.1": ("cecill", r"cecill(?: free software licen[cs]e)?(?: 2 1)?"),
    "epl-1.0": ("eclipse", r"eclipse public licen[cs]e (?:v(?:ersion)? ?)?1(?: 0)?"),
    "epl-2.0": ("eclipse", r"eclipse public licen[cs]e (?:v(?:ersion)? ?)?2(?: 0)?"),
    "eupl-1.2": ("european", r"european union public licen[cs]e"),
    "gfdl": ("documentation", r"(?:gnu )?free documentation licen[cs]e"),
    "gpl-2.0": ("public", r"(?:gnu )?general public licen[cs]e v(?:ersion)? ?2(?: 0)?"),
    "gpl-3.0": ("public", r"(?:gnu )?general public licen[cs]e v(?:ersion)? ?3(?: 0)?"),
    "isc": ("isc", r"isc licen[cs]e"),
    "lgpl-2.1": ("lesser", r"(?:gnu )?lesser general public licen[cs]e v(?:ersion)? ?2(?: 1)?"),
    "lgpl-3.0": ("lesser", r"(?:gnu )?lesser general public licen[cs]e v(?:ersion)? ?3(?: 0)?"),
    "lgpl": ("lgpl", r"(?:gnu )?lgpl"),
    "mit": ("mit licen", r"mit licen[cs]e"),
    "mpl-1.1": ("mozilla", r"mozilla public licen[cs]e (?:v(?:ersion)? ?)?1(?: 1)?"),
    "mpl-2.0": ("mozilla", r"mozilla public licen[cs]e(?: (?:v(?:ersion)? ?)?2(?: 0)?)?"),
    "ms-pl": ("microsoft", r"microsoft public licen[cs]e"),
    "odbl-1.0": ("database", r"open database licen[cs]e"),
    "ofl-1.1": ("font", r"(?:sil )?open font licen[cs]e"),
    "python-2.0": ("python", r"python software foundation licen[cs]e"),
    "unlicense": ("unlicense", r"(?:the )?unlicense"),
    "wtfpl": ("wtfpl", r"wtfpl"),
    "zlib": ("zlib", r"zlib(?: libpng)? licen[cs]e"),
    "zpl-2.1": ("zope", r"zope public licen[cs]e"),
    "0bsd": ("bsd", r"(?:zero clause bsd|bsd zero clause|0 clause bsd)(?: licen[cs]e)?"),
    "afl-3.0": ("academic", r"academic free licen[cs]e(?: (?:v(?:ersion)? ?)?3(?: 0)?)?"),
    "beerware": ("beerware", r"beerware(?: licen[cs]e)?"),
    "blueoak-1.0.0": ("oak", r"blue oak model licen[cs]e(?: 1 0 0)?"),
    "bsd-4-clause": ("bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?"),
    "busl-1.1": ("business", r"business source licen[cs]e(?: 1 1)?"),
    "commons-clause": ("clause", r"commons clause"),
    "cpl-1.0": ("common", r"common public licen[cs]e(?: (?:v(?:ersion)? ?)?1(?: 0)?)?"),
    "curl": ("curl", r"curl licen[cs]e"),
    "elastic-2.0": ("elastic", r"elastic licen[cs]e(?: (?:v(?:ersion)? ?)?2(?: 0)?)?"),
    "ftl": ("freetype", r"freetype (?:project )?licen[cs]e"),
    "hpnd": ("historical", r"historical permission notice and disclaimer"),
    "lgpl-2.0": ("library", r"(?:gnu )?library general public licen[cs]e(?: v(?:ersion)? ?2(?: 0)?)?"),
    "ms-rl": ("reciprocal", r"microsoft reciprocal licen[cs]e"),
    "mulanpsl-2.0": ("mulan", r"mulan permissive software licen[cs]e(?: v?2)?"),
    "ncsa": ("ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e"),
    "odc-by-1.0": ("commons", r"open data commons attribution licen[cs]e"),
    "openrail": ("openrail", r"(?:bigscience |creativeml )?openrail(?: m)?(?: licen[cs]e)?"),
    "openssl": ("openssl", r"openssl licen[cs]e"),
    "osl-3.0": ("open", r"open software licen[cs]e(?: (?:v(?:ersion)? ?)?3(?: 0)?)?"),
    "pddl-1.0": ("dedication", r"public domain dedication and licen[cs]e"),
    "php-3.01": ("php", r"php licen[cs]e(?: (?:v(?:ersion)? ?)?3(?: 01)?)?"),
    "postgresql": ("postgresql", r"postgresql licen[cs]e"),
    "qpl-1.0": ("public", r"q public licen[cs]e(?: (?:v(?:ersion)? ?)?1(?: 0)?)?"),
    "ruby": ("ruby", r"ruby licen[cs]e"),
    "sspl-1.0": ("server", r"server side public licen[cs]e(?: (?:v(?:ersion)? ?)?1(?: 0)?)?"),
    "unicode": ("unicode", r"unicode licen[cs]e(?: agreement)?"),
    "vim": ("vim", r"vim licen[cs]e"),
    "w3c": ("w3c", r"w3c software (?:notice and )?licen[cs]e"),
    "x11": ("x11", r"x11 licen[cs]e"),
}

#: Short and long forms: label, keyword, regular expression over words.
SHORT = [
    ("cc-by", "commons", r"creative commons attribution(?: licen[cs]e)?"),
    ("cc-by-3.0", "commons", r"creative commons attribution 3 0(?: unported)?"),
    ("cc-by-4.0", "commons", r"creative commons attribution 4 0(?: international)?"),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial(?: licen[cs]e)?"),
    ("cc-by-nc-4.0", "commons", r"creative commons attribution non ?commercial 4 0(?: international)?"),
    ("cc-by-nc-nd-4.0", "commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: 4 0)?"),
    ("cc-by-nc-sa-4.0", "commons", r"creative commons attribution non ?commercial share ?alike(?: 4 0)?"),
    ("cc-by-nd-4.0", "commons", r"creative commons attribution no ?deriv(?:ative)?s(?: 4 0)?"),
    ("cc-by-sa-3.0", "commons", r"creative commons attribution share ?alike 3 0(?: unported)?"),
    ("cc-by-sa-4.0", "commons", r"creative commons attribution share ?alike(?: 4 0)?(?: international)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?v?(?:ersion )?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?v?(?:ersion )?3(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?v?(?:ersion )?2(?: [01])?"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl ?v?(?:ersion )?3(?: 0)?"),
    ("mit", "expat", r"expat licen[cs]e"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl ?v?3(?: 0)?"),
    ("apache-1.1", "apache", r"apache 1 1"),
    ("apache-2.0", "apache", r"apache v?2 0"),
    ("artistic-2.0", "artistic", r"artistic 2 0"),
    ("boost-1.0", "bsl", r"bsl 1 0"),
    ("cddl-1.0", "cddl", r"cddl(?: 1 [01])?"),
    ("epl-1.0", "epl", r"epl ?v?1(?: 0)?"),
    ("epl-2.0", "epl", r"epl ?v?2(?: 0)?"),
    ("eupl-1.2", "eupl", r"eupl(?: v?1 2)?"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl(?: v?1 [123])?"),
    ("mpl-1.1", "mpl", r"mpl ?v?1 [01]"),
    ("mpl-2.0", "mpl", r"mpl ?v?2(?: 0)?"),
    ("ms-pl", "ms pl", r"ms pl"),
    ("mulanpsl-2.0", "mulan", r"mulan psl(?: v?2)?"),
    ("odbl-1.0", "odbl", r"odbl(?: v?1 0)?"),
    ("ofl-1.1", "ofl", r"(?:sil )?ofl ?v?1 1"),
    ("python-2.0", "psf", r"psf licen[cs]e"),
    ("zpl-2.1", "zpl", r"zpl 2 1"),
]

#: What an SPDX line calls them, as words.
SPDX = {
    "agpl-3.0": "agpl 3 0", "apache-1.1": "apache 1 1", "apache-2.0": "apache 2 0",
    "artistic-2.0": "artistic 2 0", "bsd-2-clause": "bsd 2 clause", "bsd-3-clause": "bsd 3 clause",
    "boost-1.0": "bsl 1 0", "cc-by-3.0": "cc by 3 0", "cc-by-4.0": "cc by 4 0",
    "cc-by-nc-4.0": "cc by nc 4 0", "cc-by-nc-nd-4.0": "cc by nc nd 4 0",
    "cc-by-nc-sa-4.0": "cc by nc sa 4 0", "cc-by-nd-4.0": "cc by nd 4 0",
    "cc-by-sa-3.0": "cc by sa 3 0", "cc-by-sa-4.0": "cc by sa 4 0", "cc0-1.0": "cc0 1 0",
    "cddl-1.0": "cddl 1 0", "cecill-2.1": "cecill 2 1", "epl-1.0": "epl 1 0", "epl-2.0": "epl 2 0",
    "eupl-1.2": "eupl 1 2", "gfdl": "gfdl 1 [123]", "gpl-2.0": "gpl 2 0", "gpl-3.0": "gpl 3 0",
    "isc": "isc", "lgpl-2.1": "lgpl 2 [01]", "lgpl-3.0": "lgpl 3 0", "mit": "mit(?! 0 )",
    "mpl-1.1": "mpl 1 [01]", "mpl-2.0": "mpl 2 0", "ms-pl": "ms pl", "odbl-1.0": "odbl 1 0",
    "ofl-1.1": "ofl 1 1", "python-2.0": "python 2 0", "unlicense": "unlicense", "wtfpl": "wtfpl",
    "zlib": "zlib", "zpl-2.1": "zpl 2 1",
}

#: What a grant puts before a name, with the keyword that it needs.
GRANTS = {
    "licensed": r"(?:dual |re|sub)?licen[cs]ed (?:to you )?(?:under|with|by)(?: the terms of)?(?: the)?(?: gnu)?",
    "released": r"released (?:under|with|by)(?: the terms of)?(?: the)?(?: gnu)?",
    "distributed": r"distributed (?:under|with|by)(?: the terms of)?(?: the)?(?: gnu)?",
    "available": r"(?:made )?available (?:under|with|by)(?: the terms of)?(?: the)?(?: gnu)?",
    "covered": r"covered (?:under|with|by)(?: the terms of)?(?: the)?(?: gnu)?",
}

#: Detections that no name is part of: label, rank, keyword, regular expression.
OTHERS = [
    ("mit", GRANT, "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", GRANT, "redistribution", r"redistribution and use in source and binary forms"),
    ("isc", GRANT, "permission", r"permission to use copy modify and or distribute this software"),
    ("zlib", GRANT, "altered", r"altered source versions must be plainly marked"),
    ("unlicense", GRANT, "unencumbered", r"free and unencumbered software released into the public domain"),
    ("public-domain", NAME, "domain", r"(?:dedicated to|released into|in) the public domain"),
    ("reserved", NAME, "reserved", r"(?:all|some|no) rights(?: are)? reserved"),
    ("proprietary", NAME, "proprietary", r"proprietary and confidential"),
    ("proprietary", NAME, "reproduction", r"(?:unauthori[sz]ed )?reproduction(?: or distribution)? (?:is )?(?:strictly )?prohibited"),
    ("non-commercial", HINT, "non", r"non ?commercial use only"),
    ("copyright", HINT, "copyright", r"copyright (?:c )?(?:19|20)\d\d"),
    ("license-mention", HINT, "license", r"(?:see|read) (?:the )?licen[cs]e(?: file)?"),
    ("license-mention", HINT, "licence", r"(?:see|read) (?:the )?licen[cs]e(?: file)?"),
]

#: Titles, file headers and clauses by which a license's own text shows: label, keyword, expression.
NOTICES = [
    ("mit", "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "sublicense", r"the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("hpnd", "documentation", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("isc", "disclaims", r"the software is provided as is and the author disclaims all warranties"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "holders", r"this software is provided by the copyright holders(?: and contributors)? as is"),
    ("bsd", "regents", r"this software is provided by the regents(?: and contributors)? as is"),
    ("bsd", "governed", r"use of this source code is governed by a bsd style licen[cs]e"),
    ("bsd-3-clause", "endorse", r"neither the name of (?:\S{1,40} ){1,12}nor the names of (?:its|any) contributors may be used to endorse"),
    ("bsd-3-clause-clear", "patent", r"no express or implied licen[cs]es to any party s patent rights are granted by this licen[cs]e"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation"),
    ("apache-2.0", "apache", r"apache licen[cs]e version 2 0 january 2004"),
    ("apache-2.0", "apache", r"this product includes software developed at the apache software foundation"),
    ("apache-2.0", "apache", r"licensed to the apache software foundation (?:asf )?under one or more contributor licen[cs]e agreements"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", "agreed", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e"),
    ("apache-2.0", "apache", r"(?:www )?apache org licen[cs]es licen[cs]e 2 0"),
    ("gpl-2.0", "1991", r"gnu general public licen[cs]e version 2 june 1991"),
    ("gpl-3.0", "2007", r"gnu general public licen[cs]e version 3 29 june 2007"),
    ("lgpl-2.0", "1991", r"gnu library general public licen[cs]e version 2 june 1991"),
    ("lgpl-2.1", "1999", r"gnu lesser general public licen[cs]e version 2 1 february 1999"),
    ("lgpl-3.0", "2007", r"gnu lesser general public licen[cs]e version 3 29 june 2007"),
    ("agpl-3.0", "2007", r"gnu affero general public licen[cs]e version 3 19 november 2007"),
    ("gpl-2.0", "gnu", r"gnu general public licen[cs]e(?: version 2)? as published by the free software foundation (?:either )?version 2"),
    ("gpl-3.0", "gnu", r"gnu general public licen[cs]e as published by the free software foundation (?:either )?version 3"),
    ("lgpl-2.0", "gnu", r"gnu library general public licen[cs]e as published by the free software foundation (?:either )?version 2"),
    ("lgpl-2.1", "gnu", r"gnu lesser general public licen[cs]e as published by the free software foundation (?:either )?version 2 1"),
    ("lgpl-3.0", "gnu", r"gnu lesser general public licen[cs]e as published by the free software foundation (?:either )?version 3"),
    ("agpl-3.0", "gnu", r"gnu affero general public licen[cs]e as published by the free software foundation (?:either )?version 3"),
    ("gpl", "gnu", r"you should have received a copy of the gnu general public licen[cs]e along with"),
    ("lgpl", "gnu", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with"),
    ("agpl-3.0", "gnu", r"you should have received a copy of the gnu affero general public licen[cs]e along with"),
    ("gpl", "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general"),
    ("lgpl", "redistribute", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library)"),
    ("agpl-3.0", "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu affero"),
    ("gpl-2.0", "verbatim", r"copy and distribute verbatim copies of the program s source code as you receive it"),
    ("lgpl-2.1", "verbatim", r"copy and distribute verbatim copies of the library s complete source code as you receive it"),
    ("gpl-3.0", "copyleft", r"the gnu general public licen[cs]e is a free copyleft licen[cs]e for software"),
    ("agpl-3.0", "copyleft", r"the gnu affero general public licen[cs]e is a free copyleft licen[cs]e for software"),
    ("lgpl-3.0", "incorporates", r"the gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3"),
    ("agpl-3.0", "interacting", r"prominently offer all users interacting with it remotely through a computer network"),
    ("gpl-classpath", "statically", r"linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl-gcc-exception", "gcc", r"gcc runtime library exception"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-2.0", "mpl", r"if a copy of the mpl was not distributed with this file"),
    ("mpl-2.0", "incompatible", r"this source code form is incompatible with secondary licen[cs]es"),
    ("epl-1.0", "accompanying", r"accompanying materials are made available under the terms of the eclipse public licen[cs]e v(?:ersion)? ?1 0"),
    ("epl-2.0", "accompanying", r"accompanying materials are made available under the terms of the eclipse public licen[cs]e v(?:ersion)? ?2 0"),
    ("cddl-1.0", "cddl", r"common development and distribution licen[cs]e cddl version 1 0"),
    ("cddl-1.0", "subject", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("boost-1.0", "boost", r"boost software licen[cs]e version 1 0 august 17th 2003"),
    ("boost-1.0", "organization", r"free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "removed", r"this notice may not be removed or altered from any source distribution"),
    ("unlicense", "compile", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "fuck", r"do what the fuck you want to public licen[cs]e"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
    ("cc0-1.0", "deed", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1.0", "waived", r"has waived all copyright and related or neighbou?ring rights"),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by-3.0", "creativecommons", r"creativecommons org licen[cs]es by 3 0"),
    ("cc-by-4.0", "creativecommons", r"creativecommons org licen[cs]es by 4 0"),
    ("cc-by-nc-4.0", "creativecommons", r"creativecommons org licen[cs]es by nc 4 0"),
    ("cc-by-nc-nd-4.0", "creativecommons", r"creativecommons org licen[cs]es by nc nd 4 0"),
    ("cc-by-nc-sa-4.0", "creativecommons", r"creativecommons org licen[cs]es by nc sa 4 0"),
    ("cc-by-nd-4.0", "creativecommons", r"creativecommons org licen[cs]es by nd 4 0"),
    ("cc-by-sa-3.0", "creativecommons", r"creativecommons org licen[cs]es by sa 3 0"),
    ("cc-by-sa-4.0", "creativecommons", r"creativecommons org licen[cs]es by sa 4 0"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font licen[cs]e version 1 1"),
    ("ofl-1.1", "font", r"sil open font licen[cs]e version 1 1 26 february 2007"),
    ("artistic-1.0", "intent", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "verbatim", r"distribute verbatim copies of the source form of the standard version of this package"),
    ("perl", "perl", r"under the same terms as (?:the )?perl(?: 5)?(?: programming language system)? itself"),
    ("python-2.0", "psf", r"psf is making python available to licensee on an as is basis"),
    ("python-2.0", "psf", r"this licen[cs]e agreement is between the python software foundation psf"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php-3.01", "php", r"this source file is subject to version 3 01 of the php licen[cs]e"),
    ("php-3.01", "php", r"this product includes php software freely available from"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", "freetype", r"portions of this software are copyright (?:\S{1,40} ){1,4}the freetype project"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("beerware", "buy", r"you can buy me a beer in return"),
    ("busl-1.1", "production", r"create derivative works redistribute and make non production use of the licensed work"),
    ("commons-clause", "sell", r"the licen[cs]e does not grant to you the right to sell the software"),
    ("proprietary", "sold", r"this software is licensed not sold"),
    ("proprietary", "reproduced", r"no part of this (?:publication|book|document) may be reproduced"),
    ("eula", "eula", r"end user licen[cs]e agreement eula"),
]

#: Words without any of which no rule can fit. ``mit`` is too common a word in some languages.
GATES = sorted(
    {keyword for keyword, _ in NAMES.values() if keyword != "mit licen"}
    | {keyword for _, keyword, _ in SHORT if keyword != "ms pl"}
    | {keyword for _, _, keyword, _ in OTHERS if keyword != "non"}
    | {keyword for _, keyword, _ in NOTICES}
    | {"license", "licence", "commercial", "noncommercial", "spdx", "pl", "lgplv", "gplversion"}
    | {name + v + n for name in ("gpl", "lgpl", "agpl", "epl", "mpl", "ofl") for v in ("", "v") for n in "123"}
)


@dataclass(frozen=True)
class Rule:
    """``keywords``: how a word of each match begins, and what each match holds besides."""

    label: str
    rank: int
    keywords: tuple[str, ...]
    pattern: str


#: A part of an expression that a match may lack, with groups in it or without.
OPTIONAL = re.compile(r"\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)\?")


def rules() -> list[Rule]:
    """A rule for each name alone, and for each way of granting with each name, and for what an
    SPDX line says."""
    found = []
    names = [(label, *rest) for label, rest in NAMES.items()] + SHORT
    for label, keyword, name in names:
        needs = (keyword, "licen") if "licen[cs]e" in OPTIONAL.sub("", name) else (keyword,)
        found.append(Rule(label, NAME, needs, rf"(?<= ){name}(?= )"))
        for verb, grant in GRANTS.items():
            found.append(Rule(label, GRANT, (keyword, verb), rf"(?<= ){grant} {name}(?= )"))
    found += [
        Rule(label, GRANT, ("spdx",), rf"(?<= )spdx licen[cs]e identifier {name}(?: only| or later)?(?= )")
        for label, name in SPDX.items()
    ]
    found += [
        Rule(label, rank, (keyword,), rf"(?<= ){pattern}(?= )")
        for label, rank, keyword, pattern in OTHERS
    ]
    found += [
        Rule(label, GRANT, (keyword,), rf"(?<= ){pattern}(?= )") for label, keyword, pattern in NOTICES
    ]
    return found


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; NULL has none.

    Two characters beyond ASCII would be lower-cased into ASCII letters, and are replaced by
    other letters before that.
    """
    kept = F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı"))
    parts = F.split(F.lower(F.coalesce(kept, F.lit(""))), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def _starts(words: Column, phrase: tuple[str, ...]) -> Column:
    """Where the phrase's words stand one after another."""
    last = F.size(words) - len(phrase)
    here = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(
        here,
        lambda i: reduce(
            lambda a, b: a & b, [F.get(words, i + k) == w for k, w in enumerate(phrase)]
        ),
    )


def _running(numbers: Column) -> Column:
    """Sums up to each element: each step adds the sum that lies 1, 2, 4, ... places before."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)))).cast("int"))

    def add(sums: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - back), F.lit(0)))

    return F.aggregate(steps, numbers, add)


def _by_keyword(table: list[Rule]) -> Column:
    """The rules below the keyword that their matches begin a word with, as one literal.

    It is given as SQL, since a column for each of its thousands of values takes seconds to build.
    """
    below: dict[str, list[Rule]] = {}
    for r in table:
        below.setdefault(r.keywords[0], []).append(r)

    def row(r: Rule) -> str:
        return (
            f"named_struct('rank', {r.rank}, 'label', '{r.label}', "
            f"'needs', '{r.keywords[-1]}', 'pattern', r'{r.pattern}')"
        )

    groups = (
        f"named_struct('keyword', ' {keyword}', 'rules', array({', '.join(map(row, found))}))"
        for keyword, found in below.items()
    )
    return F.expr(f"array({', '.join(groups)})")


def _detections(joined: Column, table: list[Rule]) -> Column:
    """Start, end, rank and label of all matches of the rules whose keywords the text has."""
    begun = F.filter(_by_keyword(table), lambda g: F.contains(joined, g["keyword"]))
    tried = F.filter(
        F.flatten(F.transform(begun, lambda g: g["rules"])), lambda r: F.contains(joined, r["needs"])
    )

    def find(r: Column) -> Column:
        matches = F.regexp_extract_all(joined, r["pattern"], F.lit(0))
        return F.struct(*(r[k].alias(k) for k in ("rank", "label", "pattern")), matches.alias("found"))

    def cut(r: Column) -> Column:
        between = F.split(joined, r["pattern"], -1)
        return F.struct(*(r[k].alias(k) for k in ("rank", "label", "found")), between.alias("between"))

    def lengths(c: Column) -> Column:
        """Of what stands before each match and of the match itself, in turn."""
        of_match = F.transform(c["found"], F.length)
        pairs = F.zip_with(
            F.slice(c["between"], 1, F.size(c["found"])), of_match, lambda x, n: F.array(F.length(x), n)
        )
        return F.struct(c["rank"].alias("rank"), c["label"].alias("label"), _running(F.flatten(pairs)).alias("ends"))

    def spans(c: Column) -> Column:
        """A match lies between two ends that follow each other."""
        return F.transform(
            F.when(F.size(c["ends"]) > 0, F.sequence(F.lit(0), F.size(c["ends"]) - 2, F.lit(2))).otherwise(
                F.array().cast("array<int>")
            ),
            lambda i: F.struct(
                F.get(c["ends"], i).alias("start"),
                (-F.get(c["ends"], i + 1)).alias("end"),
                c["rank"].alias("rank"),
                c["label"].alias("label"),
            ),
        )

    # One transform for each step: what a lambda takes from outside is worked out for every element.
    fitting = F.filter(F.transform(tried, find), lambda r: F.size(r["found"]) > 0)
    return F.array_sort(F.flatten(F.transform(F.transform(F.transform(fitting, cut), lengths), spans)))


def _outermost(spans: Column) -> Column:
    """Labels and confidence of the detections that lie in none of the same or a better rank.

    The spans come by start, the longer first (``end`` is negative for that), then by rank; so
    a span lies within an earlier one if that one's end is not before its own, and it is enough
    to carry the greatest end of every rank along.
    """
    none = F.lit(-1)
    begin = F.struct(
        none.alias("e0"), none.alias("e1"), none.alias("e2"),
        F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"),
    )

    def step(sofar: Column, s: Column) -> Column:
        end, rank = -s["end"], s["rank"]
        ends = [sofar["e0"], F.greatest(sofar["e0"], sofar["e1"])]
        ends.append(F.greatest(ends[1], sofar["e2"]))
        reach = F.when(rank == GRANT, ends[0]).when(rank == NAME, ends[1]).otherwise(ends[2])
        kept = reach < end
        weight = F.get(F.array(*map(F.lit, CONFIDENCE)), rank)
        return F.struct(
            *(
                F.when(rank == k, F.greatest(sofar[f"e{k}"], end)).otherwise(sofar[f"e{k}"]).alias(f"e{k}")
                for k in (GRANT, NAME, HINT)
            ),
            F.when(kept, F.array_union(sofar["labels"], F.array(s["label"])))
            .otherwise(sofar["labels"])
            .alias("labels"),
            F.when(kept, F.greatest(sofar["score"], weight)).otherwise(sofar["score"]).alias("score"),
        )

    return F.aggregate(spans, begin, step, lambda x: F.struct(x["labels"], x["score"]))


def scan_licenses(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels`` and ``score``, a row for each row.

    ``n_base`` counts the places of the base phrases, ``first_word`` and ``last_word`` are their
    smallest and largest start, NULL if there are none. NULL, empty texts and texts without a
    detection have no labels (an empty string) and score 0.
    """
    cut = docs.select(F.col(doc).alias("doc_id"), words_of(F.col(text)).alias("words"))
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    gate = F.arrays_overlap("words", F.array(*map(F.lit, GATES)))
    # The text as one string again, only where some rule may be tried.
    gated = cut.select("*", F.when(gate, joined).alias("joined"))
    nowhere = F.array().cast("array<int>")
    places = {
        label: F.when(F.col("joined").contains(f" {' '.join(phrase)} "), _starts(F.col("words"), phrase))
        for label, phrase in BASE_PHRASES.items()
    }
    found = gated.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        *(F.coalesce(p, nowhere).alias(f"at {label}") for label, p in places.items()),
        F.when(F.col("joined").isNotNull(), _outermost(_detections(F.col("joined"), rules()))).alias("own"),
    )
    starts = F.concat(*(F.col(f"`at {label}`") for label in BASE_PHRASES))
    base = F.filter(
        F.array(
            *(F.when(F.size(f"at {label}") > 0, F.lit(label)) for label in BASE_PHRASES)
        ),
        lambda x: x.isNotNull(),
    )
    empty = F.array().cast("array<string>")
    counted = found.select(
        "doc_id", "n_words", starts.alias("starts"), base.alias("base"),
        F.coalesce("own.labels", empty).alias("own"), F.coalesce("own.score", F.lit(0.0)).alias("score"),
    )
    some_base = F.size("base") > 0
    return counted.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "own")), ",").alias("labels"),
        F.when(some_base, F.greatest("score", F.lit(CONFIDENCE[NAME]))).otherwise(F.col("score")).alias("score"),
    )
