"""Licence signatures over texts whose words are lower-case and joined by single spaces.

Each rule is (label, priority, confidence, keyword, pattern), in order.  Every match of a
pattern holds its keyword, or one of those that | separates, inside one word.  Priorities:
40 and more the wording of a licence, 30 identifiers and addresses, 20 notices that name a
licence, 10 names alone, below that hints.  A name with a version ranks above its family's.

Fixed values: names, identifiers and wordings of public licences.
"""

from __future__ import annotations

UNDER = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|shared|issued|offered)(?: to you)? under (?:the |a )?(?:terms of (?:the )?)?"

TEXTS = [
    ("mit", 40, 1.0, "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 35, 0.9, "permission", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", 34, 0.8, "warranty", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit-0", 41, 1.0, "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", 37, 0.9, "advertising", r"the name of the x consortium shall not be used in advertising"),
    ("isc", 40, 1.0, "permission", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", 42, 1.0, "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("hpnd", 38, 0.9, "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd", 35, 0.9, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 34, 0.7, "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-2-clause", 36, 0.9, "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 37, 0.95, "endorse", r"neither the name of .{1,80}? may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", 36, 0.9, "endorse", r"the names? of (?:the )?(?:author|authors|copyright holders?|contributors) may not be used to endorse or promote products"),
    ("bsd-4-clause", 38, 0.95, "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", 40, 1.0, "apache", r"you may not use this file except in compliance with the license .{0,60}?apache org licenses license 2 0"),
    ("apache-2.0", 39, 1.0, "apache", r"(?:www )?apache org licenses license 2 0"),
    ("apache-2.0", 35, 0.7, "compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", 34, 0.8, "licensor", r"unless required by applicable law or agreed to in writing licensor provides the work"),
    ("apache-2.0", 33, 0.6, "applicable", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-1.1", 38, 0.9, "apache", r"this product includes software developed by the apache software foundation"),
    ("gpl", 40, 1.0, "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 33, 0.8, "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", 32, 0.8, "received", r"you should have received a copy of the gnu general public license"),
    ("gpl-2.0", 41, 1.0, "published", r"gnu general public license as published by the free software foundation (?:either )?version 2"),
    ("gpl-3.0", 41, 1.0, "published", r"gnu general public license as published by the free software foundation (?:either )?version 3"),
    ("gpl-2.0", 38, 0.9, "1991", r"gnu general public license version 2 june 1991"),
    ("gpl-3.0", 38, 0.9, "2007", r"gnu general public license version 3 29 june 2007"),
    ("lgpl", 41, 1.0, "published", r"gnu (?:lesser|library) general public license as published by the free software foundation"),
    ("lgpl-2.1", 42, 1.0, "published", r"gnu lesser general public license as published by the free software foundation (?:either )?version 2 1"),
    ("lgpl-3.0", 42, 1.0, "published", r"gnu lesser general public license as published by the free software foundation (?:either )?version 3"),
    ("lgpl", 32, 0.8, "received", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", 41, 1.0, "affero", r"gnu affero general public license as published by the free software foundation"),
    ("agpl-3.0", 42, 1.0, "affero", r"gnu affero general public license as published by the free software foundation (?:either )?version 3"),
    ("agpl", 32, 0.8, "affero", r"you should have received a copy of the gnu affero general public license"),
    ("gfdl", 40, 1.0, "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", 40, 1.0, "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", 40, 1.0, "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", 36, 0.9, "mpl", r"if a copy of the mpl was not distributed with this file"),
    ("cddl-1.0", 40, 1.0, "distribution", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl-1.0", 40, 1.0, "eclipse", r"made available under the terms of the eclipse public license v(?:ersion)? ?1 0"),
    ("epl-2.0", 40, 1.0, "eclipse", r"made available under the terms of the eclipse public license v(?:ersion)? ?2 0"),
    ("eupl", 40, 1.0, "eupl", r"licensed under the eupl(?: version)? 1 [012]"),
    ("boost", 40, 1.0, "boost", r"distributed under the boost software license version 1 0"),
    ("boost", 39, 1.0, "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("zlib", 40, 1.0, "warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", 36, 0.8, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("artistic", 36, 0.8, "artistic", r"you can redistribute it and or modify it under the (?:terms of the )?artistic license"),
    ("perl", 40, 1.0, "perl", r"under the same terms as perl itself"),
    ("unlicense", 40, 1.0, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", 40, 1.0, "want", r"do what the f[a-z]* you want to public license"),
    ("beerware", 40, 1.0, "beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("openssl", 40, 1.0, "openssl", r"this product includes software developed by the openssl project"),
    ("sqlite", 40, 1.0, "blessing", r"the author disclaims copyright to this source code in place of a legal notice here is a blessing"),
    ("postgresql", 39, 0.9, "agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("ncsa", 39, 0.9, "illinois", r"university of illinois ncsa open source license"),
    ("ofl-1.1", 40, 1.0, "font", r"this font software is licensed under the sil open font license version 1 1"),
    ("python", 39, 0.9, "python", r"python software foundation license version 2"),
    ("unicode", 38, 0.9, "unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("cc0-1.0", 40, 1.0, "waived", r"to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights"),
    ("cc-by", 39, 0.9, "attribution", r"this work is licensed under (?:a |the )?creative commons attribution [1234] [05]"),
    ("cc-by-sa", 39, 0.9, "attribution", r"this work is licensed under (?:a |the )?creative commons attribution share ?alike [1234] [05]"),
    ("commons-clause", 40, 1.0, "licensor", r"the software is provided to you by the licensor under the license as defined below subject to the following condition"),
    ("sspl-1.0", 38, 0.9, "server", r"server side public license version 1 october 16 2018"),
    ("elastic-2.0", 38, 0.9, "elastic", r"by using the software you agree to all of the terms and conditions below elastic license"),
]

IDENTIFIERS = [
    ("mit", 30, 1.0, "spdx", r"spdx license identifier mit"),
    ("mit-0", 31, 1.0, "spdx", r"spdx license identifier mit 0"),
    ("x11", 30, 1.0, "spdx", r"spdx license identifier x11"),
    ("apache-1.1", 31, 1.0, "spdx", r"spdx license identifier apache 1 1"),
    ("apache-2.0", 31, 1.0, "spdx", r"spdx license identifier apache 2 0"),
    ("bsd-1-clause", 31, 1.0, "spdx", r"spdx license identifier bsd 1 clause"),
    ("bsd-2-clause", 31, 1.0, "spdx", r"spdx license identifier bsd 2 clause(?: patent| views)?"),
    ("bsd-3-clause", 31, 1.0, "spdx", r"spdx license identifier bsd 3 clause(?: clear| lbnl)?"),
    ("bsd-4-clause", 31, 1.0, "spdx", r"spdx license identifier bsd 4 clause(?: uc)?"),
    ("0bsd", 31, 1.0, "spdx", r"spdx license identifier 0bsd"),
    ("isc", 30, 1.0, "spdx", r"spdx license identifier isc"),
    ("gpl-1.0", 31, 1.0, "spdx", r"spdx license identifier gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", 31, 1.0, "spdx", r"spdx license identifier gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", 31, 1.0, "spdx", r"spdx license identifier gpl 3 0(?: only| or later)?"),
    ("lgpl-2.0", 31, 1.0, "spdx", r"spdx license identifier lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", 31, 1.0, "spdx", r"spdx license identifier lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", 31, 1.0, "spdx", r"spdx license identifier lgpl 3 0(?: only| or later)?"),
    ("agpl-3.0", 31, 1.0, "spdx", r"spdx license identifier agpl 3 0(?: only| or later)?"),
    ("gfdl", 31, 1.0, "spdx", r"spdx license identifier gfdl 1 [123](?: only| or later| invariants| no invariants)*"),
    ("mpl-1.1", 31, 1.0, "spdx", r"spdx license identifier mpl 1 1"),
    ("mpl-2.0", 31, 1.0, "spdx", r"spdx license identifier mpl 2 0(?: no copyleft exception)?"),
    ("epl-1.0", 31, 1.0, "spdx", r"spdx license identifier epl 1 0"),
    ("epl-2.0", 31, 1.0, "spdx", r"spdx license identifier epl 2 0"),
    ("cddl-1.0", 31, 1.0, "spdx", r"spdx license identifier cddl 1 [01]"),
    ("eupl", 31, 1.0, "spdx", r"spdx license identifier eupl 1 [012]"),
    ("osl-3.0", 31, 1.0, "spdx", r"spdx license identifier osl 3 0"),
    ("afl-3.0", 31, 1.0, "spdx", r"spdx license identifier afl 3 0"),
    ("artistic-2.0", 31, 1.0, "spdx", r"spdx license identifier artistic 2 0"),
    ("artistic", 31, 1.0, "spdx", r"spdx license identifier artistic 1 0(?: perl| cl8)?"),
    ("zlib", 30, 1.0, "spdx", r"spdx license identifier zlib"),
    ("libpng", 30, 1.0, "spdx", r"spdx license identifier libpng(?: 2 0)?"),
    ("boost", 31, 1.0, "spdx", r"spdx license identifier bsl 1 0"),
    ("busl-1.1", 31, 1.0, "spdx", r"spdx license identifier busl 1 1"),
    ("python", 31, 1.0, "spdx", r"spdx license identifier (?:psf|python) 2 0(?: 1)?"),
    ("ruby", 30, 1.0, "spdx", r"spdx license identifier ruby"),
    ("php", 31, 1.0, "spdx", r"spdx license identifier php 3 01?"),
    ("unlicense", 30, 1.0, "spdx", r"spdx license identifier unlicense"),
    ("wtfpl", 30, 1.0, "spdx", r"spdx license identifier wtfpl"),
    ("ms-pl", 30, 1.0, "spdx", r"spdx license identifier ms pl"),
    ("ms-rl", 30, 1.0, "spdx", r"spdx license identifier ms rl"),
    ("ncsa", 30, 1.0, "spdx", r"spdx license identifier ncsa"),
    ("openssl", 30, 1.0, "spdx", r"spdx license identifier openssl"),
    ("curl", 30, 1.0, "spdx", r"spdx license identifier curl"),
    ("sqlite", 30, 1.0, "spdx", r"spdx license identifier blessing"),
    ("postgresql", 30, 1.0, "spdx", r"spdx license identifier postgresql"),
    ("w3c", 30, 1.0, "spdx", r"spdx license identifier w3c(?: 1998[0-9]*| 2015[0-9]*)?"),
    ("ofl-1.1", 31, 1.0, "spdx", r"spdx license identifier ofl 1 1(?: rfn| no rfn)?"),
    ("vim", 30, 1.0, "spdx", r"spdx license identifier vim"),
    ("unicode", 30, 1.0, "spdx", r"spdx license identifier unicode (?:dfs 201[56]|tou|3 0)"),
    ("icu", 30, 1.0, "spdx", r"spdx license identifier icu"),
    ("cecill", 31, 1.0, "spdx", r"spdx license identifier cecill (?:[12] [01]|b|c)"),
    ("sspl-1.0", 31, 1.0, "spdx", r"spdx license identifier sspl 1 0"),
    ("elastic-2.0", 31, 1.0, "spdx", r"spdx license identifier elastic 2 0"),
    ("polyform", 31, 1.0, "spdx", r"spdx license identifier polyform (?:noncommercial|small business) 1 0 0"),
    ("odbl-1.0", 31, 1.0, "spdx", r"spdx license identifier odbl 1 0"),
    ("odc-by", 31, 1.0, "spdx", r"spdx license identifier odc by 1 0"),
    ("pddl-1.0", 31, 1.0, "spdx", r"spdx license identifier pddl 1 0"),
    ("cc0-1.0", 31, 1.0, "spdx", r"spdx license identifier cc0 1 0"),
    ("cc-by", 31, 1.0, "spdx", r"spdx license identifier cc by [1234] [05]"),
    ("cc-by-sa", 31, 1.0, "spdx", r"spdx license identifier cc by sa [1234] [05]"),
    ("cc-by-nd", 31, 1.0, "spdx", r"spdx license identifier cc by nd [1234] [05]"),
    ("cc-by-nc", 31, 1.0, "spdx", r"spdx license identifier cc by nc [1234] [05]"),
    ("cc-by-nc-sa", 31, 1.0, "spdx", r"spdx license identifier cc by nc sa [1234] [05]"),
    ("cc-by-nc-nd", 31, 1.0, "spdx", r"spdx license identifier cc by nc nd [1234] [05]"),
    ("spdx", 7, 0.5, "spdx", r"spdx license identifier"),
    ("mit", 30, 0.8, "opensource", r"opensource org licenses mit"),
    ("bsd-2-clause", 31, 0.8, "opensource", r"opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", 31, 0.8, "opensource", r"opensource org licenses bsd 3 clause"),
    ("isc", 30, 0.8, "opensource", r"opensource org licenses isc"),
    ("artistic-2.0", 31, 0.8, "opensource", r"opensource org licenses artistic 2 0"),
    ("gpl", 30, 0.8, "gnu", r"(?:www )?gnu org licenses(?: old licenses)? gpl"),
    ("gpl-2.0", 31, 0.9, "gnu", r"(?:www )?gnu org licenses(?: old licenses)? gpl 2 0"),
    ("gpl-3.0", 31, 0.9, "gnu", r"(?:www )?gnu org licenses gpl 3 0"),
    ("lgpl", 30, 0.8, "gnu", r"(?:www )?gnu org licenses(?: old licenses)? lgpl"),
    ("lgpl-2.1", 31, 0.9, "gnu", r"(?:www )?gnu org licenses(?: old licenses)? lgpl 2 1"),
    ("lgpl-3.0", 31, 0.9, "gnu", r"(?:www )?gnu org licenses lgpl 3 0"),
    ("agpl", 30, 0.8, "gnu", r"(?:www )?gnu org licenses agpl(?: 3 0)?"),
    ("gfdl", 30, 0.8, "gnu", r"(?:www )?gnu org licenses fdl(?: 1 [123])?"),
    ("mpl", 30, 0.8, "mozilla", r"(?:www )?mozilla org mpl"),
    ("mpl-2.0", 31, 0.9, "mozilla", r"(?:www )?mozilla org mpl 2 0"),
    ("epl", 30, 0.8, "eclipse", r"(?:www )?eclipse org legal epl"),
    ("epl-1.0", 31, 0.9, "eclipse", r"(?:www )?eclipse org legal epl v10(?: html)?"),
    ("epl-2.0", 31, 0.9, "eclipse", r"(?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?"),
    ("boost", 30, 0.9, "boost", r"(?:www )?boost org license 1 0 txt"),
    ("unlicense", 30, 0.9, "unlicense", r"unlicense org"),
    ("wtfpl", 30, 0.9, "wtfpl", r"(?:www )?wtfpl net"),
    ("ofl-1.1", 30, 0.8, "sil", r"scripts sil org ofl"),
    ("cc0-1.0", 40, 1.0, "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", 30, 0.8, "creativecommons", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by", 30, 0.9, "creativecommons", r"creativecommons org licenses by [1234] [05]"),
    ("cc-by-sa", 30, 0.9, "creativecommons", r"creativecommons org licenses by sa [1234] [05]"),
    ("cc-by-nc", 30, 0.9, "creativecommons", r"creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nd", 30, 0.9, "creativecommons", r"creativecommons org licenses by nd [1234] [05]"),
    ("cc-by-nc-sa", 30, 0.9, "creativecommons", r"creativecommons org licenses by nc sa [1234] [05]"),
    ("cc-by-nc-nd", 30, 0.9, "creativecommons", r"creativecommons org licenses by nc nd [1234] [05]"),
]

NOTICES = [
    ("mit", 20, 0.95, "mit|expat", UNDER + r"(?:mit|expat|x11 mit)(?: open source)?(?: licen[sc]e)?"),
    ("mit-0", 21, 0.95, "attribution", UNDER + r"mit no attribution(?: licen[sc]e)?"),
    ("apache", 20, 0.95, "apache", UNDER + r"apache(?: software)?(?: licen[sc]e)?"),
    ("apache-2.0", 21, 0.95, "apache", UNDER + r"apache(?: software)?(?: licen[sc]e)?(?: version)? ?(?:v2|2)(?: 0)?(?: licen[sc]e)?"),
    ("bsd", 20, 0.95, "bsd", UNDER + r"(?:modified |berkeley )?bsd(?: style)?(?: licen[sc]e)?"),
    ("bsd-2-clause", 21, 0.95, "bsd", UNDER + r"(?:simplified bsd|freebsd|bsd (?:2|two) clause|(?:2|two) clause bsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", 21, 0.95, "bsd", UNDER + r"(?:new bsd|revised bsd|bsd (?:3|three) clause|(?:3|three) clause bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", 21, 0.95, "bsd", UNDER + r"(?:original bsd|bsd (?:4|four) clause|(?:4|four) clause bsd)(?: licen[sc]e)?"),
    ("isc", 20, 0.95, "isc", UNDER + r"isc(?: licen[sc]e)?"),
    ("gpl", 20, 0.95, "gpl|gnu", UNDER + r"(?:gpl|gnu gpl|gnu general public)(?: licen[sc]e)?"),
    ("gpl-2.0", 21, 0.95, "gpl|gnu", UNDER + r"(?:gpl|gnu gpl|gnu general public license)(?: version)? ?(?:v2|2)(?: 0)?(?: only| or later| or any later version)?"),
    ("gpl-3.0", 21, 0.95, "gpl|gnu", UNDER + r"(?:gpl|gnu gpl|gnu general public license)(?: version)? ?(?:v3|3)(?: 0)?(?: only| or later| or any later version)?"),
    ("lgpl", 20, 0.95, "lgpl|lesser|library", UNDER + r"(?:gnu )?(?:lgpl|(?:lesser|library) general public)(?: licen[sc]e)?"),
    ("lgpl-2.1", 21, 0.95, "lgpl|lesser", UNDER + r"(?:gnu )?(?:lgpl|lesser general public license)(?: version)? ?(?:v2|2) 1(?: only| or later)?"),
    ("lgpl-3.0", 21, 0.95, "lgpl|lesser", UNDER + r"(?:gnu )?(?:lgpl|lesser general public license)(?: version)? ?(?:v3|3)(?: 0)?(?: only| or later)?"),
    ("agpl", 20, 0.95, "agpl|affero", UNDER + r"(?:gnu )?(?:agpl|affero general public)(?: licen[sc]e)?"),
    ("agpl-3.0", 21, 0.95, "agpl|affero", UNDER + r"(?:gnu )?(?:agpl|affero general public license)(?: version)? ?(?:v3|3)(?: 0)?(?: only| or later)?"),
    ("gfdl", 20, 0.95, "gfdl|documentation", UNDER + r"(?:gfdl|(?:gnu )?free documentation)(?: licen[sc]e)?(?: version)?(?: 1 [123])?"),
    ("mpl", 20, 0.95, "mpl|mozilla", UNDER + r"(?:mpl|mozilla public)(?: licen[sc]e)?"),
    ("mpl-2.0", 21, 0.95, "mpl|mozilla", UNDER + r"(?:mpl|mozilla public license)(?: version)? ?(?:v2|2)(?: 0)?"),
    ("epl", 20, 0.95, "epl|eclipse", UNDER + r"(?:epl|eclipse public)(?: licen[sc]e)?"),
    ("epl-2.0", 21, 0.95, "epl|eclipse", UNDER + r"(?:epl|eclipse public license)(?: version)? ?(?:v2|2)(?: 0)?"),
    ("cddl-1.0", 20, 0.95, "cddl|development", UNDER + r"(?:cddl|common development and distribution)(?: licen[sc]e)?(?: 1 [01])?"),
    ("cpl-1.0", 20, 0.95, "common", UNDER + r"common public licen[sc]e(?: version)?(?: 1 0)?"),
    ("eupl", 20, 0.95, "eupl|european", UNDER + r"(?:eupl|european union public)(?: licen[sc]e)?(?: 1 [012])?"),
    ("artistic", 20, 0.95, "artistic", UNDER + r"(?:perl )?artistic(?: licen[sc]e)?(?: 1 0)?"),
    ("artistic-2.0", 21, 0.95, "artistic", UNDER + r"artistic(?: licen[sc]e)?(?: version)? 2(?: 0)?"),
    ("zlib", 20, 0.95, "zlib", UNDER + r"zlib(?: libpng)?(?: licen[sc]e)?"),
    ("libpng", 20, 0.95, "png", UNDER + r"(?:lib)?png(?: reference library)?(?: licen[sc]e)?"),
    ("boost", 20, 0.95, "boost", UNDER + r"boost(?: software)?(?: licen[sc]e)?"),
    ("python", 20, 0.95, "python|psf", UNDER + r"(?:python software foundation|psf|python)(?: licen[sc]e)?"),
    ("ruby", 20, 0.95, "ruby", UNDER + r"ruby(?: licen[sc]e)?"),
    ("php", 20, 0.95, "php", UNDER + r"php(?: licen[sc]e)?(?: version)?(?: 3 01?)?"),
    ("unlicense", 20, 0.95, "unlicense", UNDER + r"unlicense"),
    ("wtfpl", 20, 0.95, "wtfpl", UNDER + r"wtfpl(?: version)?(?: 2)?"),
    ("beerware", 20, 0.95, "beer", UNDER + r"beer ?ware(?: licen[sc]e)?"),
    ("ms-pl", 20, 0.95, "microsoft", UNDER + r"microsoft public(?: licen[sc]e)?"),
    ("ms-rl", 20, 0.95, "microsoft", UNDER + r"microsoft reciprocal(?: licen[sc]e)?"),
    ("ncsa", 20, 0.95, "ncsa", UNDER + r"(?:university of illinois )?ncsa(?: open source)?(?: licen[sc]e)?"),
    ("openssl", 20, 0.95, "openssl", UNDER + r"openssl(?: licen[sc]e)?"),
    ("curl", 20, 0.95, "curl", UNDER + r"curl(?: licen[sc]e)?"),
    ("postgresql", 20, 0.95, "postgresql", UNDER + r"postgresql(?: licen[sc]e)?"),
    ("w3c", 20, 0.95, "w3c", UNDER + r"w3c(?: software)?(?: licen[sc]e)?"),
    ("ofl-1.1", 20, 0.95, "ofl|font", UNDER + r"(?:ofl|(?:sil )?open font)(?: licen[sc]e)?(?: version)?(?: 1 1)?"),
    ("cecill", 20, 0.95, "cecill", UNDER + r"cecill(?: b| c)?(?: licen[sc]e)?"),
    ("sspl-1.0", 20, 0.95, "sspl|server", UNDER + r"(?:sspl|server side public)(?: licen[sc]e)?"),
    ("busl-1.1", 20, 0.95, "busl|business", UNDER + r"(?:busl|business source)(?: licen[sc]e)?(?: 1 1)?"),
    ("elastic-2.0", 20, 0.95, "elastic", UNDER + r"elastic(?: licen[sc]e)?(?: 2 0)?"),
    ("polyform", 20, 0.95, "polyform", UNDER + r"polyform (?:noncommercial|small business|shield|strict)(?: licen[sc]e)?"),
    ("odbl-1.0", 20, 0.95, "odbl|database", UNDER + r"(?:odbl|open database)(?: licen[sc]e)?(?: 1 0)?"),
    ("odc-by", 20, 0.95, "odc|attribution", UNDER + r"(?:odc by|open data commons attribution)(?: licen[sc]e)?(?: 1 0)?"),
    ("pddl-1.0", 20, 0.95, "pddl|dedication", UNDER + r"(?:pddl|public domain dedication)(?: and)?(?: licen[sc]e)?"),
    ("cc0-1.0", 21, 0.95, "cc0|zero", UNDER + r"(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?(?: licen[sc]e)?"),
    ("cc-by", 20, 0.95, "cc|commons", UNDER + r"(?:cc by|creative commons attribution)(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)?"),
    ("cc-by-sa", 21, 0.95, "cc|commons", UNDER + r"(?:cc by sa|creative commons attribution share ?alike)(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)?"),
    ("cc-by-nd", 21, 0.95, "cc|commons", UNDER + r"(?:cc by nd|creative commons attribution no ?derivatives)(?: [1234] [05])?(?: international| unported)?(?: licen[sc]e)?"),
    ("cc-by-nc", 21, 0.95, "cc|commons", UNDER + r"(?:cc by nc|creative commons attribution non ?commercial)(?: [1234] [05])?(?: international| unported)?(?: licen[sc]e)?"),
    ("cc-by-nc-sa", 22, 0.95, "cc|commons", UNDER + r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1234] [05])?(?: international| unported)?(?: licen[sc]e)?"),
    ("cc-by-nc-nd", 22, 0.95, "cc|commons", UNDER + r"(?:cc by nc nd|creative commons attribution non ?commercial no ?derivatives)(?: [1234] [05])?(?: international| unported)?(?: licen[sc]e)?"),
    ("llama", 20, 0.95, "llama", UNDER + r"llama [23](?: [0-9])? community(?: licen[sc]e)?"),
    ("openrail", 20, 0.95, "rail", UNDER + r"(?:bigscience |bigcode )?open ?rail(?: m)?(?: licen[sc]e)?"),
    ("public-domain", 30, 0.8, "domain", r"(?:released|placed|dedicated|put|is|are) (?:in|into|to) the public domain"),
    ("proprietary", 30, 0.8, "proprietary", r"(?:confidential and proprietary|proprietary and confidential|proprietary software|proprietary license)"),
    ("proprietary", 29, 0.8, "prohibited", r"(?:unauthorized )?(?:copying|use|reproduction|distribution)(?: or distribution)? of this (?:file|software|document|material) .{0,60}?is strictly prohibited"),
    ("all-rights-reserved", 20, 0.6, "reserved", r"all rights reserved"),
]

NAMES = [
    ("mit", 10, 0.8, "mit|expat", r"(?:the )?(?:mit|expat) (?:open source )?licen[sc]e"),
    ("x11", 10, 0.8, "x11", r"(?:the )?x11 licen[sc]e"),
    ("apache", 10, 0.8, "apache", r"(?:the )?apache (?:software )?licen[sc]e"),
    ("apache-2.0", 13, 0.85, "apache", r"(?:the )?apache (?:software )?(?:licen[sc]e )?(?:version )?(?:v2|2 0)"),
    ("apache-1.1", 13, 0.85, "apache", r"(?:the )?apache (?:software )?licen[sc]e (?:version )?1 1"),
    ("bsd", 10, 0.8, "bsd", r"(?:the )?(?:modified |berkeley )?bsd (?:style )?licen[sc]e"),
    ("bsd-2-clause", 11, 0.8, "bsd", r"(?:simplified bsd|freebsd|bsd (?:2|two) clause|(?:2|two) clause bsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", 11, 0.8, "bsd", r"(?:new bsd|revised bsd|bsd (?:3|three) clause|(?:3|three) clause bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", 11, 0.8, "bsd", r"(?:original bsd|bsd (?:4|four) clause|(?:4|four) clause bsd)(?: licen[sc]e)?"),
    ("0bsd", 11, 0.8, "bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)(?: licen[sc]e)?"),
    ("isc", 10, 0.8, "isc", r"(?:the )?isc licen[sc]e"),
    ("gpl", 10, 0.8, "general", r"(?:the )?gnu general public licen[sc]e"),
    ("gpl", 9, 0.7, "gnu", r"(?:the )?gnu gpl"),
    ("gpl-1.0", 13, 0.85, "gpl|general", r"(?:the )?(?:gnu )?(?:gpl|general public license)(?: version)? ?(?:v1|1)(?: 0)?"),
    ("gpl-2.0", 13, 0.85, "gpl|general", r"(?:the )?(?:gnu )?(?:gpl|general public license)(?: version)? ?(?:v2|2)(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", 13, 0.85, "gpl|general", r"(?:the )?(?:gnu )?(?:gpl|general public license)(?: version)? ?(?:v3|3)(?: 0)?(?: only| or later)?"),
    ("lgpl", 14, 0.8, "lesser|library", r"(?:the )?(?:gnu )?(?:lesser|library) general public licen[sc]e"),
    ("lgpl-2.0", 15, 0.85, "lgpl|library", r"(?:the )?(?:gnu )?(?:lgpl|library general public license)(?: version)? ?(?:v2|2)(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", 15, 0.85, "lgpl|lesser", r"(?:the )?(?:gnu )?(?:lgpl|lesser general public license)(?: version)? ?(?:v2|2) 1(?: only| or later)?"),
    ("lgpl-3.0", 15, 0.85, "lgpl|lesser", r"(?:the )?(?:gnu )?(?:lgpl|lesser general public license)(?: version)? ?(?:v3|3)(?: 0)?(?: only| or later)?"),
    ("agpl", 14, 0.8, "affero", r"(?:the )?(?:gnu )?affero general public licen[sc]e"),
    ("agpl-3.0", 15, 0.85, "agpl|affero", r"(?:the )?(?:gnu )?(?:agpl|affero general public license)(?: version)? ?(?:v3|3)(?: 0)?(?: only| or later)?"),
    ("gfdl", 10, 0.8, "documentation", r"(?:the )?(?:gnu )?free documentation licen[sc]e"),
    ("mpl", 10, 0.8, "mozilla", r"(?:the )?mozilla public licen[sc]e"),
    ("mpl-1.1", 13, 0.85, "mpl|mozilla", r"(?:the )?(?:mpl|mozilla public license)(?: version)? ?(?:v1|1) 1"),
    ("mpl-2.0", 13, 0.85, "mpl|mozilla", r"(?:the )?(?:mpl|mozilla public license)(?: version)? ?(?:v2|2)(?: 0)?"),
    ("epl", 10, 0.8, "eclipse", r"(?:the )?eclipse public licen[sc]e"),
    ("epl-1.0", 13, 0.85, "epl|eclipse", r"(?:the )?(?:epl|eclipse public license)(?: version)? ?(?:v1|1)(?: 0)?"),
    ("epl-2.0", 13, 0.85, "epl|eclipse", r"(?:the )?(?:epl|eclipse public license)(?: version)? ?(?:v2|2)(?: 0)?"),
    ("cddl-1.0", 10, 0.8, "development", r"common development and distribution licen[sc]e(?: version)?(?: 1 [01])?"),
    ("cpl-1.0", 10, 0.8, "common", r"(?:the )?common public licen[sc]e(?: version)?(?: 1 0)?"),
    ("ipl-1.0", 10, 0.8, "ibm", r"(?:the )?ibm public licen[sc]e(?: version)?(?: 1 0)?"),
    ("eupl", 10, 0.8, "european", r"(?:the )?european union public licen[sc]e(?: 1 [012])?"),
    ("osl-3.0", 10, 0.8, "open", r"(?:the )?open software licen[sc]e(?: version)?(?: 3 0)?"),
    ("afl-3.0", 10, 0.8, "academic", r"(?:the )?academic free licen[sc]e(?: version)?(?: 3 0)?"),
    ("artistic", 10, 0.8, "artistic", r"(?:the )?(?:perl )?artistic licen[sc]e(?: 1 0)?"),
    ("artistic-2.0", 13, 0.85, "artistic", r"(?:the )?artistic licen[sc]e(?: version)? 2(?: 0)?"),
    ("zlib", 10, 0.8, "zlib", r"(?:the )?zlib(?: libpng)? licen[sc]e"),
    ("libpng", 10, 0.8, "png", r"(?:the )?(?:lib)?png (?:reference library )?licen[sc]e"),
    ("boost", 10, 0.8, "boost", r"(?:the )?boost software licen[sc]e(?: version)?(?: 1 0)?"),
    ("python", 10, 0.8, "python|psf", r"(?:the )?(?:python(?: software foundation)?|psf) licen[sc]e(?: agreement)?"),
    ("ruby", 10, 0.8, "ruby", r"(?:the )?ruby licen[sc]e"),
    ("php", 10, 0.8, "php", r"(?:the )?php licen[sc]e(?: version)?(?: 3 01?)?"),
    ("unlicense", 10, 0.8, "unlicense", r"the unlicense"),
    ("wtfpl", 10, 0.8, "wtfpl", r"(?:the )?wtfpl(?: licen[sc]e)?"),
    ("beerware", 10, 0.8, "beer", r"(?:the )?beer ?ware licen[sc]e"),
    ("ms-pl", 10, 0.8, "microsoft", r"(?:the )?microsoft public licen[sc]e"),
    ("ms-rl", 10, 0.8, "microsoft", r"(?:the )?microsoft reciprocal licen[sc]e"),
    ("ncsa", 10, 0.8, "ncsa", r"(?:the )?ncsa (?:open source )?licen[sc]e"),
    ("openssl", 10, 0.8, "openssl", r"(?:the )?openssl licen[sc]e"),
    ("curl", 10, 0.8, "curl", r"(?:the )?curl licen[sc]e"),
    ("sqlite", 10, 0.8, "sqlite", r"(?:the )?sqlite (?:blessing|licen[sc]e)"),
    ("postgresql", 10, 0.8, "postgresql", r"(?:the )?postgresql licen[sc]e"),
    ("w3c", 10, 0.8, "w3c", r"(?:the )?w3c (?:software )?(?:notice and )?licen[sc]e"),
    ("ofl-1.1", 10, 0.8, "font", r"(?:the )?(?:sil )?open font licen[sc]e(?: version)?(?: 1 1)?"),
    ("vim", 10, 0.8, "vim", r"(?:the )?vim licen[sc]e"),
    ("tcl", 10, 0.8, "tcl", r"(?:the )?tcl(?: tk)? licen[sc]e"),
    ("unicode", 10, 0.8, "unicode", r"(?:the )?unicode (?:inc )?licen[sc]e(?: agreement)?"),
    ("icu", 10, 0.8, "icu", r"(?:the )?icu licen[sc]e"),
    ("hpnd", 10, 0.8, "historical", r"historical permission notice and disclaimer"),
    ("ecl-2.0", 10, 0.8, "educational", r"(?:the )?educational community licen[sc]e(?: version)?(?: 2 0)?"),
    ("cecill", 10, 0.8, "cecill", r"(?:the )?cecill(?: b| c)?(?: free software)? licen[sc]e"),
    ("sspl-1.0", 10, 0.8, "server", r"(?:the )?server side public licen[sc]e"),
    ("busl-1.1", 10, 0.8, "business", r"(?:the )?business source licen[sc]e(?: 1 1)?"),
    ("elastic-2.0", 10, 0.8, "elastic", r"(?:the )?elastic licen[sc]e(?: 2 0)?"),
    ("commons-clause", 10, 0.8, "commons", r"(?:the )?commons clause(?: licen[sc]e)?(?: condition)?"),
    ("polyform", 10, 0.8, "polyform", r"(?:the )?polyform (?:noncommercial|small business|shield|strict) licen[sc]e"),
    ("odbl-1.0", 10, 0.8, "database", r"(?:the )?open database licen[sc]e"),
    ("odc-by", 10, 0.8, "attribution", r"open data commons attribution licen[sc]e"),
    ("pddl-1.0", 10, 0.8, "dedication", r"public domain dedication and licen[sc]e"),
    ("cc0-1.0", 11, 0.8, "cc0|zero", r"(?:cc0(?: 1 0)?(?: universal)?|creative commons zero(?: 1 0)?)"),
    ("cc-by", 10, 0.8, "cc|commons", r"(?:cc by [1234] [05]|creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)?)"),
    ("cc-by-sa", 11, 0.8, "cc|commons", r"(?:cc by sa(?: [1234] [05])?|creative commons attribution share ?alike(?: [1234] [05])?)"),
    ("cc-by-nd", 11, 0.8, "cc|commons", r"(?:cc by nd(?: [1234] [05])?|creative commons attribution no ?derivatives(?: [1234] [05])?)"),
    ("cc-by-nc", 11, 0.8, "cc|commons", r"(?:cc by nc(?: [1234] [05])?|creative commons attribution non ?commercial(?: [1234] [05])?)"),
    ("cc-by-nc-sa", 12, 0.8, "cc|commons", r"(?:cc by nc sa(?: [1234] [05])?|creative commons attribution non ?commercial share ?alike(?: [1234] [05])?)"),
    ("cc-by-nc-nd", 12, 0.8, "cc|commons", r"(?:cc by nc nd(?: [1234] [05])?|creative commons attribution non ?commercial no ?derivatives(?: [1234] [05])?)"),
    ("llama", 10, 0.8, "llama", r"llama [23](?: [0-9])? community licen[sc]e(?: agreement)?"),
    ("openrail", 10, 0.8, "rail", r"(?:bigscience |bigcode )?open ?rail(?: m)? licen[sc]e"),
    ("public-domain", 8, 0.4, "domain", r"public domain"),
    ("copyright", 5, 0.3, "copyright", r"(?:c )?copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*"),
    ("no-warranty", 6, 0.3, "warranty", r"without (?:any )?warranty(?: of any kind)?"),
    ("unknown-license", 4, 0.3, "licensed", r"licensed (?:under|to|by|for)"),
    ("unknown-license", 3, 0.2, "license", r"(?:see|read) (?:the )?(?:accompanying )?license(?: file| txt| md)?"),
]


def rules() -> list[tuple[str, int, float, str, str]]:
    """(label, priority, confidence, keyword, pattern), in order."""
    return TEXTS + IDENTIFIERS + NOTICES + NAMES
